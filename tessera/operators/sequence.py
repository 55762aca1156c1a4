"""Numbered label families: holes between consecutive numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import labels as L

#: Holes up to this length are listed one by one, longer ones as a range.
LISTED = 3


def numbered(labels: DataFrame, column: str = "label") -> DataFrame:
    """(prefix, number, width) of the labels that end a sequence."""
    found = L.sequence(L.sanitize(L.strip_status(F.col(column))))
    return labels.select(found.alias("s")).filter("s IS NOT NULL").select("s.prefix", "s.number", "s.width").distinct()


def gaps(labels: DataFrame, column: str = "label") -> DataFrame:
    """(prefix, gap, missing): labels missing between two present ones, in the family's largest width."""
    rows = numbered(labels, column).groupBy("prefix", "number").agg(F.max("width").alias("width"))
    family = Window.partitionBy("prefix")
    rows = rows.withColumn("next", F.lead("number").over(family.orderBy("number"))).withColumn("width", F.max("width").over(family)).filter("next - number > 1")
    name = lambda n: F.concat("prefix", F.lpad(n.cast("string"), F.greatest(F.col("width").cast("int"), F.char_length(n.cast("string"))), F.lit("0")))
    n = F.col("next") - F.col("number") - 1
    single = F.transform(F.sequence(F.col("number") + 1, F.col("next") - 1), lambda k: F.struct(name(k).alias("gap"), F.lit(1).cast("long").alias("missing")))
    whole = F.array(F.struct(F.concat(name(F.col("number") + 1), F.lit(" to "), name(F.col("next") - 1)).alias("gap"), n.alias("missing")))
    return rows.select("prefix", F.explode(F.when(n <= LISTED, single).otherwise(whole)).alias("g")).select("prefix", "g.*")
