"""Predicted failure rates linked to failure modes, and rolled up to blocks and functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import tokens as T


def rates(prediction: DataFrame, unit: str = "per_hour") -> DataFrame:
    """(ref, rate, flagged, kind, pairs) for each designator: the largest rate, and how its duplicates agree."""
    r = N.clean_rate(F.col("pred_fr"), unit)
    shown = lambda c: F.when(T.clean(c) == "", "<blank>").otherwise(T.clean(c))
    rows = prediction.select(T.lookup_key(F.col("pred_ref")).alias("ref"), r["rate"].alias("rate"), r["flagged"].alias("flagged"), F.struct(shown(F.col("pred_ref")).alias("a"), shown(F.col("pred_fr")).alias("b")).alias("pair"))
    out = rows.groupBy("ref").agg(F.max("rate").alias("rate"), F.max("flagged").alias("flagged"), F.count("*").alias("n"), F.count_distinct("rate").alias("values"), F.array_sort(F.collect_set("pair")).alias("p"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("values") == 1, "benign").otherwise("conflict")
    pairs = F.array_join(F.transform("p", lambda x: F.concat(x["a"], F.lit("="), x["b"])), ", ")
    return out.select("ref", "rate", "flagged", kind.alias("kind"), F.when(kind == "conflict", pairs).alias("pairs"))


def link(fmea: DataFrame, rates: DataFrame) -> DataFrame:
    """fmea with ref, instance, part_fr, usage, ratio, mode_fr and notes (codes, in order).

    A blank usage of a part with a rate leaves mode_fr null.
    """
    rows = fmea.withColumn("ref", T.lookup_key(T.cell_base(F.col("cause")))).withColumn("instance", T.cell_instance(F.col("cause")))
    rows = rows.join(rates.select("ref", "rate", "flagged", "kind"), "ref", "left")
    part = F.coalesce("rate", F.lit(0.0))
    used = N.clean_usage(F.col("usage"), part)
    gap = used["gap"]
    usage_n, ratio_n = N.number(F.col("usage")), N.number(F.col("ratio"))
    notes = F.array_compact(F.array(
        F.when(F.col("rate").isNotNull() & F.col("flagged"), "rate unparseable"),
        F.when(F.col("kind") == "conflict", "rate conflict"),
        F.when((F.col("ref") != "") & F.col("rate").isNull(), "not in prediction"),
        F.when(gap, "usage missing").when(usage_n.isNull(), "usage invalid").when(~N.finite(usage_n) | (usage_n <= 0) | (usage_n > 1e6), "usage invalid"),
        F.when(ratio_n.isNull() | ~N.finite(ratio_n) | (ratio_n < 0) | (ratio_n > 10), "ratio invalid"),
    ))
    clean = N.clean_ratio(F.col("ratio"))
    return rows.select(
        *(c for c in fmea.columns if c not in ("usage", "ratio")), "ref", F.when(F.col("instance") == "", F.col("ref")).otherwise(F.col("instance")).alias("instance"),
        part.alias("part_fr"), used["usage"].alias("usage"), clean.alias("ratio"), F.when(~gap, part * used["usage"] * clean).alias("mode_fr"), notes.alias("notes"))


def note_ratio_sums(linked: DataFrame) -> DataFrame:
    """linked with ratio_sum of each instance, and a note where it is not 1."""
    sums = linked.filter("instance <> ''").groupBy("instance").agg(F.sum("ratio").alias("ratio_sum"))
    off = F.abs(F.col("ratio_sum") - 1) > N.RATIO_TOLERANCE
    return linked.join(sums, "instance", "left").select(*linked.columns, "ratio_sum").withColumn("notes", F.when(off, F.array_append("notes", F.lit("ratio sum"))).otherwise(F.col("notes")))


def function_rates(linked: DataFrame, func: str = "func") -> DataFrame:
    """(func, function_fr): sums of what counts; 0 where all is missing, none for a blank function."""
    return linked.filter(T.clean(F.col(func)) != "").groupBy(func).agg(F.coalesce(F.sum("mode_fr"), F.lit(0.0)).alias("function_fr"))


def _prefixes(c: Column) -> Column:
    """A hyphenated id and all it begins with, up to each hyphen."""
    parts = F.split(c, "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))


def children_by_id(rows: DataFrame) -> DataFrame:
    """(row_no, block_row): rows that are no blocks with the block of the longest id they begin with.

    Ids are exploded to their prefixes, so the join is on equality.
    """
    blocks = rows.filter("row_type = 'circuit_block'").groupBy(F.col("fmea_id").alias("id")).agg(F.min("row_no").alias("block_row")).filter("id <> ''")
    kids = rows.filter("row_type <> 'circuit_block'").select("row_no", F.explode(_prefixes(F.col("fmea_id"))).alias("id"))
    return kids.join(blocks, "id").groupBy("row_no").agg(F.max_by("block_row", F.struct(F.char_length("id").alias("n"), (-F.col("block_row")).alias("r"))).alias("block_row"))


def children_by_list(rows: DataFrame) -> DataFrame:
    """(row_no, block_row): rows with the first block that lists their designator."""
    listed = rows.filter("row_type = 'circuit_block'").select(F.col("row_no").alias("block_row"), F.explode(T.split_list(F.col("cause"))).alias("t"))
    first = listed.groupBy(T.lookup_key(F.col("t")).alias("ref")).agg(F.min("block_row").alias("block_row"))
    return rows.filter("row_type <> 'circuit_block'").select("row_no", "ref").join(first, "ref").select("row_no", "block_row")


def roll_up(rows: DataFrame, children: DataFrame, rates: DataFrame) -> DataFrame:
    """(row_no, row_type, block_row, rolled, mode_fr, counted, function_fr).

    A block with children has the sum of theirs, null if all are missing, and is not counted; one
    without, that lists several designators, the sum of their rates; another keeps its own.
    """
    modes = rows.select("row_no", "row_type", "func", "cause", "mode_fr").join(children, "row_no", "left")
    kids = modes.filter("block_row IS NOT NULL").groupBy(F.col("block_row").alias("row_no")).agg(F.sum("mode_fr").alias("sum"), F.count("*").alias("kids"))
    lists = rows.filter("row_type = 'circuit_block'").select("row_no", F.explode(T.split_list(F.col("cause"))).alias("t")).select("row_no", T.lookup_key(F.col("t")).alias("ref"))
    lists = lists.join(rates.select("ref", "rate"), "ref", "left").groupBy("row_no").agg(F.count("*").alias("listed"), F.sum(F.coalesce("rate", F.lit(0.0))).alias("list_sum"))
    all_rows = modes.join(kids, "row_no", "left").join(lists, "row_no", "left")
    block = F.col("row_type") == "circuit_block"
    rolled = block & F.col("kids").isNotNull()
    mode = F.when(rolled, F.col("sum")).when(block & (F.col("listed") > 1), F.col("list_sum")).otherwise(F.col("mode_fr"))
    out = all_rows.select("row_no", "row_type", "func", "block_row", rolled.alias("rolled"), mode.alias("mode_fr"), F.when(~rolled, F.coalesce(mode, F.lit(0.0))).otherwise(0.0).alias("counted"))
    totals = out.filter(T.clean(F.col("func")) != "").groupBy("func").agg(F.sum("counted").alias("function_fr"))
    return out.join(totals, "func", "left").select(*out.columns, "function_fr")
