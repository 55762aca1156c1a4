"""Data-quality rules over token tables; each gives rows of one audit schema, which union by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import numeric as N
from tessera.functions import tokens as T
from tessera.operators import explode as E

COLUMNS = ("refdes", "base", "usage", "expected", "count", "reason_code")


def group_duplicates(group_tokens: DataFrame) -> DataFrame:
    """(token, n, groups) of designators listed more than once; a group that repeats one is named as often."""
    return group_tokens.groupBy("token").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(T.clean(F.col("label")))), ", ").alias("groups")).filter("n > 1")


def bom_duplicates(bom_tokens: DataFrame) -> DataFrame:
    return bom_tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")


def ratio_sums(rows: DataFrame, ref: str, ratio: str, canonical: bool = True) -> DataFrame:
    """(refdes, sum, status) of designators whose failure mode ratios don't add to 1, or hold text.

    Blank cells are passed over; text and infinite ones are left out and flagged.
    """
    key = T.canonical(F.col(ref)) if canonical else T.identity_text(F.col(ref))
    n = N.number(F.col(ratio))
    rows = rows.select(key.alias("refdes"), n.alias("n"), N.finite(n).alias("ok"), (T.clean(F.col(ratio)) == "").alias("blank")).filter("refdes <> '' AND NOT blank")
    sums = rows.groupBy("refdes").agg(F.sum(F.when(F.col("ok"), F.col("n"))).alias("sum"), F.max(~F.col("ok")).alias("bad"))
    status = (
        F.when(F.col("bad") & F.col("sum").isNull(), "Non-numeric ratio cell").when(F.col("bad"), "Non-numeric ratio cell (sum incomplete)")
        .when(F.abs(F.col("sum") - 1) > N.RATIO_TOLERANCE, "FMR != 1.0")
    )
    return sums.select("refdes", "sum", status.alias("status")).filter("status IS NOT NULL")


def _audit(df: DataFrame, **given) -> DataFrame:
    kinds = dict(zip(COLUMNS, ("string", "string", "double", "double", "long", "string"), strict=True))
    return df.select(*((F.col(c) if c not in given else given[c]).cast(kinds[c]).alias(c) for c in COLUMNS))


def _counted(rows: DataFrame) -> DataFrame:
    """rows (row_no, pos, token, usage) with base and count, the distinct tokens of the base.

    The counts are aggregated and joined back, as a distinct count cannot be windowed.
    """
    rows = rows.withColumn("base", T.usage_base(F.col("token")))
    return rows.join(rows.groupBy("base").agg(F.count_distinct("token").alias("count")), "base")


def usage_basic(rows: DataFrame) -> DataFrame:
    """Every usage against 1 / instances of its base."""
    rows = _counted(rows).withColumn("expected", 1 / F.col("count"))
    return _audit(rows.filter(F.abs(F.col("usage") - F.col("expected")) > N.USAGE_TOLERANCE), refdes=F.col("token"), reason_code=F.lit("PU_EXPECTED_MISMATCH_BASIC"))


def usage_range(rows: DataFrame) -> DataFrame:
    """Usages outside (0, 1]."""
    code = F.when(F.col("usage") > 1, "PU_RANGE_ABOVE_ONE").when(F.col("usage") <= 0, "PU_RANGE_NON_POSITIVE")
    rows = rows.withColumn("code", code).filter("code IS NOT NULL")
    none = F.lit(None)
    return _audit(rows, refdes=F.col("token"), base=F.lit(""), expected=none, count=none, reason_code=F.col("code"))


def ratio_and_usage(rows: DataFrame) -> DataFrame:
    """Ratios of each token and ratio times usage of each base must add to 1.

    rows: row_no, pos, token, usage, ratio (null where missing).  A base with any ratio missing is
    reported and falls back to its usages: each token's first against 1 / instances, later ones against
    the first.
    """
    none = F.lit(None)
    rows = _counted(rows)
    bases = rows.groupBy("base", "count").agg(
        F.max(F.col("ratio").isNull()).alias("gap"), F.sum(F.col("ratio") * F.col("usage")).alias("product"), F.min_by("token", E.place()).alias("first_token"))
    rows = rows.join(bases.select("base", "gap"), "base")
    w = Window.partitionBy("base", "token").orderBy("row_no", "pos")
    gaps = rows.filter("gap").withColumn("at", F.row_number().over(w)).withColumn("seen", F.first("usage").over(w)).withColumn("expected", 1 / F.col("count"))
    off = lambda of: F.abs(F.col("usage") - F.col(of)) > N.USAGE_TOLERANCE
    sums = rows.filter("NOT gap").groupBy("base", "token", "count").agg(F.sum("ratio").alias("s")).filter(F.abs(F.col("s") - 1) > N.RATIO_TOLERANCE)
    return (
        _audit(bases.filter("gap"), refdes=F.col("first_token"), usage=none, expected=none, reason_code=F.lit("FMR_MISSING_PP"))
        .unionByName(_audit(gaps.filter((F.col("at") == 1) & off("expected")), refdes=F.col("token"), reason_code=F.lit("PU_EXPECTED_MISMATCH")))
        .unionByName(_audit(gaps.filter((F.col("at") > 1) & off("seen")), refdes=F.col("token"), expected=F.col("seen"), reason_code=F.lit("PU_INCONSISTENT_DUPLICATE")))
        .unionByName(_audit(sums, refdes=F.col("token"), usage=none, expected=F.lit(1.0), reason_code=F.lit("FMR_SUM_MISMATCH")))
        .unionByName(_audit(bases.filter(~F.col("gap") & (F.abs(F.col("product") - 1) > N.USAGE_TOLERANCE)), refdes=F.col("first_token"), usage=F.col("product"), expected=F.lit(1.0), reason_code=F.lit("FMR_USAGE_PRODUCT_MISMATCH")))
    )


def cross_usage(rows: DataFrame, other_tokens: DataFrame) -> DataFrame:
    """Bases whose instances differ in number between two files, judged by the usage of their first row."""
    own = rows.withColumn("base", T.usage_base(F.col("token"))).groupBy("base").agg(
        F.count_distinct("token").alias("count"), F.min_by("usage", E.place()).alias("usage"), F.min_by("token", E.place()).alias("refdes"))
    other = other_tokens.select(T.usage_base(F.col("token")).alias("base"), "token").groupBy("base").agg(F.count_distinct("token").alias("m"))
    both = own.join(other, "base").filter((F.col("count") != F.col("m")) & N.finite(F.col("usage")) & (F.col("usage") > 0))
    here, there = (F.abs(F.col("usage") - 1 / F.col(c)) <= N.USAGE_TOLERANCE for c in ("count", "m"))
    code = F.when(here & there, F.lit(None)).when(here, "PU_COUNT_MATCHES_THIS_FILE_ONLY").when(there, "PU_COUNT_MATCHES_OTHER_FILE_ONLY").otherwise("PU_CROSS_COUNT_CONFLICT")
    return _audit(both.withColumn("code", code).filter("code IS NOT NULL"), expected=1 / F.col("count"), reason_code=F.col("code"))


def count_warnings(bom_bases: DataFrame, group_bases: DataFrame) -> DataFrame:
    """(base, expected, observed, kind): fewer grouped tokens than the description promises, or under half of a connector's."""
    rows = bom_bases.select("base", "description", F.col("n_tokens").alias("own")).join(group_bases.select("base", F.col("n_tokens").alias("grouped")), "base", "left")
    rows = rows.withColumn("grouped", F.coalesce("grouped", F.lit(0))).withColumn("promised", N.expected_count(F.col("description")))
    short = F.when((F.col("promised") > 0) & (F.col("grouped") < F.col("promised")), F.struct(F.col("promised").alias("expected"), F.lit("count").alias("kind")))
    connector = F.col("description").rlike("(?i)" + N.CONNECTOR_WORDS) & (F.col("grouped") > 0) & (F.col("grouped") < F.col("own") * 0.5)
    low = F.when(connector, F.struct(F.col("own").alias("expected"), F.lit("connector").alias("kind")))
    return rows.select("base", F.col("grouped").alias("observed"), F.explode(F.array_compact(F.array(short, low))).alias("w")).select("base", "w.expected", "observed", "w.kind")
