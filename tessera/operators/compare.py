"""Set reconciliation of groupings, BOMs and snapshots by equi-joins on tokens or bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import labels as L
from tessera.functions import numeric as N
from tessera.functions import tokens as T
from tessera.operators import explode as E


def missing(group_tokens: DataFrame, bom_tokens: DataFrame, exact: bool = False, loose: bool = False) -> DataFrame:
    """(group, token, base, reason) of grouped designators that the BOM lacks."""
    by_token, by_base = E.group_index(group_tokens)
    found = by_token.join(by_base.select("base", "base_group"), "base")
    key = "token" if exact else "base"
    found = prefix_anti_join(found, bom_tokens.select("base")) if loose and not exact else found.join(bom_tokens.select(key).distinct(), key, "left_anti")
    reason = "Exact token missing" if exact else "Base RefDes missing"
    group = F.col("token_group") if exact else F.coalesce(F.nullif("token_group", F.lit("")), "base_group")
    return found.select(group.alias("group"), "token", "base", F.lit(reason).alias("reason"))


def extra(group_tokens: DataFrame, bom_tokens: DataFrame, exact: bool = False) -> DataFrame:
    """(base, bom_tokens, reason) of BOM designators in no group."""
    if exact:
        rest = bom_tokens.select("token", "base").distinct().join(group_tokens.select("token").distinct(), "token", "left_anti")
        return rest.select("base", F.col("token").alias("bom_tokens"), F.lit("Exact token missing in Grouping").alias("reason"))
    rest = bom_tokens.join(group_tokens.select("base").distinct(), "base", "left_anti")
    return rest.groupBy("base").agg(E.joined_set("token").alias("bom_tokens")).withColumn("reason", F.lit("Not found in Grouping"))


def prefix_anti_join(left: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose base no other base begins with, where what follows is not a number.

    R1 is covered by R1 and by R12A, not by R12.  Each other base is exploded into its prefixes, which
    are as many as it has characters, so the join is on equality.
    """
    cut = F.transform(F.sequence(F.lit(1), F.char_length("base")), lambda n: F.struct(F.substring(F.col("base"), F.lit(1), n).alias("base"), F.substring(F.col("base"), n + 1, F.char_length("base")).alias("rest")))
    covering = other.distinct().select(F.explode(cut).alias("c")).filter(~F.col("c.rest").rlike(r"^\d+$")).select("c.base").distinct()
    return left.join(covering, "base", "left_anti")


def summary(group_tokens: DataFrame, bom_tokens: DataFrame) -> DataFrame:
    """(metric, value): sizes of both sides, by one aggregate each."""
    count = lambda df, name: df.agg(F.count_distinct("token").alias(f"{name} tokens"), F.count_distinct("base").alias(f"{name} bases")).unpivot([], [f"{name} tokens", f"{name} bases"], "metric", "value")
    return count(group_tokens, "Grouping").unionByName(count(bom_tokens, "BOM"))


# ---- two tables by key ------------------------------------------------------------------------

def first_rows(tokens: DataFrame, *columns: str) -> DataFrame:
    """(token, row_no, *columns) of each token's first row."""
    rest = F.min_by(F.struct("row_no", *columns), E.place()).alias("r")
    return tokens.groupBy("token").agg(rest).select("token", "r.*")


def key_diff(a: DataFrame, b: DataFrame, key: str = "token") -> DataFrame:
    """(key, status): only_a, only_b or both."""
    a, b = a.select(key, F.lit(True).alias("in_a")).distinct(), b.select(key, F.lit(True).alias("in_b")).distinct()
    status = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise("both")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def differs(a: Column, b: Column, rule: str) -> Column:
    """By number (a billionth, else by text), by number only (cells without one do not differ), exact text, or text in any case."""
    a, b = T.clean(a), T.clean(b)
    if rule == "numbers":
        return F.coalesce(F.abs(N.number(a) - N.number(b)) > 1e-9, F.lit(False))
    text = F.lower(a) != F.lower(b)
    if rule == "numeric":
        return F.coalesce(F.abs(N.number(a) - N.number(b)) > 1e-9, text)
    return a != b if rule == "exact" else text


def column_deltas(a: DataFrame, b: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(token, column, a, b) for each compared column whose values differ in rows of one token."""
    left, right = first_rows(a, *rules), first_rows(b, *rules)
    both = left.select("token", F.struct(*rules).alias("a")).join(right.select("token", F.struct(*rules).alias("b")), "token")
    found = F.array(*(F.when(differs(F.col(f"a.{c}"), F.col(f"b.{c}"), rule), F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").alias("a"), F.col(f"b.{c}").alias("b"))) for c, rule in rules.items()))
    return both.select("token", F.explode(F.array_compact(found)).alias("d")).select("token", "d.*")


def occurrences(tokens: DataFrame, identity: list[str]) -> DataFrame:
    """Rows of repeated identities, numbered in order; the first is the one used for comparison."""
    w = Window.partitionBy(*identity)
    rows = tokens.withColumn("n", F.count("*").over(w)).withColumn("occurrence", F.row_number().over(w.orderBy("row_no", "pos")))
    return rows.filter("n > 1").withColumn("used", F.col("occurrence") == 1)


def scope(typed: DataFrame, other: DataFrame) -> DataFrame:
    """(token, in_block, in_piece, in_other) for tokens with a row type and those of the other file."""
    sides = typed.groupBy("token").agg(F.max(F.col("row_type") == "circuit_block").alias("in_block"), F.max(F.col("row_type") == "piece_part").alias("in_piece"))
    return sides.join(other.select("token", F.lit(True).alias("o")).distinct(), "token", "left").select("token", "in_block", "in_piece", F.coalesce("o", F.lit(False)).alias("in_other"))


# ---- snapshots and coverage ----------------------------------------------------------------------

def membership(rows: DataFrame) -> DataFrame:
    """(ref, groups): groups of each designator, without their verification status."""
    return rows.select("ref", L.without_verified(F.col("grp")).alias("grp")).groupBy("ref").agg(E.joined_set("grp").alias("groups"))


def snapshot_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ref, change, groups_a, groups_b): appeared, disappeared or moved between two snapshots."""
    both = membership(a).withColumnRenamed("groups", "groups_a").join(membership(b).withColumnRenamed("groups", "groups_b"), "ref", "full_outer")
    change = F.when(F.col("groups_a").isNull(), "appeared").when(F.col("groups_b").isNull(), "disappeared").when(F.col("groups_a") != F.col("groups_b"), "moved")
    return both.select("ref", change.alias("change"), "groups_a", "groups_b").filter("change IS NOT NULL")


def coverage(bom_tokens: DataFrame, extracted: DataFrame) -> DataFrame:
    """(base, status, pages): covered, not grouped, or not in the BOM; extracted has ref and pages."""
    bom = bom_tokens.select(T.coverage_key(F.col("token")).alias("base")).filter("base <> ''").distinct().withColumn("in_bom", F.lit(True))
    seen = extracted.select(T.coverage_key(F.col("ref")).alias("base"), F.explode(N.pages(F.col("pages"))).alias("page")).filter("base <> ''")
    seen = seen.groupBy("base").agg(F.array_sort(F.collect_set("page")).alias("p"))
    status = F.when(F.col("in_bom").isNull(), "extracted, not in BOM").when(F.col("p").isNull(), "BOM, not grouped").otherwise("covered")
    return bom.join(seen, "base", "full_outer").select("base", status.alias("status"), F.coalesce(F.array_join("p", ", "), F.lit("")).alias("pages"))
