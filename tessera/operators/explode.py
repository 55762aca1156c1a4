"""Token tables: one row for each designator of a delimited cell, with its place.

``row_no`` is the order of the source; ``pos`` the place in the cell.  First and last are always by
(row_no, pos), never by partition order, so results don't change with the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import tokens as T

def place() -> Column:
    """The order of tokens."""
    return F.struct("row_no", "pos")


def tokens(df: DataFrame, cell: str, *keep: str, ignore: str | None = None) -> DataFrame:
    """(row_no, *keep, pos, token, base); tokens that match ``ignore`` are left out."""
    found = df.select("row_no", *keep, F.posexplode(T.split_list(F.col(cell))).alias("pos", "token"))
    if ignore:
        found = found.filter(~F.col("token").rlike(f"(?i){ignore}"))
    return found.withColumn("base", T.base(F.col("token")))


def bom_tokens(bom: DataFrame, *keep: str, skip_unfitted: bool = True, ignore: str | None = None, ignore_description: str | None = None) -> DataFrame:
    """Tokens of a BOM (row_no, ref_des, description) without rows of parts that are not fitted.  Row filters come before the explode."""
    if skip_unfitted:
        bom = bom.filter(~T.not_fitted(F.col("ref_des"), F.col("description")))
    if ignore_description:
        bom = bom.filter(~F.coalesce("description", F.lit("")).rlike(f"(?i){ignore_description}"))
    return tokens(bom, "ref_des", "description", *keep, ignore=ignore)


def group_tokens(grouping: DataFrame, *, provisional: bool = True, ignore: str | None = None) -> DataFrame:
    """Tokens of a grouping (row_no, label, refs); provisional groups may be left out."""
    if not provisional:
        grouping = grouping.filter(~F.upper("label").contains("PROV"))
    return tokens(grouping, "refs", "label", ignore=ignore)


def first(c: Column | str, order: Column | None = None) -> Column:
    """Of the first row that has a non-blank value; an aggregate that combines on the map side."""
    c = F.col(c) if isinstance(c, str) else c
    order = place() if order is None else order
    return F.min_by(F.when(T.clean(c) != "", c), F.when(T.clean(c) != "", order))


def last(c: Column | str, order: Column | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    order = place() if order is None else order
    return F.max_by(F.when(T.clean(c) != "", c), F.when(T.clean(c) != "", order))


def joined_set(c: str, by: str = ", ") -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), by)


def bom_bases(tokens: DataFrame) -> DataFrame:
    """(base, description, tokens, n_tokens) with the first description that is not blank."""
    return tokens.groupBy("base").agg(F.coalesce(first("description"), F.lit("")).alias("description"), joined_set("token").alias("tokens"), F.count_distinct("token").alias("n_tokens"))


def group_index(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, group of its last row) and (base, group of its first row)."""
    by_token = tokens.groupBy("token", "base").agg(F.coalesce(last("label"), F.lit("")).alias("token_group"))
    by_base = tokens.groupBy("base").agg(F.coalesce(first("label"), F.lit("")).alias("base_group"), F.count_distinct("token").alias("n_tokens"))
    return by_token, by_base
