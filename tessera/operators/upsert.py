"""Generated rows merged into an existing table, group by group, one row to one.

Both tables are files of block rows and part rows; a part belongs to the block before it.  A part is known by its
group, designator and failure mode.  Only a key that occurs once on a side at most is merged: rows of any other
are quarantined, on both sides, and left as they are.  Parts before any block, or under one without an id, are in
no group and take no part.

Keys are counted before the sides are joined, so rows that repeat one key do not meet each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import tokens as T
from tessera.operators import ranges as R
from tessera.operators.unified import cell_status, merged_value

KEY = ["grp", "ref", "mode"]
REVIEW, NEW = "NOT IN BOM - Review", "NEW - Added by generator"


def grouped(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(grp, ref, mode, row_no, columns) of the parts of rows (row_no, row_type, fmea_id, cause, failure_mode, columns)."""
    block = F.when(F.col("row_type") == "circuit_block", F.struct(T.function_base(F.col("fmea_id")).alias("id")))
    found = R.carried(rows.withColumn("_block", block), [], "row_no", "_block", "_of").filter("row_type = 'piece_part' AND _of.id <> ''")
    return found.select(F.col("_of.id").alias("grp"), T.canonical(F.coalesce("cause", F.lit(""))).alias("ref"), T.failure_mode_key(F.col("failure_mode")).alias("mode"), "row_no", *columns)


def group_ends(rows: DataFrame) -> DataFrame:
    """(grp, last_row): the last part of each group of the table, or its block where it has none."""
    block = F.when(F.col("row_type") == "circuit_block", F.struct(T.function_base(F.col("fmea_id")).alias("id")))
    found = R.carried(rows.withColumn("_block", block), [], "row_no", "_block", "_of", inclusive=True).filter("_of.id <> '' AND row_type <> 'other'")
    return found.groupBy(F.col("_of.id").alias("grp")).agg(F.max("row_no").alias("last_row"))


def _counted(side: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(key, n, one row): how often a key occurs, and its first row."""
    return side.groupBy(*KEY).agg(F.count("*").alias(f"n_{name}"), F.min_by(F.struct("row_no", *columns), "row_no").alias(name))


def merged(table: DataFrame, generated: DataFrame, columns: list[str], flag_missing: bool = True) -> DataFrame:
    """(grp, ref, mode, action, at_row, new_row, columns, changes, skipped, note): the parts of the table after the merge.

    action: update or unchanged (the key is once on both sides), missing (not generated; noted, unless ``flag_missing``
    is off), insert (not in the table; stands after the last row of its group, in generated order), unplaced (its
    group is not in the table), quarantined (row_no of the table, or of the generated row in new_row).
    changes: "column: old -> new" of overwritten cells; skipped: columns whose generated value is blank.
    """
    a, b = grouped(table, columns), grouped(generated, columns)
    both = _counted(a, "a", columns).join(_counted(b, "b", columns), KEY, "full_outer")
    once_each = (F.coalesce("n_a", F.lit(0)) <= 1) & (F.coalesce("n_b", F.lit(0)) <= 1)
    pairs = both.filter(once_each).join(group_ends(table), "grp", "left")
    states = {c: cell_status(F.col(f"b.{c}"), F.col(f"a.{c}")) for c in columns}
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    action = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull() & F.col("last_row").isNull(), "unplaced").when(F.col("a").isNull(), "insert").when(_any(states, "changed", "filled"), "update").otherwise("unchanged")
    told = lambda c: F.concat(F.lit(f"{c}: "), T.clean(F.col(f"a.{c}")), F.lit(" -> "), T.clean(F.col(f"b.{c}")))
    changes = F.array_join(F.array_compact(F.array(*(F.when(paired & (s == "changed"), told(c)) for c, s in states.items()))), "; ")
    skipped = F.array_join(F.array_compact(F.array(*(F.when(paired & (T.clean(F.col(f"b.{c}")) == ""), F.lit(c)) for c in columns))), ", ")
    value = lambda c: F.when(F.col("b").isNull(), F.col(f"a.{c}")).when(F.col("a").isNull(), F.col(f"b.{c}")).otherwise(merged_value(F.col(f"b.{c}"), F.col(f"a.{c}")))
    note = F.when(F.col("b").isNull(), F.lit(REVIEW if flag_missing else "")).when(F.col("a").isNull(), F.lit(NEW)).otherwise("")
    rows = pairs.select(*KEY, action.alias("action"), F.coalesce("a.row_no", "last_row").alias("at_row"), F.when(F.col("a").isNull(), F.col("b.row_no")).alias("new_row"), *(F.coalesce(value(c), F.lit("")).alias(c) for c in columns), changes.alias("changes"), skipped.alias("skipped"), note.alias("note"))
    twice = both.filter(~once_each).select(*KEY, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    counts = F.concat(F.lit("Identity matches "), "n_a", F.lit(" template row(s) and "), "n_b", F.lit(" generated row(s); pairing is not exactly 1:1."))
    kept = lambda side, is_new, said: side.join(twice, KEY).select(
        *KEY, F.lit("quarantined").alias("action"), (F.lit(None).cast("long") if is_new else F.col("row_no")).alias("at_row"), (F.col("row_no") if is_new else F.lit(None).cast("long")).alias("new_row"),
        *(F.coalesce(c, F.lit("")).alias(c) for c in columns), F.lit("").alias("changes"), F.lit("").alias("skipped"), F.concat(F.lit(said), counts).alias("note"))
    return rows.unionByName(kept(a, False, "Template row left completely untouched. ")).unionByName(kept(b, True, "Generated row was not inserted. "))


def _any(states: dict[str, Column], *wanted: str) -> Column:
    found = F.lit(False)
    for s in states.values():
        found = found | s.isin(*wanted)
    return found
