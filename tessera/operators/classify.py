"""Row types of FMEA tables, and the blocks that rows belong to.

The type of a row may depend on the type last known before it, so each row is a map from that type to its
own, and a file is a chain of such maps; ``ranges`` composes them range by range.  Types: other, circuit_block
and piece_part; a row that is other leaves the type last known as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import tokens as T
from tessera.operators import ranges as R

TYPES = ("other", "circuit_block", "piece_part")
_OTHER, _BLOCK, _PART = range(3)


def _filled(c: Column) -> Column:
    return T.clean(c) != ""


def _keyword(c: Column) -> Column:
    return F.when(T.circuit_block_text(c), F.lit(_BLOCK)).when(T.piece_part_text(c), F.lit(_PART))


def _inferred(refs: str, signals: list[str], ids: str | None, last: int, lone: bool, copies: bool) -> Column:
    """The type of a row without a keyword after type ``last``; ``lone``: one designator makes a part; ``copies``: else the last type."""
    strong = F.lit(False)
    for s in signals:
        strong = strong | _filled(F.col(s))
    n = T.designator_count(F.col(refs))
    named = _filled(F.col(ids)) & (n <= 1) if ids else F.lit(False)
    kind = F.when(strong, F.lit(_PART)).when(n >= 2, F.lit(_BLOCK))
    if lone:
        kind = kind.when(n == 1, F.lit(_PART))
    if lone or last == _PART:
        kind = kind.when(named, F.lit(_PART))
    return kind.otherwise(F.lit(last if copies else 0))


def _typed(rows: DataFrame, partition: list[str], kinds: list[Column], size: int) -> DataFrame:
    """rows with row_type; kinds: the type of a row after each type last known."""
    after = [F.when(kind == 0, F.lit(last)).otherwise(kind) for last, kind in enumerate(kinds)]
    rows = rows.withColumn("_kinds", R.step([*kinds, F.lit(0)])).withColumn("_steps", R.step([*after, F.lit(3)]))
    found = R.states(rows, partition, "row_no", "_steps", size)
    names = F.array(*map(F.lit, TYPES))
    return found.withColumn("row_type", F.get(names, R.follow(F.col("_kinds"), F.col("state")))).drop("_kinds", "_steps", "state")


def row_types(rows: DataFrame, partition: list[str], level: str, refs: str, signals: list[str], ids: str | None = None, size: int = R.SIZE) -> DataFrame:
    """rows with row_type by the level cell; a blank one is told from signals, designators, an id, or the type last known.

    ``partition`` names the columns of a file (none: the table is one), in which rows are in order of row_no.
    """
    text = F.col(level)
    kinds = [F.coalesce(_keyword(text), F.when(_filled(text), F.lit(_OTHER)).otherwise(_inferred(refs, signals, ids, last, True, True))) for last in range(3)]
    return _typed(rows, partition, kinds, size)


def scanned_types(rows: DataFrame, partition: list[str], cells: list[str], refs: str, signals: list[str], ids: str | None = None, size: int = R.SIZE) -> DataFrame:
    """rows with row_type where no level column is known: the first cell with a keyword decides, else what can be told from signals.

    A lone designator makes no part then, and an id does only after a part; a type is never copied.
    """
    found = F.coalesce(*(_keyword(F.col(c)) for c in cells))
    return _typed(rows, partition, [F.coalesce(found, _inferred(refs, signals, ids, last, False, False)) for last in range(3)], size)


def attach_blocks(rows: DataFrame, partition: list[str], label: str, size: int = R.SIZE) -> DataFrame:
    """Piece parts with the label of the block before them; a block without a label resets it, and parts before any are orphans."""
    block = F.when(F.col("row_type") == "circuit_block", F.struct(F.col("row_no").alias("block_row"), T.clean(F.col(label)).alias("block")))
    rows = R.carried(rows.withColumn("_own", block), partition, "row_no", "_own", "_b", size=size).filter("row_type = 'piece_part'")
    orphan = F.col("_b").isNull() | (F.col("_b.block") == "")
    return rows.withColumn("block", F.when(~orphan, F.col("_b.block"))).withColumn("orphan", orphan).drop("_own", "_b")


def best_cell(cells: dict[str, Column]) -> Column:
    """Struct score, column, value of the cell with most known designators, the first of equals; null if none has any."""
    scored = F.array(*(F.struct(T.designator_count(c).alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("column"), c.alias("value")) for k, (name, c) in enumerate(cells.items())))
    top = F.array_max(scored)
    return F.when(top["score"] > 0, top)
