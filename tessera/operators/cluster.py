"""Overlap suppression and pin clusters of pages, by joins on grid cells; no task holds a page's shapes at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions import geometry as G
from tessera.operators import spatial as S
from tessera.operators.components import connected
from tessera.sources.readers import once

#: The grid and reach of pin clusters, and the parts of a grid cell along each side.
PIN_CELL, PIN_REACH, PIN_PARTS = 120.0, 150.0, 3
#: Pins of a group that are clustered as one row's lists; larger groups take joins on grid cells.
LIST_PINS = 128


def suppress_overlaps(boxes: DataFrame, most_iou: float = 0.8, most: int | None = None) -> DataFrame:
    """(page, box) kept of boxes (page, box, x0, y0, x1, y1): largest first, none that overlaps a kept one more.

    Rounds: a box is kept if no larger undecided box overlaps it, and drops those that it overlaps.
    ``most`` keeps only so many of a page, the largest (the reference stops at 5000).
    """
    if not 0 < most_iou <= 1:
        raise ValueError("most_iou is over 0 and at most 1")
    boxes = boxes.select("page", "box", "x0", "y0", "x1", "y1").withColumn("a", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    # Of two boxes that overlap so much, the left and upper edges are less than this apart.
    reach = (1 - most_iou) / most_iou + 1e-9
    large = boxes.select("page", F.col("box").alias("b_box"), F.col("a").alias("b_a"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")), F.col("x0").alias("x"), F.col("y0").alias("y"))
    small = boxes.filter("a > 0").withColumn("dx", reach * (F.col("x1") - F.col("x0"))).withColumn("dy", reach * (F.col("y1") - F.col("y0")))
    small = small.select("page", "box", "a", *(F.col(c).alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1")), (F.col("x0") - F.col("dx")).alias("x0"), (F.col("y0") - F.col("dy")).alias("y0"), (F.col("x0") + F.col("dx")).alias("x1"), (F.col("y0") + F.col("dy")).alias("y1"))
    both = G.intersection(G.rect("s_"), G.rect("b_"))
    pairs = S.near(large, small, cell=50.0).filter((F.col("b_a") > F.col("a")) | ((F.col("b_a") == F.col("a")) & (F.col("b_box") < F.col("box"))))
    pairs = once(pairs.filter(both > most_iou * (F.col("a") + F.col("b_a") - both)).select("page", "box", "b_box"))
    kept = boxes.select("page", "box", "a")
    while not pairs.isEmpty():
        waiting = pairs.select("page", "box").distinct()
        top = pairs.select("page", F.col("b_box").alias("box")).distinct().join(waiting, ["page", "box"], "left_anti")
        out = once(pairs.join(top.withColumnRenamed("box", "b_box"), ["page", "b_box"], "left_semi").select("page", "box").distinct())
        kept = once(kept.join(out, ["page", "box"], "left_anti"))
        pairs = pairs.join(out, ["page", "box"], "left_anti").join(out.withColumnRenamed("box", "b_box"), ["page", "b_box"], "left_anti")
        pairs = once(pairs.select("page", "box", "b_box"))
    if most is not None:
        kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("a"), "box"))).filter(F.col("n") <= most)
    return kept.select("page", "box")


def _pairs_of_parts(parts: DataFrame, by: list[str], far: bool) -> DataFrame:
    """Pairs (by, sx, sy, root; tx, ty, t_root), one of each two, of parts whose farthest (or nearest) points are in reach.

    A part is in its grid cell and listed in the six cells on one side of it, so each pair meets once.
    """
    grid = lambda c: F.floor(F.col(c) / PIN_PARTS)
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (-1, 0, 1))))
    a = parts.select(*by, "sx", "sy", "root", grid("sx").alias("gx"), grid("sy").alias("gy"))
    b = parts.select(*by, F.col("sx").alias("tx"), F.col("sy").alias("ty"), F.col("root").alias("t_root"), step.alias("s"))
    b = b.withColumn("gx", grid("tx") - F.col("s.i")).withColumn("gy", grid("ty") - F.col("s.j")).drop("s")
    i, j = F.col("tx") - F.col("sx"), F.abs(F.col("ty") - F.col("sy"))
    gap = (i + 1) * (i + 1) + (j + 1) * (j + 1) if far else sum(F.greatest(d - 1, F.lit(0)) * F.greatest(d - 1, F.lit(0)) for d in (i, j))
    once_each = (i > 0) | ((i == 0) & (F.col("ty") > F.col("sy")))
    return a.join(b, [*by, "gx", "gy"]).filter(once_each & (gap * (PIN_CELL / PIN_PARTS) ** 2 <= PIN_REACH**2)).drop("gx", "gy")


def _rooted(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """parts with the root of each by edges between their roots."""
    found = connected(edges.select(F.col("root").alias("u"), F.col("t_root").alias("v")))
    joined = parts.join(found.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return once(joined.withColumn("root", F.coalesce("to", "root")).drop("to"))


def cluster_pins(pins: DataFrame, by: tuple[str, ...] = ("page",), unique: bool = False) -> DataFrame:
    """(by, word, cluster): single linkage within PIN_REACH, over neighbouring grid cells; named by the smallest word.

    ``by`` names the columns within which pins may be linked.  Where words are ``unique`` in the whole table, a word
    alone names a part, which makes edges smaller.  Pins of one part of a grid cell are always linked,
    and so are parts whose farthest points are in reach.  Pins are compared only where parts are in reach that
    these links leave apart.  No task holds a page or a cluster.
    """
    by, side = list(by), PIN_CELL / PIN_PARTS
    # a part is a share of its own grid cell, so that rounding cannot set it in the next one
    part = lambda c: F.floor(F.col(c) / PIN_CELL) * PIN_PARTS + F.least(F.floor((F.col(c) - F.floor(F.col(c) / PIN_CELL) * PIN_CELL) / side), F.lit(PIN_PARTS - 1))
    pins = pins.select(*by, "word", "x", "y").withColumn("sx", part("x").cast("long")).withColumn("sy", part("y").cast("long"))
    parts = once(pins.groupBy(*by, "sx", "sy").agg(F.min("word").alias("root")).withColumn("root", F.col("root") if unique else F.struct(*by, F.col("root").alias("word"))))
    parts = _rooted(parts, _pairs_of_parts(parts, by, far=True))
    open_ = once(_pairs_of_parts(parts, by, far=False).filter("root <> t_root").select(*by, "sx", "sy", "tx", "ty", "root", "t_root"))
    at = pins.select(*by, "sx", "sy", "x", "y").distinct()
    other = at.select(*by, F.col("sx").alias("tx"), F.col("sy").alias("ty"), F.col("x").alias("b_x"), F.col("y").alias("b_y"))
    met = open_.join(at, [*by, "sx", "sy"]).join(other, [*by, "tx", "ty"])
    d = F.sqrt((F.col("x") - F.col("b_x")) ** 2 + (F.col("y") - F.col("b_y")) ** 2)
    parts = _rooted(parts, met.filter(d <= PIN_REACH).select("root", "t_root").distinct())
    # a part is named by its smallest word and a cluster by its smallest part
    return pins.join(parts.select(*by, "sx", "sy", F.col("root" if unique else "root.word").alias("cluster")), [*by, "sx", "sy"]).select(*by, "word", "cluster")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _linked(xs: pa.Array, ys: pa.Array) -> pa.Array:
    """For each list of points the place of the first point of its cluster, by single linkage as in ``cluster_pins``."""
    x, y = (v.flatten().to_numpy(zero_copy_only=False) for v in (xs, ys))
    sizes = xs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start, of = np.repeat(ends - sizes, sizes), np.repeat(sizes, sizes)
    first = np.cumsum(of) - of
    a = np.repeat(np.arange(len(x)), of)
    b = np.arange(len(a)) - first[a] + start[a]
    cell = lambda v: np.floor(v / PIN_CELL)
    met = (np.abs(cell(x)[a] - cell(x)[b]) <= 1) & (np.abs(cell(y)[a] - cell(y)[b]) <= 1) & (np.sqrt((x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2) <= PIN_REACH)
    met |= a == b
    a, b = a[met], b[met]
    root = np.arange(len(x))
    while len(x):
        least = np.minimum.reduceat(root[b], np.searchsorted(a, np.arange(len(x))))
        least = least[least]
        if (least == root).all():
            break
        root = least
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array((root - start).astype(np.int32)))


def cluster_groups(pins: DataFrame, by: tuple[str, ...], most: int = LIST_PINS) -> DataFrame:
    """pins (by, word, x, y, ...), of unique words, with their clusters as in ``cluster_pins``; a group of more than ``most`` is one row of null word.

    One shuffle by group; the larger groups are for ``cluster_pins``.
    """
    by = list(by)
    sized = pins.repartition(*by).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    item = F.struct("word", *(c for c in pins.columns if c not in (*by, "word")))
    lists = sized.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, item))).alias("_p"))
    lists = lists.withColumn("_r", _linked(F.col("_p.x"), F.col("_p.y")))
    named = F.zip_with("_p", "_r", lambda p, r: F.struct(p.alias("p"), F.get("_p", r)["word"].alias("cluster")))
    return lists.select(*by, F.explode_outer(named).alias("_q")).select(*by, "_q.p.*", "_q.cluster")
