"""Spatial joins of words, boxes and drawings on pages, as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import geometry as G

#: The side of a grid cell, and the columns that name one.
CELL = 200.0
AT = ["page", "_cx", "_cy"]


def _in_cells(points: DataFrame, rects: DataFrame, margin: float, cell: float) -> tuple[DataFrame, DataFrame]:
    """Points in their cell, rectangles in every cell that they touch.

    A rectangle in cells is many rows of one, which no planner foresees from a table's size; so that none is
    broadcast, the join is by merging.
    """
    r = rects.withColumn("_c", F.explode(G.cells(F.col("x0") - margin, F.col("y0") - margin, F.col("x1") + margin, F.col("y1") + margin, cell)))
    r = r.select("*", F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy")).drop("_c")
    p = points if "_cx" in points.columns else points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    return p, r.hint("merge")


def _reached(margin: float) -> Column:
    x, y = F.col("x"), F.col("y")
    return G.distance_to(G.rect(), x, y) <= margin if margin else G.contains(G.rect(), x, y)


def near(points: DataFrame, rects: DataFrame, margin: float = 0.0, cell: float = CELL, cells: bool = False) -> DataFrame:
    """Points (page, x, y) joined with the rectangles (page, x0, y0, x1, y1) that hold them or are within a margin.

    A rectangle is listed in every cell it touches and a point in one, so each pair meets once.  With ``cells`` the
    point's cell stays (_cx, _cy): pairs of a point are together by it, and ``best`` then shuffles none.
    """
    p, r = _in_cells(points, rects, margin, cell)
    both = p.join(r, AT).filter(_reached(margin))
    return both if cells else both.drop("_cx", "_cy")


def touching(points: DataFrame, rects: DataFrame, name: str, margin: float = 0.0, cell: float = CELL, also: Column | None = None, cells: bool = False) -> DataFrame:
    """points, which differ from one another, with ``name``: whether a rectangle holds it or is within a margin (and ``also``).

    A point is compared with rectangles until one is met.  Where its cell is kept (``cells``) or given, pairs are counted
    where they are joined, so that no point is shuffled again, nor by a next call.
    """
    p, r = _in_cells(points, rects, margin, cell)
    if not cells and "_cx" not in points.columns:
        r = r.select(*(F.col(c).alias(f"_r{c}" if c in AT else c) for c in r.columns if c in AT or c not in p.columns)).hint("merge")
        same = (F.col("page") == F.col("_rpage")) & (F.col("_cx") == F.col("_r_cx")) & (F.col("_cy") == F.col("_r_cy"))
        fits = same & _reached(margin) if also is None else same & _reached(margin) & also
        return p.join(r, fits, "left_semi").withColumn(name, F.lit(True)).unionByName(p.join(r, fits, "left_anti").withColumn(name, F.lit(False))).drop("_cx", "_cy")
    r = r.select(*AT, *(c for c in r.columns if c not in p.columns), F.lit(True).alias("_met"))
    fits = F.col("_met") & _reached(margin) if also is None else F.col("_met") & _reached(margin) & also
    met = p.join(r, AT, "left").groupBy(*AT, *(c for c in points.columns if c not in AT)).agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias(name))
    return met if cells else met.drop("_cx", "_cy")


def best(pairs: DataFrame, key: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """Of each key's pairs the first by order; an aggregate that combines on the map side.

    Pairs that still have their cell (``near``) need a key that tells points apart; they are not shuffled again.
    """
    by = [*AT, *(k for k in key if k != "page")] if "_cx" in pairs.columns else key
    return pairs.groupBy(*by).agg(F.min_by(F.struct(*keep), F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))).alias("b")).select(*key, "b.*")


def smallest_box(points: DataFrame, boxes: DataFrame, key: str, *keep: str) -> DataFrame:
    """Each point, with what is kept of it, with the smallest box that holds it; of equal ones the first by x, y and number.

    Boxes are ranked first, so that a point's best is a minimum of numbers, which is kept in a hash map; pairs are not sorted.
    """
    w = Window.partitionBy("page").orderBy(G.area(G.rect()), "x0", "y0", "box")
    ranked = boxes.select("page", "box", "x0", "y0", "x1", "y1", F.row_number().over(w).alias("_rank"))
    pairs = near(points.select("page", "x", "y", *(c for c in (key, *keep) if c not in ("page", "x", "y"))), ranked, cells=True)
    return pairs.groupBy(*AT, key, *(c for c in keep if c != "page")).agg(F.min_by("box", "_rank").alias("box")).select(key, *keep, "box")


def nearest_box(points: DataFrame, boxes: DataFrame, key: str, reach: float) -> DataFrame:
    d = G.distance_to(G.rect(), F.col("x"), F.col("y"))
    return best(near(points, boxes, reach, cells=True).withColumn("d", d), [key], [F.col("d"), F.col("box")], ["box", "d"])


def point_pairs(a: DataFrame, b: DataFrame, reach: float, cell: float = CELL) -> DataFrame:
    """Pairs of points (word, page, x, y) within reach: a's columns, and b's as b_word, b_x, b_y."""
    r = b.select("page", F.col("word").alias("b_word"), F.col("x").alias("b_x"), F.col("y").alias("b_y"), (F.col("x") - reach).alias("x0"), (F.col("y") - reach).alias("y0"), (F.col("x") + reach).alias("x1"), (F.col("y") + reach).alias("y1"))
    d = F.sqrt((F.col("x") - F.col("b_x")) ** 2 + (F.col("y") - F.col("b_y")) ** 2)
    return near(a, r, cell=cell).withColumn("d", d).filter(F.col("d") <= reach).drop("x0", "y0", "x1", "y1")


def overlapping(a: DataFrame, b: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs of rectangles (page, x0, y0, x1, y1) that overlap or touch: a's columns and b's, its rectangle as b_x0 and so on.

    Both are listed in every cell they touch; a pair is kept in the cell where what they share begins, so it meets once.
    """
    listed = lambda df: df.withColumn("_c", F.explode(G.cells(*G.rect(), cell))).select("*", F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy")).drop("_c")
    r = listed(b).withColumnsRenamed({c: f"b_{c}" for c in ("x0", "y0", "x1", "y1")})
    here = (F.col("_cx") == F.floor(F.greatest("x0", "b_x0") / cell)) & (F.col("_cy") == F.floor(F.greatest("y0", "b_y0") / cell))
    return listed(a).join(r.hint("merge"), AT).filter(G.overlap(G.rect(), G.rect("b_")) & here).drop("_cx", "_cy")


def gated_pages(metrics: DataFrame, least_orphans: int = 5, least_ratio: float = 0.30, least_pins: int = 3) -> DataFrame:
    """Pages worth a geometry pass."""
    return metrics.filter((F.col("orphans") >= least_orphans) & (F.col("ratio") >= least_ratio) & (F.col("pins") >= least_pins))


#: What orphans, their ratio, tied and grid labels, and a table's likeness weigh when pages are ranked.
PAGE_WEIGHTS = {"orphans": 1.0, "ratio": 100.0, "tied": 2.0, "grid": 0.5, "table_score": -50.0}


def ranked_pages(metrics: DataFrame, most: int = 10) -> DataFrame:
    """The pages with the highest scores; a top-k, so it sorts within partitions and merges.  Terms that metrics lack count nothing.

    Pages that are not worth a pass are left out before (``gated_pages``), so that they take no place.
    """
    score = sum((F.col(c) * w for c, w in PAGE_WEIGHTS.items() if c in metrics.columns), F.lit(0.0))
    return metrics.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), "page").limit(most)
