"""The part that a group of pin labels belongs to, and which pin of a page a label names where several have it.

Tables: entries (page, grp, word, x, y, txt), all words of the pages; bodies (page, refdes, x0, y0, x1, y1), those with
names; pins (pin), identifiers parent-label; listed (parent, at), the pages of parts by the BOM (``listed_pages``).
The box of a group is that of its entries.  Pages count from 0, those of a BOM from 1.

Candidates of a group are bounded by the drawing around it, and pins of a label by the page; both are joined by page
and cell, group or label, and the best of them is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import tokens as T
from tessera.operators import explode as E
from tessera.operators import spatial as S
from tessera.operators.qualify import GROUP, is_designator, pinlist_index
from tessera.sources.readers import broadcast_if_small, once

#: How far a designator may be from the centre of a group where there is a pin list, and what its squared
#: distance is multiplied by above and left of the centre, and below and right of it.
TEXT_REACH, TOWARDS, AGAINST = 500.0, 0.8, 1.4
#: Names of supplies such as P3V3, which look like connectors; pages of a BOM.
SUPPLY = r"(?i)^P(?:\d+(?:\.\d+)?V|\dV\d)\b"
MOST_PAGES = 9999


def part_name(c: Column) -> Column:
    """A designator without the letter behind its number: the name that candidates are known by."""
    return T.canonical(T.strip_instance(c))


def listed_pages(bom: DataFrame) -> DataFrame:
    """(parent, at): the pages that a BOM (row_no, ref_des, page) lists each part on."""
    rows = E.tokens(bom, "ref_des", "page").filter(F.col("page").rlike("^[0-9]+$"))
    rows = rows.select(part_name(F.col("token")).alias("parent"), F.col("page").try_cast("long").alias("page"))
    return rows.filter(F.col("page").between(1, MOST_PAGES)).groupBy("parent").agg(F.collect_set("page").alias("at"))


def read(entries: DataFrame) -> DataFrame:
    """entries, trimmed, with whether the text is a designator or a pin label; computed once."""
    text = F.col("txt")
    rows = entries.select(*GROUP, "word", "x", "y", T.clean(text).alias("txt")).withColumn("is_part", F.coalesce(is_designator(text) & ~text.rlike(SUPPLY), F.lit(False)))
    return once(rows.withColumn("is_label", (text != "") & ~F.col("is_part") & T.pin_candidate(text)))


def group_boxes(entries: DataFrame) -> DataFrame:
    return entries.filter("grp IS NOT NULL").groupBy(*GROUP).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def _placed(df: DataFrame, listed: DataFrame) -> DataFrame:
    """df (page, parent) with ``home`` and ``away``: whether the BOM lists the part on the page, or on others only; computed once.

    Of the BOM only parts that occur are kept.
    """
    df = once(df)
    at = broadcast_if_small(listed.join(df.select("parent").distinct(), "parent", "left_semi"))
    home = F.coalesce(F.array_contains("at", F.col("page") + 1), F.lit(False))
    return once(df.join(at, "parent", "left").withColumn("home", home).withColumn("away", F.col("at").isNotNull() & ~home).drop("at"))


def candidates(entries: DataFrame, bodies: DataFrame) -> DataFrame:
    """(page, grp, parent, source, d): the parts that a group (``read``) may belong to, each once.

    Source 0 is a body that overlaps the box of the group, source 1 a designator within reach of its centre; a body goes
    before its designators.  d is a squared distance, of designators a biased one.
    """
    boxes = group_boxes(entries)
    gx, gy = G.centre(G.rect())
    met = S.overlapping(boxes, bodies.select("page", "refdes", "x0", "y0", "x1", "y1"))
    bx, by = G.centre(G.rect("b_"))
    drawn = met.select(*GROUP, part_name(F.col("refdes")).alias("parent"), "refdes", G.area(G.rect("b_")).alias("area"), ((gx - bx) ** 2 + (gy - by) ** 2).alias("d"))
    # of bodies with one name the smallest
    drawn = S.best(drawn, [*GROUP, "parent"], [F.col("area"), F.col("refdes")], ["d"]).select(*GROUP, "parent", F.lit(0).alias("source"), "d")
    around = boxes.select(*GROUP, gx.alias("gx"), gy.alias("gy"), *(f.alias(n) for f, n in ((gx - TEXT_REACH, "x0"), (gy - TEXT_REACH, "y0"), (gx + TEXT_REACH, "x1"), (gy + TEXT_REACH, "y1"))))
    texts = entries.filter("is_part").select("page", "x", "y", part_name(F.col("txt")).alias("parent"))
    x, y, gx, gy = map(F.col, ("x", "y", "gx", "gy"))
    far = (gx - x) ** 2 + (gy - y) ** 2
    bias = F.when((x < gx) & (y < gy), TOWARDS).when((x > gx) & (y > gy), AGAINST).otherwise(1.0)
    written = S.near(texts, around, cell=2 * TEXT_REACH).filter(far <= TEXT_REACH**2).select(*GROUP, "parent", F.lit(1).alias("source"), (far * bias).alias("d"))
    found = drawn.unionByName(written).groupBy(*GROUP, "parent").agg(F.min(F.struct("source", "d")).alias("b"))
    return found.select(*GROUP, "parent", "b.*")


def parents_of(entries: DataFrame, bodies: DataFrame, pins: DataFrame, listed: DataFrame) -> DataFrame:
    """(page, grp, parent, source, hits, candidates) of every group (``read``) that has candidates.

    The parent is the candidate for which the pin list has most of the group's labels, each label as often as it stands
    there; then one that the BOM does not list on other pages only, a body before a designator, the nearest, the first.
    """
    placed = _placed(candidates(entries, bodies), listed)
    labels = entries.filter("is_label").groupBy(*GROUP, F.upper("txt").alias("label")).agg(F.count("*").alias("n"))
    index = broadcast_if_small(pinlist_index(pins))
    votes = once(labels.join(placed.select(*GROUP, "parent").hint("merge"), GROUP).join(index, ["label", "parent"]).groupBy(*GROUP, "parent").agg(F.sum("n").alias("hits")))
    ranked = placed.join(votes.hint("merge"), [*GROUP, "parent"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    order = F.struct(-F.col("hits"), F.col("away"), F.col("source"), F.round("d", 6), F.col("parent"))
    best = ranked.groupBy(*GROUP).agg(F.min_by(F.struct("parent", "source", "hits"), order).alias("b"), F.count("*").alias("candidates"))
    source = F.when(F.col("source") == 0, "body").otherwise("text")
    return best.select(*GROUP, "b.*", "candidates").withColumn("source", source)


def chosen_pins(entries: DataFrame, maps: DataFrame, bodies: DataFrame, listed: DataFrame) -> DataFrame:
    """(page, grp, word, pin, full, tier, candidates) of every pin label (``read``) that pins of its page have.

    maps: (page, pin, refdes, label, full), pins named p<page>_pin_<n>.  Where the BOM lists some of their parts on the
    page, only those are candidates.  Tier ``only`` has one; else the first whose body's centre is inside the box of
    the label's group, the first whose body overlaps it, or the one whose body's centre is nearest to the label.
    """
    rects = bodies.select("page", "refdes", "x0", "y0", "x1", "y1")
    pins = maps.select("page", F.col("label").alias("txt"), "pin", "refdes", "full", F.substring_index("pin", "_pin_", -1).cast("long").alias("n"), part_name(F.col("refdes")).alias("parent"))
    pins = _placed(pins.join(rects.hint("merge"), ["page", "refdes"]), listed)
    boxes = group_boxes(entries).withColumnsRenamed({c: f"g_{c}" for c in ("x0", "y0", "x1", "y1")})
    labels = entries.filter("is_label").select(*GROUP, "word", "x", "y", "txt")
    met = labels.join(pins.hint("merge"), ["page", "txt"]).join(boxes.hint("merge"), GROUP)
    cx, cy = G.centre(G.rect())
    tier = F.when(G.contains(G.rect("g_"), cx, cy), 0).when(G.overlap(G.rect("g_"), G.rect()), 1).otherwise(2)
    met = met.withColumn("tier", tier).withColumn("d", F.when(F.col("tier") == 2, (F.col("x") - cx) ** 2 + (F.col("y") - cy) ** 2).otherwise(0.0))
    order = F.struct(~F.col("home"), F.col("tier"), F.col("d"), F.col("n"))
    best = met.groupBy(*GROUP, "word").agg(F.min_by(F.struct("pin", "full", "tier"), order).alias("b"), F.count_if("home").alias("homes"), F.count("*").alias("candidates"))
    best = best.select(*GROUP, "word", "b.*", F.when(F.col("homes") > 0, F.col("homes")).otherwise(F.col("candidates")).alias("candidates"))
    name = F.when(F.col("candidates") == 1, "only").when(F.col("tier") == 0, "inside").when(F.col("tier") == 1, "overlapping").otherwise("nearest")
    return best.withColumn("tier", name)
