"""Geometry of drawing pages: bodies, ticks, circles and wires, classes of text, pins, and the parts they belong to.

Tables: drawings (page, item, kind, x0, y0, x1, y1, radius), where kind is re (a rectangle), l (a line between
two points) or c (a circle round x0, y0); and tokens (page, word, x, y, txt).  All pages go through one plan of
grid joins and best-of aggregates that combine where they are counted.  Only pages that a gate names need be
read: both tables are stored in folders of pages, and a join with the gate prunes folders when it runs.

Bodies are in order of size, the largest first, then of item; where several would do, the first is taken.  Of a
point beside a corner the distance to the corner counts.  Blank texts have no class but JUNK.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import geometry as G
from tessera.functions import labels as L
from tessera.functions import tokens as T
from tessera.operators import spatial as S
from tessera.operators.cluster import suppress_overlaps
from tessera.operators.qualify import is_designator
from tessera.sources.readers import BROADCAST_ROWS, once

# Sizes of bodies, ticks, balls and wires, reaches, and weights of the score.
BODY_SIZES, BODY_ASPECTS, BODY_OVERLAP = (20.0, 500.0), (0.3, 3.0), 0.8
TICK_LENGTHS, TICK_REACH = (2.0, 25.0), 5.0
BALL_RADII, BALL_REACH = (1.0, 8.0), 15.0
WIRE_LENGTH, WIRE_REACH = 50.0, 20.0
PIN_REACH, PART_REACH, PART_SHARE = 50.0, 100.0, 0.3
ALIGNED_WEIGHT, APART_WEIGHT, ALIGNED_SLACK = 0.7, 0.3, 0.5
PIN_TEXT = r"(?i)^P(?:IN)?[-_]?\d+$"
CONFIDENCE = {"pin text": 0.85, "like a part": 0.7, "pin": 0.75, "part": 0.9, "net": 0.7, "drawn": 0.5}
#: The least sizes of a rectangle that holds a group, how far above and below its upper side its label may
#: stand, how much of its sheet it may cover, and how near all its sides may be to those of the sheet.
HOLDER_WIDTH, HOLDER_HEIGHT, HOLDER_AREA = 150.0, 100.0, 10_000.0
LABEL_ABOVE, LABEL_BELOW, FRAME_SHARE, FRAME_REACH = 20.0, 30.0, 0.9, 5.0
PART_TEXT = r"^[A-Z]{1,3}\d+[A-Z]?$"

#: Pages that share a folder.
PAGES_PER_FOLDER = 8


# ---- primitives ------------------------------------------------------------------------------------

def _length() -> Column:
    return F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)


def _middle(df: DataFrame) -> DataFrame:
    return df.withColumn("x", (F.col("x0") + F.col("x1")) / 2).withColumn("y", (F.col("y0") + F.col("y1")) / 2)


def rectangles(drawings: DataFrame) -> DataFrame:
    """(page, item, x0, y0, x1, y1): the rectangles, upright."""
    sides = ((F.least, "x0", "x1", "x0"), (F.least, "y0", "y1", "y0"), (F.greatest, "x0", "x1", "x1"), (F.greatest, "y0", "y1", "y1"))
    return drawings.filter("kind = 're'").select("page", "item", *(f(c, d).alias(n) for f, c, d, n in sides))


def bodies(drawings: DataFrame) -> DataFrame:
    """(page, body, x0, y0, x1, y1): rectangles of a body's size and shape, none over another that is kept and larger."""
    r = rectangles(drawings).withColumnRenamed("item", "body")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    r = once(r.filter(w.between(*BODY_SIZES) & h.between(*BODY_SIZES) & (w / h).between(*BODY_ASPECTS)))
    kept = suppress_overlaps(r.withColumnRenamed("body", "box"), BODY_OVERLAP).withColumnRenamed("box", "body")
    return once(r.join(kept, ["page", "body"], "left_semi"))


def _order() -> list[Column]:
    return [-G.area(G.rect()), F.col("body")]


def edge(x: Column, y: Column) -> Column:
    """The side of the rectangle nearest to a point: of those it is level with, or of all beside a corner."""
    level, upright = y.between(F.col("y0"), F.col("y1")), x.between(F.col("x0"), F.col("x1"))
    beside = ~level & ~upright
    far = F.lit(float("inf"))
    sides = {"left": (F.col("x0") - x, level), "right": (F.col("x1") - x, level), "top": (F.col("y0") - y, upright), "bottom": (F.col("y1") - y, upright)}
    return F.array_min(F.array(*(F.struct(F.when(ok | beside, F.abs(d)).otherwise(far).alias("d"), F.lit(k).alias("k"), F.lit(n).alias("side")) for k, (n, (d, ok)) in enumerate(sides.items()))))


def _edge_distance(x: Column, y: Column) -> Column:
    """To the nearest side that the point is level with; beside a corner, to the corner."""
    inside_span = y.between(F.col("y0"), F.col("y1")) | x.between(F.col("x0"), F.col("x1"))
    return F.when(inside_span, edge(x, y)["d"]).otherwise(G.distance_to(G.rect(), x, y))


def drawn_pins(drawings: DataFrame, of: DataFrame) -> DataFrame:
    """(page, kind, item, x, y, side, body): ticks across a side of a body and balls near one, with the first such body."""
    x, y = F.col("x"), F.col("y")
    level, upright = y.between(F.col("y0"), F.col("y1")), x.between(F.col("x0"), F.col("x1"))
    close = lambda a, b: F.abs(a - F.col(b)) < TICK_REACH
    lines = _middle(drawings.filter("kind = 'l'").filter(_length().between(*TICK_LENGTHS))).select("page", "item", "x", "y")
    ticks = S.near(lines, of, TICK_REACH, cells=True).withColumn("side", F.when(close(x, "x0") & level, "left").when(close(x, "x1") & level, "right").when(close(y, "y0") & upright, "top").when(close(y, "y1") & upright, "bottom"))
    circles = drawings.filter("kind = 'c'").filter(F.col("radius").between(*BALL_RADII)).select("page", "item", F.col("x0").alias("x"), F.col("y0").alias("y"))
    balls = S.near(circles, of, BALL_REACH, cells=True).filter(_edge_distance(x, y) < BALL_REACH).withColumn("side", edge(x, y)["side"])
    first = lambda df, kind: S.best(df, ["page", "item", "x", "y"], _order(), ["side", "body"]).select("page", F.lit(kind).alias("kind"), "item", "x", "y", "side", "body")
    return first(ticks.filter("side IS NOT NULL"), "tick").unionByName(first(balls, "ball"))


def wire_ends(drawings: DataFrame) -> DataFrame:
    """(page, word, x, y): both ends of long lines; word is the line's item."""
    ends = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    return drawings.filter("kind = 'l'").filter(_length() >= WIRE_LENGTH).select("page", F.col("item").alias("word"), F.explode(ends).alias("e")).select("page", "word", "e.x", "e.y")


# ---- text --------------------------------------------------------------------------------------------

def classified(tokens: DataFrame, of: DataFrame, ends: DataFrame) -> DataFrame:
    """tokens with ``class`` (REFDES, PIN_LABEL, NET_LABEL or JUNK) and ``confidence``."""
    wires = ends.select("page", F.col("x").alias("wx"), F.col("y").alias("wy"), *(f.alias(n) for f, n in ((F.col("x") - WIRE_REACH, "x0"), (F.col("y") - WIRE_REACH, "y0"), (F.col("x") + WIRE_REACH, "x1"), (F.col("y") + WIRE_REACH, "y1"))))
    reach = (F.col("x") - F.col("wx")) ** 2 + (F.col("y") - F.col("wy")) ** 2 < WIRE_REACH**2
    # both marks are counted over the same cells, so the second needs no shuffle of the tokens
    rows = S.touching(S.touching(tokens, of, "by_body", PIN_REACH, cells=True), wires, "by_wire", also=reach)
    text = T.clean(F.col("txt"))
    body, pin = F.col("by_body"), T.pin_candidate(text)
    net = (F.upper(text) == text) & (F.lower(text) != text) & (F.char_length(text) >= 3) & F.col("by_wire")
    as_ = lambda kind, how: F.struct(F.lit(kind).alias("class"), F.lit(CONFIDENCE[how] if how else 0.0).alias("confidence"))
    junk = as_("JUNK", None)
    kind = (
        F.when(text.contains("_"), F.when(net, as_("NET_LABEL", "net")).otherwise(junk)).when(text.rlike(PIN_TEXT), as_("PIN_LABEL", "pin text"))
        .when(is_designator(text), F.when(pin & body, as_("PIN_LABEL", "like a part")).otherwise(as_("REFDES", "part")))
        .when(pin & body, as_("PIN_LABEL", "pin")).when(net, as_("NET_LABEL", "net")).otherwise(junk)
    )
    return rows.withColumn("_k", kind).select("page", "word", "x", "y", text.alias("txt"), "_k.class", "_k.confidence")


def text_pins(tokens: DataFrame, of: DataFrame) -> DataFrame:
    """(page, word, x, y, txt, confidence, side): pin labels near a side of a body, with the nearest side; tokens are classified."""
    x, y = F.col("x"), F.col("y")
    met = S.near(tokens.filter("class = 'PIN_LABEL'"), of, PIN_REACH, cells=True).withColumn("d", F.round(_edge_distance(x, y), 9)).filter(F.col("d") < PIN_REACH)
    return S.best(met.withColumn("side", edge(x, y)["side"]), ["page", "word", "x", "y", "txt", "confidence"], [F.col("d"), *_order()], ["side"])


def labelled_holders(drawings: DataFrame, tokens: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """(page, item, label, x0, y0, x1, y1): large rectangles with the uppermost label in the band at their upper side.

    Of equal rectangles with one label the first.  sheets: (page, x0, y0, x1, y1), where sizes of pages are known;
    a rectangle that is the frame of its sheet, or nearly covers it, holds no group.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    large = rectangles(drawings).filter((w >= HOLDER_WIDTH) & (h >= HOLDER_HEIGHT) & (w * h >= HOLDER_AREA))
    if sheets is not None:
        sides = ("x0", "y0", "x1", "y1")
        large = large.join(sheets.select("page", *(F.col(c).alias(f"s_{c}") for c in sides)), "page", "left")
        whole = G.area(G.rect("s_"))
        frame = (F.abs(F.col("x0") - F.col("s_x0")) <= FRAME_REACH) & (F.abs(F.col("y0") - F.col("s_y0")) <= FRAME_REACH) & (F.abs(F.col("x1") - F.col("s_x1")) <= FRAME_REACH) & (F.abs(F.col("y1") - F.col("s_y1")) <= FRAME_REACH)
        large = large.filter(~F.coalesce(frame | ((whole > 0) & (w * h > FRAME_SHARE * whole)), F.lit(False))).select("page", "item", *sides)
    label = F.col("label")
    texts = tokens.select("page", "word", "x", "y", L.sanitize(F.col("txt")).alias("label")).filter((label != "") & ~label.rlike(PART_TEXT) & (L.label_class(label) != "noise"))
    band = large.select("page", "item", F.struct("x0", "y0", "x1", "y1").alias("rect"), "x0", (F.col("y0") - LABEL_ABOVE).alias("y0"), "x1", (F.col("y0") + LABEL_BELOW).alias("y1"))
    found = S.best(S.near(texts, band), ["page", "item"], [F.col("y"), F.col("word")], ["label", "rect"])
    rounded = [F.bround(F.col(f"rect.{c}"), 0).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")]
    first = found.groupBy("page", "label", *rounded).agg(F.min(F.struct("item", "rect")).alias("b"))
    return first.select("page", "b.item", "label", "b.rect.*")


# ---- parts -------------------------------------------------------------------------------------------

def score(x: Column, y: Column, side: Column) -> Column:
    """How well a pin outside a body fits it: level with it counts for it, distance along against it."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    beyond = F.greatest(F.col("y0") - y, y - F.col("y1"))
    level = F.when(beyond <= ALIGNED_SLACK, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - beyond / height))
    left, right = F.abs(x - F.col("x0")), F.abs(x - F.col("x1"))
    apart = F.when(side == "left", left).when(side == "right", right).otherwise(F.least(left, right))
    return F.round(ALIGNED_WEIGHT * level - APART_WEIGHT * apart / width, 9)


def assigned(pins: DataFrame, of: DataFrame, key: list[str]) -> DataFrame:
    """(key, body): the smallest body around each pin (page, x, y, side), else that of the best score over 0 in reach."""
    x, y = F.col("x"), F.col("y")
    met = S.near(pins, of, PIN_REACH, cells=True).withColumn("inside", G.contains(G.rect(), x, y)).withColumn("score", score(x, y, F.col("side")))
    met = met.filter("inside OR score > 0")
    order = [~F.col("inside"), F.when(F.col("inside"), G.area(G.rect())).otherwise(-F.col("score")), F.when(F.col("inside"), F.lit(0.0)).otherwise(-G.area(G.rect())), F.col("body")]
    return S.best(met, key, order, ["body"])


def part_names(tokens: DataFrame, of: DataFrame) -> DataFrame:
    """(page, body, refdes): the nearest designator, nearer above and left, within a reach that grows with the body."""
    size = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    reach = F.greatest(F.lit(PART_REACH), size * PART_SHARE)
    cx, cy = G.centre(G.rect())
    # a biased distance below the reach is a distance below the reach divided by the bias
    wide = of.withColumn("reach", reach).withColumn("cx", cx).withColumn("cy", cy).select("page", "body", "reach", "cx", "cy", *(f.alias(n) for f, n in ((cx - reach / 0.8, "x0"), (cy - reach / 0.8, "y0"), (cx + reach / 0.8, "x1"), (cy + reach / 0.8, "y1"))))
    d = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2) * F.when((F.col("x") < F.col("cx")) & (F.col("y") < F.col("cy")), 0.8).otherwise(1.0)
    met = S.near(tokens.filter("class = 'REFDES'"), wide).withColumn("d", F.round(d, 9)).filter(F.col("d") < F.col("reach"))
    return S.best(met, ["page", "body"], [F.col("d"), F.col("word")], [F.col("txt").alias("refdes")])


# ---- pages -------------------------------------------------------------------------------------------

def extracted(drawings: DataFrame, tokens: DataFrame) -> dict[str, DataFrame]:
    """All primitives of the pages, computed once: bodies, pins (ticks and balls), ends (of wires), tokens with their class."""
    drawings, tokens = once(drawings), once(tokens)
    of = bodies(drawings)
    ends = once(wire_ends(drawings))
    return {"bodies": of, "pins": once(drawn_pins(drawings, of)), "ends": ends, "tokens": once(classified(tokens, of, ends))}


def tagged(found: dict[str, DataFrame]) -> DataFrame:
    """(page, kind, item, x, y, value): one row for each primitive; value is a side, a class, or nothing."""
    middle = _middle(found["bodies"]).select("page", F.lit("body").alias("kind"), F.col("body").alias("item"), "x", "y", F.lit(None).cast("string").alias("value"))
    pins = found["pins"].select("page", "kind", "item", "x", "y", F.col("side").alias("value"))
    ends = found["ends"].select("page", F.lit("wire").alias("kind"), F.col("word").alias("item"), "x", "y", F.lit(None).cast("string").alias("value"))
    texts = found["tokens"].select("page", F.lit("token").alias("kind"), F.col("word").alias("item"), "x", "y", F.col("class").alias("value"))
    return middle.unionByName(pins).unionByName(ends).unionByName(texts)


def numbered_pins(found: dict[str, DataFrame]) -> DataFrame:
    """(page, n, label, confidence, x, y, side): ticks, balls, then text pins, numbered within their page from 0."""
    drawn = found["pins"].select("page", F.when(F.col("kind") == "tick", 0).otherwise(1).alias("rank"), "item", F.lit(None).cast("string").alias("label"), F.lit(CONFIDENCE["drawn"]).alias("confidence"), "x", "y", "side")
    texts = text_pins(found["tokens"], found["bodies"]).select("page", F.lit(2).alias("rank"), F.col("word").alias("item"), F.col("txt").alias("label"), "confidence", "x", "y", "side")
    n = F.row_number().over(Window.partitionBy("page").orderBy("rank", "item")) - 1
    return once(drawn.unionByName(texts).select("page", n.cast("long").alias("n"), "label", "confidence", "x", "y", "side"))


def mapped(found: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Pins of named parts (page, pin, refdes, label, full, confidence), and bodies with their names (page, body, refdes and rectangle)."""
    pins, named = numbered_pins(found), once(part_names(found["tokens"], found["bodies"]))
    rows = pins.join(assigned(pins, found["bodies"], ["page", "n"]), ["page", "n"]).join(named, ["page", "body"])
    label = F.coalesce("label", F.concat(F.lit("PIN"), F.col("n")))
    maps = rows.select("page", F.concat(F.lit("p"), F.col("page"), F.lit("_pin_"), F.col("n")).alias("pin"), "refdes", label.alias("label"), F.concat("refdes", F.lit("-"), label).alias("full"), "confidence")
    return maps, found["bodies"].join(named, ["page", "body"])


def body_rects(named: DataFrame) -> DataFrame:
    """(page, refdes, x0, y0, x1, y1): the last body, so the smallest, of each name on a page."""
    return S.best(named, ["page", "refdes"], [G.area(G.rect()), -F.col("body")], ["x0", "y0", "x1", "y1"])


def store(df: DataFrame, path: str) -> None:
    """df in folders of pages, its rows in order of page, so that reading some pages skips folders and row groups."""
    df = df.withColumn("folder", F.floor(F.col("page") / PAGES_PER_FOLDER))
    df.repartition("folder").sortWithinPartitions("folder", "page").write.partitionBy("folder").parquet(path)


def of_pages(spark: SparkSession, path: str, gate: DataFrame) -> DataFrame:
    """The stored rows of the pages (page) of a gate; where those are few enough to broadcast, only their folders are read.

    The gate is a filter of a table that is computed already: its filter is what lets a scan be pruned by it.
    """
    gate = gate.select("page", F.floor(F.col("page") / PAGES_PER_FOLDER).alias("folder"))
    gate = F.broadcast(gate) if gate.count() <= BROADCAST_ROWS else gate
    return spark.read.parquet(path).join(gate, ["folder", "page"], "left_semi").drop("folder")


def analyzed(spark: SparkSession, drawings: str, tokens: str, gate: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pin map and body rectangles of stored drawings and tokens, of all pages or of a gate's."""
    read = (lambda path: spark.read.parquet(path).drop("folder")) if gate is None else (lambda path: of_pages(spark, path, gate))
    maps, named = mapped(extracted(read(drawings), read(tokens)))
    return maps, body_rects(named)
