"""Extraction in two passes: all pages by the pin list, then geometry on the pages where that left most labels alone.

1. Every pin label is given to a part by votes of the pin list, where that settles it.
2. Pages are gated by what was left, and ranked.
3. Drawings and texts of the pages chosen are analyzed: bodies, pins, names.
4. Labels of those pages that were left take the pin of their page that has their text, else the parent of their group,
   else the nearest designator in its box; what the pin list does not have is filtered.  Other pages keep their first results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import tokens as T
from tessera.operators import pages as A
from tessera.operators import parents as R
from tessera.operators import qualify as Q
from tessera.operators import spatial as S
from tessera.operators.qualify import GROUP
from tessera.sources.readers import broadcast_if_small, once


def _boxed(entries: DataFrame, without: DataFrame) -> DataFrame:
    """(page, grp, word, boxed): of the labels of groups that have no parent the nearest designator in the box of their group."""
    boxes = R.group_boxes(entries).join(without.hint("merge"), GROUP, "left_anti")
    texts = entries.filter("is_part").select("page", "x", "y", F.col("word").alias("t_word"), F.upper("txt").alias("boxed"))
    held = S.near(texts, boxes).select(*GROUP, F.col("x").alias("t_x"), F.col("y").alias("t_y"), "t_word", "boxed")
    met = entries.filter("is_label").select(*GROUP, "word", "x", "y").join(held, GROUP)
    return S.best(met, [*GROUP, "word"], [(F.col("x") - F.col("t_x")) ** 2 + (F.col("y") - F.col("t_y")) ** 2, F.col("t_word")], ["boxed"])


def by_geometry(entries: DataFrame, maps: DataFrame, bodies: DataFrame, pins: DataFrame, listed: DataFrame) -> DataFrame:
    """(page, grp, word, value, source) of every pin label (``parents.read``): what it is by the drawing, and how that was found.

    Labels of parts without pins (``passive prefix``) and those that the pin list does not have (``filtered``) have no value.
    """
    parents = once(R.parents_of(entries, bodies, pins, listed).select(*GROUP, "parent"))
    rows = entries.filter("is_label AND grp IS NOT NULL").select(*GROUP, "word", "txt")
    rows = rows.join(R.chosen_pins(entries, maps, bodies, listed).select(*GROUP, "word", "full"), [*GROUP, "word"], "left")
    rows = rows.join(parents, GROUP, "left").join(_boxed(entries, parents.select(*GROUP)), [*GROUP, "word"], "left")
    named = F.coalesce("full", "parent")
    of = lambda c: F.concat(c, F.lit("-"), "txt")
    how = F.when(F.col("full").isNotNull(), "geometry").when(F.col("parent").isNotNull(), "parent").when(F.col("boxed").isNotNull(), "box text").otherwise("unqualified")
    rows = rows.withColumn("value", F.coalesce("full", of("parent"), of("boxed"), of(F.lit("PIN"))))
    rows = rows.select(*GROUP, "word", "value", how.alias("how"), (named.isNotNull() & ~T.analyze_pins(T.prefix(named))).alias("passive"), R.part_name(F.regexp_extract("value", "^(.+)-[^-]+$", 1)).alias("parent"), F.upper("txt").alias("label"))
    index = broadcast_if_small(Q.pinlist_index(pins).withColumn("known", F.lit(True)))
    source = F.when(F.col("passive"), "passive prefix").when(F.col("known").isNull(), "filtered").otherwise(F.col("how"))
    rows = rows.join(index, ["label", "parent"], "left").withColumn("source", source)
    return rows.select(*GROUP, "word", F.when(F.col("source") == F.col("how"), F.col("value")).alias("value"), "source")


def extracted(entries: DataFrame, pins: DataFrame, bom: DataFrame, drawings: DataFrame, tokens: DataFrame, pages: DataFrame, most: int = 10) -> DataFrame:
    """(page, grp, word, value, source) of every pin label of the pages (page), ``most`` of them with geometry.

    source: ``pin list``, or one of ``by_geometry``; ``suppressed`` for labels of passive clusters, ``dropped`` for those
    that nothing was found for.
    """
    entries = once(entries)
    labels, of = Q.qualified_clusters(entries, pins)
    of = once(of)
    flagged = once(S.ranked_pages(S.gated_pages(once(Q.features_of(pages, of))), most).select("page"))
    here = lambda df: df.join(broadcast_if_small(flagged), "page", "left_semi")
    maps, named = A.mapped(A.extracted(here(drawings), here(tokens)))
    late = by_geometry(R.read(here(entries)), once(maps), once(A.body_rects(named)), pins, R.listed_pages(bom))
    late = broadcast_if_small(late.select(*GROUP, "word", F.col("value").alias("late"), F.col("source").alias("how")))
    rows = Q.given(labels, of).join(late, [*GROUP, "word"], "left")
    listed = F.col("parent").isNotNull()
    value = F.when(listed, F.concat("parent", F.lit("-"), "label")).when(~F.col("suppressed"), F.col("late"))
    source = F.when(listed, "pin list").when(F.col("suppressed"), "suppressed").otherwise(F.coalesce("how", F.lit("dropped")))
    return rows.select(*GROUP, "word", value.alias("value"), source.alias("source"))
