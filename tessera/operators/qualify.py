"""Pin labels given to parent parts by votes of a pin list, cluster by cluster.

Labels of a group on a page are clustered by distance.  A cluster of terminal labels, or of a few numbers
beside two-terminal parts, is passive and suppressed.  Any other is given to the part near its group for
which the pin list has most of its labels; where two parts have as many, none is guessed.

Votes are counted over the labels of a cluster and the parts near its group, both bounded by the drawing,
and only then looked up in the pin list; so a label that all parts have is not joined with all of them.
Blank texts and labels of no group are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import tokens as T
from tessera.operators import spatial as S
from tessera.operators.cluster import LIST_PINS, cluster_groups, cluster_pins
from tessera.sources.readers import broadcast_if_small, once

#: Distances to two-terminal parts and from a group to its parents, and labels that an unclear cluster needs.
PASSIVE_REACH, PARENT_REACH, LEAST_LABELS, LEAST_NUMBERS = 120.0, 300.0, 2, 3
GROUP = ["page", "grp"]
#: The grid on which groups meet parents; a group's box, with the reach around it, touches a few cells.
PARENT_CELL = 3 * PARENT_REACH
#: The text of a label from a ball grid.
GRID_TEXT = "^[A-Z]{1,2}[0-9]{1,2}$"


def pinlist_index(pins: DataFrame) -> DataFrame:
    """(label, parent) of pin identifiers parent-label, cut at the last hyphen; one row each."""
    cut = pins.select(F.regexp_extract("pin", "^(.+)-([^-]+)$", 1).alias("parent"), F.regexp_extract("pin", "^(.+)-([^-]+)$", 2).alias("label"))
    return cut.filter("parent <> ''").select("label", "parent").distinct()


def is_designator(text: Column) -> Column:
    return T.valid_designator(text) & T.known_prefix(T.prefix(text))


def may_be_parent(text: Column) -> Column:
    return F.coalesce(T.prefix(text).isin(*T.PARENT_PREFIXES), F.lit(False))


def marked(entries: DataFrame) -> DataFrame:
    """(page, grp, word, x, y, txt) of entries, trimmed and in capitals, with whether the text is a pin label, may be a parent or is passive.

    Texts are read once; that of an entry which is neither label nor parent is not kept.
    """
    text = F.col("txt")
    read = entries.select(*GROUP, "word", "x", "y", T.clean(text).alias("txt"))
    read = read.withColumn("part", is_designator(text)).withColumn("known", T.prefix(text))
    label = (text != "") & ~F.col("part") & T.pin_candidate(text)
    parent = F.col("part") & F.col("known").isin(*T.PARENT_PREFIXES)
    passive = (F.col("part") & F.col("known").isin(*T.NO_PIN_PREFIXES)) | (~F.col("part") & text.rlike(T.VALUE_TEXT))
    flags = {"is_label": label, "is_parent": parent, "is_passive": passive}
    read = read.select(*GROUP, "word", "x", "y", "txt", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()))
    return once(read.withColumn("txt", F.when(F.col("is_label") | F.col("is_parent"), F.upper("txt"))))


def _sets(labels: DataFrame) -> DataFrame:
    """labels with what their clusters are (n_labels, numeric, terminals), and whether one is the first of its text there."""
    of = Window.partitionBy(*GROUP, "cluster")
    labels = labels.repartition(*GROUP)  # for both windows
    labels = labels.withColumn("first", F.row_number().over(Window.partitionBy(*GROUP, "cluster", "label").orderBy("word")) == 1)
    return labels.select(
        "*", F.sum(F.col("first").cast("int")).over(of).alias("n_labels"), F.bool_and(F.col("label").rlike("^[0-9]+$")).over(of).alias("numeric"),
        F.bool_and(F.col("label").isin(*T.TERMINALS)).over(of).alias("terminals"),
    )


def clusters_of(entries: DataFrame, most: int = LIST_PINS) -> DataFrame:
    """(page, grp, word, x, y, label, cluster, first, n_labels, numeric, terminals): the pin labels of the entries (``marked``).

    Groups of up to ``most`` labels are clustered as lists, larger ones by joins on grid cells.
    """
    placed = "is_label AND grp IS NOT NULL AND page IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"
    labels = entries.filter(placed).select(*GROUP, "word", "x", "y", F.col("txt").alias("label"))
    found = once(_sets(cluster_groups(labels, tuple(GROUP), most)))
    large, found = found.filter("word IS NULL").select(*GROUP), found.filter("word IS NOT NULL")
    if large.isEmpty():
        return found
    rest = once(labels.join(large, GROUP, "left_semi"))
    return once(found.unionByName(_sets(rest.join(cluster_pins(rest, tuple(GROUP), unique=True).select("word", "cluster"), "word"))))


def classified(labels: DataFrame, entries: DataFrame) -> DataFrame:
    """(page, grp, cluster, n_labels, numeric, kind, pins, grid) of the clusters of labels: ic_like, passive_like or ambiguous.

    pins and grid: how many labels a cluster has, and how many that look like a ball grid's.  Passive parts are looked
    for only beside clusters whose labels leave their kind open.
    """
    open_ = labels.filter("NOT terminals AND n_labels < 4").select(*GROUP, "x", "y", "cluster")
    beside = S.point_pairs(open_, entries.filter("is_passive"), PASSIVE_REACH).select(*GROUP, "cluster").distinct().withColumn("beside", F.lit(True))
    owned = entries.filter("is_parent").select(*GROUP).distinct().withColumn("owned", F.lit(True))
    same = lambda c: F.first(c).alias(c)
    of = labels.groupBy(*GROUP, "cluster").agg(
        same("n_labels"), same("numeric"), same("terminals"), F.count("*").alias("pins"), F.count_if(F.col("label").rlike(GRID_TEXT)).alias("grid"),
    )
    kind = (
        F.when(F.col("terminals"), F.when(F.col("owned"), "ambiguous").otherwise("passive_like")).when(F.col("n_labels") >= 4, "ic_like")
        .when(F.col("beside") & F.col("numeric") & (F.col("n_labels") <= 2), "passive_like").when(F.col("beside"), "ambiguous").otherwise("ic_like")
    )
    return of.join(beside, [*GROUP, "cluster"], "left").join(owned, GROUP, "left").select(*GROUP, "cluster", "n_labels", "numeric", kind.alias("kind"), "pins", "grid")


def parents_near(entries: DataFrame) -> DataFrame:
    """(page, grp, parent): the parts that may be parents on the page, within reach of the box around a group's entries (``marked``); dealt by group."""
    boxes = entries.filter("grp IS NOT NULL").groupBy(*GROUP).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    parts = entries.filter("is_parent").select("page", "x", "y", F.col("txt").alias("parent"))
    return S.near(parts, boxes, PARENT_REACH, cell=PARENT_CELL).select(*GROUP, "parent").repartition(*GROUP).distinct()


def resolved(labels: DataFrame, near: DataFrame, index: DataFrame) -> DataFrame:
    """(page, grp, cluster, parent, hits, status) of the clusters of labels (``clusters_of``).

    status: resolved; ambiguous_tie, where two parents have the most labels; no_nearby_candidates, where the pin
    list has some label for parents elsewhere only; no_hits.  Votes are counted where labels meet parents, by group:
    they are many more than either, so a pin list of few rows is sent to them.
    """
    by = [*GROUP, "cluster"]
    index = broadcast_if_small(index)
    of = labels.filter("first").select(*by, "label")
    votes = of.join(near, GROUP).join(index, ["label", "parent"]).groupBy(*by, "parent").agg(F.count("*").alias("hits"))
    # how many parents have so many hits, and the first of them: combines where it is counted
    ranks = votes.groupBy(*by, "hits").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
    best = ranks.groupBy(*by).agg(F.max_by(F.struct("hits", "n", "parent"), "hits").alias("b")).select(*by, "b.*")
    listed = broadcast_if_small(index.filter(may_be_parent(F.col("parent"))).select("label").distinct().withColumn("listed", F.lit(True)))
    elsewhere = of.join(listed, "label", "left").groupBy(*by).agg(F.bool_or(F.coalesce("listed", F.lit(False))).alias("listed"))
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous_tie").when(F.col("listed"), "no_nearby_candidates").otherwise("no_hits")
    return elsewhere.join(best, by, "left").select(*by, F.when(F.col("n") == 1, F.col("parent")).alias("parent"), F.coalesce("hits", F.lit(0)).alias("hits"), status.alias("status"))


def drop_reason() -> Column:
    """Why a cluster (kind, parent, hits, status, numeric) is not accepted; null if it is."""
    unclear = F.col("kind") == "ambiguous"
    return (
        F.when(F.col("kind") == "passive_like", "passive_cluster").when(F.col("status") == "ambiguous_tie", "ambiguous_tie").when(F.col("parent").isNull(), "no_parent_resolved")
        .when(unclear & (F.col("hits") < LEAST_LABELS), "ambiguous_low_hits").when(unclear & F.col("numeric") & (F.col("hits") < LEAST_NUMBERS), "ambiguous_numeric")
    )


def qualified_clusters(entries: DataFrame, pins: DataFrame, most: int = LIST_PINS) -> tuple[DataFrame, DataFrame]:
    """The labels with their clusters, and for each cluster kind, parent, hits, status and drop_reason; passive ones are not resolved."""
    entries = marked(entries)
    labels = clusters_of(entries, most)
    found = resolved(labels, parents_near(entries), pinlist_index(pins))
    kinds = classified(labels, entries).join(found, [*GROUP, "cluster"], "left")
    active = lambda c: F.when(F.col("kind") != "passive_like", F.col(c)).alias(c)
    return labels, kinds.select(*GROUP, "cluster", "n_labels", "numeric", "kind", "pins", "grid", *map(active, ("parent", "hits", "status"))).withColumn("drop_reason", drop_reason())


def qualify(entries: DataFrame, pins: DataFrame) -> DataFrame:
    """(page, grp, word, label, cluster, kind, parent, suppressed, drop_reason) of every pin label.

    entries: (page, grp, word, x, y, txt), all words of the pages; pins: (pin) identifiers parent-label.
    A label has a parent if its cluster is accepted; those of passive clusters are suppressed, others say why not.
    """
    return given(*qualified_clusters(entries, pins))


def given(labels: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of ``qualify``, of labels and their clusters (``qualified_clusters``)."""
    of = of.select(*GROUP, "cluster", "kind", F.when(F.col("drop_reason").isNull(), F.col("parent")).alias("parent"), (F.col("kind") == "passive_like").alias("suppressed"), F.when(F.col("kind") != "passive_like", F.col("drop_reason")).alias("drop_reason"))
    return labels.join(of, [*GROUP, "cluster"]).select(*GROUP, "word", "label", "cluster", "kind", "parent", "suppressed", "drop_reason")


def page_features(pages: DataFrame, entries: DataFrame, pins: DataFrame) -> DataFrame:
    """(page, pins, parented, orphans, ratio, tied, grid) of every page (page), those without labels too.

    Of the pin labels of a page: how many were given a parent or not, stand in clusters whose parents tie, or look like
    a ball grid's.
    """
    return features_of(pages, qualified_clusters(entries, pins)[1])


def features_of(pages: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of ``page_features``, of clusters (``qualified_clusters``)."""
    within = lambda ok: F.sum(F.when(ok, F.col("pins")).otherwise(0))
    parented, tied = within(F.col("drop_reason").isNull() & F.col("parent").isNotNull()), within(F.col("status") == "ambiguous_tie")
    seen = of.groupBy("page").agg(F.sum("pins").alias("pins"), parented.alias("parented"), tied.alias("tied"), F.sum("grid").alias("grid"))
    rows = pages.select("page").distinct().join(seen, "page", "left").na.fill(0)
    orphans = F.col("pins") - F.col("parented")
    return rows.select("page", "pins", "parented", orphans.alias("orphans"), F.coalesce(F.try_divide(orphans, F.col("pins")), F.lit(0.0)).alias("ratio"), "tied", "grid")
