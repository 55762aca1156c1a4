"""Queries of spatial joins, page kernels and the tables made from extraction results."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import geometry as G
from tessera.functions import labels as L
from tessera.operators import cluster as P
from tessera.operators import explode as E
from tessera.operators import spatial as S
from tessera.plans.audits import B, bom
from tessera.plans.registry import add

WB, BX, WD = ("v_words", "v_boxes"), ("v_boxes",), ("v_words",)
words, boxes = (lambda v: v.v_words), (lambda v: v.v_boxes)
refs, pins = (lambda v: v.v_words.filter("txt LIKE 'R%'")), (lambda v: v.v_words.filter("txt LIKE 'U%'"))
_area = "(x1 - x0) * (y1 - y0)"
_in = "w.x BETWEEN b.x0 AND b.x1 AND w.y BETWEEN b.y0 AND b.y1"
_gap = "sqrt(pow(greatest(b.x0 - w.x, 0, w.x - b.x1), 2) + pow(greatest(b.y0 - w.y, 0, w.y - b.y1), 2))"
_sm = f"sm AS (SELECT word, box FROM (SELECT w.word, b.box, row_number() OVER (PARTITION BY w.word ORDER BY {_area}, x0, y0, box) AS n FROM v_words w JOIN v_boxes b ON w.page = b.page AND {_in}) q WHERE n = 1)"
inside = lambda v: S.smallest_box(words(v), boxes(v), "word")
add("sj_point_in_rect", inside, f"WITH {_sm} SELECT word, box FROM sm", WB)
_labels = "role = 'label'"
add("sj_label_to_box", lambda v: S.smallest_box(words(v).filter(_labels), boxes(v), "word", "txt").groupBy("box").agg(F.min("txt").alias("label")),
    f"WITH {_sm} SELECT box, min(txt) AS label FROM sm JOIN v_words USING (word) WHERE {_labels} GROUP BY 1", WB)
add("sj_prov", lambda v: S.point_pairs(refs(v), words(v).filter(_labels), 15.0).select("word").distinct(),
    f"SELECT DISTINCT a.word FROM v_words a JOIN v_words b ON a.page = b.page AND a.x BETWEEN b.x - 15 AND b.x + 15 AND a.y BETWEEN b.y - 15 AND b.y + 15 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 15 WHERE a.txt LIKE 'R%' AND b.{_labels}", WD)
_bias = "sqrt(pow(w.x - (b.x0 + b.x1) / 2, 2) + pow(w.y - (b.y0 + b.y1) / 2, 2)) * CASE WHEN w.x <= (b.x0 + b.x1) / 2 AND w.y <= (b.y0 + b.y1) / 2 THEN 0.8 ELSE 1 END"
_biased = lambda: G.biased_distance(F.col("x"), F.col("y"), *G.centre(G.rect()))
_ends = lambda v: boxes(v).filter("x1 - x0 >= 150").select(F.col("box").alias("word"), "page", F.col("x0").alias("x"), F.col("y0").alias("y")).unionByName(boxes(v).filter("x1 - x0 >= 150").select(F.col("box").alias("word"), "page", F.col("x1").alias("x"), F.col("y0").alias("y")))
add("sj_near_wire", lambda v: S.point_pairs(words(v), _ends(v), 20.0).select("word").distinct(),
    "SELECT DISTINCT w.word FROM v_words w JOIN v_boxes b ON w.page = b.page AND b.x1 - b.x0 >= 150 AND (sqrt(pow(w.x - b.x0, 2) + pow(w.y - b.y0, 2)) <= 20 OR sqrt(pow(w.x - b.x1, 2) + pow(w.y - b.y0, 2)) <= 20)", WB)
add("sp_wires", _ends, "SELECT box AS word, page, x0 AS x, y0 AS y FROM v_boxes WHERE x1 - x0 >= 150 UNION ALL SELECT box, page, x1, y0 FROM v_boxes WHERE x1 - x0 >= 150", BX)
add("sj_near_body", lambda v: _flagged(v).filter("near").select("word"), f"SELECT DISTINCT w.word FROM v_words w JOIN v_boxes b ON w.page = b.page AND {_gap} <= 10", WB)


def _nearest_in_box(v):
    placed = S.smallest_box(words(v), boxes(v), "word", "x", "y", "txt")
    a = placed.filter("txt LIKE 'U%'").select("box", "word", "x", "y")
    b = placed.filter("txt LIKE 'R%'").select("box", F.col("word").alias("ref"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    d = (F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2
    return S.best(a.join(b, "box").withColumn("d", d), ["box", "word"], [F.col("d"), F.col("ref")], ["ref"]).drop("box")


add("sj_nearest_in_box", _nearest_in_box, f"WITH {_sm}, pw AS (SELECT w.*, box FROM v_words w JOIN sm USING (word)) SELECT word, ref FROM (SELECT a.word, b.word AS ref, row_number() OVER (PARTITION BY a.word ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.word) AS n FROM pw a JOIN pw b ON a.box = b.box WHERE a.txt LIKE 'U%' AND b.txt LIKE 'R%') q WHERE n = 1", WB)
_bbox = lambda v: pins(v).groupBy("page").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
_bb = "SELECT page, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v_words WHERE txt LIKE 'U%' GROUP BY 1"
add("agg_group_bbox", _bbox, _bb, WD)
add("sj_near_bbox", lambda v: S.near(refs(v), _bbox(v), 25.0).select("word"), f"WITH b AS ({_bb}) SELECT w.word FROM v_words w JOIN b ON w.page = b.page AND {_gap} <= 25 WHERE w.txt LIKE 'R%'", WD)

# page kernels
add("sp_bodies", lambda v: boxes(v).filter("x1 - x0 BETWEEN 20 AND 500 AND y1 - y0 BETWEEN 20 AND 500 AND (x1 - x0) / (y1 - y0) BETWEEN 0.8 AND 1.5").select("page", "box"),
    "SELECT page, box FROM v_boxes WHERE (x1 - x0) / (y1 - y0) BETWEEN 0.8 AND 1.5", BX)
add("sp_cluster", lambda v: P.cluster_pins(pins(v), unique=True))
add("sp_ticks", lambda v: S.best(S.near(words(v).filter("shape = 'tick'"), boxes(v), 5.0, cells=True), ["word"], [F.col("box")], ["box"]),
    f"SELECT w.word, min(b.box) AS box FROM v_words w JOIN v_boxes b ON w.page = b.page AND {_gap} <= 5 WHERE w.shape = 'tick' GROUP BY 1", WB)
add("sp_bga", lambda v: S.best(S.near(words(v).filter("shape = 'circle'"), boxes(v), 15.0, cells=True), ["word"], [F.col("box")], ["box"]),
    f"SELECT w.word, min(b.box) AS box FROM v_words w JOIN v_boxes b ON w.page = b.page AND {_gap} <= 15 WHERE w.shape = 'circle' GROUP BY 1", WB)
_class = "CASE WHEN txt LIKE 'R%' THEN 'REFDES' WHEN near THEN 'PIN' WHEN length(txt) > 5 THEN 'NET' ELSE 'JUNK' END"
_flagged = lambda v: S.touching(words(v).select("word", "page", "x", "y", "txt"), boxes(v), "near", 10.0)
_named = "SELECT a.word, r.txt || '-' || a.txt AS mapping FROM ({}) m JOIN v_words a ON a.word = m.word JOIN v_words r ON r.word = m.ref"
_clusters = lambda v: words(v).select(F.floor(F.col("x") / 120).alias("cx"), F.floor(F.col("y") / 120).alias("cy"), "page", "txt", "word")
add("sp_indexes", lambda v: _clusters(v).groupBy("page", "cx", "cy").agg(F.count("*").alias("n")), "SELECT page, floor(x / 120)::BIGINT AS cx, floor(y / 120)::BIGINT AS cy, count(*) AS n FROM v_words GROUP BY 1, 2, 3", WD)

# result tables
SN = ("v_snap_a", "v_bom")
_split = lambda v: v.v_snap_a.select(L.without_verified(F.col("grp")).alias("grp"), "ref", "pages").join(bom(v).select(F.col("base").alias("ref"), F.lit(True).alias("ok")).distinct(), "ref", "left")


def verified_split(v):
    """Every group with a Verified and an Unverified row, whether or not it has designators of the kind."""
    rows = _split(v).withColumn("status", F.when(F.col("ok"), "Verified").otherwise("Unverified"))
    both = rows.select("grp").distinct().withColumn("status", F.explode(F.array(F.lit("Verified"), F.lit("Unverified"))))
    found = rows.groupBy("grp", "status").agg(F.count_distinct("ref").alias("n"), E.joined_set("ref").alias("refs"))
    return both.join(found, ["grp", "status"], "left").select("grp", "status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("refs", F.lit("")).alias("refs"))


_rows = f"{B}, sp AS (SELECT replace(grp, ' (Verified)', '') AS grp, ref, pages, CASE WHEN ref IN (SELECT base FROM b) THEN 'Verified' ELSE 'Unverified' END AS status FROM v_snap_a)"
add("gen_verified_split", verified_split,
    f"WITH {_rows} SELECT g.grp, s.status, count(DISTINCT ref) AS n, coalesce(string_agg(DISTINCT ref, ', ' ORDER BY ref), '') AS refs FROM (SELECT DISTINCT grp FROM sp) g CROSS JOIN (SELECT 'Verified' AS status UNION ALL SELECT 'Unverified') s LEFT JOIN sp ON sp.grp = g.grp AND sp.status = s.status GROUP BY 1, 2", SN)
add("agg_group_verification", lambda v: verified_split(v).groupBy("grp").agg(F.max((F.col("status") == "Verified") & (F.col("n") > 0)).alias("verified")), f"WITH {_rows} SELECT grp, bool_or(status = 'Verified') AS verified FROM sp GROUP BY 1", SN)
_merged = lambda v: v.v_snap_a.unionByName(v.v_snap_b).select(L.without_verified(F.col("grp")).alias("grp"), "ref", F.explode(F.split("pages", ", ")).alias("page"))
_un = "SELECT replace(grp, ' (Verified)', '') AS grp, ref, pages AS page FROM v_snap_a UNION ALL SELECT replace(grp, ' (Verified)', ''), ref, pages FROM v_snap_b"
add("merge_results_legacy", lambda v: _merged(v).groupBy("grp").agg(E.joined_set("ref").alias("refs"), E.joined_set("page").alias("pages")),
    f"SELECT grp, string_agg(DISTINCT ref, ', ' ORDER BY ref) AS refs, string_agg(DISTINCT page, ', ' ORDER BY page) AS pages FROM ({_un}) q GROUP BY 1", ("v_snap_a", "v_snap_b"))


def _reconciled(v):
    """Of a group's designators those verified anywhere are not unverified."""
    rows = v.v_snap_a.unionByName(v.v_snap_b).select(L.without_verified(F.col("grp")).alias("grp"), "ref", F.col("grp").contains("(Verified)").alias("ok"))
    sets = rows.groupBy("grp").agg(F.collect_set(F.when(F.col("ok"), F.col("ref"))).alias("yes"), F.collect_set("ref").alias("any"))
    return sets.select("grp", F.array_join(F.array_sort("yes"), ", ").alias("verified"), F.array_join(F.array_sort(F.array_except("any", "yes")), ", ").alias("unverified"))


add("merge_results", _reconciled,
    """WITH u AS (SELECT replace(grp, ' (Verified)', '') AS grp, ref, bool_or(contains(grp, '(Verified)')) AS ok FROM (SELECT grp, ref FROM v_snap_a UNION ALL SELECT grp, ref FROM v_snap_b) q GROUP BY 1, 2)
    SELECT grp, coalesce(string_agg(ref, ', ' ORDER BY ref) FILTER (ok), '') AS verified, coalesce(string_agg(ref, ', ' ORDER BY ref) FILTER (NOT ok), '') AS unverified FROM u GROUP BY 1""", ("v_snap_a", "v_snap_b"))  # fmt: skip
add("gen_page_mismatch", lambda v: v.v_snap_a.select("ref", F.array("pages").alias("p")).join(v.v_bom.select(F.col("ref_des").alias("ref"), F.array("page").alias("q")), "ref").filter(~F.arrays_overlap("p", "q")).select("ref", F.col("p")[0].alias("seen"), F.col("q")[0].alias("listed")),
    "SELECT ref, pages AS seen, page AS listed FROM v_snap_a JOIN v_bom ON ref = ref_des WHERE pages <> page", SN)
_dups = lambda v: v.v_snap_a.unionByName(v.v_snap_b).select("grp", "ref", F.col("pages").cast("long").alias("page"))
_w = lambda: Window.partitionBy("ref").orderBy("page", "grp")
_du = "SELECT ref, grp, page, row_number() OVER (PARTITION BY ref ORDER BY page, grp) AS n, first_value(grp) OVER (PARTITION BY ref ORDER BY page, grp) AS f FROM (SELECT grp, ref, pages::BIGINT AS page FROM v_snap_a UNION ALL SELECT grp, ref, pages::BIGINT FROM v_snap_b) q"
add("win_dup_ordinal", lambda v: _dups(v).withColumn("n", F.row_number().over(_w())).withColumn("f", F.first("grp").over(_w())).filter("n > 1").select("ref", F.concat(L.ordinal(F.col("n")), F.lit(" extraction, first seen in "), "f").alias("note")),
    f"SELECT ref, CASE n WHEN 2 THEN '2nd' WHEN 3 THEN '3rd' ELSE n || 'th' END || ' extraction, first seen in ' || f AS note FROM ({_du}) z WHERE n > 1", ("v_snap_a", "v_snap_b"))
add("gen_notes", lambda v: _split(v).groupBy("grp").agg(F.count_distinct(F.when(F.col("ok").isNull(), F.col("ref"))).alias("bad")).select("grp", F.concat_ws(" ", F.when(F.col("bad") > 0, F.concat(F.col("bad"), F.lit(" not in BOM.")))).alias("note")),
    f"WITH {_rows} SELECT grp, CASE WHEN count(DISTINCT CASE WHEN status <> 'Verified' THEN ref END) > 0 THEN count(DISTINCT CASE WHEN status <> 'Verified' THEN ref END) || ' not in BOM.' ELSE '' END AS note FROM sp GROUP BY 1", SN)
add("gen_component_detail", lambda v: _split(v).select("grp", "ref", "pages", F.coalesce("ok", F.lit(False)).alias("verified")), f"WITH {_rows} SELECT grp, ref, pages, status = 'Verified' AS verified FROM sp", SN)
_disp = "CASE WHEN txt LIKE 'R%' THEN 'designator' WHEN near THEN 'kept' WHEN word % 3 = 0 THEN 'excluded' ELSE 'no parent' END"
add("gen_orphan_pins", lambda v: _flagged(v).withColumn("d", F.expr(_disp)).groupBy("d").agg(F.count("*").alias("n")).select(F.col("d").alias("disposition"), "n"),
    f"WITH nr AS (SELECT DISTINCT w.word FROM v_words w JOIN v_boxes b ON w.page = b.page AND {_gap} <= 10) SELECT {_disp} AS disposition, count(*) AS n FROM (SELECT w.*, w.word IN (SELECT word FROM nr) AS near FROM v_words w) q GROUP BY 1", WB)
_ladder = "CASE WHEN txt LIKE 'R%' THEN 'refdes' WHEN box IS NOT NULL THEN 'box' WHEN near THEN 'pin' ELSE 'dropped' END"
add("sp_harvest", lambda v: _flagged(v).join(inside(v), "word", "left").select("word", F.expr(_ladder).alias("disposition")),
    f"WITH {_sm}, nr AS (SELECT DISTINCT w.word FROM v_words w JOIN v_boxes b ON w.page = b.page AND {_gap} <= 10) SELECT word, {_ladder} AS disposition FROM (SELECT w.*, sm.box, w.word IN (SELECT word FROM nr) AS near FROM v_words w LEFT JOIN sm ON w.word = sm.word) q", WB)
