"""The derived views and the queries on them cover the whole driver tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster, components, pages, qualify
from tessera.operators import spatial as S
from tessera.plans import page_geometry, registry
from tessera.sources.fixtures import Views
from tessera.sources.readers import once

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


def test_words_and_boxes_are_whole_tables(views):
    for view, table in (("v_words", "lineitem"), ("v_boxes", "orders")):
        rows = getattr(views, view)
        assert rows.count() == views.table(table).count()
        assert {r["page"] for r in rows.select("page").distinct().collect()} == set(range(4))


def test_words_have_numbers_of_their_own(views):
    for view in ("v_words", "v_entry"):
        assert getattr(views, view).select("word").distinct().count() == views.table("lineitem").count()


def test_clusters_hold_every_pin(spark, views):
    got = registry.queries()["sp_cluster"](spark, SF).select("page", "word")
    pins = views.v_words.filter("txt LIKE 'U%'").select("page", "word")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pins.collect()))


def test_shapes_are_a_class_of_the_view(views):
    assert {r["shape"] for r in views.v_words.select("shape").distinct().collect()} == {"tick", "circle", "text"}


def test_no_box_is_dropped_unless_it_overlaps(spark):
    boxes = spark.range(5100).selectExpr("1L AS page", "id AS box", "id % 100 * 50.0D AS x0", "floor(id / 100) * 50.0D AS y0", "id % 100 * 50.0D + 40 AS x1", "floor(id / 100) * 50.0D + 40 AS y1")
    assert cluster.suppress_overlaps(boxes).count() == 5100
    assert {r["box"] for r in cluster.suppress_overlaps(boxes, most=7).collect()} == set(range(7))


def test_clusters_equal_single_linkage(spark):
    r = np.random.default_rng(1)
    rows = [(p, k, float(x), float(y)) for p, n in enumerate((5, 30, 80)) for k, (x, y) in enumerate(r.uniform(-900, 900, (n, 2)).tolist())]
    root = {(p, k): k for p, k, _, _ in rows}
    cell = lambda v: v // cluster.PIN_CELL
    close = [((p, k), (q, m)) for p, k, x, y in rows for q, m, u, w in rows if p == q and k < m and abs(cell(x) - cell(u)) <= 1 and abs(cell(y) - cell(w)) <= 1 and np.hypot(x - u, y - w) <= cluster.PIN_REACH]
    for _ in rows:
        for a, b in close:
            root[a] = root[b] = min(root[a], root[b])
    pins = spark.createDataFrame(rows, "page long, word long, x double, y double")
    assert {tuple(x) for x in cluster.cluster_pins(pins).collect()} == {(*a, c) for a, c in root.items()}


def test_components(spark):
    r = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (380, 2))] + [(k, k + 1) for k in range(1000, 1200)]
    root = {n: n for e in edges for n in e}
    for _ in range(250):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["root"] for x in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_every_status_of_qualified_pins_occurs(spark, views):
    entries = once(views.v_entry)
    for n in (1, 7):
        labels, of = qualify.qualified_clusters(entries.repartition(n), views.v_pinlist)
        rows = of.collect()
        assert {x["status"] for x in rows} == {None, "resolved", "ambiguous_tie", "no_nearby_candidates", "no_hits"}
        assert {x["kind"] for x in rows} == {"ic_like", "passive_like", "ambiguous"}
        assert {"passive_cluster", "ambiguous_tie", "no_parent_resolved", "ambiguous_low_hits", None} <= {x["drop_reason"] for x in rows}
        assert labels.select("cluster").distinct().count() == len(rows)
    empty = qualify.qualify(entries.limit(0), views.v_pinlist)
    assert empty.count() == 0 and qualify.qualify(entries, views.v_pinlist.limit(0)).filter("parent IS NOT NULL").count() == 0


def _shuffled(spark) -> int:
    """Records written to shuffles by the session so far."""
    none = spark._jvm.java.util.ArrayList()
    stages = spark._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pages_are_counted_with_few_shuffles_of_their_labels(spark, views):
    before = _shuffled(spark)
    assert page_geometry.page_counts(views).count() > 0
    assert _shuffled(spark) - before < 6 * views.v_entry.count()


def test_large_groups_are_clustered_like_small_ones(views):
    entries = qualify.marked(views.v_entry)
    lists, mixed, joins = ({tuple(r) for r in qualify.clusters_of(entries, most).collect()} for most in (128, 8, 0))
    assert lists == mixed == joins and len(lists) > 2000


def test_bom_of_a_generation_is_not_broadcast(spark):
    """Neither as planned nor as run, where sizes are known to be small."""
    for name, most in (("join_bom_index", 0), ("fn_usage_check", 1)):
        df = registry.queries()[name](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # the part list, one row a part number, may be
        assert plan.count("BroadcastHashJoin") <= most, name


def test_a_point_is_compared_until_a_rectangle_is_met(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, 31.0, 0.0), (3, 2, 0.0, 0.0), (4, None, 0.0, 0.0), (5, 1, None, 0.0)], "word long, page long, x double, y double")
    rects = spark.createDataFrame([(1, k, 0.0, 0.0, 20.0 + k, 5.0) for k in range(3)], "page long, box long, x0 double, y0 double, x1 double, y1 double")
    for also, want in ((None, {1, 2}), (F.col("box") == 0, {1})):
        met = S.touching(points, rects, "near", 10.0, also=also)
        assert {r["word"]: r["near"] for r in met.collect()} == {k: k in want for k in range(1, 6)}
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi" in plan and "Aggregate" not in plan


def test_types_of_every_part_number(views):
    rows = [tuple(r) for r in views.v_hda.select("part_number", "row_no").collect()]
    least = {}
    for number, k in views.v_bom.select("part_number", "k").collect():
        least[number] = min(k, least.get(number, k))
    assert sorted(rows) == sorted((number, k + 2) for number, k in least.items() if k % 41)


def test_gated_pages_are_pruned_where_they_are_read(spark, views, tmp_path):
    gate = S.gated_pages(once(page_geometry.page_counts(views)))
    kept = {r["page"] for r in gate.collect()}
    assert kept == {0, 1, 2}  # page 3 has no pin labels
    path = f"file://{tmp_path}/drawings"
    drawings = views.v_drawing.unionByName(views.v_drawing.withColumn("page", F.col("page") + 40))
    pages.store(drawings, path)
    read = pages.of_pages(spark, path, gate)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert any("dynamicpruning" in line.split("PartitionFilters:")[1] for line in plan.splitlines() if "PartitionFilters:" in line)
    assert read.count() == views.v_drawing.filter("page < 3").count()
    assert pages.of_pages(spark, path, gate.limit(0)).count() == 0


def test_pages_hold_every_case(views):
    found = pages.extracted(views.v_drawing, views.v_token)
    rectangles = views.v_drawing.filter("kind = 're' AND abs(x1 - x0) BETWEEN 20 AND 500 AND y1 - y0 BETWEEN 20 AND 500 AND abs(x1 - x0) / (y1 - y0) BETWEEN 0.3 AND 3").count()
    assert 0 < found["bodies"].count() < rectangles  # some are suppressed
    assert {r["kind"] for r in found["pins"].collect()} == {"tick", "ball"}
    assert {r["side"] for r in found["pins"].collect()} == {"left", "right", "top", "bottom"}
    assert {(r["class"], r["confidence"]) for r in found["tokens"].collect()} == {("REFDES", 0.9), ("PIN_LABEL", 0.85), ("PIN_LABEL", 0.75), ("PIN_LABEL", 0.7), ("NET_LABEL", 0.7), ("JUNK", 0.0)}
    nothing = pages.mapped(pages.extracted(views.v_drawing.limit(0), views.v_token.limit(0)))
    assert nothing[0].count() == 0 and nothing[1].count() == 0


@pytest.mark.parametrize("name", ["sj_parent", "sj_disambiguate", "sp_harvest", "sj_point_in_rect", "sj_nearest_in_box"])
def test_no_rectangle_in_cells_is_broadcast(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_pairs_of_a_point_are_not_shuffled_again(spark, views):
    plan = S.smallest_box(views.v_words, views.v_boxes, "word")._jdf.queryExecution().executedPlan().toString()
    # the number of a word, the rank of a box, and both sides of the join
    assert plan.count("Exchange hashpartitioning") == 4


@pytest.mark.parametrize("name", ["fn_iou", "fn_rects", "fn_pin_score", "fn_bias_distance"])
def test_pairs_of_boxes_are_whole(spark, views, name):
    pages = [r["count"] for r in views.v_boxes.groupBy("page").count().collect()]
    assert registry.queries()[name](spark, SF).count() == sum(n * (n - 1) // 2 for n in pages)


def test_parts_of_pins_are_listed_in_few_cells(spark):
    pins = spark.createDataFrame([(1, k, 40.0 * (k % 9), 40.0 * (k // 9)) for k in range(81)], "page long, word long, x double, y double")
    parts = pins.selectExpr("page", "word AS root", "CAST(x / 40 AS LONG) AS sx", "CAST(y / 40 AS LONG) AS sy")
    for far in (True, False):
        pairs = cluster._pairs_of_parts(parts, ["page"], far)
        got = {tuple(r) for r in pairs.select("root", "t_root").collect()}
        near = lambda a, b: (abs(a % 9 // 3 - b % 9 // 3) <= 1) and (abs(a // 27 - b // 27) <= 1)
        gap = lambda d: d + 1 if far else max(d - 1, 0)
        want = {tuple(sorted((a, b), key=lambda k: (k % 9, k // 9))) for a in range(81) for b in range(a) if near(a, b) and np.hypot(gap(abs(a % 9 - b % 9)), gap(abs(a // 9 - b // 9))) * 40 <= cluster.PIN_REACH}
        assert got == want and pairs.count() == len(want)
    assert parts.select("root").distinct().count() == 81 and dict(parts.dtypes)["root"] == "bigint"
