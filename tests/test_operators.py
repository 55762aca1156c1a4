"""Operators on small hand-made tables, and independence of row order and partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import labels, numeric, tokens
from tessera.operators import audit, classify, cluster, compare, explode, link, ranges, unified, upsert
from tessera.sources import headers, readers
from tessera.streaming import heartbeats


def value(spark, f, *args):
    columns = [F.lit(a) for a in args]
    return spark.range(1).select(f(*columns).alias("v")).first()["v"]


@pytest.mark.parametrize("f,arg,want", [
    (tokens.canonical, "  r1  ", "R1"), (tokens.canonical, "U100\x00", "U100"), (tokens.canonical, '="R5"', "R5"), (tokens.canonical, "---", ""), (tokens.canonical, None, ""),
    (tokens.canonical, " r7​", "R7"), (tokens.base, "U200-1-A", "U200"), (tokens.base, "J1-4", "J1-4"), (tokens.base, "U1A", "U1"), (tokens.usage_base, "J1-4", "J1"),
    (tokens.prefix, "CR25", "CR"), (tokens.prefix, "123", None), (tokens.expand_range, "R1-R5", ["R1", "R2", "R3", "R4", "R5"]), (tokens.expand_range, "U3-7", ["U3-7"]),
    (tokens.expand_range, "R01-R03", ["R01", "R02", "R03"]), (tokens.expand_range, "R5-R1", ["R5-R1"]), (tokens.expand_range, "R1..3", ["R1", "R2", "R3"]),
    (tokens.lookup_key, "U000", "U0"), (tokens.lookup_key, "r001a", "R1A"), (tokens.find_instance, "Failure in U200-1 of R5", "U200-1"), (labels.ordinal, 111, "111th"),
    (labels.strip_status, "X (Verified) (PARTIAL)", "X"), (labels.strip_mode, "-FN", "-FN"), (numeric.expected_count, "DUAL op amp", 2), (numeric.expected_count, "SOIC-8 4x2", 0), (numeric.expected_count, "100mΩ 2x4", 0),
    (numeric.expected_count, "header 4 pin", 4), (numeric.pages, "Sheet 4-6, 9", [4, 5, 6, 9]), (numeric.number, "1_000", None), (numeric.number, "1.5d", None), (numeric.number, " 1e3 ", 1000.0),
])
def test_scalars(spark, f, arg, want):
    assert value(spark, f, arg) == want


def test_usage_text(spark):
    got = {t: tuple(value(spark, numeric.parse_usage, t)) for t in ("", "1/2", "1 of 4", "3/0", "abc", "0.5")}
    assert got == {"": (1.0, "1"), "1/2": (0.5, "=1/2"), "1 of 4": (0.25, "=1/4"), "3/0": (None, None), "abc": (None, None), "0.5": (0.5, None)}


@pytest.fixture
def sides(spark):
    g = spark.createDataFrame([(2, "A", "R1, R2, J1-4"), (3, "B", "R2 U5-1"), (4, "", "R9"), (5, None, None)], "row_no long, label string, refs string")
    b = spark.createDataFrame([(2, "R1", "res"), (3, "U5", "dual op amp"), (4, "C1 C2", "cap DNP"), (5, "R12A", "x"), (6, None, None)], "row_no long, ref_des string, description string")
    return g, b


def test_reconciliation(spark, sides):
    g, b = sides
    gt, bt = explode.group_tokens(g), explode.bom_tokens(b)
    assert {r["token"] for r in compare.missing(gt, bt).collect()} == {"R2", "J1-4", "R9"}
    assert {r["token"] for r in compare.missing(gt, bt, exact=True).collect()} == {"R2", "J1-4", "U5-1", "R9"}
    assert {r["base"] for r in compare.extra(gt, bt).collect()} == {"R12"}
    assert {(r["token"], r["n"], r["groups"]) for r in audit.group_duplicates(gt).collect()} == {("R2", 2, "A, B")}


def test_results_do_not_depend_on_partitioning(spark, sides):
    g, b = sides
    runs = []
    for n in (1, 7):
        gt, bt = explode.group_tokens(g.repartition(n)), explode.bom_tokens(b.repartition(n).orderBy(F.rand(n)))
        runs.append((sorted(map(str, compare.missing(gt, bt).collect())), sorted(map(str, explode.bom_bases(bt).collect()))))
    assert runs[0] == runs[1]


def test_unified_merge(spark):
    """Every status, note and flag of the merge, on rows made for each."""
    old = spark.createDataFrame([
        (2, "R1", "a", "10", "x"), (3, "U5-1", "b", "1", ""), (4, "U5-2", "b", "2", "y"), (5, "C9", "gone", "", None), (6, "R1, R7", "again", "3", "z"),
        (7, "L1", "", "4", "p"), (8, "L2", "coil", "4.0", "q"), (9, "Q1-1", "n", "5", ""), (10, "K3", "relay DNP", "", ""), (11, "T4", "t", "", ""), (12, "J1-J3", "range", "", ""),
    ], "row_no long, ref_des string, description string, page string, legacy string")
    new = spark.createDataFrame([
        (2, "R1", "changed", "10.0", "g"), (3, "U5", "new b", "", "h"), (4, "Q2", "new", "", ""), (5, "L1 L2", "", "", ""), (6, "R1", "twice", None, ""),
        (7, "X1, Q1", "", "", ""), (8, "T4-1", "", "", ""), (9, None, "no ref", "", ""), (10, "U5", "late", "", ""),
    ], "row_no long, ref_des string, description string, page string, grade string")
    got = [tuple(r)[:1] + tuple(r)[5:] for r in unified.unified(old.repartition(3), new.repartition(2)).orderBy(*unified.ORDER).collect()]
    want = [
        (2, "R1", "changed", "10.0", "g", "x", 1, "Changed", "Both", 'Duplicate RefDes R1 in Old BOM — old row 6 was not merged (first occurrence used); description changed from "a" to "changed"'),
        (3, "U5", "new b", "", "h", "", 0, "Superseded", "New BOM (superseded)", "Superseded by 2 carried rows (U5-1 … U5-2) — delete this row"),
        (3, "U5-1", "new b", "1", "h", "", 1, "Carried", "Old BOM (carried)", 'Carried forward from Old BOM (manual suffix row of U5); description updated from "b" to "new b" by New BOM'),
        (3, "U5-2", "new b", "2", "h", "y", 0, "Carried", "Old BOM (carried)", 'Carried forward from Old BOM (manual suffix row of U5); description updated from "b" to "new b" by New BOM'),
        (3, "C9", "gone", "", "", "", 0, "Delete", "Old BOM only", "Not in New BOM — remove from the FMEAs"),
        (3, "R7", "again", "3", "", "z", 0, "Delete", "Old BOM only", 'Not in New BOM — remove from the FMEAs; From an old row listing "R1, R7"'),
        (4, "Q2", "new", "", "", "", 0, "Added", "New BOM only", "Not in Old BOM — new part; add to the FMEAs"),
        (5, "L1 L2", "coil", "4", "", "p", 3, "Changed", "Both", '[L1] page: kept old value "4" (new was blank); [L2] description: kept old value "coil" (new was blank); [L2] legacy: differing old values — kept "p"'),
        (5, "Q1-1", "n", "5", "", "", 0, "Delete", "Old BOM only", "Q1-1 is not in New BOM, but its base Q1 is — manual expansion was not auto-carried; review before deleting"),
        (5, "T4", "t", "", "", "", 0, "Delete", "Old BOM only", "T4 is not in New BOM as a bare row, but its expansion rows are — likely replaced by suffix rows; review before deleting"),
        (5, "J1-J3", "range", "", "", "", 0, "Delete", "Old BOM only", "Not in New BOM — remove from the FMEAs"),
        (6, "R1", "twice", "", "", "", 1, "Changed", "Both", "Duplicate RefDes R1 — first occurrence (row 2) was used for matching"),
        (7, "X1, Q1", "", "", "", "", 0, "Added", "New BOM only", "Not in Old BOM — new part; add to the FMEAs"),
        (8, "T4-1", "", "", "", "", 0, "Added", "New BOM only", "Not in Old BOM — new part; add to the FMEAs"),
        (9, "", "no ref", "", "", "", 0, "", "New BOM only", ""),
        (10, "U5", "late", "", "", "", 1, "Changed", "Both", "Duplicate RefDes U5 — first occurrence (row 3) was used for matching"),
    ]
    for g, w in zip(got, want, strict=False):
        assert g == w
    assert len(got) == len(want)
    assert unified.unified(old.limit(0), new).count() == 9 and unified.unified(old, new.limit(0)).filter("Status = 'Delete' AND entry = -1").count() == 10


def test_planned_columns():
    plan = unified.plan_columns(["Ref", "desc ", "Desc", "lot", "Status"], ["ref", "Description", "DESC", "merge status"], [("DESC", "description"), ("none", "ref"), ("desc", "DESC")])
    assert plan.columns == ["ref", "Description", "DESC", "merge status", "lot", "Status", "Merge Merge Status", "Source", "Change Notes"]
    assert plan.filled == {"desc ": "Description", "Ref": "ref", "Desc": "DESC", "lot": "lot", "Status": "Status"} and len(plan.notes) == 2
    twice = unified.plan_columns(["A", "a ", "a (old)"], ["a"])
    assert twice.filled == {"A": "a", "a ": "a (old)", "a (old)": "a (old) (old)"} and len(twice.notes) == 2


def test_row_types(spark):
    rows = spark.createDataFrame([(1, "Circuit Block", "R1, R2", ""), (2, "", "", ""), (3, "", "R1", "0.5"), (4, "", "", ""), (5, "other", "", "")], "row_no long, level string, cause string, ratio string")
    got = classify.row_types(rows.withColumn("file", F.lit(1)), ["file"], "level", "cause", ["ratio"]).orderBy("row_no").collect()
    assert [r["row_type"] for r in got] == ["circuit_block", "circuit_block", "piece_part", "piece_part", "other"]


def test_page_kernels_against_plain_python(spark):
    r = np.random.default_rng(4)
    rows = [(1, k, float(x), float(y), float(x + w), float(y + h)) for k, (x, y, w, h) in enumerate(r.integers([0, 0, 20, 20], [60, 60, 60, 60], (40, 4)).tolist())]
    boxes = spark.createDataFrame(rows, "page long, box long, x0 double, y0 double, x1 double, y1 double")
    area = lambda b: (b[4] - b[2]) * (b[5] - b[3])
    kept = []
    for b in sorted(rows, key=lambda b: (-area(b), b[1])):
        both = [max(0, min(b[4], k[4]) - max(b[2], k[2])) * max(0, min(b[5], k[5]) - max(b[3], k[3])) for k in kept]
        if all(i <= 0.5 * (area(b) + area(k) - i) for i, k in zip(both, kept, strict=True)):
            kept.append(b)
    assert {r["box"] for r in cluster.suppress_overlaps(boxes, 0.5).collect()} == {b[1] for b in kept}
    pins = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (100, 0), (200, 0), (900, 900)])], "page long, word long, x double, y double")
    assert {(r["word"], r["cluster"]) for r in cluster.cluster_pins(pins).collect()} == {(0, 0), (1, 0), (2, 0), (3, 3)}


def test_headers():
    assert headers.dedupe_headers(["a", "a", "a.1", "a"]) == ["a", "a.2", "a.1", "a.3"]
    assert headers.detect_column(["Part-Number", "x"], ["part number"]) == "Part-Number"
    assert headers.detect_column(["Spin"], ["pn"], substring=True) is None
    assert headers.resolve_column(["My PN 1"], ["pn"]) == "My PN 1"
    assert headers.resolve_column(["Spin"], ["pn"]) is None


def test_reports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\x01b", 1)], "t string, _hidden int")
    assert readers.write_report({"one": df, "none": df.limit(0)}, str(tmp_path)) == ["one"]
    assert spark.read.parquet(f"{tmp_path}/one").collect()[0].asDict() == {"t": "ab"}
    (tmp_path / "x.csv").write_text('A,B\n"1,2",NA\n,z\n')
    assert [tuple(r) for r in readers.read_delimited(spark, str(tmp_path / "x.csv")).collect()] == [("1,2", "NA"), ("", "z")]


def test_streamed_sessions_match_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id")
    events.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = heartbeats.sessions(stream, "1 hour").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = {tuple(r) for r in heartbeats.sessions(events, "1 hour").collect()}
    streamed = {tuple(r) for r in spark.table("sessions").collect()}
    assert streamed and streamed <= batch


def sheet_rows():
    r = np.random.default_rng(8)
    kinds = [("Circuit Block", "R1, C2", "", ""), ("PP", "R1", "", ""), ("", "R1", "", ""), ("", "R1, C2", "", ""), ("", "", "0.5", ""), ("", "", "", ""), ("", "", "", ""), ("", "", "", "BLK-1"), ("note", "R1", "1", ""), (None, None, None, None), ("", "R1, C2", "", "BLK-2")]
    return [(str(f), k * 3 + 5, *kinds[i]) for f, n in (("a", 700), ("b", 3), ("c", 90)) for k, i in enumerate(r.integers(0, len(kinds), n))]


def typed_by_hand(rows, by_level):
    out, last = {}, {}
    for file, row_no, level, cause, ratio, fmea_id in rows:
        level, n, before = level or "", len([t for t in (cause or "").split(", ") if t]), last.get(file, "other")
        kind = {"Circuit Block": "circuit_block", "PP": "piece_part"}.get(level)
        if kind is None and (not level or not by_level):
            if ratio:
                kind = "piece_part"
            elif n >= 2:
                kind = "circuit_block"
            elif n == 1 and by_level:
                kind = "piece_part"
            elif fmea_id and n <= 1 and (by_level or before == "piece_part"):
                kind = "piece_part"
            elif by_level:
                kind = before
        out[file, row_no] = kind or "other"
        if out[file, row_no] != "other":
            last[file] = out[file, row_no]
    return out


@pytest.mark.parametrize("size", [10**9, 33, 4])
def test_row_types_by_ranges(spark, size):
    """One range, sixty-four, and ranges of ranges give the same types, which are those of a walk along each file."""
    rows = sheet_rows()
    df = spark.createDataFrame(rows, "file string, row_no long, level string, cause string, ratio string, fmea_id string").repartition(5)
    typed = classify.row_types(df, ["file"], "level", "cause", ["ratio"], "fmea_id", size=size)
    assert typed.columns == [*df.columns, "row_type"]
    assert {(r["file"], r["row_no"]): r["row_type"] for r in typed.collect()} == typed_by_hand(rows, True)
    scanned = classify.scanned_types(df, ["file"], ["fmea_id", "level", "cause"], "cause", ["ratio"], "fmea_id", size=size)
    assert {(r["file"], r["row_no"]): r["row_type"] for r in scanned.collect()} == typed_by_hand(rows, False)
    block, want, kinds = {}, {}, typed_by_hand(rows, True)
    for file, row_no, *_, fmea_id in rows:
        kind = kinds[file, row_no]
        if kind == "circuit_block":
            block[file] = fmea_id or None
        elif kind == "piece_part":
            want[file, row_no] = block.get(file)
    parts = classify.attach_blocks(typed, ["file"], "fmea_id", size=size).collect()
    assert {(r["file"], r["row_no"]): r["block"] for r in parts} == want and all(r["orphan"] == (r["block"] is None) for r in parts)
    assert classify.row_types(df.limit(0), ["file"], "level", "cause", ["ratio"], size=size).count() == 0


def test_running_values(spark):
    rows = [(k, k if k % 7 == 3 else None) for k in range(0, 400, 2)]
    df = spark.createDataFrame(rows, "pos long, v long").repartition(3)
    for size in (1000, 8):
        got = {r["pos"]: (r["before"], r["upto"]) for r in ranges.carried(ranges.carried(df, [], "pos", "v", "before", size=size), [], "pos", "v", "upto", inclusive=True, size=size).collect()}
        last = None
        for pos, v in rows:
            assert got[pos] == (last, v if v is not None else last)
            last = v if v is not None else last


def test_long_numbers_are_linked(spark):
    fmea = spark.createDataFrame([(1, "r120001 ", "1", "0.6"), (2, "R7 of R8", "1", "0.4"), (3, "J1234567-4", "1", "1")], "row_no long, cause string, usage string, ratio string")
    found = link.link(fmea, link.rates(spark.createDataFrame([("R0120001", "5"), ("R7", "2")], "pred_ref string, pred_fr string")))
    rows = {r["row_no"]: (r["ref"], r["instance"], r["part_fr"], list(r["notes"])) for r in found.collect()}
    assert rows == {1: ("R120001", "R120001", 5.0, []), 2: ("R7", "R7", 2.0, []), 3: ("", "J1234567-4", 0.0, [])}


def test_numbers_only_rule(spark):
    a, b = F.lit("20"), F.lit("")
    got = spark.range(1).select(compare.differs(a, b, "numbers"), compare.differs(a, b, "numeric"), compare.differs(a, F.lit("20.0"), "numbers"), compare.differs(a, F.lit("21"), "numbers")).first()
    assert tuple(got) == (False, True, False, True)


def test_upsert(spark):
    """Each action once, keys that differ in writing only, and a key that is twice on one side."""
    kind = "row_no long, row_type string, fmea_id string, cause string, failure_mode string, ratio string, usage string"
    block = lambda n, k: (n, "circuit_block", k, "", "", "", "")
    part = lambda n, ref, mode, ratio, usage="1": (n, "piece_part", "x", ref, mode, ratio, usage)
    table = spark.createDataFrame([part(1, "R9", "Open", "1"), block(2, "CPU-A"), part(3, "R1", "Open", "0.6"), part(4, "R1", "Short  Circuit", ""), part(5, "C1", "Open", "1"), part(6, "Q1", "Open", "1"), part(7, "q1", "open", "2"), part(8, "L1", "Open", "0.50"), block(9, ""), part(10, "R8", "Open", "1"), block(11, "MEM")], kind)
    made = spark.createDataFrame([block(1, "cpu"), part(2, " r1 ", "OPEN", "0.7", ""), part(3, "R1", "short circuit", "0.4"), part(4, "Q1", "Open", "3"), part(5, "L1", "Open", "0.5"), part(6, "X1", "Open", "1"), block(7, "MEM-B"), part(8, "M1", "Open", "1"), block(9, "NEW"), part(10, "N1", "Open", "1")], kind)
    got = list((r["grp"], r["ref"], r["mode"], r["action"], r["at_row"], r["new_row"], r["ratio"], r["usage"], r["changes"], r["skipped"]) for r in upsert.merged(table, made.repartition(3), ["ratio", "usage"]).collect())
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted([
        ("CPU", "R1", "OPEN", "update", 3, None, "0.7", "1", "ratio: 0.6 -> 0.7", "usage"), ("CPU", "R1", "SHORT CIRCUIT", "update", 4, None, "0.4", "1", "", ""), ("CPU", "C1", "OPEN", "missing", 5, None, "1", "1", "", ""),
        ("CPU", "Q1", "OPEN", "quarantined", 6, None, "1", "1", "", ""), ("CPU", "Q1", "OPEN", "quarantined", 7, None, "2", "1", "", ""), ("CPU", "Q1", "OPEN", "quarantined", None, 4, "3", "1", "", ""),
        ("CPU", "L1", "OPEN", "unchanged", 8, None, "0.5", "1", "", ""), ("CPU", "X1", "OPEN", "insert", 8, 6, "1", "1", "", ""), ("MEM", "M1", "OPEN", "insert", 11, 8, "1", "1", "", ""), ("NEW", "N1", "OPEN", "unplaced", None, 10, "1", "1", "", ""),
    ], key=key)
    notes = {r["note"] for r in upsert.merged(table, made, ["ratio"]).filter("action = 'quarantined'").collect()}
    assert notes == {f"{who} Identity matches 2 template row(s) and 1 generated row(s); pairing is not exactly 1:1." for who in ("Template row left completely untouched.", "Generated row was not inserted.")}
    assert upsert.merged(table.limit(0), made.limit(0), ["ratio"]).count() == 0
