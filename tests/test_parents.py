"""Parents of groups and choices of pins against the reference's steps, candidate by candidate, on small random pages."""

import numpy as np
import pytest

from tessera.operators import adaptive, pages, qualify
from tessera.operators import parents as R
from tessera.sources.fixtures import Views

ENTRY, BODY = "page long, grp long, word long, x double, y double, txt string", "page long, refdes string, x0 double, y0 double, x1 double, y1 double"
LISTED = {"U1": {1, 3}, "U2": {2}, "J3": {1}}


@pytest.fixture(scope="module")
def drawing(spark):
    r = np.random.default_rng(3)
    texts = ["U1", "U2", "U2A", "J3", "R7", "P3V3", "1", "2", "a1", "A1", "VCC", "NET_1", " 2 ", ""]
    rows, word = [], 0
    for page in range(3):
        for grp in range(14):
            left, top = r.integers(0, 900, 2)
            for _ in range(r.integers(1, 9)):
                word += 1
                rows.append((page, grp if grp else None, word, float(left + r.integers(0, 300)), float(top + r.integers(0, 200)), str(r.choice(texts))))
    bodies = [(p, f"{n}{s}", float(x), float(y), float(x + r.integers(30, 400)), float(y + r.integers(30, 400))) for p in range(3) for n in ("U1", "U2", "J3", "CR4") for s in ("", "A") for x, y in [r.integers(0, 900, 2)]]
    pins = ["U1-1", "U1-A1", "U2-1", "U2-2", "J3-VCC", "J3-A1"]
    bom = [(1, "U1, U1A", "1"), (2, "U2A", "2"), (3, "U1", "3"), (4, "J3", "1"), (5, "U2", "none"), (6, "R7", "0")]
    tables = {
        "entries": R.read(spark.createDataFrame(rows, ENTRY)), "bodies": spark.createDataFrame(bodies, BODY), "pins": spark.createDataFrame([(p,) for p in pins], "pin string"),
        "listed": R.listed_pages(spark.createDataFrame(bom, "row_no long, ref_des string, page string")),
    }
    return rows, bodies, set(pins), tables


def bare(name):
    return name[:-1] if name[-1].isalpha() else name


def kinds(text):
    text = text.strip()
    part = text in ("U1", "U2", "U2A", "J3", "R7")
    return part, not part and text != "" and text != "NET_1"


def grouped(rows):
    groups = {}
    for row in rows:
        if row[1] is not None:
            groups.setdefault(row[:2], []).append(row)
    return {key: (of, [f(row[k] for row in of) for f, k in ((min, 3), (min, 4), (max, 3), (max, 4))]) for key, of in groups.items()}


def overlap(a, b):
    return not (a[2] < b[0] or b[2] < a[0] or a[3] < b[1] or b[3] < a[1])


def middle(r):
    return (r[0] + r[2]) / 2, (r[1] + r[3]) / 2


def test_pages_of_a_bom(drawing):
    assert {r["parent"]: set(r["at"]) for r in drawing[3]["listed"].collect()} == LISTED


def test_parents_are_those_of_the_reference(drawing):
    rows, bodies, pins, t = drawing
    want = {}
    for (page, grp), (of, box) in grouped(rows).items():
        gx, gy = middle(box)
        found = {}
        for p, ref, *rect in sorted(bodies, key=lambda b: (-(b[4] - b[2]) * (b[5] - b[3]))):
            if p == page and overlap(box, rect):
                found[bare(ref)] = (0, (gx - middle(rect)[0]) ** 2 + (gy - middle(rect)[1]) ** 2)
        for p, _, _, x, y, text in rows:
            d = (gx - x) ** 2 + (gy - y) ** 2
            if p == page and kinds(text)[0] and d <= 500**2:
                d *= 0.8 if x < gx and y < gy else 1.4 if x > gx and y > gy else 1.0
                found[bare(text)] = min(found.get(bare(text), (1, d)), (1, d))
        labels = [row[5].strip().upper() for row in of if kinds(row[5])[1]]
        rank = {ref: (-sum(f"{ref}-{x}" in pins for x in labels), ref in LISTED and page + 1 not in LISTED[ref], *info, ref) for ref, info in found.items()}
        if found:
            ref = min(rank, key=rank.get)
            want[page, grp] = (ref, "text" if found[ref][0] else "body", -rank[ref][0], len(found))
    got = {(r["page"], r["grp"]): (r["parent"], r["source"], r["hits"], r["candidates"]) for r in R.parents_of(*(t[k] for k in ("entries", "bodies", "pins", "listed"))).collect()}
    assert got == want and {v[1] for v in want.values()} == {"body", "text"} and {v[2] > 0 for v in want.values()} == {True, False}


def test_pins_are_chosen_as_in_the_reference(spark, drawing):
    rows, bodies, _, t = drawing
    r = np.random.default_rng(4)
    maps = [(p, f"p{p}_pin_{n}", ref, text, f"{ref}-{text}") for p in range(3) for n, (ref, text) in enumerate((b[1], str(x)) for b in bodies if b[0] == p for x in r.choice(["1", "2", "A1", "VCC"], 2))]
    rect = {(b[0], b[1]): b[2:] for b in bodies}
    want = {}
    for (page, _), (of, box) in grouped(rows).items():
        for _, _, word, x, y, text in of:
            pins = [m for m in maps if m[0] == page and m[3] == text.strip() and kinds(text)[1]]
            pins = [m for m in pins if page + 1 in LISTED.get(bare(m[2]), ())] or pins
            if not pins:
                continue
            where = [rect[page, m[2]] for m in pins]
            inside = [m for m, b in zip(pins, where, strict=True) if box[0] <= middle(b)[0] <= box[2] and box[1] <= middle(b)[1] <= box[3]]
            over = [m for m, b in zip(pins, where, strict=True) if overlap(box, b)]
            near = min(range(len(pins)), key=lambda k: ((x - middle(where[k])[0]) ** 2 + (y - middle(where[k])[1]) ** 2, k))
            tier, pin = ("only", pins[0]) if len(pins) == 1 else ("inside", inside[0]) if inside else ("overlapping", over[0]) if over else ("nearest", pins[near])
            want[word] = (pin[1], pin[4], tier, len(pins))
    chosen = R.chosen_pins(t["entries"], spark.createDataFrame(maps, "page long, pin string, refdes string, label string, full string"), t["bodies"], t["listed"])
    assert {x["word"]: (x["pin"], x["full"], x["tier"], x["candidates"]) for x in chosen.collect()} == want
    assert {v[2] for v in want.values()} == {"only", "inside", "overlapping", "nearest"}


def test_nothing_near_gives_nothing(drawing):
    t = drawing[3]
    none = R.parents_of(t["entries"].filter("NOT is_part"), t["bodies"].limit(0), t["pins"], t["listed"])
    assert none.count() == 0


def test_labels_by_geometry(spark):
    rows = [
        (0, 1, 1, 10.0, 10.0, "1"), (0, 1, 2, 20.0, 10.0, "A1"), (0, 1, 3, 30.0, 10.0, "B9"), (0, 2, 4, 5000.0, 5000.0, "J9"), (0, 2, 5, 5010.0, 5000.0, "3"), (0, 2, 6, 7000.0, 5000.0, "4"),
        (0, 3, 7, 9000.0, 0.0, "R5"), (0, 3, 8, 9010.0, 0.0, "2"), (1, 4, 9, 0.0, 0.0, "7"), (1, None, 10, 0.0, 0.0, "8"),
    ]
    maps = spark.createDataFrame([(0, "p0_pin_0", "U1", "1", "U1-1")], "page long, pin string, refdes string, label string, full string")
    pins = spark.createDataFrame([(p,) for p in ("U1-1", "U1-A1", "J9-3", "R5-2", "PIN-7")], "pin string")
    bodies, listed = spark.createDataFrame([(0, "U1", 0.0, 0.0, 50.0, 50.0)], BODY), spark.createDataFrame([], "parent string, at array<long>")
    got = adaptive.by_geometry(R.read(spark.createDataFrame(rows, ENTRY)), maps, bodies, pins, listed)
    assert {r["word"]: (r["value"], r["source"]) for r in got.collect()} == {
        1: ("U1-1", "geometry"), 2: ("U1-A1", "parent"), 3: (None, "filtered"), 5: ("J9-3", "box text"), 6: (None, "filtered"), 8: (None, "passive prefix"), 9: ("PIN-7", "unqualified"),
    }


def test_only_pages_chosen_have_geometry(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    drawn = v.v_drawing.select("page").distinct()
    first = {r["word"]: r for r in qualify.qualify(v.v_entry, v.v_pinlist).collect()}
    rows = adaptive.extracted(v.v_entry, v.v_pinlist, v.v_bom, v.v_drawing, v.v_token, drawn, most=1).collect()
    assert sorted(r["word"] for r in rows) == sorted(first)
    late = [r for r in rows if r["source"] not in ("pin list", "suppressed", "dropped")]
    assert len({r["page"] for r in late}) == 1 and {r["page"] for r in rows if r["source"] == "dropped"} == {0, 1, 2} - {late[0]["page"]}
    for r in rows:
        q = first[r["word"]]
        assert (r["source"] == "pin list") == (q["parent"] is not None) and (r["source"] == "suppressed") == q["suppressed"]
        assert q["parent"] is None or r["value"] == f"{q['parent']}-{q['label']}"


def test_holders_and_labels_are_those_of_the_reference(spark):
    rect = lambda item, *r, page=0: (page, item, "re", *map(float, r), 0.0)
    drawings = [
        rect(1, 300, 300, 100, 100), rect(2, 100, 100, 300, 300), rect(3, 0, 500, 149, 900), rect(4, 0, 500, 900, 599), rect(5, 1000, 0, 1150, 110),
        rect(6, 2000, 0, 2200, 200), rect(7, 3000, 0, 3200, 200), rect(8, 0, 0, 1000, 1000, page=1), rect(9, 3, 3, 1000, 1000, page=2),
    ]
    texts = [
        (0, 1, 150.0, 90.0, "CPU core"), (0, 2, 150.0, 85.0, "U12"), (0, 3, 150.0, 84.0, "note"), (0, 4, 150.0, 79.0, "FAR_1"), (0, 5, 160.0, 130.0, "LOW_1"), (0, 6, 50.0, 505.0, "SMALL_1"),
        (0, 7, 1000.0, 30.0, "<adc 1>"), (0, 8, 1150.0, 30.0, "dac_1"), (0, 9, 2100.0, 31.0, "BELOW_1"), (0, 10, 3001.0, 3.0, "12"), (1, 11, 500.0, 5.0, "SHEET_1"), (2, 12, 500.0, 5.0, "SHEET_2"),
    ]
    tables = spark.createDataFrame(drawings, "page long, item long, kind string, x0 double, y0 double, x1 double, y1 double, radius double"), spark.createDataFrame(texts, "page long, word long, x double, y double, txt string")
    got = lambda *sheets: {(r["page"], r["item"]): r["label"] for r in pages.labelled_holders(*tables, *sheets).collect()}
    held = {(0, 1): "CPU CORE", (0, 5): "ADC 1"}
    assert got() == held | {(1, 8): "SHEET_1", (2, 9): "SHEET_2"}
    sheets = spark.createDataFrame([(0, 0.0, 0.0, 5000.0, 4000.0), (1, 0.0, 0.0, 1050.0, 1050.0), (2, 0.0, 0.0, 1000.0, 1000.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    assert got(sheets) == held
