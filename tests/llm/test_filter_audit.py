"""The filter audit against a count row by row, and its repeats where hashes fail."""

import collections
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, oracles

DOCS = "doc_id long, text string, lang string, part string, bits int, cls long, least long, rows string, b0 int"


def table(spark, rows):
    return spark.createDataFrame([(k, t, g, "p", 1, 2, 3, "r", 4) for k, t, g in rows], DOCS).repartition(3)


def make_rows():
    r = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "d#", "e", "ß", "漢字", "x|y"]
    make = lambda n: r.choice([" ", "\n", "\t "]).join(r.choice(words) for _ in range(n))
    texts = [None, "", "", " \x0b\n", "A", make(199), make(200), make(5000) + "!", "w " * 400] + [" ".join(f"w{k}" for k in range(n)) for n in (199, 200, 260)]
    texts += [make(r.randint(0, 30)) for _ in range(40)]
    long = "long " * 2000
    texts += [long + "a", long + "b", long + "a", "a" + long]
    rows = [(k, t, r.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    rows += [(100 + k, r.choice(texts), r.choice(["en", "de"])) for k in range(60)]
    return rows + [(None, "A", "en"), (None, "only", "en"), (4, "A", "de"), (150, "A", None), (150, "B", None)] + [(-3, "A", "xx")] * 2


def brute(rows, labels):
    least, good, toxic = {}, {k for k, q, _ in labels if q == 1}, {k for k, _, t in labels if t == 1}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    masks = []
    for k, t, g in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": k is not None and k > least[t]}
        masks.append((g or "", {n for n, x in fails.items() if x}, k in good - {None}, k in toxic - {None}))
    out, shapley = {}, collections.Counter()
    for part in {m[0] for m in masks}:
        for order in itertools.permutations("ABCDE"):
            for step, own in enumerate(order, 1):
                before = set(order[: step - 1])
                of = [m for m in masks if m[0] == part]
                removed = [m for m in of if own in m[1] and not m[1] & before]
                shapley[part, own] += len(removed)
                out[part, "".join(order), step] = (
                    sum(not m[1] & (before | {own}) for m in of), len(removed), sum(own in m[1] and bool(m[1] & before) for m in of),
                    sum(m[1] == {own} for m in of), sum(m[2] for m in removed), sum(m[3] for m in removed),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 60, 2)] + [(None, 1, 1), (7, None, None), (9, 0, 1), (9, 1, 0), (150, 1, 1)]


def collected(df):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("way", ["broadcast", "shuffled", "every hash alike", "small blocks"])
def test_against_brute_force(spark, monkeypatch, way):
    if way == "shuffled":
        monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", 2)
        monkeypatch.setattr(filter_audit, "COMMONEST", 1)
    if way == "every hash alike":
        monkeypatch.setattr(filter_audit, "block_hashes", lambda text: [F.when(F.length(text) > 3, F.lit(5).cast("long")).alias(n) for n in filter_audit._names])
    if way == "small blocks":
        monkeypatch.setattr(filter_audit, "BLOCKS", (2, 9, 3000, 100_000, 1, 1, 1))
    rows = make_rows()
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert collected(filter_audit.report(table(spark, rows), labels)) == brute(rows, LABELS)


def test_sql(spark):
    """The SQL holds on the same awkward rows."""
    rows, con = make_rows(), duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", LABELS)
    rel = con.sql(oracles.FILTER_AUDIT)
    got = {tuple(r[:3]): tuple(r[3:]) for r in rel.select("part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley").fetchall()}
    assert got == brute(rows, LABELS)


def test_singletons_drop_out(spark):
    """A round keeps what shares its class; of texts that differ in the last block only all blocks are needed."""
    texts = ["a" * 300, "a" * 299 + "b", "c" * 300, "c" * 300, "d" * 7, "e" * 20_000]
    rows = filter_audit.features(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    left, rounds = filter_audit.refined(rows.select("doc_id", "n_chars", *filter_audit._names))
    assert {r["doc_id"] for r in left.collect()} == {2, 3} and rounds == 2


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table(spark, make_rows())
    assert filter_audit.report(docs.limit(0), labels).count() == 0
    assert filter_audit.report(docs, labels).agg(F.sum("good_lost")).first()[0] == 0
