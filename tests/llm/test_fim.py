"""Fill-in-the-middle against lists of units."""

import hashlib
import random
import re

import duckdb
import pytest

from tessera.llm import fim, oracles

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
SPLIT = {fim.LINES: r"[^\n]*\n|[^\n]+", fim.WORDS: r"[^ \t\n\x0b\x0c\r]*[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+"}


def make_texts():
    r = random.Random(6)
    pieces = ["a", "bc", "\n", "\n\n", " ", "é", "漢", "😀", "\r\n", "<", ">", "P>", "<S", "\t", "\x85", " ", "\x0b"]
    return [None, "", "\n", "\n\n\n", "one", "x\n" * 9000 + "tail", "a<P>b\nc", "<M>", "a\n<S>", "<p>\n</P>"] + ["".join(r.choice(pieces) for _ in range(r.randint(0, 25))) for _ in range(300)]


def brute(text, doc_id, unit, rate, spm_rate):
    text, units = text or "", re.findall(SPLIT[unit], text or "")
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm_rate else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", [fim.LINES, fim.WORDS])
def test_offsets_of_all_cuts(unit):
    for text in make_texts()[1:]:
        units, runs = re.findall(SPLIT[unit], text), fim.Runs(text, unit)
        assert runs.n == len(units)
        cuts = range(len(units) + 1) if len(units) < 100 else (0, 1, 77, 4000, 8999, 9000, 9001)
        assert [runs.offset(m) for m in cuts] == [len("".join(units[:m])) for m in cuts], text


@pytest.mark.parametrize(("unit", "rate", "spm_rate"), [(fim.LINES, 100, 50), (fim.WORDS, 60, 20)])
def test_rows(spark, unit, rate, spm_rate):
    rows = [(k, t) for k, t in enumerate(make_texts())] + [(3, "again\nand\nagain"), (3, "again\nand\nagain"), (None, "no\nid\n"), (-12, "below\nzero")]
    docs = spark.createDataFrame([(k, t, 1, "f", ["o"]) for k, t in rows], "doc_id long, text string, n int, form string, output array<string>").repartition(3)
    key = lambda x: tuple(map(str, x))
    got = fim.transform(docs, unit, rate=rate, spm_rate=spm_rate)
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = sorted(((k, t, *brute(t, k, unit, rate, spm_rate)) for k, t in rows), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    back = fim.report(docs, unit, rate=rate, spm_rate=spm_rate)
    assert sorted(map(tuple, back.collect()), key=key) == sorted(((k, *w[:4], sha(w[4]), sha(t or "")) for k, t, *w in want), key=key)
    assert {w[3] for w in want} == {"plain", "psm", "spm"}
    assert fim.report(docs.limit(0)).count() == 0


def test_sql(spark):
    rows, con = [(k, t) for k, t in enumerate(make_texts())] + [(None, "a\nb")], duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = {r[0]: r[1:] for r in con.sql(oracles.FILL_IN_MIDDLE).fetchall()}
    for k, t in rows:
        n, form, p, m, out = brute(t, k, fim.LINES, 100, 50)
        assert got[k] == (n, form, p, m, sha(out), sha(t or "")), t
