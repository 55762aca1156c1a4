"""The corpus operators against brute force on small tables that hold the awkward cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, components, decontam, exact_dedup, kneser_ney, langid, near_dedup, oracles, pii, queries, substring_dedup, token_files
from tessera.llm.chunks import pack_ids

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, th long, row string, at string, ids string, bucket int, n_words int"
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def table(spark, texts, ids=None):
    """Rows with columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "r", "a", "x", 2, 3) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = make(120).split()
    near = [" ".join(w if r.random() > 0.012 else "zz" for w in base) for _ in range(25)]
    passage = make(60)
    mixed = [make(20) + " " + passage + "\n" + make(r.randint(0, 40)) for _ in range(8)]
    odd = [None, "", " \t\n", "one", "one two three", "One TWO three", "x " * 200, make(4000), "a  b\r\n\r\n c", "\x1c<|endoftext|>   y", "漢字 😀 'st don't"]
    return [make(r.randint(1, 90)) for _ in range(60)] + near + mixed + odd + near[:3] + [None, ""]


def rows_by_id(df):
    got = df.collect()
    out = {r["doc_id"]: r for r in got}
    assert len(out) == len(got)
    return out


def test_pii_base_spans(spark):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def holds(kind, v):
        d = re.sub("[^0-9]", "", v)
        luhn = sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    r = random.Random(3)
    pieces = ["4539578763621486", "1.2.3.4.5", "300.1.1.1", "a@b.c", "_d@e-f.g.h", "+1 (269) 555-3296", ".", "-", " ", "😀", "é", "x", "0009", "Dr. Jane Doe", "555-123-4567", "123-45-6789"]
    cases = [None, "", "9" * 5000, "a" * 3000 + "@" + "b.c" * 900] + ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(400)]
    got = rows_by_id(pii.report(table(spark, cases)))
    for k, t in enumerate(cases):
        found = sorted((m.start(), n, kind, m.end()) for n, kind in enumerate(patterns) for m in re.finditer(patterns[kind], t or "") if holds(kind, m[0]))
        assert got[k]["base_sha256"] == sha(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)), t
        assert [got[k][f"n_{p}"] for p in patterns] == [sum(x[2] == p for x in found) for p in patterns]
        assert {f"{kind}:{a}:{b}" for a, _, kind, b in found} <= set(got[k]["spans"].split(","))
    assert pii.report(table(spark, ["a"]).limit(0)).count() == 0
    masked = {r["doc_id"]: r["text"] for r in pii.mask(table(spark, ["to a@b.cd now", None, "plain"])).collect()}
    assert masked == {0: "to [email] now", 1: None, 2: "plain"}
    long = pii.mask(table(spark, ["wörter ohne zahl " * 500 + "a@b.cd 1.2.3.4" + " ende" * 900])).first()["text"]
    assert long == "wörter ohne zahl " * 500 + "[email] [ip]" + " ende" * 900


def test_pii_added_spans(spark):
    """Precision and recall of the spans that the classifier adds, on texts whose personal data are known."""
    r = random.Random(11)
    given, family = ["John", "Maria", "Klaus", "Sophie"], ["Keller", "Moreau", "Lopez", "Harris"]
    real = [
        lambda: ("name", f"Dr. {r.choice(given)} {r.choice(family)}"), lambda: ("name", f"{r.choice(given)} {r.choice(family)}"),
        lambda: ("phone", f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}"), lambda: ("ssn", f"{r.randint(100, 660)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
    ]
    decoy = [
        lambda: ("", f"{r.choice(['New', 'North', 'United'])} {r.choice(['York', 'River', 'Street'])}"),
        lambda: ("", f"order {r.randint(100, 199)}-{r.randint(100, 199)}-{r.randint(1000, 9999)}"), lambda: ("", f"isbn 9{r.randint(10, 99)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
    ]
    cue = {"name": "signed by ", "phone": "call ", "ssn": "social security ", "": ""}
    texts, want = [], set()
    for k in range(600):
        text = "it was said here "
        for _ in range(3):
            kind, value = r.choice(real if r.random() < 0.6 else decoy)()
            text += cue[kind] if r.random() < 0.7 else "and then "
            if kind:
                want.add((k, f"{kind}:{len(text)}:{len(text) + len(value)}"))
            text += value + " was found, "
        texts.append(text)
    got = {(r["doc_id"], x) for r in pii.report(table(spark, texts)).collect() for x in r["spans"].split(",") if x}
    precision, recall = len(got & want) / len(got), len(got & want) / len(want)
    assert precision > 0.95 and recall > 0.95, (precision, recall)


def test_pii_takes_time_in_proportion(spark):
    import time

    spent = {}
    for n in (10_000, 100_000):
        docs = table(spark, ["1.2.3.4 " * n])
        began = time.perf_counter()
        assert pii.report(docs).first()["n_ip"] == n
        spent[n] = time.perf_counter() - began
    assert spent[100_000] < 15 * spent[10_000] + 10, spent


def test_pii_reliabilities():
    """EM finds the labeler that disagrees with all others to be worth little."""
    soft = pii.estimate({("card", 1, 1, 0, 1): 80, ("card", -1, -1, 0, 1): 80, ("card", 1, 1, 0, -1): 20, ("card", -1, -1, 0, -1): 20})
    assert soft["card", 1, 1, 0, -1] > 0.9 and soft["card", -1, -1, 0, 1] < 0.1


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = [*range(100, 100 + len(texts) - 1), None]
    files, root = token_files.encode_to_files(table(spark, texts, ids), path, 2)
    got = {r["doc_id"]: r for r in token_files.digest(files).collect()}
    at = 0
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes())), t
        at += len(want)
    import pyarrow.parquet as pq

    part = next(f for f in sorted(root_files(root)) if pq.ParquetFile(f).metadata.num_rows)
    column = pq.ParquetFile(part).metadata.row_group(0).column(4)
    assert any("DICTIONARY" in e for e in column.encodings) and column.has_column_index and column.has_offset_index
    empty, _ = token_files.encode_to_files(table(spark, texts).limit(0), path, 2)
    assert token_files.digest(empty).count() == 0


def root_files(root):
    from pathlib import Path

    return [str(p) for p in Path(root.removeprefix("file:")).glob("part-*")]


def test_byte_bpe(spark, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = rows_by_id(bpe.digests(table(spark, texts), path, public_tokenizers.PATTERN))
    for k, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), sha(pack_ids(ids)), sha(t or ""))
    rows = bpe.encode(table(spark, texts), path, public_tokenizers.PATTERN)
    assert rows.filter("cast(decoded as string) <> coalesce(text, '')").count() == 0
    assert set(rows.columns) == {*SCHEMA.replace(",", "").split()[::2], "n_tokens", "decoded"}


def test_near_dedup(spark, texts, monkeypatch):
    def brute(k):
        sets = []
        for t in texts:
            w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
            sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
        root = list(range(len(texts)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in range(len(texts)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        return {k: (len(s), find(k)) for k, s in enumerate(sets)}

    for block, size in ((1024, 4), (8, 5)):  # the second cuts groups into blocks
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got, want = rows_by_id(near_dedup.report(table(spark, texts), size)), brute(size)
        assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
        assert all(r["kept"] == (want[k][1] == k) for k, r in got.items())
    kept = near_dedup.keep_one(table(spark, texts), 5)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, (_, c) in want.items() if c == k}
    assert kept.columns == table(spark, texts).columns
    assert near_dedup.report(table(spark, texts).limit(0)).count() == 0
    lone = near_dedup.report(table(spark, ["a b c d e", None], [None, None])).collect()
    assert [(r["component_id"], r["kept"]) for r in lone] == [(None, True)] * 2


def test_minhash_estimate():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 2**63, 200, dtype=np.uint64)])
    got = near_dedup.estimate(near_dedup.packed(near_dedup.minima(a)), near_dedup.packed(near_dedup.minima(b)))
    assert abs(got - 800 / 1200) < 0.15


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60) if k % 13] + [(r.randint(100, 200), r.randint(100, 200)) for _ in range(80)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    for u, v in edges:
        root.setdefault(u, u), root.setdefault(v, v)
    for _ in range(100):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {k: c for k, c in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_stars_take_no_round(spark, monkeypatch):
    names, staged = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df, name, rows=None: names.append(name) or staged(df, name, rows))
    stars = [(k, k % 7) for k in range(7, 90)]
    got = components.connected_components(spark.createDataFrame(stars + stars[:5], "u long, v long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {k: k % 7 for k in range(90)} and names == ["edges", "least"]
    path = random.Random(4).sample(range(300), 300)
    far = components.connected_components(spark.createDataFrame(list(zip(path, path[1:], strict=False)), "u long, v long"))
    assert {(r["node"], r["component"]) for r in far.collect()} == {(k, 0) for k in range(300)}


def test_langid(spark):
    r = random.Random(7)
    vocab = {"en": "the and thing of with that ation ering".split(), "de": "der und schau nicht über ein keit zu".split()}
    rows = []
    for k in range(400):
        lang = ("en", "de")[k % 2]
        rows.append((k, " ".join(r.choice(vocab[lang]) for _ in range(30)), lang if k % 10 else "xx", "a" if k % 2 else "b", 1))
    rows += [(1000, "".join(r.choice("qxzjvwkyfpg ") for _ in range(600)), "en", "a", 1), (1001, None, "de", None, 1), (1002, "", None, "b", 1), (1003, "12 34 5", "en", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, logs int")
    got = {r["doc_id"]: r for r in langid.of_documents(docs, ["de", "en"]).collect()}
    assert all(got[k]["lang"] == ("en", "de")[k % 2] and got[k]["kept"] for k in range(400))
    assert not got[1000]["kept"] and got[1001]["lang"] == "de" and got[1001]["kept"] and got[1002]["kept"] and got[1003]["kept"]
    assert sorted(r["doc_id"] for r in langid.keep_identified(docs, ["de", "en"]).collect()) == sorted([*range(400), 1001, 1002, 1003])
    assert langid.of_documents(docs.limit(0), ["de", "en"]).count() == 0
    assert langid.of_documents(docs.withColumn("lang", F.lit(None).cast("string")), ["de", "en"]).count() == len(rows)


def test_language_sample_at_any_size(spark, monkeypatch):
    """The sample is about as large for a hundred thousand million rows as for fewer, and never empty without an error."""
    for n in (1, 10**4, 10**6, 10**9, 10**11, 10**15):
        expected = n * (langid.sample_bound(n) + 1) / 2**63
        assert math.isclose(expected, min(n, langid.TRAIN_ROWS), rel_tol=0.01)
    docs = spark.createDataFrame([(k, "the and thing", "en") for k in range(50)], "id long, text string, declared string")
    assert langid.fit(docs, ["en"]).shape[0] == 2
    monkeypatch.setattr(langid, "sample_bound", lambda n: -1)
    with pytest.raises(ValueError, match="no row of 50"):
        langid.fit(docs, ["en"])


def test_page_languages(spark):
    """Every fifth page's declaration is taken out; its language is then told from text and host alone."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    said = {r["page_id"]: re.search(r'<html lang="(\w+)', r["html"]) for r in pages.collect()}
    hidden = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("html", "<html lang=[^>]*>", "<html>")).otherwise(F.col("html"))
    got = {r["page_id"]: r["lang"] for r in langid.of_pages(pages.withColumn("html", hidden), ["de", "en", "es", "fr"]).collect()}
    told = [got[k] == m[1] for k, m in said.items() if m and k % 5 == 0]
    assert len(told) > 30 and sum(told) / len(told) > 0.9, (sum(told), len(told))


def test_markup(spark):
    html = '<html LANG=de-AT><!-- a > b --><script>x < y</SCRIPT >Da <b>ist</b> 1 < 2 <style>p{}'
    rows = spark.createDataFrame([(1, "HTTP://Www.x.example:80/p", html)], "page_id long, url string, html string")
    got = rows.select(F.regexp_replace("html", langid.MARKUP, " ").alias("t")).first()["t"]
    assert got.split() == ["Da", "ist", "1", "<", "2"]
    assert langid.of_pages(rows, ["de", "en"]).count() == 1


def test_langid_fusion(spark, monkeypatch):
    """All evidence recomputed row by row; hosts by broadcast, and with hot ones apart."""
    r = random.Random(9)
    vocab = {"en": "the and thing of with that".split(), "de": "der und schau nicht über ein".split()}
    rows = []
    for k in range(120):
        lang = r.choice(["en", "de"])
        rows.append((k, " ".join(r.choice(vocab[lang]) for _ in range(r.randint(0, 3))) or None, r.choice([lang, lang, "xx", None]), r.choice(["com", "de"]), f"h{k % 4}"))
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string")
    names, labels = ["de", "en", "und"], ["de", "en", "other"]

    def grams(t):
        x = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
        ok = lambda b: b == 32 or 97 <= b <= 122 or b >= 128
        h = lambda a, b, c: (((a * 0x9E3779B1) & 0xFFFFFFFF ^ (b * 0x85EBCA77) & 0xFFFFFFFF ^ (c * 0xC2B2AE3D) & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF) >> 18
        return [h(*x[i : i + 3]) for i in range(len(x) - 2) if all(map(ok, x[i : i + 3])) and x[i : i + 2] != b"  "]

    counts = {n: collections.Counter() for n in labels[:2]}
    for _, t, d, _, _ in rows:
        if d in counts:
            counts[d].update(grams(t))
    size = langid.BUCKETS
    log = lambda n, g: -math.log(size) if n == "und" else math.log((counts[n][g] + 0.1) / (counts[n].total() + 0.1 * size))
    logs = [[langid.TEMPER * sum(log(n, g) for g in grams(t)) for n in names] for _, t, *_ in rows]
    soft = [[math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v] for v in logs]
    label = [d if d in counts else "other" for _, _, d, _, _ in rows]
    total = [sum(v[k] for v in soft) for k in range(3)]
    sums = lambda ok: [sum(v[k] for v, row in zip(soft, rows, strict=True) if ok(row)) for k in range(3)]
    smooth = lambda own, parent: [(x + langid.SMOOTH * p) / (sum(own) + langid.SMOOTH) for x, p in zip(own, parent, strict=True)]
    overall = [(x + 1) / (sum(total) + 3) for x in total]
    want = {}
    for row, v, d in zip(rows, logs, label, strict=True):
        said = [sum(s[k] for s, x in zip(soft, label, strict=True) if x == d) for k in range(3)]
        prior = smooth(sums(lambda x: x[3:] == row[3:]), smooth(sums(lambda x: x[3] == row[3]), overall))  # noqa: B023
        z = [v[k] + math.log((said[k] + 1) / (total[k] + 3)) + math.log(prior[k]) for k in range(3)]
        top = max(z)
        want[row[0]] = names[z.index(top)], 1 / sum(math.exp(x - top) for x in z)
    for rows_, hot in ((langid.BROADCAST_ROWS, 10), (0, 15), (0, 10**6)):
        monkeypatch.setattr(langid, "BROADCAST_ROWS", rows_)
        monkeypatch.setattr(langid, "HOT_ROWS", hot)
        got = {x["id"]: x for x in langid.identify(df, ["de", "en"]).collect()}
        assert len(got) == len(rows)
        for k, (lang, sure) in want.items():
            assert math.isclose(got[k]["confidence"], sure, rel_tol=1e-4) and (got[k]["lang"] == lang or sure < 0.51), k


def test_substrings(spark, texts):
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    got, total = rows_by_id(substring_dedup.report(table(spark, texts))), 0
    for k, w in enumerate(words):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        total += len(gone)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept_sha256"]) == (len(w), len(gone), sha(kept)), k
    assert total > 1000
    twice = substring_dedup.report(table(spark, ["w " * 3 + " ".join(map(str, range(40)))] * 2, [7, 7])).collect()
    assert [r["n_removed"] for r in twice] == [43, 43]
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeats(table(spark, texts)).collect()}
    assert cut[0] == texts[0] and cut[texts.index(None)] is None
    assert substring_dedup.report(table(spark, texts).limit(0)).count() == 0


def test_key_blobs_are_in_proportion():
    """A range gets the names of its own documents only: bytes do not grow with the number of ranges."""
    r = np.random.default_rng(4)
    ids, ths = r.integers(0, 2**63, 14_000, dtype=np.uint64), np.zeros(14_000, np.uint64)
    key = r.integers(0, 2**63, 300_000, dtype=np.uint64) * np.uint64(2)
    key[:50_000] = key[0]  # one key of very many documents
    entries = key, np.zeros(len(key), np.uint64), r.integers(0, 14_000, len(key)).astype(np.uint32), np.arange(len(key), dtype=np.uint32)
    size, largest = {}, {}
    for bits in (8, 11):
        batch = next(substring_dedup._blobs(ids, ths, entries, bits)).to_pylist()
        sizes = [len(x["keys"]) + len(x["docs"] or b"") for x in batch]
        size[bits], largest[bits] = sum(sizes), max(sizes) / (sum(sizes) / len(sizes))
    assert size[11] < 1.3 * size[8] and max(largest.values()) < 10


def test_chat(spark):
    kind = "conv_id long, turn long, role string, text string, turns string"
    bad = r"a\e\p<|im_end|>" + "\n<|im_start|>assistant\n\\"
    rows = [(1, 0, "user", "hi", ""), (1, 1, "assistant", bad, ""), (1, 1, "assistant", bad, ""), (2, None, None, None, ""), (2, 0, "assis\ntant", "", ""), (3, 5, "assistant", "😀é", "")]
    out = chat.write_formatted(spark.createDataFrame(rows, kind))
    got = {r["conv_id"]: r for r in chat.digest(out).collect()}
    turns = {1: [("user", "hi"), ("assistant", bad), ("assistant", bad)], 2: [("", ""), ("assis\ntant", "")], 3: [("assistant", "😀é")]}
    for k, t in turns.items():
        loss = "".join(x for r, x in t if r == "assistant")
        assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), len(loss), sha(loss))
    assert chat.digest(chat.write_formatted(spark.createDataFrame(rows, kind).limit(0))).count() == 0


def test_chat_layouts(spark):
    records = [
        ('{"prompt":"a","response":"b","extra":{"x":1}}', [("user", "a"), ("assistant", "b")]),
        ('{"system":"s","prompt":"a","response":"b"}', [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ('{"instruction":"i","input":"n","output":"o"}', [("user", "i\n\nn"), ("assistant", "o")]),
        ('{"messages":[{"role":"user","content":"x"},{"role":"assistant","content":null}]}', [("user", "x"), ("assistant", "")]),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"w"}]}', [("user", "q"), ("assistant", "w")]),
        ('{"messages":[{"role":"user"},{"content":"x"},{"role":"assistant","content":"y"}]}', [("user", ""), ("", "x"), ("assistant", "y")]),
        ('{"messages":[{"role":"user","content":"x"}],"prompt":"p","output":"o","input":[1]}', [("user", "x")]),
        ('{"question":"q","answer":"a","prompt":"p","response":"r"}', [("user", "p"), ("assistant", "r")]),
        ('{"prompt":"[a","response":"[{\\"b\\":1}]"}', [("user", "[a"), ("assistant", '[{"b":1}]')]),
        ('{"messages":[]}', []), ('{"prompt":"a"}', []), ('{"other":1}', []), ("no json", []), (None, []),
    ]
    df = spark.createDataFrame([(k, j) for k, (j, _) in enumerate(records)], "id long, j string")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.canonical_json(df, "id", "j").collect()}
    assert got == {k: t for k, (_, t) in enumerate(records)}
    nested = spark.createDataFrame([(1, [("user", "x"), ("assistant", "y")])], "id long, messages array<struct<role string, content string>>")
    assert [tuple(t) for t in chat.canonical(nested, "id").first()["turns"]] == [("user", "x"), ("assistant", "y")]
    clashing = spark.createDataFrame([(1, 0, "user", "x", "p", "s", "o")], "conv_id long, turn long, role string, text string, prompt string, system string, output string")
    assert [tuple(t) for t in chat.canonical(clashing).first()["turns"]] == [("user", "x")]
    with pytest.raises(ValueError):
        chat.canonical(spark.range(1), "id")


def test_chat_of_many_turns(spark):
    rows = spark.range(30_000).selectExpr("1 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('é', id) AS text")
    got = chat.digest(chat.write_formatted(rows)).first()
    said = "".join(f"é{k}" for k in range(1, 30_000, 2))
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (30_000, len(said), sha(said))


def test_exact_dedup(spark, texts):
    for hash_of in (F.xxhash64, lambda c: F.lit(5).cast("long")):  # all texts collide in the second
        got = rows_by_id(exact_dedup.exact_groups(table(spark, texts), capacity=2000, hash_of=hash_of))
        groups = collections.defaultdict(list)
        for k, t in enumerate(texts):
            groups[t or ""].append(k)
        for t, ks in groups.items():
            assert all((got[k]["keep_id"], got[k]["group_size"], got[k]["kept"], got[k]["text_sha256"]) == (max(ks), len(ks), k == max(ks), sha(t)) for k in ks)
    assert {r["doc_id"] for r in exact_dedup.keep_one(table(spark, texts)).collect()} == {max(ks) for ks in groups.values()}
    ties = exact_dedup.keep_one(table(spark, ["a", "a", "b", None, ""], [1, 1, None, None, None])).collect()
    assert sorted((r["text"] or "") for r in ties) == ["", "a", "b"]
    assert exact_dedup.exact_groups(table(spark, texts).limit(0)).count() == 0
    alike = exact_dedup.exact_groups(table(spark, ["a", "a", None, "", "b"], [1, 1, None, None, None])).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in alike) == [
        (0, 0, 1, True), (0, 0, 2, False), (0, 0, 2, True), (1, 1, 2, False), (1, 1, 2, True)]


def test_hash_index_is_the_path(spark, texts):
    """Each bucket's file holds its own slots' texts, and without it their documents are an error."""
    import shutil

    docs = table(spark, texts)
    index = exact_dedup.build_index(docs, capacity=2000)
    assert index.depth > 0 and index.entries.select("bucket").distinct().count() > 2
    rows = exact_dedup._rows(docs, F.xxhash64)
    assert index.probe(rows).count() == len(texts)
    bucket = index.entries.first()["bucket"]
    held = {r["h"] for r in index.entries.filter(F.col("bucket") == bucket).collect()}
    gone = sum(r["h"] in held for r in rows.collect())
    shutil.rmtree(f"{index.path.removeprefix('file:')}/entries/bucket={bucket}")
    left = exact_dedup.Index(spark, index.path).probe(rows)
    assert gone > 0
    with pytest.raises(Exception, match="the hash index has lost the place"):
        left.write.format("noop").mode("overwrite").save()
    shutil.rmtree(f"{index.path.removeprefix('file:')}/directory")
    spark.createDataFrame([], exact_dedup.Index.DIRECTORY).write.parquet(f"{index.path}/directory")
    with pytest.raises(Exception, match="the hash index has lost the place"):
        exact_dedup.Index(spark, index.path).probe(rows).write.format("noop").mode("overwrite").save()
    chains = exact_dedup.build_index(docs, hash_of=lambda c: F.lit(5).cast("long")).entries.collect()
    assert [len(r["chain"]) for r in chains] == [len({t or "" for t in texts})]


def test_directory_doubling():
    depth, buckets = exact_dedup.directory({0: 10, 1: 10, 2: 1, 7: 1}, capacity=10, max_depth=3)
    assert depth == 3 and buckets == [(3, 0), (3, 1), (2, 1), (1, 1)]
    assert exact_dedup.directory({}, 10, 3) == (0, [(0, 0)])


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(spark, texts, order):
    got = rows_by_id(kneser_ney.report(table(spark, texts), order))
    toks = {k: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW)), "</s>"] for k, t in enumerate(texts)}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in toks}
    padded = {k: ["<s>"] * (order - 1) + t for k, t in toks.items()}
    runs = lambda t, n: [tuple(t[i - n + 1 : i + 1]) for i in range(order - 1, len(t))]
    one, top = collections.Counter(), collections.Counter()
    for k in toks:
        if not held[k]:
            one.update(toks[k])
            top.update(runs(padded[k], order))
    counts = {order: top}  # of the longest runs; of shorter ones the kinds of longer runs they end
    distinct = {order: set(top)}
    for n in range(order - 1, 0, -1):
        distinct[n] = {r for k in toks if not held[k] for r in runs(padded[k], n)}
        counts[n] = collections.Counter(r[1:] for r in distinct[n + 1])
    by, total, weight = {}, {}, {}
    d = lambda n, c: by[n][min(c, 3) - 1] if c else 0
    for n, c in counts.items():
        cc = collections.Counter(c.values())
        by[n] = kneser_ney.discounts(*(cc[k] for k in (1, 2, 3, 4)))
        total[n], weight[n] = collections.Counter(), collections.Counter()
        for r, m in c.items():
            total[n][r[:-1]] += m
            weight[n][r[:-1]] += d(n, m)
    n, v = one.total(), len(one)

    def p(run):
        k = len(run)
        lower = p(run[1:]) if k > 1 else 1 / (v + 1)
        context, c = run[:-1], counts[k][run]
        return (c - d(k, c) + weight[k][context] * lower) / total[k][context] if total[k][context] else lower

    context = tuple(padded[next(k for k in toks if not held[k] and len(toks[k]) > 20)][9 : 9 + order - 1])
    assert abs(sum(p((*context, w)) for w in one) + p((*context, "never seen")) - 1) < 1e-9
    for k, t in toks.items():
        assert (got[k]["held_out"], got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (held[k], len(t), sum(one[w] > 0 for w in t), n)
        assert math.isclose(got[k]["base_score"], sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(got[k]["score"], sum(math.log10(p(r)) for r in runs(padded[k], order)), rel_tol=1e-9)
    assert kneser_ney.report(table(spark, texts).limit(0), order).count() == 0


def test_lost_model_file(spark, texts):
    """A range's file that is gone is an error, not an empty range."""
    import os

    model = kneser_ney.train(table(spark, texts))
    for level in model.levels.values():
        for f in os.listdir(level.files.folder):
            os.remove(f"{level.files.folder}/{f}")
    with pytest.raises(Exception, match="FileNotFoundError"):
        kneser_ney.score(table(spark, texts), model).collect()


def test_decontamination(spark, texts):
    items = [(1, " ".join(texts[3].split()[2:30])), (2, "tiny Item"), (3, None), (4, "..."), (5, " ".join(texts[3].split()[4:22])), (None, "once more tiny item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cases = [*texts, "a TINY, item! tiny item", "é" + (texts[3] or "").upper().replace("É", "é"), "Once more tiny item."]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for a in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[a : a + min(10, len(w))])].add("" if i is None else str(i))
    for broadcast in (1 << 26, 0):
        decontam.BROADCAST_BYTES, was = broadcast, decontam.BROADCAST_BYTES
        got = rows_by_id(decontam.report(table(spark, cases), bench))
        decontam.BROADCAST_BYTES = was
        for k, t in enumerate(cases):
            w, hit, found = cut(t), set(), set()
            for x in windows:
                for a in range(len(w) - len(x) + 1):
                    if tuple(w[a : a + len(x)]) == x:
                        hit |= set(range(a, a + len(x)))
                        found |= windows[x]
            want = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
            assert tuple(got[k][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want, t
    kept = {r["doc_id"] for r in decontam.drop_documents(table(spark, cases), bench).collect()}
    assert kept == {k for k, r in got.items() if not r["contaminated"]}
    spans = {r["doc_id"]: r["text"] for r in decontam.drop_spans(table(spark, cases), bench).collect()}
    assert spans[len(texts)] == "a , !  " and spans[0] == texts[0]
    assert decontam.report(table(spark, cases), bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.report(table(spark, cases).limit(0), bench).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.sql(oracles.SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)
