"""The pipeline's stages, each on what the one before kept."""

import random
import re

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "language_id":
            assert docs.count() == len(seen)
        if name == "exact_dedup":
            last = {t: k for k, t in sorted(seen.items())}
            assert {r["doc_id"] for r in docs.collect()} == set(last.values())
    assert docs.filter("NOT round_trip").count() == 0 and docs.count() > 100


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def windows(text, pattern, n):
    w = re.findall(pattern, (text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_stages_against_brute_force(spark, tmp_path):
    """Awkward rows through the first four stages, each held against its own input."""
    r = random.Random(8)
    vocab = {"en": "the and thing of with that ation ering was for".split(), "de": "der und schau nicht über ein keit zu das mit".split()}
    make = lambda lang, n: " ".join(r.choice(vocab[lang]) + r.choice(["", "", "s", "er"]) for _ in range(n))
    texts = [make(("en", "de")[k % 2], r.randint(20, 90)) for k in range(60)]
    base = make("en", 200).split()
    near = [" ".join(w if k != at else "changed" for k, w in enumerate(base)) for at in (20, 90, 150)]
    item = make("de", 30)
    leaks = [make("de", 15) + " " + item.upper() + ". " + make("de", 9), " ".join(item.split()[5:15]), " ".join(item.split()[5:14]) + " anders"]
    junk = "".join(r.choice("qxzjvwkyfpg ") for _ in range(900))
    texts += [*near, *near[:1], *leaks, junk, None, "", None, texts[3], texts[3], make("en", 6000)]
    rows = [(k, t, ("en", "de")[k % 2] if t != junk else None, "s", "x", "y") for k, t in enumerate(texts)] + [(None, texts[5], "en", "s", "x", "y"), (3, texts[3], "de", "s", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, th string, bucket string").repartition(3)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda df: sorted(((x["doc_id"] is not None, x["doc_id"] or 0), x["text"] or "") for x in df.collect())
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        seen.append((key(docs), key(out)))
        docs = out
    (a, b), (_, c), (_, d), (_, e) = seen
    assert [x for x in a if x not in b] == [x for x in a if x[1] == junk]
    assert c == sorted((i, t) for t, i in {t: i for i, t in sorted(b)}.items())
    left = {i: windows(t, "[^\x20\x09-\x0d]+", 5) for i, t in c}
    root = {i: i for i in left}
    for _ in range(4):
        for i, s in left.items():
            for j, t in left.items():
                if s and t and 100 * len(s & t) >= 80 * len(s | t):
                    root[i] = root[j] = min(root[i], root[j])
    assert d == [x for x in c if root[x[0]] == x[0]] and len(d) < len(c)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    leaked = windows(item, word, 10)
    assert e == [x for x in d if not leaked & windows(x[1], word, 10)] and len(d) - len(e) == 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.filter("NOT round_trip").count() == 0 and last.count() == len(e)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
