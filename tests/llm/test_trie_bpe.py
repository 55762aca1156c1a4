"""Encoding by the trie walk against the library, and against merging by hand."""

import array
import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import queries, trie_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as file:
        return trie_bpe.Codec(file.read())


def awkward():
    r = random.Random(1)
    alphabet = [*"aaaabcdeestTHinIN'012 \t\n\x0b\x1c\x85\xa0éÉİΣσςßñ漢😀\u0301\u0300가<|>_-.", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'re", "'LL", "\u3000", "A\u030a", "ﬁ", "٣", "½"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    return texts + ["a" * n for n in range(1, 150)] + ["".join(r.choice("ab") for _ in range(300)) for _ in range(40)]


def test_ids_and_text_equal_the_library(codec, library):
    texts = awkward()
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for text, got in zip(part, codec.encode([t.encode() for t in part]), strict=True):
            ids = library.encode(text, add_special_tokens=False).ids
            assert array.array("I", got).tolist() == ids, text
            assert codec.decode(got).decode() == library.decode(ids, skip_special_tokens=False)


def test_small_caches_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(trie_bpe, "KEPT_PIECES", 20)
    monkeypatch.setattr(trie_bpe, "KEPT_PAIRS", 20)
    for text in awkward()[:300]:
        assert array.array("I", codec.encode([text.encode()])[0]).tolist() == library.encode(text, add_special_tokens=False).ids


def by_merging(word, rank):
    """Lowest rank first, leftmost of a rank."""
    parts = [*word[:-1], word[-1] + "$"]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: rank.get((parts[k], parts[k + 1]), len(rank)))
        if (parts[best], parts[best + 1]) not in rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def test_any_merges():
    """Small random vocabularies over two letters, where ties and overlaps are the rule."""
    r = random.Random(3)
    for _ in range(60):
        tokens, merges = ["a", "b", "a$", "b$"], []
        while len(merges) < 12:
            a, b = r.choice([t for t in tokens if not t.endswith("$")]), r.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        bpe = trie_bpe.WordBpe({t: k for k, t in enumerate(tokens)}, merges, "$")
        words = list({"".join(r.choice("ab") for _ in range(r.randint(1, 14))) for _ in range(200)})
        rank = {m: k for k, m in enumerate(merges)}
        assert [[tokens[t] for t in ids] for ids in bpe.encode(words)] == [by_merging(w, rank) for w in words]


def test_shared_prefixes_are_found_once(codec):
    looked = []
    word_bpe = trie_bpe.WordBpe.__new__(trie_bpe.WordBpe)
    word_bpe.__dict__ = dict(codec.bpe.__dict__)

    class Counting(dict):
        def get(self, key, default=None):
            looked.append(key)
            return dict.get(self, key, default)

    word_bpe.plain_tails = Counting(codec.bpe.plain_tails)
    stem = "internationalisation"
    word_bpe.encode([stem + c for c in "s"])
    once = len(looked)
    looked.clear()
    word_bpe.encode([stem + c for c in "abcdefghij"])
    assert len(looked) <= once + 10


def test_rows(spark, library):
    """Nulls, empties, repeated and missing doc_ids, clashing columns, long words; and an empty table."""
    texts = [None, "", " \t", "A cat's 12 hats", "A cat's 12 hats", "x" * 50_000, "<|endoftext|>" * 3, "é" * 400]
    rows = [(k if k < 7 else None, t, "a", 1, ["x"]) for k, t in enumerate(texts)] + [(3, "other", "b", 2, ["y"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, decoded array<string>")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), sha(array.array("I", ids).tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, trie_bpe.digests(docs, PATH).collect()), key=key) == sorted(want, key=key)
    coded = trie_bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    assert {(r["doc_id"], r["text"], len(r["ids"])) for r in coded.collect()} == {(k, t, n) for (k, t, *_), (_, n, *_) in zip(rows, want, strict=True)}
    assert trie_bpe.digests(docs.limit(0), PATH).count() == 0


def test_other_vocabularies_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        trie_bpe.Codec(file.read())


def test_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_trie_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(array.array("I", ids).tobytes()).hexdigest()
