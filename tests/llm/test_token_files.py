"""Token files: ids by chunks of an Arrow column are the library's ids, and cost a fraction of chunk-wise Python."""

from __future__ import annotations

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import chunks, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "b", "Z", "\u00e9", "\u00df", "\u4e2d", "\U0001f642", " ", "  ", "\n", "\n\n", "\t", "\r", "\u00a0", "\u2003", "\u3000", "\u0085", "\u2028", "\x1c", "\x1f", *".,!?:;",
    "'", "'s", "'ll", "<|endoftext|>", "<|", "|>", "endoftext", "1", "42", "-", "\"", "\u0301", "\u200b", "\u2019", "\u2013", "the", " and", "#",
]


def library(tokenizer: Tokenizer, text: str | None) -> list[int]:
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("kept", [chunks.KEPT_COLUMN_CHUNKS, 20])
def test_column_encoder_is_the_library(kept):
    tokenizer, encoder, rng = Tokenizer.from_file(PATH), token_files._encoder(PATH, 2), random.Random(3)
    encoder = chunks.ColumnEncoder(encoder.encode_chunks, 2, kept=kept)
    batches = [[None if rng.random() < 0.05 else "".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(100)] for _ in range(60)]
    for texts in [[], [None], [""], ["", None, ""], [" "], ["a"], ["x" * 5000 + " y", "x" * 5000], *batches]:
        assert encoder.encode(pa.array(texts, pa.string())).to_pylist() == [library(tokenizer, t) for t in texts]
        assert len(encoder.ids) == len(encoder.places) + 1
    part = pa.array(["xx", "a b", "c d. ", None, "zz"]).slice(1, 3)
    assert encoder.encode(part).to_pylist() == [library(tokenizer, t) for t in part.to_pylist()]
    assert max(map(len, encoder.places)) <= chunks.LONGEST_KEPT


def test_tokens_that_run_across_cuts(spark, tmp_path):
    """An added token with a space or mark was cut, so its texts got other ids than the library's."""
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.add_tokens(["New York", "etc. and"])
    tokenizer.save(path := str(tmp_path / "added.json"))
    texts = ["in New York it is", "so on etc. and New York.", None, "new york"]
    files, _ = token_files.encode_to_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, 2)
    got = {r["doc_id"]: r for r in token_files.digest(files).collect()}
    for k, t in enumerate(texts):
        want = library(tokenizer, t)
        assert (got[k]["n_tokens"], got[k]["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes())), t


def test_known_words_cost_little():
    """Words met before are looked up once a batch, not once for each place as the encoder of Python strings does."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=500)) + "." for _ in range(1000)]
    encoder = token_files._encoder(PATH, 2)

    def plain(some: list[str]) -> list[bytes]:
        ids, counts = encoder.encode_chunks(some)
        ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
        return [chunks.pack_ids(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    strings, column = chunks.ChunkEncoder(plain), pa.array(texts)
    spent = {"column": [], "strings": []}
    for _ in range(4):  # the first meets the words
        began = time.process_time()
        got = encoder.encode(column)
        spent["column"].append(time.process_time() - began)
        began = time.process_time()
        want = strings.encode(column.to_pylist())
        spent["strings"].append(time.process_time() - began)
    end = np.array([2], "<u4").tobytes()
    assert [np.array(x, "<u4").tobytes() for x in got.to_pylist()] == [x + end for x in want]
    assert min(spent["column"][1:]) < 0.7 * min(spent["strings"][1:]), spent
