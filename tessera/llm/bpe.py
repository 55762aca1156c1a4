"""Byte-level BPE by a sentencepiece model written straight from a rank vocabulary.

The model proto is assembled field by field: every vocabulary entry becomes a NORMAL piece whose
characters stand for its bytes and whose score is its negative rank, so that sentencepiece merges the
pair of lowest rank first, leftmost on ties, as rank-based BPE does.  Normalisation is the identity, no
prefix is added and no space is removed.  The unknown piece comes last, so a piece's id is its rank.

A text is cut into pre-tokens by the split pattern.  A pre-token that is itself an entry is that entry;
any other goes through sentencepiece.  Decoding maps ids back to pieces, characters and bytes.

Null texts are empty.  Rows keep their other columns; existing columns ids, n_tokens or decoded are
replaced.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chunks import ChunkEncoder, pack_ids
from tessera.llm.common import bounded_batches, slices

#: Byte b is written as this character; none is white space or special to sentencepiece.
BYTE_CHARS = [chr(0x4E00 + b) for b in range(256)]
_AS_CHARS = {b: BYTE_CHARS[b] for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def as_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_AS_CHARS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece ModelProto for the ranks, which must be 0..n-1 and hold all 256 bytes."""
    entries = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in entries] != list(range(len(entries))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be consecutive from 0 and cover every byte")
    piece = lambda text, score, kind: _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind)
    parts = [_field(1, piece(as_chars(data), -float(rank), 1)) for data, rank in entries]
    parts.append(_field(1, piece("<unk>", -float(len(entries)), 2)))
    off = 2**64 - 1  # an int32 of -1
    trainer = _field(3, 2) + _field(4, len(parts)) + _field(40, len(entries)) + _field(41, off) + _field(42, off) + _field(43, off)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(parts) + _field(2, trainer) + _field(3, normalizer)


class ByteLevelBpe:
    """Encoder and decoder over one model proto."""

    def __init__(self, proto: bytes, pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.split = regex.compile(pattern).findall
        back = {c: bytes([b]) for b, c in enumerate(BYTE_CHARS)}
        n = self.processor.get_piece_size() - 1
        self.pieces = [b"".join(back[c] for c in self.processor.id_to_piece(i)) for i in range(n)]
        self.whole = {piece: i for i, piece in enumerate(self.pieces)}
        self.chunks = ChunkEncoder(self._encode_chunks)

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        cut = [[p.encode() for p in self.split(c)] for c in chunks]
        hard = {p for pieces in cut for p in pieces if p not in self.whole}
        hard = list(hard)
        found = dict(zip(hard, self.processor.encode([as_chars(p) for p in hard], num_threads=1), strict=True)) if hard else {}
        out = []
        for pieces in cut:
            ids: list[int] = []
            for p in pieces:
                if p in found:
                    ids += found[p]
                else:
                    ids.append(self.whole[p])
            out.append(pack_ids(ids))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.chunks.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))


_loaded: dict[str, ByteLevelBpe] = {}


def _codec(proto: bytes, pattern: str) -> ByteLevelBpe:
    """One for each worker process and model, kept between tasks."""
    key = hashlib.sha256(proto + pattern.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = ByteLevelBpe(proto, pattern)
    return _loaded[key]


def _shipped(docs: DataFrame, ranks_path: str):
    """The model's bytes for the workers: one vocabulary, about a megabyte, whatever the input."""
    bounded_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(model_proto(read_ranks(ranks_path)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with ``ids`` (array<int>) of the whole text, ``n_tokens``, and ``decoded`` (binary) from the ids."""
    proto = _shipped(docs, ranks_path)
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "n_tokens", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(proto.value, pattern)
        for batch in slices(batches, text_col):
            coded = codec.encode([t or "" for t in batch.column(text_col).to_pylist()])
            n = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            decoded = pa.array([codec.decode(x) for x in coded], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), ids, pa.array(n), decoded], names=[*(f.name for f in kept), "ids", "n_tokens", "decoded"]
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ids array<int>, n_tokens long, decoded binary"])
    return docs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode, and hash both where they are made."""
    proto = _shipped(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(proto.value, pattern)
        for batch in slices(batches):
            coded = codec.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in coded], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
