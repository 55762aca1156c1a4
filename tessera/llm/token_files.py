"""Token-ID files: Parquet with dictionary-coded id lists, set row groups and page indexes.

A file set holds one row per document in ascending order of doc_id over all its parts:

    part      int           ordinal of the file; ascending in doc_id
    at        long          tokens of this part before the document
    doc_id    long
    n_tokens  long
    ids       array<int>    the document's ids, the end id last

``ids`` is dictionary coded (a vocabulary fits one dictionary page), the counters are delta coded, and
row groups and pages are small enough that a reader of some documents, or of the metadata columns
alone, touches little else: the writer adds column and offset indexes by which Spark skips pages.

Null texts are empty (only the end id); null doc_ids come first; equal doc_ids are ordered by text.
An empty table gives an empty file set.  Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.chunks import ColumnEncoder
from tessera.llm.common import bounded_batches, slices, staging_path

WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(2 << 20),
}
SCHEMA = "part int, at long, doc_id long, n_tokens long, ids array<int>"

#: Unseen chunks put together for one call of the tokenizer.
TOGETHER = 512

#: Bytes of texts whose distinct chunks are looked up together.
_BATCH = 4_000_000

_encoders: dict[tuple[str, int], ColumnEncoder] = {}


def _cuttable(tokenizer) -> bool:
    """Whether no token of the tokenizer runs across the cuts: byte-level, by its usual pattern, and added tokens without their characters."""
    spec = json.loads(tokenizer.to_str())
    before = spec["pre_tokenizer"] or {}
    usual = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return usual and not any(
        any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(c.isspace() or c in ".,;:!?" for c in t["content"])
        for t in spec["added_tokens"]
    )


def _encoder(tokenizer_path: str, end_id: int) -> ColumnEncoder:
    """One for each worker process, kept between tasks.

    Chunks that begin with their only space or line feed and do not end with white space are joined before they
    are encoded: the cuts between them are safe, and a token that begins with a space or line feed begins a chunk.
    """
    key = tokenizer_path, end_id
    if key in _encoders:
        return _encoders[key]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    cuttable = _cuttable(tokenizer)
    size = max(tokenizer.get_vocab().values()) + 1
    begins = np.array([(tokenizer.id_to_token(i) or "")[:1] in ("\u0120", "\u010a") for i in range(size)])

    def encode_joined(chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        ids = np.array(tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, np.int64)
        starts = np.flatnonzero(begins[ids])
        return (ids, np.diff(starts, append=len(ids))) if len(starts) == len(chunks) else None

    def encode_each(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [tokenizer.encode(c, add_special_tokens=False).ids for c in chunks]
        return np.array(list(chain.from_iterable(ids)), np.int64), np.array(list(map(len, ids)), np.int64)

    def encode_chunks(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joins = [cuttable and c[0] in " \n" and c.count(" ") + c.count("\n") == 1 and not c[-1].isspace() for c in chunks]
        order = sorted(range(len(chunks)), key=joins.__getitem__)
        single = len(chunks) - sum(joins)
        found = [encode_each([chunks[k] for k in order[:single]])]
        for at in range(single, len(order), TOGETHER):
            part = [chunks[k] for k in order[at : at + TOGETHER]]
            found.append(encode_joined(part) or encode_each(part))
        ids, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return lists.take(pa.array(back)).values.to_numpy(), counts[back]

    _encoders[key] = ColumnEncoder(encode_chunks, end_id, whole=not cuttable)
    return _encoders[key]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode every text, append end_id, and write the file set at ``path``.

    Texts are dealt out by ranges of doc_id, so each task writes one part in order.  ``tokenizer_path``
    must exist on every worker.
    """
    bounded_batches(docs.sparkSession)
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0
        for batch in slices(batches, most=_BATCH):
            ids = encoder.encode(batch.column("text"))
            offsets = ids.offsets.to_numpy().astype(np.int64)
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), part, np.int32)),
                    pa.array(at + offsets[:-1]),
                    batch.column("doc_id"),
                    pa.array(n),
                    ids,
                ],
                names=["part", "at", "doc_id", "n_tokens", "ids"],
            )
            at += int(offsets[-1])

    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(encode, SCHEMA).write.options(**WRITE_OPTIONS).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def document_starts(files: DataFrame) -> DataFrame:
    """(part, before): tokens of all earlier parts.  One row a part; reads the counters only."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("before"))


def digest(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as the files have them; start counts the tokens of all documents before."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            found = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("at"), batch.column("doc_id"), batch.column("n_tokens"), pa.array(found, pa.int64())],
                names=["part", "at", "doc_id", "n_tokens", "ids_crc32"],
            )

    rows = files.mapInArrow(crc, "part int, at long, doc_id long, n_tokens long, ids_crc32 long")
    # one row a part, so as many as there are files
    return rows.join(F.broadcast(document_starts(files)), "part").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_to_files(docs: DataFrame, tokenizer_path: str, end_id: int) -> tuple[DataFrame, str]:
    """Write a file set to the shared folder; gives it back as read, and its path."""
    spark = docs.sparkSession
    path = staging_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_files(spark, path), path
