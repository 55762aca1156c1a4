"""Exact deduplication by an extendible-hash index in files of the shared folder.

Texts get a 64-bit hash; its leading bits name a directory slot.  The directory starts with one bucket
and depth 0.  As long as a bucket holds more distinct text than ``capacity`` bytes it is split on its
next bit, and the directory doubles when the bucket was as deep as the directory.  The split decisions
need only a histogram of distinct text by hash prefix (at most 2**max_depth rows on the driver).

Rows find their bucket through the directory.  Texts of one key (bucket and hash) are brought to the
key's owner task, where they are compared byte by byte: equal ones are one entry, different ones form
the key's chain.  Rows are combined so where they are read too, so a text that a third of all rows
share costs one row for each task.  The owner of a bucket, a contiguous range of hashes, then writes the
bucket's file.  Documents find their group by probing: slot to bucket in the directory, hash in the
bucket's file, text in the chain; nothing but the index says who stays.

Null texts count as empty.  Of equal texts the row with the largest doc_id stays (a null doc_id is
smaller than any other); if rows repeat both, one of them stays.  An empty table gives an empty index
and no rows.  Other columns are ignored, whatever their names, or carried as they are.

DataFrame operations only; nothing runs in Python on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, staged, staging_path

CAPACITY = 64 << 20
MAX_DEPTH = 16
#: Rows that one row of repeated documents is spread to at a time.
SPREAD = 100_000


def _slot(h: Column, depth: int) -> Column:
    """The leading bits of a hash as a number."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def directory(histogram: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, list[tuple[int, int]]]:
    """(global depth, buckets) where a bucket is (local depth, prefix of that many bits), in key order.

    ``histogram`` has the bytes of distinct text by prefix of max_depth bits.
    """
    depth, done, todo = 0, [], [(0, 0, histogram)]
    while todo:
        local, prefix, held = todo.pop()
        if local < max_depth and sum(held.values()) > capacity:
            depth = max(depth, local + 1)
            bit = max_depth - local - 1
            for half in (1, 0):
                todo.append((local + 1, prefix * 2 + half, {k: v for k, v in held.items() if k >> bit & 1 == half}))
        else:
            done.append((local, prefix))
    return depth, done


class Index:
    """The directory and the bucket files of one index, at ``path``."""

    DIRECTORY = "slot long, bucket int, local_depth int"
    ENTRIES = "h long, chain array<struct<text_sha256: string, n_bytes: long, keep_id: long, group_size: long>>, bucket int"

    def __init__(self, spark, path: str):
        self.path = path
        self.directory = spark.read.schema(self.DIRECTORY).parquet(f"{path}/directory")
        self.entries = spark.read.schema(self.ENTRIES).parquet(f"{path}/entries")
        self.depth = max((r["local_depth"] for r in self.directory.select("local_depth").distinct().collect()), default=0)

    def located(self, rows: DataFrame) -> DataFrame:
        """rows, which have h, with the bucket that the directory names (at most 2**max_depth slots)."""
        slots = F.broadcast(self.directory.select("slot", "bucket"))
        return rows.withColumn("slot", _slot(F.col("h"), self.depth)).join(slots, "slot", "left").drop("slot")

    def probe(self, rows: DataFrame) -> DataFrame:
        """rows (h, text_sha256, n_bytes, ...) with keep_id and group_size of their text's place in the chain; a text without one is an error."""
        found = self.located(rows).join(self.entries, ["bucket", "h"], "left")
        at = F.get(F.filter("chain", lambda c: (c["text_sha256"] == F.col("text_sha256")) & (c["n_bytes"] == F.col("n_bytes"))), 0)
        lost = F.raise_error(F.concat(F.lit("the hash index has lost the place of "), F.col("text_sha256"), F.lit(": a bucket's file is gone")))
        found = found.withColumn("at", F.when(at.isNull(), lost).otherwise(at))
        return found.select(*rows.columns, "at.keep_id", "at.group_size")


def build_index(
    docs: DataFrame,
    capacity: int = CAPACITY,
    max_depth: int = MAX_DEPTH,
    hash_of: Callable[[Column], Column] = F.xxhash64,
) -> Index:
    """Write the index of docs to the shared folder: directory (slot, bucket, local_depth) and one file a
    bucket with, for each hash, the chain of its distinct texts: text_sha256, n_bytes, keep_id, group_size."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"))
    rows = rows.withColumn("h", hash_of(F.col("text")))

    held = (
        rows.select("h", F.octet_length("text").alias("n")).groupBy("h").agg(F.max("n").alias("n"))
        .groupBy(_slot(F.col("h"), max_depth).alias("slot")).agg(F.sum("n").alias("n"))
    )
    depth, buckets = directory({r["slot"]: r["n"] for r in held.collect()}, capacity, max_depth)
    slots = [(prefix * 2 ** (depth - local) + k, b, local) for b, (local, prefix) in enumerate(buckets) for k in range(2 ** (depth - local))]
    path = staging_path(spark, "hash-index")
    spark.createDataFrame(slots, Index.DIRECTORY).coalesce(1).write.parquet(f"{path}/directory")
    spark.createDataFrame([], Index.ENTRIES).write.parquet(f"{path}/entries")
    index = Index(spark, path)

    # the owner of a key compares the texts under it, byte by byte as keys of their own, and chains what is left
    texts = index.located(rows).groupBy("bucket", "h", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    link = F.struct(F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"), "keep_id", "group_size")
    entries = texts.select("bucket", "h", link.alias("link")).groupBy("bucket", "h").agg(F.array_sort(F.collect_list("link")).alias("chain"))
    entries.repartition("bucket").sortWithinPartitions("bucket", "h").write.mode("append").partitionBy("bucket").parquet(f"{path}/entries")
    return Index(spark, path)


def _rows(docs: DataFrame, hash_of: Callable[[Column], Column]) -> DataFrame:
    text = _text()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), hash_of(text).alias("h"),
        F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).cast("long").alias("n_bytes"),
    )


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build_index(docs, capacity=capacity, hash_of=hash_of)
    found = index.probe(_rows(docs, hash_of))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = found.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256", "h", "n_bytes")
    repeats = staged(_repeats(docs, hash_of), "repeats")
    if repeats.isEmpty():
        return out.drop("h", "n_bytes")
    # rows that repeat both id and text are alike: they are counted and dealt out again, the first one staying
    key = ["doc_id", "h", "text_sha256", "n_bytes"]
    many = broadcast_if_small(repeats.select(*(F.col(c).alias(f"_{c}") for c in [*key, "n"])), "repeated")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / SPREAD))
    dealt = many.select("*", F.explode(parts).alias("_part")).repartition(*(f"_{c}" for c in key), "_part")
    first = F.col("_part") * SPREAD
    dealt = dealt.select("*", F.explode(F.sequence(first, F.least(first + SPREAD, F.col("_n")) - 1)).alias("_k"))
    once = index.probe(many.select(*(F.col(f"_{c}").alias(c) for c in key)))
    again = dealt.join(broadcast_if_small(once, "repeated-groups"), same).select(
        "doc_id", "keep_id", "group_size", (stays & (F.col("_k") == 0)).alias("kept"), "text_sha256")
    return out.join(many, same, "left_anti").drop("h", "n_bytes").unionByName(again)


def _repeats(docs: DataFrame, hash_of: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, h, text_sha256, n_bytes, n) of rows that are there more than once."""
    key = ["doc_id", "h", "n_bytes"]
    often = _rows(docs, hash_of).drop("text_sha256").groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    often = broadcast_if_small(often.select(*(F.col(c).alias(f"_{c}") for c in key)), "often")
    rows = _rows(docs, hash_of).join(often, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left_semi")
    return rows.groupBy(*key, "text_sha256").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "h", "text_sha256", "n_bytes", "n")


def keep_one(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs without the rows whose text a staying row has; all columns as they were."""
    index = build_index(docs, capacity=capacity)
    found = index.probe(_rows(docs, F.xxhash64)).filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    key = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("text_sha256").alias("_sha")).distinct()
    gone = broadcast_if_small(key(found), "copies")
    own, sha = F.xxhash64(_text()), F.sha2(_text(), 256)
    at = lambda of: docs["doc_id"].eqNullSafe(of["_id"]) & (own == of["_h"]) & (sha == of["_sha"])
    kept = docs.join(gone, at(gone), "left_anti")
    again = broadcast_if_small(key(_repeats(docs, F.xxhash64)), "repeats")
    if not again.isEmpty():  # rows that repeat both id and text
        once = kept.join(again, at(again), "left_semi").withColumn("_sha", sha).dropDuplicates(["doc_id", "_sha"]).drop("_sha")
        kept = kept.join(again, at(again), "left_anti").unionByName(once)
    return kept
