"""What the corpus operators share: staged tables, word hashing over Arrow buffers, compact key blobs.

Word hashing works on the raw UTF-8 buffer of an Arrow string column.  A word is a maximal run of
bytes other than ASCII white space (0x20, 0x09-0x0D).  Its 64-bit hash is a polynomial over a fixed
random byte table, read off prefix sums modulo 2**64, then mixed; so no Python string is made.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_shared: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where that is unset, a fresh one of a local master only."""
    global _local_shared
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_shared is None:
        _local_shared = tempfile.mkdtemp(prefix="tessera-")
    return "file://" + _local_shared


_swept: set[str] = set()


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder.  All that an application stages goes when its driver ends."""
    root = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    if root not in _swept:
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _swept.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


#: Rows of a few numbers that one task writes with ease.
TASK_ROWS = 20_000


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors.

    ``rows``: a bound on its rows, all of a few numbers, for as many tasks and files as they need; hundreds of
    files of a few rows take longer to open than the work of a round.
    """
    spark, schema = df.sparkSession, df.schema
    path = staging_path(spark, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // TASK_ROWS)))).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows of a few numbers that may be broadcast: some tens of megabytes as a hash table.
BROADCAST_ROWS = 400_000


def broadcast_if_small(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df, staged, for the smaller side of a join: marked for broadcast only if its counted rows are few."""
    df = staged(df, name, rows)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches: by Spark's defaults a batch of long texts takes hundreds of megabytes on both sides.

    Sizes given in the application's own configuration stay.  The session keeps these, as DataFrames read them when they run.
    """
    given = spark.sparkContext.getConf()
    for name, size in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")):
        if not given.contains(name):
            spark.conf.set(name, size)


# ---- long arrays in a row ------------------------------------------------------------------------

#: Elements that are scanned together; an array of n takes about n * _CHUNK + (n / _CHUNK) ** 2 steps.
_CHUNK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, as inside other lambdas it would be for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def before_each(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """array<bigint>: for each of the bigint values what ``add`` makes, from zero, of those before it.

    ``add`` is associative and zero its neutral element.  The values are scanned by chunks, as one fold that
    appends to an array copies the array for every element.
    """
    none = F.array().cast("array<bigint>")
    fold = lambda xs: F.aggregate(
        xs, F.struct(zero.cast("bigint").alias("at"), none.alias("out")),
        lambda a, x: F.struct(add(a["at"], x).cast("bigint").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def scanned(xs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / _CHUNK).cast("int") - 1, F.lit(0)))
        folded = F.transform(numbers, lambda c: fold(F.slice(xs, c * _CHUNK + 1, F.lit(_CHUNK))))
        return bound(folded, lambda parts: F.flatten(F.zip_with(
            parts, fold(F.transform(parts, lambda p: p["at"]))["out"], lambda p, start: F.transform(p["out"], lambda x: add(start, x).cast("bigint")))))

    return bound(values, scanned)


# ---- Arrow batches -------------------------------------------------------------------------

def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts take about ``most`` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        offsets = _offsets(column)
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    offsets = _offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if column.null_count:  # a null may still own bytes
        lengths = np.diff(offsets)
        null = np.asarray(column.is_null())
        if lengths[null].any():
            keep = np.repeat(~null, lengths)
            raw = raw[keep]
            lengths = np.where(null, 0, lengths)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
    return raw, offsets


# ---- word hashes ----------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 19
_table = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_second_table = np.random.Generator(np.random.PCG64(20240301)).integers(1, 2**63, 256, dtype=np.uint64)
_lower_table = _table.copy()
_lower_table[65:91] = _table[97:123]
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, spans: bool = False, second: bool = False):
    """Hashes of the words of consecutive texts, and the word offsets of each text.  ``second``: by another byte table.

    Returns (hashes, word_offsets) or, with ``spans``, (hashes, word_offsets, starts, ends) in bytes.
    """
    table = _lower_table if lower else _second_table if second else _table
    edges = np.zeros(len(raw) + 1, bool)
    edges[offsets] = True
    out, firsts, lasts = [], [], []
    at, n = 0, len(raw)
    while at < n:
        to = min(n, at + _SEGMENT)
        while to < n and not (edges[to] or _space[raw[to]]):  # end at a text's end or at white space
            to += 1
        part = raw[at:to]
        inside = ~_space[part]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        cut = edges[at:to]
        starts = np.flatnonzero(inside & (~before | cut))
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:] & ~cut[1:]
        ends = np.flatnonzero(inside & ~after) + 1
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * up[: len(part)], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * down[starts]))
        firsts.append(starts + at)
        lasts.append(ends + at)
        at = to
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    starts = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    word_offsets = np.searchsorted(starts, offsets)
    if not spans:
        return hashes, word_offsets
    return hashes, word_offsets, starts, np.concatenate(lasts) if lasts else np.zeros(0, np.int64)


def windows_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words (by its first word); runs may cross texts, the caller masks them."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _SEGMENT):
        to = min(n, at + _SEGMENT)
        part = hashes[at : to + size - 1]
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[at:to] = mix((sums[size:] - sums[: to - at]) * down[: to - at])
    return out


# ---- blobs of sorted keys ----------------------------------------------------------------------

def pack(*columns: np.ndarray) -> bytes:
    """Compress arrays of one length; the first holds ascending uint64 keys and is stored as differences."""
    keys = columns[0]
    parts = [len(keys).to_bytes(8, "little")]
    for k, column in enumerate(columns):
        if k == 0 and len(column):
            column = np.diff(column, prepend=np.uint64(0))
        if column.dtype.itemsize > 1:  # equal byte places together compress better
            column = np.ascontiguousarray(column.view(np.uint8).reshape(-1, column.dtype.itemsize).T)
        parts.append(column.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for k, kind in enumerate(kinds):
        size = np.dtype(kind).itemsize
        column = np.frombuffer(raw, np.uint8, n * size, at)
        at += n * size
        column = np.ascontiguousarray(column.reshape(size, n).T).view(kind).reshape(n)
        out.append(np.cumsum(column, dtype=np.uint64) if k == 0 else column)
    return out


def bucket_bits(total: int, per_bucket: int) -> int:
    """Bits of the key that name its bucket, so that a bucket has about ``per_bucket`` keys."""
    return max(3, min(24, (max(1, total) // per_bucket).bit_length()))


def by_bucket(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds) of ascending keys: keys of buckets[i] are bounds[i]:bounds[i+1]."""
    tops = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(tops)) + 1
    firsts = np.concatenate([[0], cuts]) if len(keys) else np.zeros(0, np.int64)
    return tops[firsts], np.concatenate([firsts, [len(keys)]])
