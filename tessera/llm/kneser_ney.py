"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from memory-mapped files.

The model has a level for each length k from 1 to ``order`` (3 by default).  The first pass over the
training text counts the runs of ``order`` tokens: tasks send sorted, distinct keys with counts as
compressed blobs by key range, and the owner of a range merges them into a file of sorted 64-bit hashes
and counts.  Each further pass makes the next shorter level.  It reads the text again and looks the
longer runs up: a run seen c times counts 1/c at each of its places, so sums over places give, for every
shorter run, how many kinds of longer runs it ends (its continuation count), and how many of each count
it begins (in single precision, added up in double, so exact up to some 2**23 kinds and good to one
part in 2**24 beyond).  These become files too.  Workers map the files into memory and look whole batches up in
order, so that the operating system keeps what is needed and no worker loads the model; a worker keeps
MOST_OPEN maps at a time.  The model's size grows with the corpus; of it nothing passes through the
driver but sums and one bit for each range, by which a lost file is an error and not an empty range.

The discounts of every level come from its counts of counts, and the lowest level is interpolated with
the uniform distribution over all training tokens and one for any other, so probabilities sum to one.
A text is preceded by order - 1 begin marks.

A-Z is lower-cased; tokens are runs of anything but ASCII white space, then one end.  A null text is
empty: only the end.  A row with a null doc_id is training text.  Repeated rows count repeatedly.
Without training text every token has the same probability.  An empty table gives no rows; other
columns are ignored.  The shared folder must be a file system path, as the files are memory-mapped.
"""

from __future__ import annotations

import math
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, bucket_bits, by_bucket, mix, pack, slices, staged, staging_path, unpack, utf8, words_of

BEGIN, END = (np.uint64(x) for x in (0x0123456789ABCDEF, 0xFEDCBA9876543210))
_LEFT = np.uint64(0xD6E8FEB86659FD93)
GATHERED, PER_BUCKET = 1_500_000, 1_000_000
#: Tokens of the longest run.
ORDER = 3
#: Files that a worker keeps mapped, of a usual limit of 65 530 maps a process.
MOST_OPEN = 4096


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by their id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def tokens_of(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, places, offsets): all tokens with order - 1 begin marks before each text, where the tokens of
    texts are in it, and the offsets of the texts among these places."""
    words, offsets = words_of(*utf8(column), lower=True)
    n, marks = len(offsets) - 1, order - 1
    out = offsets + np.arange(n + 1)  # with one end a text
    stream = np.full(len(words) + n * (1 + marks), BEGIN, np.uint64)
    places = np.arange(len(words) + n) + marks * (1 + np.repeat(np.arange(n), np.diff(out)))
    is_end = np.zeros(len(places), bool)
    is_end[out[1:] - 1] = True
    stream[places[is_end]], stream[places[~is_end]] = END, words
    return stream, places, out


def run_keys(stream: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The key of the k tokens that end at each place."""
    if k == 1:
        return stream[places]
    key = stream[places - (k - 1)]
    for back in range(k - 2, -1, -1):
        key = mix(key * _LEFT + stream[places - back])
    return key


# ---- files of sorted keys -------------------------------------------------------------------

def local_path(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return path
    raise ValueError(f"the model's files are memory-mapped; {path} is not on a mounted file system")


def _save(folder: str, bucket: int, arrays: list[np.ndarray]) -> None:
    """All or nothing, so that a repeated task does no harm."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.array([len(a) for a in arrays], "<i8").tofile(out)
        for a in arrays:
            a.tofile(out)
    os.replace(part, f"{folder}/{bucket}")


def _pack_small(n: np.ndarray) -> list[np.ndarray]:
    """Counts up to 254 in a byte each; places and counts of the larger."""
    large = np.flatnonzero(n >= 255)
    return [np.minimum(n, 255).astype(np.uint8), large.astype(np.uint32), n[large].astype(np.uint64)]


_SMALL = (np.uint8, np.uint32, np.uint64)


class KeyFiles:
    """Counts by key, in files by key range, mapped when used.  ``names``: the counts a key has.

    ``present``: a bit for each range that has a file.
    """

    def __init__(self, folder: str, bits: int, names: tuple[str, ...], present: np.ndarray):
        self.folder, self.bits, self.names, self.present = folder, bits, names, present
        self.kinds = (np.uint64, *_SMALL * len(names))
        self.open: OrderedDict[int, list[np.ndarray]] = OrderedDict()

    def arrays(self, bucket: int) -> list[np.ndarray] | None:
        if not self.present[bucket >> 3] >> (bucket & 7) & 1:
            return None  # no key in this range
        if bucket in self.open:
            self.open.move_to_end(bucket)
            return self.open[bucket]
        raw = np.memmap(f"{self.folder}/{bucket}", np.uint8, "r")
        sizes = raw[: 8 * len(self.kinds)].view("<i8").tolist()
        at, out = 8 * len(self.kinds), []
        for n, kind in zip(sizes, self.kinds, strict=True):
            to = at + n * np.dtype(kind).itemsize
            out.append(raw[at:to].view(kind))
            at = to
        self.open[bucket] = out
        if len(self.open) > MOST_OPEN:
            self.open.popitem(last=False)
        return out

    def find(self, keys: np.ndarray, *names: str) -> list[np.ndarray]:
        """The named counts of ascending keys, 0 where a key is not there."""
        out = [np.zeros(len(keys), np.int64) for _ in names]
        buckets, bounds = by_bucket(keys, self.bits)
        for bucket, a, b in zip(buckets.tolist(), bounds[:-1], bounds[1:], strict=True):
            arrays = self.arrays(bucket)
            if arrays is None:
                continue
            place = np.searchsorted(arrays[0], keys[a:b])
            place[place == len(arrays[0])] = 0
            found = arrays[0][place] == keys[a:b]
            for held, name in zip(out, names, strict=True):
                small, places, large = arrays[1 + 3 * self.names.index(name) :][:3]
                n = small[place].astype(np.int64)
                big = np.flatnonzero(n == 255)
                if len(big):
                    n[big] = large[np.searchsorted(places, place[big])]
                held[a:b] = np.where(found, n, 0)
        return out


# ---- counting -------------------------------------------------------------------------------

def _gathered(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(stream, places) of many texts at a time."""
    held, count = [], 0
    whole = lambda: (np.concatenate([h[0] for h in held]), np.concatenate([h[1] + h[2] for h in held]))
    at = 0
    for batch in slices(batches):
        stream, places, _ = tokens_of(batch.column("text"), order)
        held.append((stream, places, at))
        at, count = at + len(stream), count + len(places)
        if count >= GATHERED:
            yield whole()
            held, count, at = [], 0, 0
    if count:
        yield whole()


def _sent(columns: list[np.ndarray], bits: int) -> pa.RecordBatch:
    buckets, bounds = by_bucket(columns[0], bits)
    blobs = [pack(*(c[a:b] for c in columns)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _merged(blobs: list[bytes], kinds: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys of all blobs, ascending, and the sums of their columns."""
    parts = [unpack(b, *kinds) for b in blobs]
    key = np.concatenate([p[0] for p in parts])
    order = np.argsort(key)
    key = key[order]
    firsts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums = [np.add.reduceat(np.concatenate([p[k] for p in parts])[order].astype(np.float64 if np.issubdtype(kinds[k], np.floating) else np.int64), firsts) for k in range(1, len(kinds))]
    return key[firsts], sums


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts of 1, 2, and 3 or more; fixed values where the counts of counts don't give them."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


#: Counts of a run: its places, kinds of longer runs it ends, and of longer runs that it begins: kinds
#: counted once, twice and more often, and the sum of their counts.
TOP, LOWER = ("n",), ("n", "ended", "once", "twice", "more", "begun")


@dataclass(frozen=True)
class Level:
    """The runs of one length.  A longest run counts its places, any other the kinds of longer runs it ends."""

    files: KeyFiles
    kinds: int  # runs that count
    places: int
    total: int  # sum of the counts
    seen: tuple[int, int, int]  # runs that count 1, 2, more
    discounts: tuple[float, float, float]


@dataclass(frozen=True)
class Model:
    folder: str
    order: int
    levels: dict[int, Level]

    @property
    def tokens(self) -> int:
        """Training tokens, ends included."""
        return self.levels[1].places

    @property
    def words(self) -> int:
        """Distinct training tokens."""
        return self.levels[1].kinds


_STATS = ("kinds", "places", "total", "n1", "n2", "n3", "n4", "more")


def _level(df: DataFrame, folder: str, bits: int, names: tuple[str, ...]) -> Level:
    """Run the owners of the ranges, each of which gives back its number and its sums."""
    found = staged(df, "ranges")
    sums = found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _STATS)).first()
    bit = (F.col("bucket") + 1).cast("long")  # at most 2**bits / 32768 rows of 4 KB
    parts = found.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    present = np.zeros(max(4096, (1 << bits) >> 3), np.uint8)
    for r in parts:
        present[(r["part"] - 1) * 4096 :][:4096] |= np.frombuffer(r["bits"], np.uint8)[: len(present)]
    n = [sums[c] for c in ("n1", "n2", "n3", "n4")]
    return Level(KeyFiles(folder, bits, names, present), sums["kinds"], sums["places"], sums["total"], (n[0], n[1], sums["more"]), discounts(*n))


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count the texts of docs and write the model's files to the shared folder."""
    if order < 2:
        raise ValueError("a Kneser-Ney model needs runs of two tokens at least")
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = local_path(staging_path(spark, "kneser-ney"))
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bits = bucket_bits((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6, PER_BUCKET)

    def owner(k: int, kinds: tuple, names: tuple[str, ...]):
        def write(table: pa.Table) -> pa.Table:
            keys, columns = _merged(table["blob"].to_pylist(), kinds)
            columns = [np.rint(c).astype(np.int64) for c in columns]
            bucket = table["bucket"][0].as_py()
            _save(f"{folder}/{k}", bucket, [keys, *(x for c in columns for x in _pack_small(c))])
            places = columns[0]
            counts = places if k == order else columns[1]
            real = places if k == 1 else counts  # begin marks are no words
            row = [int((real > 0).sum()), int(places.sum()), int(counts.sum()), *_counts_of_counts(counts), int((counts > 2).sum())]
            return pa.table({"bucket": pa.array([bucket], pa.int32())} | {c: pa.array([v], pa.int64()) for c, v in zip(_STATS, row, strict=True)})

        return write

    schema = "bucket int, " + ", ".join(f"{c} long" for c in _STATS)

    def send_longest(batches):
        for stream, places in _gathered(batches, order):
            keys, n = np.unique(run_keys(stream, places, order), return_counts=True)
            yield _sent([keys, n.astype(np.uint32)], bits)

    sent = texts.mapInArrow(send_longest, "bucket int, blob binary").groupBy("bucket")
    levels = {order: _level(sent.applyInArrow(owner(order, (np.uint64, np.uint32), TOP), schema), f"{folder}/{order}", bits, TOP)}

    def sender(k: int, above: KeyFiles):
        def send(batches):
            for stream, places in _gathered(batches, order):
                longer, first, here = np.unique(run_keys(stream, places, k + 1), return_index=True, return_counts=True)
                n, *ended = above.find(longer, *above.names[:2])
                count = ended[0] if ended else n
                share = here / n
                ends = run_keys(stream, places[first], k)
                runs, at = np.unique(np.concatenate([ends, run_keys(stream, places[first] - 1, k)]), return_inverse=True)
                ends, begins = at[: len(longer)], at[len(longer) :]
                add = lambda to, w: np.bincount(to, w, len(runs)).astype(np.float32)
                yield _sent([
                    runs, np.bincount(ends, here, len(runs)).astype(np.uint32), add(ends, share), add(begins, share * (count == 1)),
                    add(begins, share * (count == 2)), add(begins, share * (count > 2)), add(begins, share * count),
                ], bits)

        return send

    for k in range(order - 1, 0, -1):
        sent = texts.mapInArrow(sender(k, levels[k + 1].files), "bucket int, blob binary").groupBy("bucket")
        kinds = (np.uint64, np.uint32, *[np.float32] * 5)
        levels[k] = _level(sent.applyInArrow(owner(k, kinds, LOWER), schema), f"{folder}/{k}", bits, LOWER)
    return Model(folder, order, levels)


# ---- scoring --------------------------------------------------------------------------------

#: Open files of the models a worker scores with, by folder and level.
_files: dict[tuple[str, int], KeyFiles] = {}


def _discount(n: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *by])[np.minimum(n, 3)]


def _looked_up(model: Model, k: int, keys: np.ndarray, *names: str) -> list[np.ndarray]:
    files = _files.setdefault((model.folder, k), model.levels[k].files)
    distinct, at = np.unique(keys, return_inverse=True)
    return [x[at] for x in files.find(distinct, *names)]


def log_probabilities(model: Model, stream: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability of the token at each place after those before it, training count of each token)."""
    uniform, lowest = 1 / (model.words + 1), model.levels[1]
    count, n = _looked_up(model, 1, stream[places], "n", "ended")
    if not model.tokens:
        return np.full(len(places), math.log10(uniform)), count
    spare = sum(d * c for d, c in zip(lowest.discounts, lowest.seen, strict=True))
    p = (n - _discount(n, lowest.discounts) + spare * uniform) / lowest.total
    for k in range(2, model.order + 1):
        by = model.levels[k].discounts
        (n,) = _looked_up(model, k, run_keys(stream, places, k), "n" if k == model.order else "ended")
        once, twice, more, total = _looked_up(model, k - 1, run_keys(stream, places - 1, k - 1), "once", "twice", "more", "begun")
        known = total > 0
        safe = np.where(known, total, 1)
        p = np.where(known, (n - _discount(n, by) + (by[0] * once + by[1] * twice + by[2] * more) * p) / safe, p)
    return np.log10(p), count


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4_000_000):
            stream, places, offsets = tokens_of(batch.column("text"), model.order)
            logs, n = log_probabilities(model, stream, places)
            base = np.log10((n + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
            total = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731  every text has a token
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(total((n > 0).astype(np.int64)), pa.int64()), pa.array(total(base)), pa.array(total(logs))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def report(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Learn from the documents that are not held out, and score all."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), order)
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
