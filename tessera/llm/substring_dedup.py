"""Removal of word runs that occur more than once, found by difference-cover anchors.

A window is ``size`` consecutive words.  COVER is a perfect difference set of PERIOD: any two places in
two documents have, within PERIOD - 1 steps, a common offset at which both word positions fall on the
cover.  So it is enough to hash runs of ``size - PERIOD + 1`` words at cover positions, 5 of 21, and
equal windows still share an equal anchor.  Around each anchor that occurs twice the match is extended:
the whole windows that contain it are hashed and looked up among each other, and those whose word
sequence starts at two places are removed, each word once.

Keys travel as compressed blobs by hash range.  A task sends each key once, however often it has seen
it, with the names of the documents that the range needs and no others.  Places of keys that a task has
seen twice itself go straight to the part of their document.  So a passage of a third of all documents
costs its range one entry a task, and no range grows with it.  Texts are shuffled once, and those with
anchors a second time.

Words are runs of anything but ASCII white space, unchanged; null texts have none.  Windows are judged
on the input, within one row and across rows; equal rows repeat each other.  A row is named by doc_id
and text, so ids may repeat or be null.  An anchor, which only nominates, is a 64-bit hash; a window is
told by 128 bits, two hashes from independent byte tables over all its words, so that even 2**44 windows
have two unequal ones alike with probability 2**-41.  An empty table gives no rows; other columns are
carried or ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, bucket_bits, by_bucket, mix, pack, slices, staged, unpack, utf8, windows_of, words_of

PERIOD, COVER = 21, (0, 1, 6, 8, 18)
_on_cover = np.isin(np.arange(PERIOD), COVER)
#: Keys a task gathers before it sends them, and keys of one range.
GATHERED, PER_BUCKET = 1_000_000, 1_000_000
NO_ID = -(2**63)

#: Groups from this number on are parts of documents, those below are key ranges.
PARTS = 1 << 24
_SEEN_HERE = 0xFFFFFFFF

Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # key, second half of the key, document of the batch, word position


def _sorted_keys(key: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a key is new) of two-part keys."""
    order = np.lexsort((more, key)) if more.any() else np.argsort(key)
    key, more = key[order], more[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
    return order, new


def _places(ids: np.ndarray, ths: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, list[bytes]]:
    """(part, blob) for each part of the documents that has places."""
    to = (mix(ids ^ mix(ths)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((at, ths, ids, to))
    ids, ths, at, to = ids[order], ths[order], at[order], to[order]
    bounds = [*np.flatnonzero(np.diff(to, prepend=-1)).tolist(), len(to)]
    return to[bounds[:-1]], [pack(ids[a:b], ths[a:b], at[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _blobs(ids: np.ndarray, ths: np.ndarray, entries: Entries, bits: int) -> Iterator[pa.RecordBatch]:
    """One row for each key range: its keys, each once, and the documents they name; and one for each part
    of the documents with the places of keys met twice here."""
    order, new = _sorted_keys(*entries[:2])
    key, more, doc, at = (x[order] for x in entries)
    firsts = np.flatnonzero(new)
    counts = np.diff(np.append(firsts, len(key)))
    again = counts > 1
    buckets, bounds = by_bucket(key[firsts], bits)
    rows: list[list] = [buckets.tolist(), [], []]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own, here = firsts[a:b], again[a:b]
        used, place = np.unique(doc[own[~here]], return_inverse=True)
        named = np.full(len(own), _SEEN_HERE, np.uint32)
        named[~here] = place
        rows[1].append(pack(key[own], more[own], named, at[own]))
        rows[2].append(pack(ids[used], ths[used]))
    mine = np.flatnonzero(np.repeat(again, counts))
    to, places = _places(ids[doc[mine]], ths[doc[mine]], at[mine], bits)
    rows = [rows[0] + (to + PARTS).tolist(), rows[1] + places, rows[2] + [None] * len(places)]
    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "keys", "docs"])


def _matches(bits: int) -> Callable[[pa.Table], pa.Table]:
    """Places of the keys of one range that two blobs have, as blobs by part of the documents; places of a part as they are."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket >= PARTS:
            return pa.table({"to": pa.array(np.full(len(table), bucket - PARTS, np.int32)), "places": table["keys"]})
        ids, ths, parts, base = [], [], [], 0
        for blob, names in zip(table["keys"].to_pylist(), table["docs"].to_pylist(), strict=True):
            i, t = unpack(names, np.uint64, np.uint64)
            k, m, d, a = unpack(blob, np.uint64, np.uint64, np.uint32, np.uint32)
            ids.append(i)
            ths.append(t)
            parts.append((k, m, np.where(d == _SEEN_HERE, -1, d.astype(np.int64) + base), a))
            base += len(i)
        key, more, doc, at = (np.concatenate([p[c] for p in parts]) for c in range(4))
        order, new = _sorted_keys(key, more)
        same = ~new
        same[:-1] |= ~new[1:]
        hit = order[same]
        hit = hit[doc[hit] >= 0]  # the others were reported where they were seen
        to, blobs = _places(np.concatenate(ids)[doc[hit]], np.concatenate(ths)[doc[hit]], at[hit], bits)
        return pa.table({"to": pa.array(to.astype(np.int32)), "places": pa.array(blobs, pa.binary())})

    return run


def _gather(table: pa.Table) -> pa.Table:
    """(id, th, at) of the documents of one part."""
    parts = [unpack(b, np.uint64, np.uint64, np.uint32) for b in table["places"].to_pylist()]
    i, t, at = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((at, t, i))
    i, t, at = i[order], t[order], at[order]
    firsts = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])]))
    return pa.table({
        "id": pa.array(i[firsts].view(np.int64)), "th": pa.array(t[firsts].view(np.int64)),
        "at": pa.ListArray.from_arrays(pa.array(np.append(firsts, len(i)).astype(np.int32)), pa.array(at.astype(np.int32))),
    })


def _repeated(rows: DataFrame, entries_of: Callable[[pa.RecordBatch], Entries], bits: int) -> DataFrame:
    """(id, th, at): the places whose key occurs at two places of the table.  rows has id, th and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = docs = 0

        def flush():
            ids, ths = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            yield from _blobs(ids, ths, tuple(np.concatenate([h[k] for h in held]) for k in (2, 3, 4, 5)), bits)

        for batch in slices(batches):
            key, more, doc, at = entries_of(batch)
            ids, ths = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("id", "th"))
            held.append((ids, ths, key, more, (doc + docs).astype(np.uint32), at.astype(np.uint32)))
            count, docs = count + len(key), docs + len(ids)
            if count >= GATHERED:
                yield from flush()
                held, count, docs = [], 0, 0
        if count:
            yield from flush()

    sent = rows.mapInArrow(run, "bucket int, keys binary, docs binary")
    found = sent.groupBy("bucket").applyInArrow(_matches(bits), "to int, places binary")
    return found.groupBy("to").applyInArrow(_gather, "id long, th long, at array<int>")


def _anchors(size: int) -> Callable[[pa.RecordBatch], Entries]:
    length = size - PERIOD + 1

    def entries_of(batch: pa.RecordBatch) -> Entries:
        words, offsets = words_of(*utf8(batch.column("text")))
        n = np.diff(offsets)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(words)) - offsets[:-1][doc]
        use = np.flatnonzero(_on_cover[at % PERIOD] & (at + length <= n[doc]) & (n[doc] >= size))
        return windows_of(words, length)[use], np.zeros(len(use), np.uint64), doc[use], at[use]

    return entries_of


def _marked(places: list[np.ndarray | None], offsets: np.ndarray, before: int, after: int) -> np.ndarray:
    """Which words of consecutive texts lie in [p - before, p + after) of a place p of their text."""
    n = np.diff(offsets)
    change = np.zeros(int(offsets[-1]) + 1, np.int64)
    for k, p in enumerate(places):
        if p is not None and len(p):
            p = np.asarray(p, np.int64)
            np.add.at(change, offsets[k] + np.maximum(p - before, 0), 1)
            np.add.at(change, offsets[k] + np.minimum(p + after, n[k]), -1)
    return np.cumsum(change[:-1]) > 0


def _candidates(size: int) -> Callable[[pa.RecordBatch], Entries]:
    """The windows that contain one of the row's anchors."""

    def entries_of(batch: pa.RecordBatch) -> Entries:
        text = utf8(batch.column("text"))
        words, offsets = words_of(*text)
        n = np.diff(offsets)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(words)) - offsets[:-1][doc]
        near = _marked(_lists(batch.column("anchors")), offsets, PERIOD - 1, 1)
        use = np.flatnonzero(near & (at + size <= n[doc]))
        return windows_of(words, size)[use], windows_of(words_of(*text, second=True)[0], size)[use], doc[use], at[use]

    return entries_of


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    null = np.asarray(column.is_null())
    return [None if null[k] else values[offsets[k] : offsets[k + 1]] for k in range(len(column))]


def _cut(batches: Iterator[pa.RecordBatch], size: int, carried: list[str], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Take out the words of the windows in ``starts``; digests of what is left, or the text itself."""
    for batch in slices(batches):
        raw, byte_offsets = utf8(batch.column("text"))
        _, offsets, first, last = words_of(raw, byte_offsets, spans=True)
        gone = _marked(_lists(batch.column("starts")), offsets, 0, size)
        data, kept, removed = raw.tobytes(), [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            g = gone[a:b]
            left = np.flatnonzero(~g) + a
            kept.append(b" ".join([data[x:y] for x, y in zip(first[left].tolist(), last[left].tolist(), strict=True)]))
            removed.append(int(g.sum()))
        made = [pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        if with_text:
            made.append(pa.array([k.decode() for k in kept]))
        names = ["n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *made], names=[*carried, *names])


def _run(docs: DataFrame, size: int, carry: list[str], with_text: bool) -> DataFrame:
    if size < PERIOD + 1:
        raise ValueError(f"windows of {size} words are shorter than the period of the cover")
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.lit(0).cast("long").alias("th"), text.alias("text"),
        F.struct("doc_id", *carry).alias("row"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(total // 6 * len(COVER) // PERIOD, PER_BUCKET)
    anchors = _repeated(rows.select("id", "th", "text"), _anchors(size), bits).select("id", F.col("at").alias("anchors"))
    joined = rows.withColumn("th", F.xxhash64("text")).join(anchors, "id", "left")

    own = joined.schema["row"].dataType.simpleString()
    plain_fields = "n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without anchors are done; the others keep their text for the next step."""
        for batch in batches:
            idle = batch.column("anchors").is_null()
            starts = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            plain = batch.append_column("starts", starts).filter(idle)
            for part in _cut(iter([plain]), size, ["row"], with_text):
                none = [pa.nulls(part.num_rows, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("row"), *none, *part.columns[1:]], names=["row", "id", "th", "text", "anchors", *part.schema.names[1:]])
            busy = batch.filter(pa.compute.invert(idle))
            if busy.num_rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())[: 4 if with_text else 3]
                names = ["n_words", "n_removed", "kept_sha256", "kept"][: len(kinds)]
                columns = [busy.column(c) for c in ("row", "id", "th", "text", "anchors")]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(busy.num_rows, t) for t in kinds)], names=["row", "id", "th", "text", "anchors", *names])

    import pyarrow.compute  # noqa: F401  for pa.compute in the tasks

    both = staged(
        joined.select("row", "id", "th", "text", "anchors").mapInArrow(split, f"row {own}, id long, th long, text string, anchors array<int>, {plain_fields}"),
        "substrings",
    )
    busy = both.filter("id is not null")
    windows = _repeated(busy.select("id", "th", "text", "anchors"), _candidates(size), bits).withColumnRenamed("at", "starts")
    cut = busy.select("row", "id", "th", "text").join(windows, ["id", "th"], "left").select("row", "text", "starts")
    done = cut.mapInArrow(lambda batches: _cut(batches, size, ["row"], with_text), f"row {own}, {plain_fields}")
    return both.filter("id is null").select(*done.columns).unionByName(done)


def report(docs: DataFrame, size: int = 35) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    return _run(docs, size, [], False).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def drop_repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """docs with repeated windows taken out; changed texts are their kept words joined by one space."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = _run(docs.withColumn("_was", F.col("text")), size, [*others, "_was"], True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row._was"))
    return rows.select(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
