"""Near-duplicate detection by b-bit MinHash, with every link confirmed on the full shingle sets.

Each document gets HASHES minima over its distinct word shingles.  Their low BITS bits are packed into
bit planes; runs of ROWS minima are hashed to one band key each.  Two documents of similarity 0.8 miss
all 40 bands of 5 with probability 1.2e-7.

1. Documents of one shingle set are represented by the smallest doc_id.
2. Representatives that share a band key are compared by counting equal bits.  The estimate is corrected
   for chance collisions, 2**-BITS, and pairs are left out whose equal bits are six standard deviations
   below those of the threshold without any chance collision.  A bucket reports the connected parts of
   what remains as stars, never its pairs.
3. The connected parts of all buckets together are small families of like texts.  Each family's texts
   are brought together once, and its pairs are compared exactly, as a product of sparse sets.
4. The components of the confirmed links name the groups.

A bucket or family above BLOCK members is cut into blocks, each with a copy of the group's centre, its
smallest member; all pairs of a block are compared.  Members that this ties to the centre need no more
comparison with each other.  Those that it does not are compared with all blocks.  So a group of n like
texts sends n rows and its blocks' centres, no task grows with a group, and no link is lost.

Words are runs of anything but ASCII white space, with A-Z lower-cased; a shingle is ``size`` consecutive
words, or the whole text where it has fewer.  Texts without words, and nulls, have no shingle and no
link.  Rows with a null doc_id are represented, if at all, by the other rows of their set, and otherwise
stand alone with a null component_id.  Rows that share a doc_id are one node.  An empty table gives no
rows; other columns are carried or ignored.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, bounded_batches, broadcast_if_small, mix, slices, staged, utf8, windows_of, words_of
from tessera.llm.components import connected_components

ROWS, BANDS, BITS = 5, 40, 2
HASHES = ROWS * BANDS
BLOCK = 1024
_rng = np.random.Generator(np.random.PCG64(7))
_mul = _rng.integers(0, 2**32, (HASHES, 1), dtype=np.uint32) | np.uint32(1)
_add = _rng.integers(0, 2**32, (HASHES, 1), dtype=np.uint32)
_salt = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_band_mul = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_band_add = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
_WORDS = -(-HASHES // 64)  # of 64 bits in a bit plane


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, offsets = words_of(*utf8(column), lower=True)
    whole = windows_of(words, size)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(whole[a : b - size + 1])
        else:
            yield windows_of(words[a:b], b - a) if b > a else words[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[None, at : at + 1024] * _mul + _add).min(1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """BITS planes of 64-bit words from the low bits of the minima.

    A minimum is mixed with its own salt first: bare, its low bits depend on those of the shingle alone,
    so that in small sets the same chance collisions, or none, would repeat in all minima.
    """
    least = least ^ _salt
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        least = (least ^ least >> np.uint32(shift)) * np.uint32(factor)
    least ^= least >> np.uint32(16)
    planes = [np.packbits((least >> np.uint32(b) & np.uint32(1)).astype(np.uint8), bitorder="little") for b in range(BITS)]
    return np.concatenate([np.pad(p, (0, _WORDS * 8 - len(p))).view(np.uint64) for p in planes])


def band_keys(least: np.ndarray) -> np.ndarray:
    return mix((least.reshape(BANDS, ROWS).astype(np.uint64) * _band_mul).sum(1) + _band_add)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (last axis): the share of equal minima, less chance collisions."""
    differ = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1] + (_WORDS,), np.uint64)
    for p in range(BITS):
        differ |= a[..., p * _WORDS : (p + 1) * _WORDS] ^ b[..., p * _WORDS : (p + 1) * _WORDS]
    equal = 1 - np.bitwise_count(differ).sum(-1, dtype=np.int64) / HASHES
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def least_estimate(percent: int) -> float:
    """Six standard deviations below the threshold, had no two different minima collided."""
    p, chance = percent / 100, 2.0**-BITS
    return (p - 6 * (p * (1 - p) / HASHES) ** 0.5 - chance) / (1 - chance)


def _signatures(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digests, signs, bands = [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                least = minima(s)
                signs.append(packed(least).tobytes() if len(s) else None)
                bands.append(band_keys(least))
            keys = pa.ListArray.from_arrays(
                pa.array(np.arange(0, BANDS * len(n) + 1, BANDS, dtype=np.int32)), pa.array(np.concatenate(bands).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary()), keys],
                names=["doc_id", "th", "n_shingles", "digest", "sign", "bands"],
            )

    return run


def _parts(linked: np.ndarray) -> np.ndarray:
    """The smallest index connected with each, in a symmetric boolean matrix."""
    n = len(linked)
    root = np.full(n, -1)
    for k in range(n):
        if root[k] < 0:
            root[k] = k
            front = np.array([k])
            while len(front):
                front = np.flatnonzero(linked[front].any(0) & (root < 0))
                root[front] = k
    return root


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key (columns key, i, j), from batches sorted by it and by node.  A key has at most 2 * BLOCK rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j")])
        cuts = np.flatnonzero((np.diff(keys) != 0).any(0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(keys[:, a].tolist())
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


_EDGES = "u long, v long"


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        u, v = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _stars(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = _parts(linked)
    other = np.flatnonzero(root != np.arange(len(root)))
    return ids[root[other]], ids[other]


def _all_pairs(matrix_of: Callable[[pa.Table], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links among the rows of each run, as stars around the smallest nodes; ``matrix_of`` tells which rows are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list = []
        for table in _runs(batches):
            if len(table) > 1:
                pairs.append(_stars(table["node"].to_numpy(), matrix_of(table)))
            if len(pairs) >= 5000:
                yield from _edges(pairs)
                pairs = []
        yield from _edges(pairs)

    return run


def _linked(rows: DataFrame, matrix_of: Callable[[pa.Table], np.ndarray], large: bool) -> DataFrame:
    """Edges (u, v) whose components are those of all links within each key.

    rows: key, n (rows of the key), centre (its smallest node), node, load.  ``large``: some key has more than BLOCK.
    """
    def compared(placed: DataFrame) -> DataFrame:
        placed = placed.select("key", "i", "j", "node", "load").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
        return placed.mapInArrow(_all_pairs(matrix_of), _EDGES)

    alone = lambda df, i, j: df.withColumns({"i": i.cast("int"), "j": j.cast("int")})
    small = compared(alone(rows.filter(F.col("n") <= BLOCK), F.lit(0), F.lit(0)))
    if not large:
        return small
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = rows.filter(F.col("n") > BLOCK)
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    centres = rows.filter("node = centre").withColumn("i", every(blocks)).filter(F.col("i") != own)
    within = staged(compared(alone(rows, own, F.lit(0)).unionByName(alone(centres, F.col("i"), F.lit(0)))), "within-blocks")

    part = connected_components(within)
    of = lambda node: part.select(F.col("node").alias(node), F.col("component").alias(f"{node}_part"))
    told = rows.select("key", "n", "centre", "node").join(of("node"), "node", "left").join(broadcast_if_small(of("centre"), "centres"), "centre", "left")
    far = told.filter(F.coalesce("node_part", "node") != F.coalesce("centre_part", "centre")).select("key", "node")
    far = staged(far, "far")
    if far.isEmpty():
        return small.unionByName(within)
    counts = broadcast_if_small(far.groupBy("key").agg(F.count("*").alias("n_far")), "far-counts")
    rows = rows.join(counts, "key")
    far_blocks = F.ceil(F.col("n_far") / BLOCK).cast("int")
    far_rows = rows.join(broadcast_if_small(far, "far-nodes"), ["key", "node"], "left_semi")
    far_rows = far_rows.withColumn("i", F.pmod(F.xxhash64("node"), far_blocks)).withColumn("j", every(blocks))
    others = rows.withColumn("j", own).withColumn("i", every(far_blocks))
    placed = [alone(df, F.col("i"), F.col("j")).select("key", "i", "j", "node", "load") for df in (far_rows, others)]
    return small.unionByName(within).unionByName(compared(placed[0].unionByName(placed[1])))


def _like(cut: float) -> Callable[[pa.Table], np.ndarray]:
    def matrix(table: pa.Table) -> np.ndarray:
        signs = np.frombuffer(b"".join(table["load"].to_pylist()), np.uint64).reshape(len(table), -1)
        return np.stack([estimate(signs[k], signs) >= cut for k in range(len(signs))])

    return matrix


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: the product of the 0/1 matrix with its transpose, over shared shingles."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    out = np.zeros((n, n), np.float32)
    step = max(1, 8_000_000 // n)
    keep = shared[place]
    owner, column = owner[keep], rank[place[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [at, at + step])
        part = np.zeros((n, step), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    out = out.astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _confirmed(size: int, percent: int) -> Callable[[pa.Table], np.ndarray]:
    def matrix(table: pa.Table) -> np.ndarray:
        sets = [s for chunk in table["load"].chunks for s in shingle_sets(chunk, size)]
        common = _common(sets)
        sizes = np.array([len(s) for s in sets])
        return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)

    return matrix


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, th (hash of the text), n_shingles, component_id, kept."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    signed = staged(
        rows.mapInArrow(_signatures(size), "doc_id long, th long, n_shingles long, digest binary, sign binary, bands array<long>"), "signatures"
    )
    first = F.min_by(F.struct("th", "sign", "bands"), "doc_id")
    nodes = staged(
        signed.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), first.alias("f"))
        .select("digest", "node", "f.*"), "representatives",
    )

    banded = nodes.select(F.explode("bands").alias("key"), "node")
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).filter("n > 1")
    members = banded.join(shared, "key").join(nodes.select("node", F.col("sign").alias("load")), "node")
    members = staged(members.select("key", "n", "centre", "node", "load"), "buckets")
    most = lambda df: (df.agg(F.max("n")).first()[0] or 0) > BLOCK
    families = connected_components(_linked(members, _like(least_estimate(percent)), most(members)))

    sized = families.groupBy("component").agg(F.count("*").alias("n"))
    wanted = families.join(broadcast_if_small(sized, "family-sizes"), "component").withColumnRenamed("node", "doc_id")
    wanted = nodes.select(F.col("node").alias("doc_id"), "th").join(wanted, "doc_id").select("doc_id", "th", F.col("component").alias("key"), "n")
    wanted = staged(wanted, "families")
    texts = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, ["doc_id", "th"])
    texts = texts.select("key", "n", F.col("key").alias("centre"), F.col("doc_id").alias("node"), F.col("text").alias("load")).dropDuplicates(["key", "node"])
    found = connected_components(_linked(texts, _confirmed(size, percent), most(wanted)))

    named = nodes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", "th", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def report(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    return groups(docs, size, percent).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate group, that of the smallest doc_id."""
    gone = groups(docs, size, percent).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    gone = broadcast_if_small(gone, "near-copies")
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(gone, (docs["doc_id"] == gone["_id"]) & (own == gone["_th"]), "left_anti")
