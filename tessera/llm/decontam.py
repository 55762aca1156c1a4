"""Benchmark decontamination: word windows of the benchmark, found again in training documents.

Texts are lower-cased in A-Z only and cut into words: runs of 0-9, a-z and anything beyond ASCII.
Every run of ``n`` words of a benchmark item is a window; an item of fewer words is one window itself.
A document is read once: the hashes of its windows, of all lengths in use, are put together from those
of shorter runs by doubling, and probed against the benchmark's hash set; a hit is verified word by word.
A document word inside any occurrence of a window is hit.

The hash set (hash, window number, length) is broadcast while it takes at most BROADCAST_BYTES, which is
checked; beyond that the same join shuffles.  Hits carry the number of their window; the items that have
it are joined once a document.  Hits are gathered for each document; there are at most as many as the
document has words, for each length.

Nulls have no words.  Equal items, repeated windows and repeated documents give the same result as
single ones; an empty benchmark hits nothing.  Items with a null id count under the empty id.  Other
columns are ignored or carried.  DataFrame operations only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, staged

BROADCAST_BYTES = 64 << 20
#: Everything in ASCII but digits and small letters; capitals are small by then.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _BETWEEN), "")


def _with_run_hashes(df: DataFrame, word_hashes: str, lengths: list[int]) -> DataFrame:
    """df with ``run_k`` for each length k: the hash of every run of k words, put together from runs of powers of two."""
    pair = lambda a, b: F.xxhash64(a, b)
    some = lambda k, of: F.when(F.size(word_hashes) >= k, of).otherwise(F.array().cast("array<bigint>"))
    starts = lambda k: F.size(word_hashes) - (k - 1)
    powers, size = {1: word_hashes}, 1
    while 2 * size <= max(lengths, default=1):
        half = F.col(powers[size])
        df = df.withColumn(f"pow_{2 * size}", some(2 * size, F.zip_with(F.slice(half, 1, starts(2 * size)), F.slice(half, size + 1, starts(2 * size)), pair)))
        powers[2 * size], size = f"pow_{2 * size}", 2 * size
    for k in lengths:
        parts = [p for p in powers if k & p]
        done, made = parts[0], F.col(powers[parts[0]])
        for p in parts[1:]:
            n = starts(done + p)
            made = F.zip_with(F.slice(made, 1, n), F.slice(powers[p], done + 1, n), pair)
            done += p
        df = df.withColumn(f"run_{k}", some(k, made))
    return df


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame, list[int]]:
    """(windows, items, lengths): distinct windows (wid, k, window, h), the (wid, item_id) that have them, and the k in use."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w"))
    items = items.filter(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)
    rows = items.select("item_id", "k", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))).alias("window"))
    windows = rows.select("k", "window").distinct().withColumn("wh", F.transform(F.split("window", " "), lambda w: F.xxhash64(w)))
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most n
    h = F.lit(None).cast("long")
    for k in lengths:
        h = F.when(F.col("k") == k, F.get(f"run_{k}", F.lit(0))).otherwise(h)
    windows = _with_run_hashes(windows, "wh", lengths).select(F.monotonically_increasing_id().alias("wid"), "k", "window", h.alias("h"))
    windows = staged(windows, "windows")
    return windows, staged(rows.join(windows, ["k", "window"]).select("wid", "item_id").distinct(), "window-items"), lengths


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(occurrences, items).  occurrences: (doc_id, th, k, at, wid), each verified place of a benchmark window, from
    word ``at`` (0 first); ``th`` is the hash of the text and with doc_id names the row.  items: (wid, item_id)."""
    windows, items, lengths = benchmark_windows(benchmark, n)
    table = windows.select("h", "wid", "k")
    if windows.count() * 64 <= BROADCAST_BYTES:
        table = F.broadcast(table)
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th")
    rows = docs.select("doc_id", th, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("wh"))
    rows = _with_run_hashes(rows, "wh", lengths)
    runs = F.col(f"run_{lengths[0]}") if len(lengths) == 1 else F.explode(F.array(*(f"run_{k}" for k in lengths)) if lengths else F.array(F.array().cast("array<bigint>")))
    # the words stay behind, and the hashes are exploded from a transform: a stored array would be copied with every row
    places = rows.select("doc_id", "th", runs.alias("run")).select("doc_id", "th", F.posexplode(F.transform("run", lambda h: h)).alias("at", "h"))
    probed = staged(places.join(table, "h").select("doc_id", "th", "k", "at", "wid"), "probed")
    where = broadcast_if_small(probed.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "probed-documents")
    texts = docs.select("doc_id", th, F.col("text").cast("string").alias("text"))
    texts = texts.join(where, texts["doc_id"].eqNullSafe(where["_id"]) & (texts["th"] == where["_th"]), "left_semi")
    texts = texts.groupBy("doc_id", "th").agg(F.collect_set("text").alias("t"))  # equal rows once; texts under one hash apart
    texts = texts.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.transform("t", words).alias("ws"))
    said = probed.join(broadcast_if_small(windows.select("wid", "window"), "window-texts"), "wid")
    said = said.groupBy("doc_id", "th").agg(F.collect_set(F.struct("k", "at", "wid", "window")).alias("hits"))
    found = said.join(texts, said["doc_id"].eqNullSafe(texts["_id"]) & (said["th"] == texts["_th"]))
    same = lambda x: F.exists("ws", lambda w: F.array_join(F.slice(w, x["at"] + 1, x["k"]), " ") == x["window"])
    return found.select("doc_id", "th", F.explode(F.filter("hits", same)).alias("x")).select("doc_id", "th", "x.k", "x.at", "x.wid"), items


def hit_words(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, th, hit, items) of the documents with hits: their hit words, ascending, and the items, sorted."""
    found, items = find(docs, benchmark, n)
    found = staged(found, "found")
    places = F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["k"] - 1))
    spans = found.select("doc_id", "th", F.struct("at", "k").alias("span"), F.lit(None).cast("string").alias("item_id"))
    named = found.select("doc_id", "th", "wid").distinct().join(broadcast_if_small(items, "items"), "wid")
    named = named.select("doc_id", "th", F.lit(None).cast(spans.schema["span"].dataType).alias("span"), "item_id")
    return (
        spans.unionByName(named).groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans"), F.collect_set("item_id").alias("items"))
        .select("doc_id", "th", F.array_sort(F.array_distinct(F.flatten(places))).alias("hit"), F.array_sort("items").alias("items"))
    )


def _with_hits(docs: DataFrame, benchmark: DataFrame, n: int, columns: list[Column]) -> DataFrame:
    left = docs.select(*columns, F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_th"))
    hits = hit_words(docs, benchmark, n).select(F.col("doc_id").alias("_hit_id"), F.col("th").alias("_hit_th"), F.col("hit").alias("_hit"), F.col("items").alias("_items"))
    return left.join(hits, F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_th") == F.col("_hit_th")), "left")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    none = F.array().cast("array<string>")
    rows = _with_hits(docs, benchmark, n, [F.col("doc_id"), F.size(words(F.col("text"))).cast("long").alias("n_words")])
    n_hit = F.when(F.col("_hit").isNull(), F.lit(0)).otherwise(F.size("_hit")).cast("long")
    items = F.coalesce("_items", none)
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs without the contaminated ones."""
    gone = find(docs, benchmark, n)[0].select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    gone = broadcast_if_small(gone, "contaminated")
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (own == gone["_th"]), "left_anti")


def drop_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs with the hit words taken out of their texts; what stands between words stays."""
    rows = _with_hits(docs, benchmark, n, [F.col(f"`{c}`") for c in docs.columns])
    between, own = F.split("text", _WORD), F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    cut = F.concat(
        between[0],
        F.array_join(F.transform(own, lambda w, i: F.concat(F.when(F.array_contains("_hit", i), F.lit("")).otherwise(w), between[i + 1])), ""),
    )
    text = F.when(F.col("_hit").isNull(), F.col("text")).otherwise(cut)
    return rows.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
