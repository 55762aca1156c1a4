"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

The hypotheses are the given languages and ``und``, text in none of them.

    text      naive Bayes over hashed byte trigrams; ``und`` spreads its probability evenly.  The
              log-likelihood is tempered, as neighbouring trigrams are not independent.
    declared  the language that markup or metadata declares, by how often texts of each language, as
              the text evidence has it, declare it.
    host      prior of the languages on the host, smoothed to that of its address suffix, and that to
              the overall one; by sums of the text evidence, grouped over all rows.

Only the trigram table is fit on a bounded sample: about TRAIN_ROWS rows, chosen by hash, whose declared
language is one of the given ones.  All other statistics cover every row.

Trigrams of letters and spaces count, not those with digits or marks.  A row is rejected if ``und`` is
the most likely and at least REJECT probable; short or mixed texts stay.  A text without trigrams, or null, has no text evidence
and follows the others.  Null or unknown declarations count as "other"; a null host is a host of its
own.  Repeated rows count repeatedly and get equal results.  An empty table gives no rows.  With no
labelled row all languages are alike; a language without one, beside others that have some, is never
more likely by its text than ``und``.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, bounded_batches, broadcast_if_small, slices, staged, utf8

TRAIN_ROWS = 20_000
BUCKETS = 1 << 14
#: Share of trigrams counted as independent evidence.
TEMPER = 1 / 3
#: Pseudo-rows of the parent in the priors of a suffix and of a host.
SMOOTH = 20.0

#: Hosts of more rows than this, at most one for so many rows, have their priors broadcast, so that no join task grows with a host.
HOT_ROWS = 1_000_000
#: A rejection needs at least this probability of ``und``.
REJECT = 0.999

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_lower[0x09:0x0E] = 0x20
_telling = np.zeros(256, bool)  # digits and marks say nothing of a language
_telling[[0x20, *range(97, 123), *range(128, 256)]] = True


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram that begins at each byte, or -1; byte offsets of the texts)."""
    raw, offsets = utf8(column)
    lowered = _lower[raw]
    x = lowered.astype(np.uint32)
    out = np.full(len(x), -1, np.int32)
    if len(x) > 2:
        h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        telling = _telling[lowered]
        telling = telling[:-2] & telling[1:-1] & telling[2:] & ((x[:-2] != 32) | (x[1:-1] != 32))
        out[:-2] = np.where(telling, (h >> np.uint32(32 - 14)).astype(np.int32), -1)
    for back in (1, 2):  # no trigram runs over the end of its text
        last = offsets[1:] - back
        out[last[last >= offsets[:-1]]] = -1
    return out, offsets


def _counts(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    held = np.zeros((len(languages), BUCKETS), np.int64)
    for batch in slices(batches):
        grams, offsets = trigrams(batch.column("text"))
        labels = batch.column("declared").to_pylist()
        for label, a, b in zip(labels, offsets[:-1], offsets[1:], strict=True):
            own = grams[a:b]
            held[languages.index(label)] += np.bincount(own[own >= 0], minlength=BUCKETS)
    lang, bucket = np.nonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(held[lang, bucket])], names=["lang", "bucket", "n"])


def sample_bound(n: int) -> int:
    """The largest 63-bit hash of a sampled row, so that about TRAIN_ROWS of n rows are sampled, or all."""
    return min(2**63 - 1, 2**63 * TRAIN_ROWS // max(1, n))


def fit(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Log-probabilities (language or und, bucket) from a bounded sample of the rows (id, text, declared)."""
    labelled = rows.filter(F.col("declared").isin(*languages))
    n = labelled.count()
    sample = labelled.filter(F.shiftrightunsigned(F.xxhash64("id"), 1) <= F.lit(sample_bound(n)).cast("long")).select("text", "declared")
    found = sample.mapInArrow(lambda b: _counts(b, languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), BUCKETS))
    for r in found.collect():  # at most one row for each language and bucket
        counts[r["lang"], r["bucket"]] = r["n"]
    if n and not counts.any() and sample.isEmpty():
        raise ValueError(f"no row of {n} labelled ones was sampled")
    smoothed = counts + 0.1
    logs = np.log(smoothed / smoothed.sum(1, keepdims=True))
    trained = counts.any(1)
    if trained.any():  # what no text has shown is less likely than no language
        logs[~trained] = -math.log(BUCKETS) - 1
    return np.vstack([logs, np.full((1, BUCKETS), -math.log(BUCKETS))]).astype(np.float32)


def _likelihoods(table: np.ndarray, kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams, offsets = trigrams(batch.column("text"))
            at = np.where(grams < 0, 0, grams)
            logs = np.empty((batch.num_rows, len(table)))
            for k, row in enumerate(table):
                sums = np.concatenate([[0.0], np.cumsum(np.where(grams < 0, 0, row[at]), dtype=np.float64)])
                logs[:, k] = TEMPER * (sums[offsets[1:]] - sums[offsets[:-1]])
            logs -= logs.max(1, keepdims=True)
            soft = np.exp(logs)
            soft /= soft.sum(1, keepdims=True)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(table)).cast(pa.list_(pa.float64())) for x in (logs, soft)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *lists], names=[*kept, "logs", "soft"])

    return run


def _sums(n: int) -> list[Column]:
    return [F.sum(F.col("soft")[k]).alias(f"s{k}") for k in range(n)]


def _vector(n: int, prefix: str = "s") -> Column:
    return F.array(*(F.col(f"{prefix}{k}") for k in range(n)))


def _smoothed(own: Column, parent: Column) -> Column:
    """own sums with SMOOTH pseudo-rows of the parent distribution, as a distribution."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) + SMOOTH
    return F.zip_with(own, parent, lambda x, p: (x + SMOOTH * p) / total)


def identify(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(id, th, lang, confidence, text_lang, kept) of rows (id, text, declared, suffix, host)."""
    bounded_batches(rows.sparkSession)
    n = len(languages) + 1
    names = F.array(*map(F.lit, [*languages, "und"]))
    rows = rows.select(
        "id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.when(F.lower("declared").isin(*languages), F.lower("declared")).otherwise("other").alias("declared"),
        F.coalesce(F.col("suffix").cast("string"), F.lit("")).alias("suffix"), F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host"),
    )
    rows = rows.withColumn("th", F.xxhash64("text"))
    table = fit(rows, languages)
    kept = ["id", "th", "declared", "suffix", "host"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    seen = staged(
        rows.mapInArrow(_likelihoods(table, kept), ", ".join([*(f"{c} {kinds[c]}" for c in kept), "logs array<double>, soft array<double>"])), "languages"
    )

    # bounded by the languages: the confusion of text evidence and declaration
    said = {r["declared"]: [r[f"s{k}"] for k in range(n)] for r in seen.groupBy("declared").agg(*_sums(n)).collect()}
    totals = [sum(v[k] for v in said.values()) for k in range(n)]
    labels = [*languages, "other"]
    given = {d: [math.log((said.get(d, [0.0] * n)[k] + 1) / (totals[k] + len(labels))) for k in range(n)] for d in labels}
    whole = sum(totals)
    overall = F.array(*(F.lit((t + 1) / (whole + n)) for t in totals))
    declared = F.array(*(F.lit(0.0) for _ in range(n)))
    for d, logs in given.items():
        declared = F.when(F.col("declared") == d, F.array(*map(F.lit, logs))).otherwise(declared)

    by_host = staged(seen.groupBy("suffix", "host").agg(F.count("*").alias("n"), *_sums(n)), "hosts")
    by_suffix = by_host.groupBy("suffix").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(n)))
    by_suffix = by_suffix.select("suffix", _smoothed(_vector(n), overall).alias("parent"))
    prior = by_host.join(broadcast_if_small(by_suffix, "suffixes"), "suffix")
    prior = staged(prior.select("suffix", "host", "n", _smoothed(_vector(n), F.col("parent")).alias("prior")), "priors")

    fused = _with_prior(seen, prior).select(
        "id", "th", "logs",
        F.zip_with(F.zip_with("logs", declared, lambda a, b: a + b), F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b).alias("z"),
    )
    mass = F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.array_max("z")))
    pick = lambda v: F.element_at(names, F.array_position(v, F.array_max(v)).cast("int"))
    out = fused.select("id", "th", pick(F.col("z")).alias("lang"), (1 / mass).alias("confidence"), pick(F.col("logs")).alias("text_lang"))
    return out.withColumn("kept", (F.col("lang") != "und") | (F.col("confidence") < REJECT))


def _with_prior(seen: DataFrame, prior: DataFrame) -> DataFrame:
    """seen with the prior of its host.  What is broadcast is counted, or bounded by HOT_ROWS."""
    keys = ["suffix", "host"]
    if prior.count() <= BROADCAST_ROWS:
        return seen.join(F.broadcast(prior.drop("n")), keys)
    hot = prior.filter(F.col("n") > HOT_ROWS).drop("n")
    told = seen.join(F.broadcast(hot), keys, "left")
    rest = told.filter("prior IS NULL").drop("prior").join(prior.filter(F.col("n") <= HOT_ROWS).drop("n"), keys)
    return told.filter("prior IS NOT NULL").unionByName(rest)


def of_documents(docs: DataFrame, languages: list[str]) -> DataFrame:
    """Documents declare ``lang`` and come from ``source``; they have no address."""
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.lit("").alias("suffix"), F.col("source").alias("host"))
    return identify(rows, languages).withColumnRenamed("id", "doc_id")


#: Scripts, styles, comments and tags; what is never closed goes to the end of the page.
MARKUP = r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|</?[a-z!?][^>]*(?:>|\z)"


def of_pages(pages: DataFrame, languages: list[str]) -> DataFrame:
    """Pages declare <html lang>; the address gives host and suffix.  Tags, scripts and styles are no text."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    text = F.regexp_replace("html", MARKUP, " ")
    rows = pages.select(
        F.col("page_id").alias("id"), text.alias("text"), F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-zA-Z]+)", 1)).alias("declared"),
        F.substring_index(host, ".", -1).alias("suffix"), host.alias("host"),
    )
    return identify(rows, languages).withColumnRenamed("id", "page_id")


def keep_identified(docs: DataFrame, languages: list[str]) -> DataFrame:
    """docs without those in none of the languages."""
    found = of_documents(docs, languages).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("kept").alias("_kept")).filter("not _kept").distinct()
    found = broadcast_if_small(found, "rejected")
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (own == found["_th"]), "left_anti")
