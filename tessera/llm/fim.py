"""Fill-in-the-middle: texts cut at two unit borders, written as prefix, suffix and middle between marks.

A text is held as its maximal runs of one character class, breaks or not, each with the number of units
that end up to its own end.  A cut after m units lies in the first run with a count of m or more, found by
binary search; where units end at single breaks, it is as many characters into that run as units are
missing before it.  So a cut takes a search over runs, and no list of units is made.

Where a row is cut, and in which form it is written, follows from a hash of its doc_id alone, so lost tasks
give the same rows again.  Marks that occur in a text would not be told from those written; such a text is
left plain, and so is an empty one.

Null texts are empty.  A null doc_id hashes as if it had no digits.  Rows that repeat doc_id and text are
cut alike.  Texts are taken whole, however long.  An empty table gives an empty result.  Rows keep their
other columns; existing columns n, form, prefix_chars, middle_chars or output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, slices

MARKS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Unit:
    """Characters that are breaks; a unit ends at each of them, or at the last of a run.  Text after the last break is a unit too."""

    breaks: str
    each: bool


LINES = Unit("\n", True)
#: A word with the white space after it.
WORDS = Unit(" \t\n\x0b\x0c\r", False)


class Runs:
    """The runs of a text: ``ends`` (offset after each run), ``units`` (units ended by then), and whether it is one of breaks."""

    def __init__(self, text: str, unit: Unit):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        broken = np.isin(points, np.array([ord(c) for c in unit.breaks], np.uint32))
        self.ends = np.append(np.flatnonzero(broken[1:] != broken[:-1]) + 1, len(points)) if len(points) else np.zeros(0, np.int64)
        self.broken = broken[self.ends - 1]
        lengths = np.diff(self.ends, prepend=0)
        ended = np.where(self.broken, lengths if unit.each else 1, 0)
        if len(ended) and not self.broken[-1]:
            ended[-1] = 1
        self.units, self.each = np.cumsum(ended), unit.each

    @property
    def n(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def offset(self, m: int) -> int:
        """Characters up to the end of the m-th unit."""
        if not m:
            return 0
        run = int(np.searchsorted(self.units, m))
        if not (self.each and self.broken[run]):
            return int(self.ends[run])
        start, before = (int(self.ends[run - 1]), int(self.units[run - 1])) if run else (0, 0)
        return start + m - before


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def rearranged(text: str, doc_id: int | None, unit: Unit, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    runs = Runs(text, unit)
    n = runs.n
    a, b, chance, kind = draws(doc_id, seed)
    if not text or chance % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    first, second = sorted((a % (n + 1), b % (n + 1)))
    start, end = runs.offset(first), runs.offset(second)
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if kind % 100 < spm_rate:
        return n, "spm", start, end - start, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", start, end - start, f"<P>{prefix}<S>{suffix}<M>{middle}"


def transform(docs: DataFrame, unit: Unit = LINES, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """docs with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` and ``spm_rate``: of 100 texts as many are cut, and of those as many are written suffix first.
    """
    bounded_batches(docs.sparkSession)
    added = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
    kept = [f for f in docs.schema.fields if f.name not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [
                rearranged(t or "", k, unit, seed, rate, spm_rate)
                for t, k in zip(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)
            ]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), added.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n long, form string, prefix_chars long, middle_chars long, output string"])
    return docs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    ahead = F.substring_index(output, "<M>", 1)
    psm = F.concat(F.substring_index(F.substr(ahead, F.lit(4)), "<S>", 1), F.substring_index(output, "<M>", -1), F.substring_index(ahead, "<S>", -1))
    spm = F.concat(F.substring_index(ahead, "<P>", -1), F.substring_index(output, "<M>", -1), F.substring_index(F.substr(ahead, F.lit(4)), "<P>", 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame, unit: Unit = LINES, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    cut = transform(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), unit, seed, rate, spm_rate)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
