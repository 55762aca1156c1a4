"""How filters interact: what each removes in every order of them, alone, and beside the others.

Every row gets one bit for each filter that it fails.  What a filter removes at a step of an order depends
on the bits alone, so the rows are counted by part and bits once, and all orders are read off these counts.

The last filter drops repeated texts, found by refining a partition: rows are split by their length in code
points, then by the hashes of one block of text after another, blocks growing sixteenfold; rows alone in
their class drop out of every round.  Whatever is left is compared by its full text, so no hash decides,
and of equal texts all but those of the smallest doc_id are marked.

The texts are read twice: once for bits and block hashes, which are staged, as the rounds work on those;
and once for the full texts of the classes that are left.  A class is counted where it is read before it
is shuffled, and the commonest classes are broadcast, so copies of one text do not meet in one task.

Null texts and parts are empty.  A null doc_id is not smaller or larger than any, so such a row is no repeat
and has no labels.  Rows that repeat doc_id and text are counted each; if it is the smallest, none is a repeat.
A doc_id that labels name more than once has all their marks.  An empty table has no parts.  Texts are
taken whole.  Other columns are left aside, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, broadcast_if_small, staged

#: Code points of the blocks of text; together they hold any text that a row can.
BLOCKS = tuple(256 * 16**k for k in range(7))

#: Classes that are broadcast though others are too many: no other can hold more than its share of all rows.
COMMONEST = 10_000

_names = [f"b{k}" for k in range(len(BLOCKS))]

_words = lambda text: F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")

#: Filter -> whether a text fails it.  Repeats are filter E.
FILTERS: dict[str, Callable[[Column], Column]] = {
    "A": lambda text: F.size(_words(text)) < 200,
    "B": lambda text: 100 * F.size(F.array_distinct(_words(text))) < 50 * F.size(_words(text)),
    "C": lambda text: 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
    "D": lambda text: text.rlike(r"[#$%&*|]"),
}
REPEATS = "E"


# ---- repeated texts --------------------------------------------------------------------------------

def block_hashes(text: Column) -> list[Column]:
    """Of each block the hash, null where the text has ended."""
    starts = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    return [F.when(F.length(text) > start, F.xxhash64(F.substring(text, start + 1, size))).alias(f"b{k}") for k, (start, size) in enumerate(zip(starts, BLOCKS, strict=True))]


def _class_of(length: Column, blocks: list[Column]) -> Column:
    """The class of a row after the rounds of these blocks."""
    found = length.cast("long")
    for block in blocks:
        found = F.xxhash64(found, block)
    return found


def _beside(rows: DataFrame, classes: DataFrame, how: str) -> DataFrame:
    """rows joined with classes (staged: cls, rows and more) by ``cls``, inner or left.

    Too many classes for a broadcast: the commonest are broadcast; other rows are shuffled only if a broadcast
    sieve of one bit for each class says that theirs may be among them.
    """
    if classes.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(classes), "cls", how)
    common = staged(classes.orderBy(F.desc("rows"), "cls").limit(COMMONEST), "common", COMMONEST).withColumn("common", F.lit(True))
    met = rows.join(F.broadcast(common), "cls", "left")
    slot, bit = F.expr(f"pmod(xxhash64(cls), {BROADCAST_ROWS})"), "cast(pmod(xxhash64(cls, 1), 64) as int)"
    sieve = staged(classes.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("sieve_bits")), "sieve", BROADCAST_ROWS)
    rest = met.filter("common IS NULL").select(*rows.columns).withColumn("slot", slot).join(F.broadcast(sieve), "slot", "left").drop("slot")
    maybe = F.expr(f"coalesce(getbit(sieve_bits, {bit}) = 1, false)")
    out = met.filter("common").drop("common").unionByName(rest.filter(maybe).drop("sieve_bits").join(classes, "cls", how))
    return out.unionByName(rest.filter(~maybe).drop("sieve_bits"), allowMissingColumns=True) if how == "left" else out


def refined(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows (n_chars, b0, b1 ...) that share their class ``cls`` with another row, and how many blocks that took."""
    done, rows = 0, rows.withColumn("cls", _class_of(F.col("n_chars"), []))
    while True:
        classes = staged(rows.groupBy("cls").agg(F.count("*").alias("rows")).filter("rows > 1"), "classes")
        rows = staged(_beside(rows, classes, "inner").drop("rows"), "refined")
        longest = rows.agg(F.max("n_chars")).first()[0] or 0
        if longest <= sum(BLOCKS[:done]):
            return rows, done
        rows = rows.withColumn("cls", F.xxhash64("cls", F.col(f"b{done}")))
        done += 1


def mark_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and more) without text, and with ``repeat``: whether a row of a smaller doc_id has the same text.

    ``features`` of the text stand in its place.
    """
    prepared = staged(features(docs).drop("text"), "features")
    left, rounds = refined(prepared.select("n_chars", *_names))
    classes = staged(left.groupBy("cls").agg(F.count("*").alias("rows")), "classes")
    texts = docs.withColumn("cls", _class_of(F.length("text"), block_hashes(F.col("text"))[:rounds]))
    same = _beside(texts.select("doc_id", "text", "cls"), classes, "inner").groupBy("cls", "text").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    least = same.groupBy("cls").agg(F.min("least").alias("least"), F.sum("rows").alias("rows"), F.count("*").alias("texts"))
    least = staged(least, "least_ids")
    told = _beside(prepared.withColumn("cls", _class_of(F.col("n_chars"), [F.col(b) for b in _names[:rounds]])), least, "left")
    late = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    mixed = staged(least.filter("texts > 1").select("cls", "rows"), "mixed")
    if not mixed.isEmpty():  # different texts met in one class: its rows are taken from docs again, each with its text
        texts = staged(_beside(texts, mixed, "inner").drop("rows"), "mixed_texts")
        least = texts.groupBy("cls", "text").agg(F.min("doc_id").alias("least"))
        again = features(texts).join(least, ["cls", "text"])
        told = told.filter("texts IS NULL OR texts = 1").drop("rows", "texts").unionByName(again.drop("text"))
    return told.withColumn("repeat", late).drop("cls", "least", "rows", "texts", "n_chars", *_names)


# ---- the audit --------------------------------------------------------------------------------------

def features(docs: DataFrame) -> DataFrame:
    """docs with ``bits`` (one for each filter by text that it fails), ``n_chars`` and block hashes."""
    bits = sum((F.when(fails(F.col("text")), F.lit(1 << k)).otherwise(F.lit(0)) for k, fails in enumerate(FILTERS.values())), F.lit(0))
    return docs.select("*", bits.alias("bits"), F.length("text").alias("n_chars"), *block_hashes(F.col("text")))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, rows, good, toxic): counts of the rows that fail just the filters of the mask, and of those with either label."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = mark_repeats(docs).select("doc_id", "part", (F.col("bits") + F.when(F.col("repeat"), 1 << len(FILTERS)).otherwise(0)).alias("mask"))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_or(F.col("quality") == 1).alias("is_good"), F.bool_or(F.col("toxic") == 1).alias("is_toxic"))
    said = broadcast_if_small(said.filter("doc_id IS NOT NULL AND (is_good OR is_toxic)"), "said")
    # rows of one doc_id, or of none, are counted before they meet its labels
    marked = marked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("rows")).join(said, "doc_id", "left")
    counted = lambda when: F.sum(F.when(when, F.col("rows")).otherwise(0))
    return marked.groupBy("part", "mask").agg(F.sum("rows").alias("rows"), counted(F.col("is_good")).alias("good"), counted(F.col("is_toxic")).alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: what is kept, removed, redundant, failed alone, lost, and the sum over orders."""
    names = [*FILTERS, REPEATS]
    bit = {name: 1 << k for k, name in enumerate(names)}
    orders = F.array(*(F.lit("".join(p)) for p in permutations(names)))
    steps = counts.select("*", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    value = lambda letter: sum((F.when(letter == n, F.lit(b)).otherwise(F.lit(0)) for n, b in bit.items()), F.lit(0))
    before = sum((F.when(F.col("filter_order").contains(n) & (F.instr("filter_order", n) <= F.col("at")), F.lit(b)).otherwise(F.lit(0)) for n, b in bit.items()), F.lit(0))
    steps = steps.withColumn("own", value(F.col("letter"))).withColumn("before", before)
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, what="rows": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    out = steps.groupBy("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "letter").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    # one part has as many rows as there are orders and steps, however many documents
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return interactions(staged(masks(docs, labels), "masks"))
