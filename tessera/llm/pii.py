"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are matches of the base rules (email, ip, card, phone) and of looser patterns (numbers in
telephone form without a plus, social security numbers, names with or without a title).  Four labelers
vote for, against or not at all on every candidate:

    rule        does the value pass the strict rule of its kind, or fail it?
    gazetteer   is its domain ending, calling code, number block, card issuer or given name listed, or is
                it one of what is no such thing?
    context     do words just before it name such data, or something else (a version, an order)?
    boundary    does it stand alone, or run on into letters or digits?

Expectation-maximisation over the histogram of vote patterns (kinds x 3**4 rows at most, whatever the
input) estimates how reliable each labeler is and how likely each pattern is to be personal data.  With
these probabilities as soft labels a naive Bayes span classifier over votes, length, digit share and
neighbouring characters is trained by one grouped sum, and is applied to every candidate.  Spans that
the base rules find are reported in any case; the classifier adds others that do not overlap them.

Spans count code points, end exclusive.  A null text is empty.  Rows are independent of each other, so
repeated rows give repeated results; an empty table gives no rows.  Other columns are ignored.
DataFrame operations only.  Patterns are written so that matching is linear in the text: a run is
entered at its start and quantified possessively, which changes no match.  Places are running sums over
the matches and the gaps between them, and overlaps are told by running maxima, so a text of very many
matches takes time in proportion.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import before_each, bound, staged

#: Kinds in the order of reports, and their patterns.
KINDS = ("email", "ip", "card", "phone", "ssn", "name")
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE_PATTERNS = {
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Don)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?|[A-Z][a-z]{1,30}\x20[A-Z][a-z]{1,30})(?![A-Za-z])",
}
TITLED = r"^(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Don)\.?\x20"
#: Gazetteers.
DOMAIN_ENDINGS = ("com", "net", "org", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "us", "eu", "ch", "at", "nl")
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
NUMBER_BLOCKS = r"^[2-9][0-9]{2}[2-9][0-9]{6}$"
GIVEN_NAMES = (
    "Alice", "Andreas", "Anna", "Antonio", "Barbara", "Carlos", "Carmen", "Charles", "Christine", "Claire", "Daniel", "David", "Elena",
    "Elizabeth", "Emma", "Francois", "Hans", "Helen", "Isabel", "James", "Jane", "Jean", "Jennifer", "Johann", "John", "Jose", "Juan",
    "Julia", "Karen", "Karl", "Klaus", "Laura", "Linda", "Louis", "Lucia", "Luis", "Maria", "Marie", "Mark", "Martin", "Mary", "Michael",
    "Miguel", "Nancy", "Nicole", "Patricia", "Paul", "Pedro", "Peter", "Petra", "Philippe", "Pierre", "Richard", "Robert", "Sabine",
    "Sarah", "Sofia", "Sophie", "Stefan", "Susan", "Thomas", "Ursula", "William", "Wolfgang",
)
NO_NAMES = (
    "Act", "Avenue", "Bank", "Board", "Bridge", "Center", "City", "Club", "College", "Company", "Council", "County", "Court", "Day", "Department",
    "East", "Group", "House", "Institute", "Island", "January", "July", "June", "Lake", "Law", "March", "Monday", "Mount", "Museum", "National",
    "New", "North", "Park", "Press", "Republic", "River", "Road", "School", "South", "State", "Street", "Sunday", "The", "United", "University",
    "Valley", "War", "West", "World", "York",
)
#: Words before a span that speak for its kind, or against personal data.
CUES = {
    "email": r"(?i)(?:mail|correo|courriel|contact|write|schreib)",
    "ip": r"(?i)(?:\bip\b|address|host|server|adresse|direcci)",
    "card": r"(?i)(?:card|visa|mastercard|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|call|tel|fax|mobile|anruf|appel|llam)",
    "ssn": r"(?i)(?:ssn|social|security)",
    "name": r"(?i)(?:dear|name|signed|by|sehr geehrte|cher|estimad)",
}
COUNTER_CUES = r"(?i)(?:version|\bv|release|order|isbn|issn|page|chapter|section)[\x20.:#]*$"
#: Code points before a span that the context labeler sees.
BEFORE = 30

SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _matches(kind: str, text: str, pattern: str, guard: Column) -> Column:
    """All leftmost non-overlapping matches as spans, each with what stands before and after it.

    Gaps between matches give their places, and with the matches next to them their surroundings.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found, gaps = F.expr(f"regexp_extract_all({text}, '{quoted}', 0)"), F.expr(f"split({text}, '{quoted}', -1)")

    def spans(p: Column) -> Column:
        values, between, n = p["values"], p["gaps"], F.size(p["values"])
        first = lambda c: F.substring(c, 1, 1)
        length = F.zip_with(values, F.slice(between, F.lit(1), n), lambda v, g: (F.char_length(g) + F.char_length(v)).cast("bigint"))
        zipped = F.arrays_zip(
            values.alias("v"), F.slice(between, F.lit(1), n).alias("g"), F.slice(between, F.lit(2), n).alias("h"),
            F.concat(F.array(F.lit("")), F.slice(values, F.lit(1), n - 1)).alias("last"), F.concat(F.slice(values, F.lit(2), n), F.array(F.lit(""))).alias("next"),
            before_each(length, F.lit(0), lambda x, y: x + y).alias("at"))
        return F.transform(zipped, lambda m: F.struct(
            F.lit(kind).alias("kind"), (m["at"] + F.char_length(m["g"])).alias("start"),
            (m["at"] + F.char_length(m["g"]) + F.char_length(m["v"])).alias("end"), m["v"].alias("value"),
            F.substring(F.concat(m["last"], m["g"]), -BEFORE, BEFORE).alias("before"), first(F.concat(first(m["h"]), first(m["next"]))).alias("after")))

    held = F.struct(found.alias("values"), gaps.alias("gaps"))
    return F.when(guard & F.expr(f"{text} rlike '{quoted}'"), bound(held, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check-digit test, for a string of digits."""
    at = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(digits)), F.lit(0),
        lambda s, i: s + F.when(i % 2 == 1, F.substring(at, i, F.lit(1)).cast("int")).otherwise(
            F.substring(at, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(at, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
    )
    return total % 10 == 0


def _passes(kind: str, s: Column) -> Column:
    """Whether a match of a base pattern is one by the whole rule."""
    n = F.char_length(_digits(s["value"]))
    if kind == "ip":
        return s["value"].rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(_digits(s["value"]))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def find_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, loose): spans by the base rules, and candidates of the looser patterns beside them.

    A loose candidate carries what the labelers see: the text before it and its neighbours.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    guards = {"email": F.contains("text", F.lit("@")), "ip": digit & F.contains("text", F.lit(".")), "card": digit,
              "phone": digit & F.contains("text", F.lit("+"))}
    rows = rows.select("*", *(_matches(k, "text", p, guards[k]).alias(f"_{k}") for k, p in BASE_PATTERNS.items()))
    # failing matches of the base patterns stay candidates where they look like their kind
    shown = lambda strict, tested: lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"),
        strict(s).alias("strict"), F.lit(tested).alias("tested"), s["before"].alias("before"), s["after"].alias("after"))
    base = [F.transform(f"_{k}", shown(lambda s, k=k: _passes(k, s), True)) for k in BASE_PATTERNS]
    plausible = lambda s: s["strict"] | (
        (s["kind"] != "card") | F.char_length(_digits(s["value"])).between(12, 19))
    loose_guard = {"phone": digit, "ssn": digit, "name": F.lit(True)}
    loose = [F.transform(_matches(k, "text", p, loose_guard[k]), shown(lambda s: F.lit(False), False)) for k, p in LOOSE_PATTERNS.items()]
    rows = rows.select("doc_id", F.filter(F.concat(*base), plausible).alias("b"), F.concat(*loose).alias("l"))
    return rows.select("doc_id", F.when(F.size("l") == 0, F.col("b")).otherwise(F.concat("b", _free(F.col("l"), F.filter("b", lambda s: s["strict"])))).alias("spans"))


def _free(loose: Column, strict: Column) -> Column:
    """The loose spans that no strict one overlaps: no earlier one ends after their start, and no later one begins before their end."""
    never = F.lit(2**62)

    def kept(spans: Column) -> Column:
        ended = before_each(F.transform(spans, lambda s: F.when(s["strict"], s["end"]).otherwise(F.lit(0))), F.lit(0), F.greatest)
        begun = before_each(F.transform(F.reverse(spans), lambda s: F.when(s["strict"], s["start"]).otherwise(never)), never, F.least)
        zipped = F.arrays_zip(spans.alias("s"), ended.alias("ended"), F.reverse(begun).alias("begun"))
        free = F.filter(zipped, lambda z: ~z["s"]["strict"] & (z["ended"] <= z["s"]["start"]) & (z["begun"] >= z["s"]["end"]))
        return F.transform(free, lambda z: z["s"])

    return bound(F.array_sort(F.concat(loose, strict)), kept)


def _votes(s: Column) -> dict[str, Column]:
    value, kind = s["value"], s["kind"]
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    titled = value.rlike(TITLED)
    parts = lambda names: F.arrays_overlap(F.split(value, " "), F.array(*map(F.lit, names)))
    listed = (
        F.when(kind == "email", F.lower(F.substring_index(value, ".", -1)).isin(*DOMAIN_ENDINGS))
        .when(kind == "card", value.rlike(CARD_ISSUERS))
        .when((kind == "phone") & value.startswith("+"), value.rlike(CALLING_CODES))
        .when(kind == "phone", _digits(value).rlike(NUMBER_BLOCKS))
        .when(kind == "ssn", ~value.rlike("^(?:000|666|9)"))
        .when(kind == "name", F.when(parts(NO_NAMES), False).when(parts(GIVEN_NAMES), True).when(~titled, False))
    )
    cue = F.lit(False)
    for k, p in CUES.items():
        cue = F.when(kind == k, s["before"].rlike(p)).otherwise(cue)
    alone = ~(F.substring(s["before"], -1, 1).rlike("[A-Za-z0-9]") | s["after"].rlike("[A-Za-z0-9]"))
    return {
        "rule": vote((s["tested"] & s["strict"]) | ((kind == "name") & titled), s["tested"] & ~s["strict"]),
        "gazetteer": vote(listed, ~listed),
        "context": vote(cue, s["before"].rlike(COUNTER_CUES)),
        "boundary": vote(alone, ~alone),
    }


LABELERS = ("rule", "gazetteer", "context", "boundary")


def estimate(histogram: dict[tuple, int], rounds: int = 50) -> dict[tuple, float]:
    """Probability of personal data for each (kind, votes...) pattern, by EM with one reliability per labeler.

    Starts from the majority of votes; a prior count of one keeps every reliability off 0 and 1.
    """
    prob = {p: 1 / (1 + math.exp(-1.5 * sum(p[1:]))) for p in histogram}
    for _ in range(rounds):
        rate: dict[tuple, float] = {}
        prior: dict[str, list[float]] = {}
        for p, n in histogram.items():
            yes = prior.setdefault(p[0], [1.0, 1.0])
            yes[0] += n * prob[p]
            yes[1] += n * (1 - prob[p])
            for j, v in enumerate(p[1:]):
                for c, w in ((1, prob[p]), (0, 1 - prob[p])):
                    rate[j, v, c] = rate.get((j, v, c), 1.0) + n * w
        totals = {(j, c): sum(rate.get((j, v, c), 1.0) for v in (-1, 0, 1)) for j in range(len(LABELERS)) for c in (0, 1)}
        for p in histogram:
            odds = math.log(prior[p[0]][0] / prior[p[0]][1])
            for j, v in enumerate(p[1:]):
                odds += math.log(rate[j, v, 1] / totals[j, 1]) - math.log(rate[j, v, 0] / totals[j, 0])
            prob[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prob


def _features(s: Column) -> Column:
    """Names of the classifier's features; their number is fixed by the design."""
    n = s["end"] - s["start"]
    share = F.floor(4 * F.char_length(_digits(s["value"])) / n)
    side = lambda c: F.when(c.rlike("[A-Za-z0-9]"), "word").when(c.rlike(r"\s") | (c == ""), "space").otherwise("mark")
    named = [F.concat(F.lit(f"{name}="), v.cast("string")) for name, v in _votes(s).items()]
    return F.array(
        F.concat(F.lit("kind="), s["kind"]), *named,
        F.concat(F.lit("length="), F.least(F.floor(n / 4), F.lit(8)).cast("string")),
        F.concat(F.lit("digits="), share.cast("string")),
        F.concat(F.lit("left="), side(F.substring(s["before"], -1, 1))), F.concat(F.lit("right="), side(s["after"])),
    )


def _pattern(s: Column) -> Column:
    return F.concat_ws(",", s["kind"], *(v.cast("string") for v in _votes(s).values()))


def train(candidates: DataFrame) -> dict[str, float]:
    """Log-odds of each feature, and of "" for the prior.  What reaches the driver has one row a pattern or feature."""
    spans = candidates.select(F.explode("spans").alias("s"))
    counted = spans.groupBy(_pattern(F.col("s")).alias("pattern")).count().collect()
    histogram = {(p[0], *map(int, p[1:])): r["count"] for r in counted for p in [r["pattern"].split(",")]}
    if not histogram:
        return {"": 0.0}
    soft = estimate(histogram)
    table = F.create_map(*(F.lit(x) for p, v in soft.items() for x in (",".join(map(str, p)), float(v))))
    rows = spans.select(_features(F.col("s")).alias("f"), F.element_at(table, _pattern(F.col("s"))).alias("p"))
    sums = rows.select(F.explode(F.array_append("f", F.lit(""))).alias("f"), "p").groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    by = {r["f"]: (r["yes"], r["no"]) for r in sums}
    yes, no = by[""]
    odds = {f: math.log((a + 1) / (yes + 2)) - math.log((b + 1) / (no + 2)) for f, (a, b) in by.items() if f}
    return odds | {"": math.log((yes + 1) / (no + 1))}


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base spans, and all spans, each sorted by start and kind."""
    candidates = staged(find_candidates(docs), "pii")
    odds = train(candidates)
    table = F.create_map(*(F.lit(x) for f, v in odds.items() for x in (f, float(v))))
    score = lambda s: F.aggregate(
        _features(s), F.lit(odds[""]), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
    order = F.array(*map(F.lit, KINDS))
    placed = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))
    base = F.filter("spans", lambda s: s["strict"])
    everything = F.filter("spans", lambda s: s["strict"] | (~s["tested"] & (score(s) > 0)))
    return candidates.select("doc_id", placed(base).alias("base"), placed(everything).alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return detect(docs).select("doc_id", *map(count, BASE_PATTERNS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


#: Code points of a block of a masked text, in which pieces of it are looked up.
_BLOCK = 4096


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span in the text replaced by its kind in brackets; spans that overlap an earlier one are covered with it."""
    rows = docs.withColumn("_row", F.struct("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    found = detect(rows.select(F.col("_row").alias("doc_id"), "text")).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("_found"), "spans")
    rows = rows.join(found, F.col("_row").eqNullSafe(F.col("_found")), "left")
    rows = rows.withColumn("_blocks", F.when(F.size("spans") > 0, F.transform(
        F.sequence(F.lit(0), F.floor(F.char_length("text") / _BLOCK).cast("int")), lambda i: F.substring(F.col("text"), i * _BLOCK + 1, F.lit(_BLOCK)))))

    def piece(start: Column, end: Column) -> Column:
        first = F.floor(start / _BLOCK).cast("int")
        held = F.slice("_blocks", first + 1, F.floor(end / _BLOCK).cast("int") - first + 1)
        return F.substring(F.array_join(held, ""), (start - first * _BLOCK + 1).cast("int"), (end - start).cast("int"))

    def cut(spans: Column) -> Column:
        zipped = F.arrays_zip(spans.alias("s"), before_each(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest).alias("at"))
        shown = F.transform(zipped, lambda z: F.when(z["s"]["start"] < z["at"], F.lit("")).otherwise(
            F.concat(piece(z["at"], z["s"]["start"]), F.lit("["), z["s"]["kind"], F.lit("]"))))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(shown, ""), piece(last, F.char_length("text").cast("bigint")))

    return rows.withColumn("text", F.when(F.size("spans") > 0, bound(F.col("spans"), cut)).otherwise(F.col("text"))).select(*docs.columns)
