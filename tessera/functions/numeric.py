"""Guarded number parsing and the arithmetic of rates, ratios and usages.

One grammar for numbers, so that text Java alone or Python alone would accept is no number here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.tokens import clean

NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
RATIO_TOLERANCE, USAGE_TOLERANCE = 0.001, 0.01
UNITS = {"per_hour": 1.0, "per_million_hours": 1e6, "per_billion_hours": 1e9}


def number(c: Column) -> Column:
    """A double, or null where the text is none; an overflow is infinite."""
    t = clean(c.cast("string"))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def finite(c: Column) -> Column:
    """Whether a double is a number that is not infinite; false for null."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def _short(n: Column) -> Column:
    """A number's text without a fraction of zero."""
    return F.regexp_replace(n, r"\.0+$", "")


def parse_usage(c: Column) -> Column:
    """Struct value, text: blank is 1, a/b and "a of b" are fractions with formula text, garbage and x/0 are null."""
    t = clean(c)
    fraction = r"(?i)^(\d+(?:\.\d+)?)\s*(?:/|of)\s*(\d+(?:\.\d+)?)$"
    a, b = F.regexp_extract(t, fraction, 1), F.regexp_extract(t, fraction, 2)
    over = b.try_cast("double")
    value = F.when(t == "", 1.0).when(t.rlike(fraction), F.try_divide(a.try_cast("double"), over)).otherwise(number(t))
    text = F.when(t == "", "1").when(t.rlike(fraction) & (over != 0), F.concat(F.lit("="), _short(a), F.lit("/"), _short(b)))
    return F.struct(value.alias("value"), text.alias("text"))


def clean_rate(c: Column, unit: str = "per_hour") -> Column:
    """Struct rate, flagged: what is no finite number counts as 0 and is flagged unless blank; then per hour."""
    n = number(c)
    ok = finite(n)
    return F.struct(
        (F.when(ok, n).otherwise(0.0) / UNITS.get(unit, 1.0)).alias("rate"), ((clean(c) != "") & ~ok).alias("flagged"))


def clean_usage(c: Column, rate: Column) -> Column:
    """Struct usage, gap: blank with a rate is a gap; blank without one, and anything out of (0, 1e6], is 1."""
    n = number(c)
    return F.struct(
        F.when(n.isNull() | ~finite(n) | (n <= 0) | (n > 1e6), 1.0).otherwise(n).alias("usage"), (n.isNull() & (rate > 0)).alias("gap"))


def clean_ratio(c: Column) -> Column:
    """What is no finite number in [0, 10] is 1."""
    n = number(c)
    return F.when(n.isNull() | ~finite(n) | (n < 0) | (n > 10), 1.0).otherwise(n)


# Words for numbers of parts, package names and units beside numbers, connector words.
MULTIPLIERS = (("single", 1), ("dual", 2), ("triple", 3), ("tri", 3), ("quad", 4), ("penta", 5), ("hex", 6), ("octal", 8), ("deca", 10))
NOT_A_COUNT = (
    r"\b(?:SOIC|TSSOP|QFN|BGA|QFP|DFN|SOT|LQFP|MSOP)\s*-?\s*\d+\b|(?:\b(?:0402|0603|0805|1206)\b)|(?:\b\d+\s*(?:(?:bit|mhz|ghz|khz|v|mv|kohm|ohm)\b|mΩ(?:[^A-Za-z0-9_]|$)))"
)
CONNECTOR_WORDS = r"\b(?:connector|header|socket|plug|jack|backplane)\b"


def expected_count(c: Column) -> Column:
    """Parts a description promises: a multiplier word, else AxB, else the pins of a connector, else 0."""
    t = F.coalesce(c, F.lit(""))
    out = None
    for word, n in MULTIPLIERS:
        hit = t.rlike(rf"(?i)\b{word}\b")
        out = F.when(hit, n) if out is None else out.when(hit, n)
    grid = lambda k: F.regexp_extract(t, r"(?i)(\d+)\s*x\s*(\d+)", k).try_cast("long")
    pins = F.regexp_extract(t, r"(?i)(\d+)\s*-?\s*pins?", 1).try_cast("long")
    out = out.when(t.rlike("(?i)" + NOT_A_COUNT), 0).when(grid(1).isNotNull(), grid(1) * grid(2))
    return F.coalesce(out.when(t.rlike("(?i)" + CONNECTOR_WORDS), pins), F.lit(0)).cast("long")


def pages(c: Column, most: int = 200) -> Column:
    """Distinct page numbers of a cell, ascending: numbers and ranges of up to ``most`` pages, 1 to 9999."""
    parts = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+\s*[-–]\s*\d+|\d+)"), F.lit(1))
    first = lambda s: F.regexp_extract(s, r"^(\d+)", 1).try_cast("long")
    last = lambda s: F.regexp_extract(s, r"(\d+)$", 1).try_cast("long")
    whole = lambda s: F.when((first(s) <= last(s)) & (last(s) - first(s) <= most), F.sequence(first(s), last(s))).otherwise(F.array(first(s), last(s)))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(parts, whole)), lambda p: p.between(1, 9999))))
