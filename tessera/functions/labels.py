"""Column expressions over group labels: cleaning, suffixes, class, and place in a numbered sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.tokens import clean

# Labels that name no group, and the suffixes of status and mode.
STOP_LABELS = (
    "NOTE", "NOTES", "TODO", "TBD", "NA", "N/A", "REV", "REVISION", "DOC", "PAGE", "SHEET", "TITLE", "DATE", "BY", "CHECKED",
    "APPROVED", "DNP", "DO", "NOT", "POPULATE", "VCC", "GND",
)
STATUSES = ("UNVERIFIED", "VERIFIED", "PARTIAL")
MODES = ("-FN", "-PN")


def sanitize(c: Column) -> Column:
    """First line, plain characters only, in capitals."""
    line = clean(F.regexp_extract(F.coalesce(c, F.lit("")), r"^([^\r\n]*)", 1))
    return F.upper(clean(F.regexp_replace(line, r"[^A-Za-z0-9 _\-/.]", "")))


def strip_status(c: Column) -> Column:
    """Without any number of statuses in brackets at the end."""
    return clean(F.regexp_replace(clean(c), r"(?i)(?:\s*\((?:" + "|".join(STATUSES) + r")\))+$", ""))


def strip_mode(c: Column) -> Column:
    """Without one mode suffix, unless nothing else is there."""
    t = clean(c)
    short = clean(F.regexp_replace(t, r"(?i)(?:" + "|".join(MODES) + r")$", ""))
    return F.when(short == "", t).otherwise(short)


def group_mode(c: Column, default: str) -> Column:
    """functional or piece_part by suffix, else the default."""
    t = F.upper(strip_status(c))
    return F.when(F.endswith(t, F.lit("-FN")), "functional").when(F.endswith(t, F.lit("-PN")), "piece_part").otherwise(default)


def without_verified(c: Column) -> Column:
    """Without one (Verified) or (Unverified)."""
    return clean(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\((?:Verified|Unverified)\)$", ""))


def label_class(c: Column) -> Column:
    """strong, weak or noise, for a sanitized label."""
    noise = (
        (c == "") | c.isin(*STOP_LABELS) | (F.char_length(c) > 60) | c.rlike(r"^\d+$") | c.rlike(r"(?i)^\d+(?:\.\d+)?\s*[VA]$") | c.rlike(r"^[A-Z]{1,2}\d+[A-Z]?$")
    )
    letters, digits = c.rlike("[A-Za-z]"), c.rlike("[0-9]")
    return F.when(noise, "noise").when(letters & digits, "strong").when(letters & (F.char_length(c) <= 20), "weak").otherwise("noise")


def sequence(c: Column) -> Column:
    """Struct prefix, number, width, kind of a label that ends in dotted or at least two plain digits; else null."""
    dotted = r"^(.+?)(\d+(?:\.\d+)+)$"
    plain = r"^(.+?)(\d{2,})$"
    last = F.regexp_extract(c, r"\.(\d+)$", 1)
    own = F.regexp_extract(c, plain, 2)
    of = lambda p, n, kind: F.struct(p.alias("prefix"), n.try_cast("long").alias("number"), F.char_length(n).cast("long").alias("width"), F.lit(kind).alias("kind"))
    return F.when(c.rlike(dotted), of(F.regexp_replace(c, r"\d+$", ""), last, "dotted")).when(c.rlike(plain), of(F.regexp_extract(c, plain, 1), own, "plain"))


def partition_id(c: Column, modes: bool = False) -> Column:
    """Struct label, mode, class, sequence of a raw group label."""
    bare = strip_status(c)
    mode = F.upper(F.regexp_extract(bare, r"(?i)(-FN|-PN)$", 1)) if modes else F.lit("")
    label = sanitize(strip_mode(bare) if modes else bare)
    return F.struct(label.alias("label"), mode.alias("mode"), label_class(label).alias("class"), sequence(label).alias("sequence"))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, ..., 11th, ..."""
    teen = (n % 100).between(11, 13)
    end = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def natural_key(c: Column) -> Column:
    """An orderable key: runs of digits compare as numbers, others as text."""
    return F.transform(
        F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+|\D+)"), F.lit(1)),
        lambda s: F.struct(s.rlike(r"^\d").cast("int").alias("kind"), F.coalesce(s.try_cast("decimal(38,0)"), F.lit(0)).alias("n"), F.lower(s).alias("t")),
    )
