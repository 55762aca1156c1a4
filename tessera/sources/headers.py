"""Schema resolution by header text, on the driver: pure functions over column names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header synonyms of the canonical columns.
SYNONYMS = {
    "ref_des": ("reference designator", "ref des", "refdes", "designator"),
    "part_number": ("part number", "part no", "pn", "mpn"),
    "description": ("description", "desc"),
    "hda_level1": ("commodity 1", "commodity i", "commodity level 1"),
    "hda_level2": ("commodity 2", "commodity ii", "commodity level 2"),
    "part_usage": ("part usage", "usage"),
    "component_group": ("component group", "group", "circuit block"),
    "failure_mode": ("failure mode",),
    "ratio": ("failure mode ratio", "ratio", "fmr"),
    "page": ("schematic page", "page", "sheet"),
}
# What the headers of an FMEA sheet contain.
CONTAINED = {
    "fmea_refdes": ("failure mode causes", "failure mode cause", "fmcs", "refdes", "reference designator", "ref des", "ref_des", "parts", "components", "affected parts"),
    "fmea_id": ("fmea id", "fmea-id", "fmea_id", "fmeaid"),
    "circuit_block": ("circuit block", "function block", "component group", "function group", "circuit_block", "function_block", "fmea level", "fmea_level", "row type"),
}
DO_NOT_MAP = "__do_not_map__"


def clean_header(name: str) -> str:
    """Without marks and line breaks that spreadsheets leave; runs of blanks as one."""
    return re.sub(r"\s+", " ", re.sub("[﻿​]", "", name)).strip()


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*dedupe_headers([clean_header(c) for c in df.columns]))


def dedupe_headers(names: Iterable[str]) -> list[str]:
    """Repeated headers get .1, .2, ..., passing over names that exist."""
    names, out = list(names), []
    taken = set(names)
    for name in names:
        new, k = name, 0
        while new in out or (k and new in taken):
            k += 1
            new = f"{name}.{k}"
        out.append(new)
    return out


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def detect_column(columns: Iterable[str], synonyms: Iterable[str], substring: bool = False) -> str | None:
    """Exact in any case, then by letters and digits, then by containment; short synonyms need word bounds."""
    columns, synonyms = list(columns), [s.lower() for s in synonyms]
    for key in (lambda c: c.lower().strip(), _plain):
        for s in synonyms:
            for c in columns:
                if key(c) == key(s):
                    return c
    if substring:
        for c in columns:
            for s in synonyms:
                if (re.search(rf"\b{re.escape(s)}\b", c.lower()) if len(s) < 5 else s in c.lower()):
                    return c
    return None


def resolve_column(columns: Iterable[str], names: Iterable[str]) -> str | None:
    """Exact, then by containment in column order; names under four characters need bounds of letters and digits."""
    columns, names = list(columns), [n.lower() for n in names]
    for n in names:
        for c in columns:
            if c.lower().strip() == n:
                return c
    for c in columns:
        for n in names:
            if (re.search(rf"(?<![a-z0-9]){re.escape(n)}(?![a-z0-9])", c.lower()) if len(n) < 4 else n in c.lower()):
                return c
    return None


def containing(columns: Iterable[str], synonyms: Iterable[str]) -> str | None:
    """The first column that contains a synonym."""
    return next((c for c in columns if any(s in c.lower() for s in synonyms)), None)


def description_column(columns: Iterable[str], given: str | None, ignore_dnp: bool) -> str | None:
    """The given column if it exists; else one is looked for only where unplaced parts are left out by their description."""
    columns = list(columns)
    if given in columns:
        return given
    return detect_column(columns, SYNONYMS["description"]) if ignore_dnp else None


def plain_header(name: Column) -> Column:
    """A header's letters and digits, in small letters."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def ensure_columns(df: DataFrame, columns: Iterable[str], source: str) -> None:
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"{source}: required column {c!r} is missing; it has {df.columns}")


def map_columns(df: DataFrame, wanted: Iterable[str], required: Iterable[str] = (), overrides: dict[str, str] | None = None) -> DataFrame:
    """The wanted canonical columns; overrides come first where their column exists, and may unmap one."""
    overrides, found = overrides or {}, {}
    for name in wanted:
        given = overrides.get(name)
        if given == DO_NOT_MAP:
            continue
        actual = given if given in df.columns else resolve_column(df.columns, SYNONYMS.get(name, (name,)))
        if actual:
            found[name] = actual
    missing = [r for r in required if r not in found]
    if missing:
        raise ValueError(f"no column for {missing} among {df.columns}")
    return df.select(*(F.col(f"`{actual}`").alias(name) for name, actual in found.items()))


def overrides_of(rows: Iterable[dict]) -> dict[str, dict[str, str]]:
    """{file: {canonical: column}} from flat mapping rows with file, target and column."""
    out: dict[str, dict[str, str]] = {}
    for r in rows:
        if r.get("target") and r.get("column"):
            out.setdefault(r.get("file", ""), {})[r["target"]] = r["column"]
    return out
