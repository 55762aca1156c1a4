"""DuckDB expressions for the SQL twins, written for RE2 and without look-around."""

from __future__ import annotations

from tessera.functions import labels as L
from tessera.functions import tokens as T

_list = lambda names: ", ".join(f"'{n}'" for n in names)
KNOWN, PINS, INSTANCES, NO_PINS = map(_list, (T.KNOWN_PREFIXES, T.PIN_PREFIXES, T.INSTANCE_PREFIXES, T.NO_PIN_PREFIXES))
STOPS = _list(L.STOP_LABELS)


def trim(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


def canon(x: str) -> str:
    t = trim(f"regexp_replace(upper({x}), '[[:cntrl:]]', '', 'g')")
    t = f"regexp_replace(regexp_replace({t}, '^=\\s*', ''), '^\"(.*)\"$', '\\1')"
    return f"(SELECT CASE WHEN regexp_matches(q.t, '[A-Z0-9]') THEN q.t ELSE '' END FROM (SELECT {t} AS t) q)"


def stem(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '(-[A-Z0-9/]+)+$', ''), '([0-9])[A-Z]+$', '\\1')"


def pin(t: str) -> str:
    return f"(regexp_extract(upper({t}), '^([A-Z]+)[0-9]+-.+$', 1) IN ({PINS}))"


def instance(t: str) -> str:
    u = f"upper({t})"
    p, rest = f"regexp_extract({u}, '^([A-Z]+)[0-9]+-.+$', 1)", f"regexp_extract({u}, '^[A-Z]+[0-9]+-(.+)$', 1)"
    return f"({p} IN ({INSTANCES}) AND NOT (length({rest}) > 1 AND starts_with({rest}, {p})))"


def usage_base(x: str) -> str:
    return stem(canon(x))


def base(x: str) -> str:
    c = canon(x)
    return f"(CASE WHEN {pin(c)} THEN {c} ELSE {stem(c)} END)"


def prefix(x: str) -> str:
    return f"nullif(regexp_extract({trim(f'upper({x})')}, '^([A-Z]+)', 1), '')"


def known(x: str) -> str:
    return f"coalesce({prefix(x)} IN ({KNOWN}), false)"


def suffix(t: str, of: str) -> str:
    """Whether a canonical token is an instance or pin of a base."""
    rest = f"regexp_extract({t}, '^[^-]*-(.*)$', 1)"
    span = f"(length({rest}) > 1 AND starts_with({rest}, regexp_extract({t}, '^([A-Z]+)', 1)))"
    return f"(contains({t}, '-') AND {t} <> {of} AND NOT {span} AND ({instance(t)} OR {pin(t)}) AND {stem(t)} = {of})"


def tokens(cell: str) -> str:
    """A list of the non-empty canonical tokens of a cell."""
    t = f"regexp_replace(regexp_replace(upper(x), '^=\\s*', ''), '^\"(.*)\"$', '\\1')"
    return f"list_filter(list_transform(string_split_regex(coalesce({cell}, ''), '[,\\s;|\\n]+'), lambda x: {t}), lambda x: regexp_matches(x, '[A-Z0-9]'))"


def lookup(x: str) -> str:
    return f"regexp_replace(upper({trim(x)}), '^([A-Z]+)0*([0-9]+)([A-Z]*)$', '\\1\\2\\3')"


NUMBER = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(x: str) -> str:
    """A double; overflow is infinite, as in Java."""
    t = trim(x)
    big = f"TRY_CAST(regexp_extract({t}, '[eE]([+-]?[0-9]+)$', 1) AS INTEGER) > 400"
    return f"(CASE WHEN NOT regexp_matches({t}, '{NUMBER}') THEN NULL WHEN {big} THEN 'inf'::DOUBLE ELSE TRY_CAST({t} AS DOUBLE) END)"


def valid(t: str) -> str:
    return f"regexp_matches(upper({trim(t)}), '^[A-Z]{{1,6}}[0-9]{{1,5}}[A-Z]?$')"


def strip_instance(t: str) -> str:
    u = f"upper({trim(t)})"
    return f"(CASE WHEN regexp_extract({u}, '^([A-Z]+)[0-9]+[A-Z]$', 1) IN ({KNOWN}) THEN regexp_replace({u}, '[A-Z]$', '') ELSE {u} END)"
