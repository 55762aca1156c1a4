"""Column expressions over reference designators, part numbers and free text.  No function here is a UDF.

Java regular expressions; ``(?U)`` makes white space Unicode-aware where cells may hold it.  Every
function maps null to the empty string unless its docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Designator prefixes of the IEEE 315 list, and the special groups among them.
KNOWN_PREFIXES = (
    "R", "C", "L", "FB", "D", "CR", "Z", "Q", "U", "IC", "LED", "DS", "VR", "J", "P", "CN", "CONN", "X", "XPSJ", "XPSSJ",
    "K", "RELAY", "SW", "S", "F", "FUSE", "BT", "T", "XTAL", "Y", "OSC", "MOV", "TVS", "BR", "TP", "TEST", "M", "FID",
    "ANT", "MP", "JP", "SH", "NT", "AR", "SENSOR", "H", "HDR",
)
PIN_PREFIXES = ("J", "P", "CN", "CONN", "X", "XPSJ", "XPSSJ")
INSTANCE_PREFIXES = (*PIN_PREFIXES, "U", "IC", "Q", "T", "AR")
NO_PIN_PREFIXES = (
    "R", "C", "L", "FB", "D", "CR", "Z", "LED", "DS", "VR", "MOV", "TVS", "F", "FUSE", "BR", "TP", "TEST", "FID", "MP",
    "Y", "XTAL", "BT",
)
# The most tokens a range may expand to, and the pattern of parts that are not fitted.
MAX_RANGE = 5000
# Prefixes of parts that pins may belong to, labels of two-terminal parts, and texts that are values.
PARENT_PREFIXES = ("U", "IC", "J", "P", "CN", "CONN", "X", "XPSJ", "AR")
TERMINALS = ("1", "2")
VALUE_TEXT = r"(?i)^(?:\d+(?:\.\d+)?[munpkMG]?[FfHhVvAaWwRrΩ]+|\d+(?:\.\d+)?(?:uF|nF|pF|mF|uH|nH|mH|ohm|OHM|Ohm|[kK]|[mM]eg))$"
DNP_PATTERN = r"(?:\bDNP\b|\bNF\b|NOT\s*FITTED|NO[-\s]?LOAD|DO\s*NOT\s*POPULATE)"

_CONTROL = r"[\x00-\x1f\x7f-\x9f]"
_INVISIBLE = "[﻿​‌‍⁠]"


def clean(c: Column) -> Column:
    """Trimmed of any white space; null becomes empty."""
    return F.coalesce(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def canonical(c: Column) -> Column:
    """A designator in capitals without hidden characters, a leading equals sign or quotes; "" if nothing alphanumeric is left."""
    t = F.regexp_replace(F.regexp_replace(F.upper(c), _CONTROL, ""), _INVISIBLE, "")
    t = clean(t)
    t = clean(F.regexp_replace(t, r"^=", ""))
    t = clean(F.regexp_replace(F.regexp_replace(t, r'^"(.*)"$', "$1"), r"^'(.*)'$", "$1"))
    return F.when(t.rlike(r"[\p{L}\p{N}]"), t).otherwise("")


def prefix(c: Column) -> Column:
    """Leading letters, or null."""
    t = F.regexp_replace(F.regexp_replace(clean(F.upper(c)), _CONTROL, ""), _INVISIBLE, "")
    return F.nullif(F.regexp_extract(t, r"^([A-Z]+)", 1), F.lit(""))


def known_prefix(p: Column) -> Column:
    return F.coalesce(F.upper(p).isin(*KNOWN_PREFIXES), F.lit(False))


def analyze_pins(p: Column) -> Column:
    return F.coalesce(~F.upper(p).isin(*NO_PIN_PREFIXES), F.lit(True))


def valid_designator(c: Column) -> Column:
    return F.coalesce(F.upper(clean(c)).rlike(r"^[A-Z]{1,6}\d{1,5}[A-Z]?$"), F.lit(False))


def pin_candidate(c: Column, most: int = 4) -> Column:
    """A short alphanumeric label, or two bonded ones, that is no value with a unit."""
    valued = c.rlike(r"(?i)^\d+(?:\.\d+)?(?:[VAKMRUNPF]|OHM|HZ|MHZ|UF|NF|PF|UH|MH)$")
    return (F.char_length(c) <= most) & c.rlike("^[A-Za-z0-9]+(?:/[A-Za-z0-9]+)?$") & ~valued


def pin_notation(t: Column) -> Column:
    """Connector and pin, as J1-4."""
    return F.regexp_extract(F.upper(t), r"^([A-Z]+)\d+-.+$", 1).isin(*PIN_PREFIXES)


def instance_notation(t: Column) -> Column:
    """Part and instance or terminal, as U3-7, which is not a range such as U1-U5."""
    u = F.upper(t)
    p, rest = F.regexp_extract(u, r"^([A-Z]+)\d+-.+$", 1), F.regexp_extract(u, r"^[A-Z]+\d+-(.+)$", 1)
    return p.isin(*INSTANCE_PREFIXES) & ~((F.char_length(rest) > 1) & F.startswith(rest, p))


def _stem(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"(?:-[A-Z0-9/]+)+$", ""), r"(\d)[A-Z]+$", "$1")


def usage_base(c: Column) -> Column:
    """Without any suffix: U200-1-A, U200A and J200-4 are of U200 and J200."""
    return _stem(canonical(c))


def base(c: Column) -> Column:
    """Without instance suffixes; a connector's pin stays."""
    t = canonical(c)
    return F.when(pin_notation(t), t).otherwise(_stem(t))


def expand_range(c: Column, most: int = MAX_RANGE) -> Column:
    """Array: R1-R5 in full, in the width of its first number; anything else as it is."""
    t = canonical(c)
    part = lambda k: F.regexp_extract(t, r"^([A-Z]+)(\d+)\s*(?:-|–|—|\.\.)\s*([A-Z]+)?(\d+)$", k)
    a, b = (part(k).try_cast("long") for k in (2, 4))
    p = part(1)
    fits = (p != "") & ((part(3) == "") | (part(3) == p)) & (a <= b) & (b - a < most) & ~instance_notation(t)
    width = F.char_length(part(2))
    made = F.transform(F.sequence(a, b), lambda k: F.concat(p, F.lpad(k.cast("string"), F.greatest(width, F.char_length(k.cast("string"))), F.lit("0"))))
    return F.when(F.coalesce(fits, F.lit(False)), made).otherwise(F.array(t))


def split_list(c: Column) -> Column:
    """The non-empty canonical tokens of a delimited cell, in order."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,\s;|\n]+"), canonical), lambda t: t != "")


def designator_count(c: Column) -> Column:
    """How many tokens of a cell begin with a known prefix."""
    return F.size(F.filter(split_list(c), lambda t: known_prefix(prefix(t))))


def find_base(c: Column) -> Column:
    """The first designator in free text, in capitals, or ""."""
    return F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)\b([A-Z]{1,6}\d{1,5}[A-Z]?)\b", 1))


def find_instance(c: Column) -> Column:
    """The first hyphenated identifier or designator in free text, whichever stands first, or ""."""
    return F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)\b(?:[A-Z0-9]+(?:-[A-Z0-9/]+)+|[A-Z]{1,6}\d{1,5}[A-Z]?)\b", 0))


def _whole_or(c: Column, found: Column) -> Column:
    """A cell that is one designator, with a number of any length, in capitals; else what is found in its text."""
    t = F.upper(clean(c))
    return F.when(t.rlike(r"^[A-Z]{1,6}\d+[A-Z]?$"), t).otherwise(found)


def cell_base(c: Column) -> Column:
    """The designator that a cell is, or the first in its text, or ""."""
    return _whole_or(c, find_base(c))


def cell_instance(c: Column) -> Column:
    """The designator that a cell is, or the first identifier or designator in its text, or ""."""
    return _whole_or(c, find_instance(c))


def lookup_key(c: Column) -> Column:
    """In capitals, the number without leading zeros: R001 and R1 are the same."""
    t = F.upper(clean(c))
    return F.regexp_replace(t, r"^([A-Z]+)0*(\d+)([A-Z]*)$", "$1$2$3")


def strip_instance(c: Column) -> Column:
    """R1A is R1, for known prefixes only."""
    t = F.upper(clean(c))
    p = F.regexp_extract(t, r"^([A-Z]+)\d+[A-Z]$", 1)
    return F.when(p.isin(*KNOWN_PREFIXES), F.regexp_replace(t, "[A-Z]$", "")).otherwise(t)


def bom_token(c: Column) -> Column:
    """A BOM cell's token by its base: a designator, or what stands before a hyphen if that is one; else ""."""
    t = canonical(c)
    head = F.substring_index(t, "-", 1)
    return F.when(valid_designator(t), strip_instance(t)).when(valid_designator(head), strip_instance(head)).otherwise("")


def verification_base(c: Column) -> Column:
    """What an extracted component is verified by; null for a pin without a parent."""
    t = F.upper(clean(F.regexp_replace(F.coalesce(c, F.lit("")), r"\[\?\]", "")))
    return F.when(F.startswith(t, F.lit("PIN-")), F.lit(None).cast("string")).otherwise(F.regexp_replace(F.substring_index(t, "-", 1), r"(\d)[A-Z]+$", "$1"))


def pin_id(c: Column) -> Column:
    """REF-PIN from REF-PIN, REF.PIN or REF:PIN, parted at the last of these; blanks removed."""
    t = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")
    return F.regexp_replace(t, r"^(.+)[-.:]([^-.:]+)$", "$1-$2")


def coverage_key(c: Column) -> Column:
    """The usage base, or "" if it has no digit."""
    b = usage_base(c)
    return F.when(b.rlike(r"\d"), b).otherwise("")


def suffix_notation(t: Column) -> Column:
    """Whether a canonical token is an instance or pin of what stands before its first hyphen, and no range such as J1-J5."""
    rest = F.regexp_extract(t, "^[^-]*-(.*)$", 1)
    span = (F.char_length(rest) > 1) & F.startswith(rest, F.regexp_extract(t, "^([A-Z]+)", 1))
    return t.contains("-") & ~span & (instance_notation(t) | pin_notation(t))


def is_suffix_of(token: Column, of: Column) -> Column:
    """Whether a hyphenated token is an instance or pin of the given base."""
    t = canonical(token)
    return (t != of) & suffix_notation(t) & (usage_base(t) == of)


def part_number(c: Column) -> Column:
    """Letters and digits in capitals."""
    return F.regexp_replace(F.upper(clean(c)), "[^A-Z0-9]", "")


def identity_text(c: Column) -> Column:
    return F.upper(clean(c))


def failure_mode_key(c: Column) -> Column:
    """In capitals, runs of white space as one space."""
    return F.upper(F.regexp_replace(clean(c), r"(?U)\s+", " "))


def not_fitted(ref: Column, description: Column, pattern: str = DNP_PATTERN) -> Column:
    """Whether designator and description say that the part is not fitted."""
    return F.regexp_replace(F.concat_ws(" ", F.coalesce(ref, F.lit("")), F.coalesce(description, F.lit(""))), _CONTROL, "").rlike("(?i)" + pattern)


def plain_decimal(c: Column) -> Column:
    """A canonical form of plain decimals (10.0 is 10; 0123 is no decimal), other text as it is, in small letters."""
    t = F.lower(clean(c))
    whole = t.rlike(r"^-?(?:0|[1-9]\d*)(?:\.\d+)?$")
    short = F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(whole, F.when(short == "-0", "0").otherwise(short)).otherwise(t)


def same_value(a: Column, b: Column) -> Column:
    return plain_decimal(a) == plain_decimal(b)


def function_base(c: Column) -> Column:
    """A function id without its -A or -FM1."""
    return F.regexp_replace(F.upper(clean(c)), r"-(?:[A-Z]|FM\d+)$", "")


def printable(c: Column) -> Column:
    """Without the characters that XML does not allow."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def circuit_block_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?i)circuit block|circuit-block|function block|functional block|function-block|\b(?:cb|fb)\b")


def piece_part_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?i)piece part|piece-part|piecepart|\bpp\b")


def suffix_letters(n: Column) -> Column:
    """0, 1, ... as A, B, ..., Z, AA, AB, ...; up to three letters."""
    letter = lambda k: F.char(65 + k)
    one, two = n - 26, n - 702
    return (
        F.when(n < 26, letter(n))
        .when(n < 702, F.concat(letter(F.floor(one / 26)), letter(one % 26)))
        .otherwise(F.concat(letter(F.floor(two / 676)), letter(F.floor(two / 26) % 26), letter(two % 26)))
    )


def fmea_id(*parts: Column) -> Column:
    return F.concat_ws("-", *(F.nullif(p, F.lit("")) for p in parts))
