"""Chat formatting: layouts are told by a schema fingerprint and mapped to canonical turns.

A record's nested field paths (``messages[].content``, over all elements of its lists) that any mapping
reads are sorted and hashed; the hash selects a declarative mapping.  Where fields of several mappings
are there and no mapping has just these, the first whose fields are all there is taken, so extra columns,
known or not, do no harm.  Tables of turns, tables of whole records and JSON records of mixed layouts all
become (conv_id, turns array<struct<role, text>>).  Members of a list may lack their role or text.

The template writes each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.  In roles and texts a
backslash becomes ``\\e`` and the ``|`` of ``<|`` becomes ``\\p`` (in roles also a line feed ``\\n``), so a
control string inside a text cannot be read as one, and reading back gives every text as it was.  The
loss mask lists the code point spans of assistant texts.

Null texts and roles are empty.  Turns are ordered by turn, then role, then text, so repeated rows stay
and ties have one order; null turns come first.  A record of unknown layout has no turns.  An empty
table gives no rows.  A conversation is gathered into one row, as its output is one string.
DataFrame operations only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import before_each, bound, staged

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role string, text string>>"
#: Code points of a block of a formatted text.
_BLOCK = 4096


@dataclass(frozen=True)
class Mapping:
    """``fields``: (role, field paths whose non-empty values are joined by a blank line), in order.
    ``list_of``: or an array field with its role and text members, of which the text tells the layout.
    ``rows_of``: or the columns of one turn a row: conversation, order, role and text.  Roles of records
    are renamed by ROLES."""

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    list_of: tuple[str, str, str] | None = None
    rows_of: tuple[str, str, str, str] | None = None

    @property
    def paths(self) -> frozenset[str]:
        if self.list_of:
            return frozenset((f"{self.list_of[0]}[].{self.list_of[2]}",))
        return frozenset(self.rows_of or (p for _, paths in self.fields for p in paths))


#: In the order in which they are tried where a record has fields of several.
MAPPINGS = (
    Mapping("turn-rows", rows_of=("conv_id", "turn", "role", "text")),
    Mapping("messages", list_of=("messages", "role", "content")),
    Mapping("from-value", list_of=("conversations", "from", "value")),
    Mapping("system-prompt-response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction-input-output", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt-response", (("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt-completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question-answer", (("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction-output", (("user", ("instruction",)), ("assistant", ("output",)))),
)
_OF_RECORDS = tuple(m for m in MAPPINGS if not m.rows_of)
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_KNOWN = sorted(frozenset().union(*(m.paths for m in MAPPINGS)))


def fingerprint(paths) -> str:
    """Hash of the field paths that some mapping reads."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(_KNOWN))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def mapping_of(paths) -> Mapping | None:
    """By the fingerprint, or the first mapping whose fields are all there."""
    return BY_FINGERPRINT.get(fingerprint(paths)) or next((m for m in MAPPINGS if m.paths <= set(paths)), None)


def schema_paths(schema: T.StructType, before: str = "") -> list[str]:
    found = []
    for f in schema.fields:
        kind, path = f.dataType, before + f.name
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, path + "[]"
        found += schema_paths(kind, path + ".") if isinstance(kind, T.StructType) else [path]
    return found


def _role(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for old, new in ROLES.items():
        c = F.when(c == old, new).otherwise(c)
    return c


def _turns(mapping: Mapping, field, members: set[str]) -> Column:
    """The mapping as an expression; ``field(name)`` is a column of the record, ``members`` those of its list's elements."""
    if mapping.list_of:
        array, role, text = mapping.list_of
        return F.transform(
            F.coalesce(field(array), F.array()),
            lambda m: F.struct(_role(m[role] if role in members else F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")),
        ).cast(TURNS)
    made = []
    for role, paths in mapping.fields:
        text = F.concat_ws("\n\n", *(F.when(field(p) != "", field(p)) for p in paths))
        made.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.filter(F.array(*made), lambda t: (t["role"] != "system") | (t["text"] != "")).cast(TURNS)


def canonical(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns) of a table of turns or a table of records, by the fingerprint of its schema."""
    mapping = mapping_of(schema_paths(df.schema))
    if mapping is None:
        raise ValueError(f"no mapping for the fields {schema_paths(df.schema)}")
    if mapping.rows_of:
        conv, turn, role, text = (F.col(f"`{c}`") for c in mapping.rows_of)
        said = F.struct(turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        rows = df.groupBy(conv.alias("conv_id")).agg(F.array_sort(F.collect_list(said)).alias("t"))
        return rows.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    members = {f.name for f in df.schema[mapping.list_of[0]].dataType.elementType.fields} if mapping.list_of else set()
    return df.select(F.col(f"`{id_col}`").alias("conv_id"), _turns(mapping, lambda name: F.col(f"`{name}`"), members).alias("turns"))


def canonical_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, fingerprint, turns) of JSON records whose layouts differ from row to row."""
    parsed = F.from_json(F.col(f"`{json_col}`"), "map<string,string>")
    members = lambda v: F.array_distinct(F.flatten(F.transform(F.from_json(v, "array<map<string,string>>"), lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>")))))
    inner = lambda e: F.when(e["value"].startswith("["), F.transform(members(e["value"]), lambda m: F.concat(e["key"], F.lit("[]."), m)))
    # a list and a text that looks like one read alike here, so both paths count
    paths = F.flatten(F.transform(F.map_entries(parsed), lambda e: F.concat(F.array(e["key"]), F.coalesce(inner(e), F.array().cast("array<string>")))))
    known = F.array(*map(F.lit, _KNOWN))
    names = sorted({p for m in _OF_RECORDS if not m.list_of for p in m.paths})
    lists = [m.list_of for m in _OF_RECORDS if m.list_of]
    schema = ", ".join([*(f"`{p}` string" for p in names), *(f"`{a}` array<struct<`{r}` string, `{t}` string>>" for a, r, t in lists)])
    rows = df.select(
        F.col(f"`{id_col}`").alias("conv_id"), F.from_json(F.col(f"`{json_col}`"), schema).alias("r"),
        F.array_sort(F.array_intersect(F.coalesce(paths, F.array().cast("array<string>")), known)).alias("paths"),
    )
    rows = rows.withColumn("fingerprint", F.sha2(F.array_join("paths", "\n"), 256))
    turns = F.array().cast(TURNS)
    made = [(m, _turns(m, lambda name: F.col("r")[name], set(m.list_of or ()))) for m in _OF_RECORDS]
    for m, found in reversed(made):  # the first that fits, unless the fingerprint names one
        turns = F.when(F.size(F.array_intersect("paths", F.array(*map(F.lit, sorted(m.paths))))) == len(m.paths), found).otherwise(turns)
    for m, found in made:
        turns = F.when(F.col("fingerprint") == fingerprint(m.paths), found).otherwise(turns)
    return rows.select("conv_id", "fingerprint", turns.alias("turns"))


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\e")), F.lit("<|"), F.lit("<\\p"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\p"), F.lit("|")), F.lit("\\e"), F.lit("\\"))


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) from (conv_id, turns); loss: spans of code points, end exclusive."""
    head = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))
    pieces = F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    rows = conversations.select("conv_id", pieces.alias("p"))
    tail = END + "\n"
    length = lambda p: (F.char_length(p["head"]) + F.char_length(p["body"]) + len(tail)).cast("bigint")

    def under_loss(at: Column) -> Column:
        span = lambda p, x: F.when(p["loss"], F.struct(
            (x + F.char_length(p["head"])).alias("start"), (x + F.char_length(p["head"]) + F.char_length(p["body"])).alias("end")))
        return F.filter(F.zip_with("p", at, span), lambda s: s.isNotNull())

    spans = bound(before_each(F.transform("p", length), F.lit(0), lambda x, y: x + y), under_loss)
    text = F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    return rows.select("conv_id", text.alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted string holds."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substring(p, len(START) + 1, F.char_length(p))
    cut = lambda p: F.instr(body(p), "\n")
    return F.transform(parts, lambda p: F.struct(
        _unescape_role(F.substring(body(p), F.lit(1), cut(p) - 1)).alias("role"),
        unescape(F.substring(body(p), cut(p) + 1, F.char_length(p))).alias("text"),
    ))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted rows say: turns, the text under the loss mask, lengths.

    The mask is read by blocks of the text, as a substring far into it is found from its start.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.char_length("formatted") / _BLOCK).cast("int")), lambda i: F.substring(F.col("formatted"), i * _BLOCK + 1, F.lit(_BLOCK)))
    number = lambda at: F.floor(at / _BLOCK).cast("int")
    piece = lambda held, s: F.substring(
        F.array_join(F.slice(held, number(s["start"]) + 1, number(s["end"]) - number(s["start"]) + 1), ""),
        (s["start"] - number(s["start"]) * _BLOCK + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    under = bound(blocks, lambda held: F.array_join(F.transform("loss", lambda s: unescape(piece(held, s))), ""))
    rows = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), under.alias("under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def write_formatted(conversations: DataFrame) -> DataFrame:
    """Format a table of any known layout, write it to the shared folder and read it back."""
    return written(canonical(conversations))


def written(canonical_turns: DataFrame) -> DataFrame:
    """Format (conv_id, turns), write them to the shared folder and read them back."""
    return staged(format_turns(canonical_turns.select("conv_id", "turns")), "chat")
