"""Merge of an old and a new BOM: every row of both, with merged values, status, source and notes of what happened.

New rows come first and in their order; new values win, a blank one keeps the old, which is noted.  A designator
is matched by its first row on each side.  A row of one bare designator (U5) whose old instances (U5-1, U5-2) the
new table lacks is superseded by these, carried along under it; only the first such row carries.  Old designators
that are found nowhere stand after the entry that took the last old row before them.

Token tables of both sides are computed once, and all rows of one designator are counted before they are
joined.  Rows are told apart by row_no, which also is their order.  Blank cells and nulls are the same.
Repeated designators are noted, not merged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import tokens as T
from tessera.operators import explode as E
from tessera.operators import ranges as R
from tessera.sources.readers import once

#: Order of the merged rows: the new row, the old row and place of a carried one, those of a deleted one after it; 0 where there is none.
ORDER = ["entry", "carried_row", "carried_pos", "gone_row", "gone_pos"]
OLD, NEW = "Old BOM", "New BOM"


# ---- columns ----------------------------------------------------------------------------------------

@dataclass
class Plan:
    """``columns`` in order, the one each old column fills, the names of status, source and notes, and what could not be settled."""

    columns: list[str]
    filled: dict[str, str]
    tool: dict[str, str]
    notes: list[str] = field(default_factory=list)


def _key(name: str) -> str:
    return name.strip().casefold()


def plan_columns(old: list[str], new: list[str], pairs: list[tuple[str, str]] = ()) -> Plan:
    """The new columns, then those of the old that no new one stands for.

    A column may be filled by one old column: pairs (old, new) claim first, then names that are equal but for case
    and blanks, in order.  An old column that comes too late keeps its data under a name of its own.
    """
    plan = Plan(list(new), {}, {})
    by_key = {}
    for name in reversed(new):
        by_key[_key(name)] = name
    old_by_key = {}
    for name in reversed(old):
        old_by_key[_key(name)] = name
    taken, owner = {_key(name) for name in new}, {}

    def claim(name: str, target: str) -> None:
        if _key(target) in owner:
            own, n = f"{name.strip()} (old)", 2
            while _key(own) in taken:
                own, n = f"{name.strip()} (old {n})", n + 1
            plan.notes.append(f'Old column "{name}" kept separately as "{own}" — "{target}" was already filled by old column "{owner[_key(target)]}"')
            target = own
        plan.filled[name] = target
        owner[_key(target)] = name
        if _key(target) not in taken:
            plan.columns.append(target)
            taken.add(_key(target))

    for a, b in pairs:
        if _key(a) not in old_by_key or _key(b) not in by_key:
            plan.notes.append(f'Column pair "{a}" -> "{b}" did not match the loaded headers and was ignored')
        elif old_by_key[_key(a)] in plan.filled:
            plan.notes.append(f'Column pair "{a}" -> "{b}" was ignored — "{a}" is already mapped by an earlier pair')
        else:
            claim(old_by_key[_key(a)], by_key[_key(b)])
    for name in old:
        if name not in plan.filled:
            claim(name, by_key.get(_key(name), name.strip()))
    for what, name in (("status", "Status"), ("source", "Source"), ("notes", "Change Notes")):
        while _key(name) in taken:
            name = f"Merge {name}"
        taken.add(_key(name))
        plan.columns.append(name)
        plan.tool[what] = name
    return plan


# ---- cells -------------------------------------------------------------------------------------------

def _blank(c: Column) -> Column:
    return T.clean(c) == ""


def merged_value(new: Column, old: Column) -> Column:
    """The new value; where it is blank, the old one."""
    return F.when(_blank(new), F.coalesce(old, F.lit(""))).otherwise(new)


def cell_status(new: Column, old: Column) -> Column:
    """kept, unchanged, filled or changed: a blank never overwrites."""
    return F.when(_blank(new), "kept").when(T.same_value(new, old), "unchanged").when(_blank(old), "filled").otherwise("changed")


# ---- designators -----------------------------------------------------------------------------------

@dataclass
class Sides:
    """Both tables and their designators, computed once, and what the merge asks of them.

    old_tokens, new_tokens: (row_no, pos, token); known: (token, of, old_row, old_pos, new_row, new_pos) by first
    occurrence; carry: (of, token, old_row, old_pos, entry), the old instances that a bare new row carries;
    matches: (entry, old_row, tokens), old rows that a new row meets, with the designators by which; consumers:
    (old_row, entry, carried_row, carried_pos), the first entry that takes each old row; repeats: (old_row, repeats),
    notes of later old rows that list a designator of this one again.
    """

    old: DataFrame
    new: DataFrame
    key: str

    def __post_init__(self) -> None:
        cell = lambda df: E.tokens(df, self.key).select("row_no", "pos", "token")
        self.old_tokens, self.new_tokens = once(cell(self.old)), once(cell(self.new))
        first = lambda df, name: df.groupBy("token").agg(F.min(E.place()).alias(name))
        known = first(self.old_tokens, "o").join(first(self.new_tokens, "n"), "token", "full_outer")
        self.known = once(known.select("token", T.usage_base(F.col("token")).alias("of"), F.col("o.row_no").alias("old_row"), F.col("o.pos").alias("old_pos"), F.col("n.row_no").alias("new_row"), F.col("n.pos").alias("new_pos")))
        alone = self.new_tokens.groupBy("row_no").agg(F.count("*").alias("n"), F.min("token").alias("of")).filter(F.col("n") == 1).filter(T.usage_base(F.col("of")) == F.col("of"))
        bare = alone.groupBy("of").agg(F.min("row_no").alias("entry"))
        lost = self.known.filter("old_row IS NOT NULL AND new_row IS NULL").filter("token <> of").filter(T.suffix_notation(F.col("token")))
        self.carry = once(lost.join(bare, "of").select("of", "token", "old_row", "old_pos", "entry"))
        self.matches, self.repeats = once(self._matches()), once(self._repeats())
        self.consumers = once(self._consumers())

    def _matches(self) -> DataFrame:
        both = self.known.filter("old_row IS NOT NULL AND new_row IS NOT NULL")
        return both.groupBy(F.col("new_row").alias("entry"), "old_row").agg(F.array_sort(F.collect_list("token")).alias("tokens"))

    def _consumers(self) -> DataFrame:
        taken = self.matches.select("old_row", F.struct("entry", F.lit(0).cast("long").alias("carried_row"), F.lit(0).alias("carried_pos")).alias("e"))
        taken = taken.unionByName(self.carry.select("old_row", F.struct("entry", F.col("old_row").alias("carried_row"), (F.col("old_pos") + 1).alias("carried_pos")).alias("e")))
        return taken.groupBy("old_row").agg(F.min("e").alias("e")).select("old_row", "e.*")

    def _repeats(self) -> DataFrame:
        again = self.old_tokens.join(self.known.select("token", "old_row", "old_pos"), "token").filter((F.col("row_no") != F.col("old_row")) | (F.col("pos") != F.col("old_pos")))
        note = F.concat(F.lit("Duplicate RefDes "), "token", F.lit(f" in {OLD} — old row "), "row_no", F.lit(" was not merged (first occurrence used)"))
        return again.groupBy("old_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "pos", note.alias("note")))), lambda x: x["note"]).alias("repeats"))


def carried(old: DataFrame, new: DataFrame, key: str = "ref_des") -> DataFrame:
    """(new_row, base, token, old_row): old instances that a bare new row stands for."""
    return Sides(old, new, key).carry.select(F.col("entry").alias("new_row"), F.col("of").alias("base"), "token", "old_row")


def deletions(sides: Sides, description: str | None) -> DataFrame:
    """(token, of, old_row, old_pos): first occurrences of old designators that are nowhere new and not carried, fitted ones only."""
    gone = sides.known.filter("new_row IS NULL").join(sides.carry.select("token"), "token", "left_anti")
    if description is None:
        return gone.select("token", "of", "old_row", "old_pos")
    fitted = sides.old.filter(~T.not_fitted(F.col(sides.key), F.col(description))).select(F.col("row_no").alias("old_row"))
    return gone.join(fitted, "old_row").select("token", "of", "old_row", "old_pos")


def anchors(old: DataFrame, new: DataFrame, key: str = "ref_des", description: str | None = "description") -> DataFrame:
    """(token, old_row, entry, carried_row, carried_pos): deletions with the entry after which they stand, -1 for the start."""
    sides = Sides(old, new, key)
    return deletions(sides, description).join(_anchored(sides), "old_row").select("token", "old_row", *ORDER[:3])


def _anchored(sides: Sides) -> DataFrame:
    """(old_row, entry, carried_row, carried_pos): for each old row the entry that took the last old row up to it."""
    rows = sides.old.select(F.col("row_no").alias("old_row")).join(sides.consumers, "old_row", "left")
    rows = rows.select("old_row", F.when(F.col("entry").isNotNull(), F.struct(*ORDER[:3])).alias("e"))
    found = R.carried(rows, [], "old_row", "e", "at", inclusive=True, size=10_000)
    return found.select("old_row", F.coalesce("at.entry", F.lit(-1)).alias("entry"), F.coalesce("at.carried_row", F.lit(0)).alias("carried_row"), F.coalesce("at.carried_pos", F.lit(0)).alias("carried_pos"))


# ---- rows ----------------------------------------------------------------------------------------------

def _cell(c: Column) -> Column:
    """A cell as it is, trimmed, and as it is compared; so that no rule below cleans it again."""
    raw = F.coalesce(c.cast("string"), F.lit(""))
    return F.struct(raw.alias("raw"), T.clean(raw).alias("text"), T.plain_decimal(raw).alias("same"))


def _empty(cell: Column) -> Column:
    return cell["text"] == ""


def _differs(a: Column, b: Column) -> Column:
    return a["same"] != b["same"]


def _quoted(cell: Column) -> Column:
    return F.concat(F.lit('"'), cell["text"], F.lit('"'))


def _cell_of(o: str):
    return lambda r: r["was"][o]


def _note_of(place: int, name: str, mine: Column | None, had, first: Column, kept: Column):
    """What to note of a column of a matched old row, the i-th: a change, an old value kept, or one that differs from it."""
    def note(r: Column, i: Column) -> Column:
        differs = F.when(_differs(kept, had(r)), F.concat(F.lit(f"{name}: differing old values — kept "), _quoted(kept)))
        if mine is None:
            of = F.when(_empty(had(r)) | (i == first), None).otherwise(differs)
        else:
            keeps = F.concat(F.lit(f"{name}: kept old value "), _quoted(had(r)), F.lit(" (new was blank)"))
            changes = F.when(_differs(had(r), mine), F.concat(F.lit(f"{name} changed from "), _quoted(had(r)), F.lit(" to "), _quoted(mine)))
            of = F.when(_empty(had(r)), None).when(~_empty(mine), changes).when(i == first, keeps).otherwise(differs)
        lead = F.when(F.size("olds") > 1, F.concat(F.lit("["), F.array_join(r["tokens"], ", "), F.lit("] "))).otherwise("")
        flag = F.lit(True) if mine is None else _empty(mine)
        return F.struct(i.alias("i"), F.lit(place).alias("c"), flag.alias("flag"), F.concat(lead, of).alias("note"))

    return note


def _first_filled(columns: list[tuple[str, str | None, str | None]]) -> list[Column]:
    """Of each column with an old one: the place and cell of the first matched old row (``olds``) that has it filled."""
    out = []
    for place, (_, o, _) in enumerate(columns):
        if o:
            had = _cell_of(o)
            filled = F.filter(F.transform("olds", lambda r, i: F.struct(i.alias("i"), had(r).alias("cell"))), lambda x: ~_empty(x["cell"]))  # noqa: B023
            out.append(F.get(filled, F.lit(0)).alias(f"first{place}"))
    return out


def _merged_cells(columns: list[tuple[str, str | None, str | None]]) -> tuple[dict[str, Column], Column]:
    """Values by column, and notes (flag, note) in order, of new cells n.* against ``olds`` and the first filled of them."""
    values, notes = {}, []
    for place, (name, o, n) in enumerate(columns):
        mine = F.col(f"n.`{n}`") if n else None
        if not o:
            values[name] = F.when(_empty(mine), "").otherwise(mine["raw"])
            continue
        first, kept = F.col(f"first{place}.i"), F.col(f"first{place}.cell")
        old = F.coalesce(kept["raw"], F.lit(""))
        values[name] = old if mine is None else F.when(~_empty(mine), mine["raw"]).otherwise(old)
        notes.append(F.transform("olds", _note_of(place, name, mine, _cell_of(o), first, kept)))
    if not notes:
        return values, F.array().cast("array<struct<i:int,c:int,flag:boolean,note:string>>")
    return values, F.array_sort(F.filter(F.flatten(F.array(*notes)), lambda x: x["note"].isNotNull()))


_none = lambda: F.array().cast("array<string>")
_or_none = lambda c: F.coalesce(F.col(c), _none())


def matched_rows(sides: Sides, columns: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """(entry, status, source, notes, flags, key, v0, v1 ...): each new row with the values and notes of the merge."""
    was = sides.old.select(F.col("row_no").alias("old_row"), F.struct(*(_cell(F.col(f"`{o}`")).alias(o) for _, o, _ in columns if o)).alias("was"))
    olds = sides.matches.join(was, "old_row").groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("old_row", "tokens", "was"))).alias("olds"))
    again = sides.new_tokens.join(sides.known.select("token", "new_row", "new_pos"), "token").filter((F.col("row_no") != F.col("new_row")) | (F.col("pos") != F.col("new_pos")))
    note = F.concat(F.lit("Duplicate RefDes "), "token", F.lit(" — first occurrence (row "), "new_row", F.lit(") was used for matching"))
    again = again.groupBy(F.col("row_no").alias("entry")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", note.alias("note")))), lambda x: x["note"]).alias("again"))
    owned = sides.repeats.join(sides.consumers.filter("carried_row = 0"), "old_row")
    owned = owned.groupBy("entry").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("old_row", "repeats"))), lambda x: x["repeats"])).alias("repeats"))
    heads = sides.carry.groupBy("entry").agg(F.count("*").alias("n_carried"), F.min_by("token", F.struct("old_row", "old_pos")).alias("first"), F.max_by("token", F.struct("old_row", "old_pos")).alias("last"))
    bases = sides.carry.groupBy(F.col("of").alias("token")).agg(F.min("entry").alias("carrier"))
    found = F.col("old_row").isNotNull() | F.coalesce(F.col("carrier") < F.col("row_no"), F.lit(False))
    listed = sides.new_tokens.join(sides.known.select("token", "old_row"), "token").join(bases, "token", "left").groupBy(F.col("row_no").alias("entry")).agg(
        F.count("*").alias("n_tokens"), F.bool_or(found).alias("found"), F.array_sort(F.collect_list(F.when(~found, F.struct("pos", "token")))).alias("added"))
    rows = sides.new.select(F.col("row_no").alias("entry"), F.coalesce(F.col(f"`{sides.key}`"), F.lit("")).alias("key"), F.struct(F.lit(0), *(_cell(F.col(f"`{n}`")).alias(n) for _, _, n in columns if n)).alias("n"))
    for part in (olds, again, owned, heads, listed):
        rows = rows.join(part, "entry", "left")
    rows = rows.withColumn("olds", F.coalesce("olds", F.array().cast(olds.schema["olds"].dataType)))
    rows = rows.select("*", *_first_filled(columns))
    values, merged = _merged_cells(columns)
    rows = rows.withColumn("merged", merged).withColumn("middle", F.concat(_or_none("again"), _or_none("repeats"), F.transform("merged", lambda x: x["note"])))
    new_here = F.transform(F.coalesce("added", F.array().cast("array<struct<pos:int,token:string>>")), lambda x: F.concat(x["token"], F.lit(f" is not in {OLD} — new on this row")))
    all_new = F.coalesce(F.size("added") == F.col("n_tokens"), F.lit(False))
    span = F.when(F.col("n_carried") == 1, F.col("first")).otherwise(F.concat("first", F.lit(" … "), "last"))
    superseded = F.col("n_carried").isNotNull()
    head = F.when(superseded, F.array(F.concat(F.lit("Superseded by "), "n_carried", F.lit(" carried rows ("), span, F.lit(") — delete this row")))).when(all_new, F.array(F.lit(f"Not in {OLD} — new part; add to the FMEAs"))).otherwise(_none())
    notes = F.concat(head, F.col("middle"), F.when(superseded | all_new, _none()).otherwise(new_here))
    status = F.when(superseded, "Superseded").when(all_new, "Added").when(F.size("notes") > 0, "Changed").otherwise("")
    source = F.when(superseded, f"{NEW} (superseded)").when(all_new, f"{NEW} only").when(F.coalesce("found", F.lit(False)), "Both").otherwise(f"{NEW} only")
    flags = F.size(F.filter("merged", lambda x: x["flag"])) + F.size(_or_none("again")) + F.size(_or_none("repeats"))
    return rows.withColumn("notes", notes).select("entry", status.alias("status"), source.alias("source"), "notes", flags.alias("flags"), "key", *(values[name].alias(f"v{k}") for k, (name, *_) in enumerate(columns)))


def carried_rows(sides: Sides, columns: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """Carried old rows: what all of a group agree on follows the bare row, what they differ in stays.

    A column with a new value other than theirs is overwritten and flagged once, on the group's first row.
    """
    old = sides.old.select(F.col("row_no").alias("old_row"), *(_cell(F.col(f"`{o}`")).alias(f"o{k}") for k, (_, o, _) in enumerate(columns) if o))
    bare = sides.new.select(F.col("row_no").alias("entry"), *(_cell(F.col(f"`{n}`")).alias(f"n{k}") for k, (_, _, n) in enumerate(columns) if n))
    rows = once(sides.carry.join(old, "old_row"))
    shared = [k for k, (_, o, n) in enumerate(columns) if o and n]
    at = F.struct("old_row", "old_pos")
    filled = lambda k, c: F.when(~_empty(F.col(f"o{k}")), c)
    group = rows.groupBy("entry").agg(F.min(at).alias("lead"), *(x for k in shared for x in (F.min(filled(k, F.col(f"o{k}.same"))).alias(f"lo{k}"), F.max(filled(k, F.col(f"o{k}.same"))).alias(f"hi{k}"), F.min_by(f"o{k}", filled(k, at)).alias(f"c{k}"))))
    rows = rows.join(group.join(bare, "entry"), "entry")
    values, notes, over = {}, [F.concat(F.lit(f"Carried forward from {OLD} (manual suffix row of "), "of", F.lit(")"))], F.lit(0)
    blank = lambda cell: F.when(_empty(cell), "").otherwise(cell["raw"])
    for k, (name, o, n) in enumerate(columns):
        own, mine, agreed = F.col(f"o{k}"), F.col(f"n{k}"), F.col(f"c{k}")
        if o and n:
            agree = F.col(f"lo{k}") == F.col(f"hi{k}")
            replaced = F.coalesce(agree & ~_empty(mine) & _differs(agreed, mine), F.lit(False))
            spare = F.when(F.col(f"lo{k}").isNull(), blank(mine)).when(agree, agreed["raw"]).otherwise("")
            values[name] = F.when(replaced, mine["raw"]).when(_empty(own), spare).otherwise(own["raw"])
            notes.append(F.when(replaced, F.concat(F.lit(f"{name} updated from "), _quoted(agreed), F.lit(" to "), _quoted(mine), F.lit(f" by {NEW}"))))
            over = over + replaced.cast("int")
        else:
            values[name] = blank(own if o else mine)
    owned = sides.repeats.join(sides.consumers.filter("carried_row > 0"), "old_row").select("carried_row", "carried_pos", "entry", "repeats")
    rows = rows.withColumn("carried_row", F.col("old_row")).withColumn("carried_pos", F.col("old_pos") + 1).join(owned, ["entry", "carried_row", "carried_pos"], "left")
    flags = F.size(_or_none("repeats")) + F.when(F.col("lead") == at, over).otherwise(0)
    return rows.select("entry", "carried_row", "carried_pos", F.lit("Carried").alias("status"), F.lit(f"{OLD} (carried)").alias("source"), F.concat(F.array_compact(F.array(*notes)), _or_none("repeats")).alias("notes"), flags.alias("flags"), F.col("token").alias("key"), *(values[name].alias(f"v{k}") for k, (name, *_) in enumerate(columns)))


def deleted_rows(sides: Sides, columns: list[tuple[str, str | None, str | None]], description: str | None) -> DataFrame:
    """Deleted designators with the values of their old row, after the entry that took the last old row before it."""
    gone = deletions(sides, description)
    counts = sides.old_tokens.groupBy(F.col("row_no").alias("old_row")).agg(F.count("*").alias("n"))
    listed = sides.known.filter("new_row IS NOT NULL")
    expanded = listed.filter("token <> of").select("of").distinct().withColumn("expanded", F.lit(True))
    based = listed.select(F.col("token").alias("of")).withColumn("based", F.lit(True))
    free = sides.repeats.join(sides.consumers.select("old_row"), "old_row", "left_anti").join(gone.groupBy("old_row").agg(F.min("old_pos").alias("old_pos")), "old_row")
    old = sides.old.select(F.col("row_no").alias("old_row"), F.col(f"`{sides.key}`").alias("cell"), *(F.col(f"`{o}`").alias(f"o{k}") for k, (_, o, _) in enumerate(columns) if o))
    rows = gone.join(old, "old_row").join(counts, "old_row").join(_anchored(sides), "old_row").join(expanded, "of", "left").join(based, "of", "left").join(free, ["old_row", "old_pos"], "left")
    note = (
        F.when((F.col("token") != F.col("of")) & F.col("based"), F.concat("token", F.lit(f" is not in {NEW}, but its base "), "of", F.lit(" is — manual expansion was not auto-carried; review before deleting")))
        .when((F.col("token") == F.col("of")) & F.col("expanded"), F.concat("token", F.lit(f" is not in {NEW} as a bare row, but its expansion rows are — likely replaced by suffix rows; review before deleting")))
        .otherwise(f"Not in {NEW} — remove from the FMEAs")
    )
    from_list = F.when(F.col("n") > 1, F.concat(F.lit('From an old row listing "'), T.clean(F.col("cell")), F.lit('"')))
    cells = [F.when(_blank(F.col(f"o{k}")), "").otherwise(F.col(f"o{k}")).alias(f"v{k}") if o else F.lit("").alias(f"v{k}") for k, (_, o, _) in enumerate(columns)]
    return rows.select("entry", "carried_row", "carried_pos", F.col("old_row").alias("gone_row"), (F.col("old_pos") + 1).alias("gone_pos"), F.lit("Delete").alias("status"), F.lit(f"{OLD} only").alias("source"),
        F.concat(F.array_compact(F.array(note, from_list)), _or_none("repeats")).alias("notes"), F.size(_or_none("repeats")).alias("flags"), F.col("token").alias("key"), *cells)


def planned(old: DataFrame, new: DataFrame, key: str, pairs: list[tuple[str, str]] = ()) -> tuple[Plan, list[tuple[str, str | None, str | None]]]:
    """The plan of both tables' columns, and each data column with the old and the new one that fill it; row_no and key apart."""
    plan = plan_columns([c for c in old.columns if c != "row_no"], [c for c in new.columns if c != "row_no"], pairs)
    # what old columns fill comes first, in the order in which they claimed it, which is that of notes
    filled = [(target, name, target if target in new.columns else None) for name, target in plan.filled.items() if target != key]
    return plan, filled + [(c, None, c) for c in new.columns if c not in ("row_no", key) and c not in plan.filled.values()]


def unified(old: DataFrame, new: DataFrame, key: str = "ref_des", pairs: list[tuple[str, str]] = (), description: str | None = "description") -> DataFrame:
    """The merged table: ORDER, the key, the planned columns, flags, and status, source and notes under their planned names.

    old, new: row_no, the key and any text columns.  ``description`` names the old column that may say that a part is
    not fitted; such rows are not reported as deleted.
    """
    plan, columns = planned(old, new, key, pairs)
    sides = Sides(old, new, key)
    none = {c: F.lit(0).cast("long" if c.endswith("row") else "int") for c in ORDER[1:]}
    rows = matched_rows(sides, columns).withColumns(none)
    rows = rows.unionByName(carried_rows(sides, columns).withColumns({c: none[c] for c in ORDER[3:]})).unionByName(deleted_rows(sides, columns, description))
    at = {name: F.col(f"v{k}").alias(name) for k, (name, *_) in enumerate(columns)}
    out = {"status": F.col("status"), "source": F.col("source"), "notes": F.array_join("notes", "; ")}
    return rows.select(*ORDER, F.col("key").alias(key), *(at[c] for c in plan.columns if c in at), "flags", *(c.alias(plan.tool[what]) for what, c in out.items()))


def consensus(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, state, value): within a group all blank, one value, or disagreement."""
    long = rows.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), T.plain_decimal(F.col(c)).alias("v"), F.col(c).alias("raw")) for c in columns))).alias("c")).select(key, "c.*")
    filled = F.when(F.col("v") != "", F.col("v"))
    out = long.groupBy(key, "column").agg(F.min(filled).alias("lo"), F.max(filled).alias("hi"))
    state = F.when(F.col("lo").isNull(), "blank").when(F.col("lo") == F.col("hi"), "consensus").otherwise("disagreement")
    return out.select(key, "column", state.alias("state"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("value"))
