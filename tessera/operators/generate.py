"""Failure-mode rows: grouped designators enriched from BOM and part list, fanned out to failure modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import tokens as T
from tessera.operators import explode as E
from tessera.sources.readers import once


def bom_index(bom: DataFrame) -> DataFrame:
    """(token, part_number, c1, c2, usage) of each BOM token's first row."""
    rows = E.tokens(bom, "ref_des", "part_number", "hda_level1", "hda_level2", "part_usage")
    first = F.min_by(F.struct("part_number", F.col("hda_level1").alias("c1"), F.col("hda_level2").alias("c2"), F.col("part_usage").alias("usage")), E.place())
    return rows.groupBy("token").agg(first.alias("f")).select("token", "f.*")


def with_bom(source: DataFrame, bom: DataFrame) -> DataFrame:
    """source (row_no, pos, label, token) with its BOM row; failing that the row of its base (inherited).  ``found`` says which, or null.

    The BOM grows with the tables and packs tightly, so its estimated size says little: the joins merge, and none is broadcast.
    """
    index = bom_index(bom)
    named = lambda p: index.select(F.col("token").alias(f"{p}_token"), F.struct("part_number", "c1", "c2", "usage").alias(p)).hint("merge")
    rows = source.withColumn("base", T.usage_base(F.col("token")))
    rows = rows.join(named("own"), F.col("token") == F.col("own_token"), "left")
    rows = rows.join(named("of"), (F.col("base") == F.col("of_token")) & F.col("own_token").isNull() & (F.col("base") != F.col("token")), "left")
    found = F.when(F.col("own").isNotNull(), "exact").when(F.col("of").isNotNull(), "inherited")
    return rows.select("row_no", "pos", "label", "token", "base", found.alias("found"), F.coalesce("own", "of").alias("b")).select("row_no", "pos", "label", "token", "base", "found", "b.*")


def with_types(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with the part list's commodities in place of the BOM's where they are not blank; first part number wins."""
    first = F.min_by(F.struct("commodity1", "commodity2"), "row_no")
    index = parts.groupBy(T.part_number(F.col("part_number")).alias("pn")).agg(first.alias("p"))
    rows = rows.withColumn("pn", T.part_number(F.col("part_number"))).join(index, "pn", "left")
    pick = lambda c, d: F.coalesce(F.nullif(T.clean(F.col(f"p.{c}")), F.lit("")), T.clean(F.col(d)))
    return rows.withColumn("type1", pick("commodity1", "c1")).withColumn("type2", pick("commodity2", "c2")).drop("p", "pn", "c1", "c2")


def with_usage(rows: DataFrame) -> DataFrame:
    """rows with the usage that holds: what the BOM says, or for inherited ones 1 / instances of the base in the source."""
    told = N.parse_usage(F.col("usage"))["value"]
    counts = rows.groupBy("base").agg(F.count_distinct("token").alias("instances"))
    rows = rows.join(counts.hint("merge"), "base")
    value = F.when((F.col("found") == "inherited"), 1 / F.col("instances")).otherwise(told)
    code = F.when(F.col("found") == "inherited", "inherited").when(told.isNull(), "unparseable").when(T.clean(F.col("usage")) == "", "blank").otherwise("explicit")
    return rows.withColumn("part_usage", value).withColumn("usage_code", code).drop("usage")


def usage_checks(rows: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(token, usage, expected) where an explicit usage is not 1 / occurrences of its base; occurrences: base, n."""
    rows = rows.filter("usage_code = 'explicit'").join(occurrences.hint("merge"), "base").withColumn("expected", 1 / F.col("n"))
    return rows.filter(F.abs(F.col("part_usage") - F.col("expected")) > N.USAGE_TOLERANCE).select("token", F.col("part_usage").alias("usage"), "expected")


def fan_out(rows: DataFrame, modes: DataFrame) -> DataFrame:
    """rows with every failure mode of their types, in order, and one placeholder where there is none.

    Types compare in any case.  A row with a first type only takes the modes of that type if no mode has
    an empty second type.  Adds failure_mode, ratio, ratio_total (of the row's modes), suffix (A, B, ...)
    and no_match (why there is none).

    The modes of a type, a few, are gathered into one list, so rows are joined once and spread in place.
    """
    modes = modes.select(F.lower("commodity1").alias("m1"), F.lower("commodity2").alias("m2"), F.struct("failure_mode", F.col("ratio").cast("double").alias("ratio")).alias("mode"), "fm_row")
    listed = lambda *order: F.transform(F.array_sort(F.collect_list(F.struct(*order, "mode.failure_mode", "mode"))), lambda m: m["mode"])
    pairs = modes.groupBy("m1", "m2").agg(listed("fm_row").alias("of_pair"))
    firsts = modes.groupBy("m1").agg(listed("m2", "fm_row").alias("of_first"))
    keep = rows.columns
    rows = rows.withColumn("m1", F.lower("type1")).withColumn("m2", F.lower("type2"))
    rows = rows.join(pairs, ["m1", "m2"], "left").join(firsts, "m1", "left")
    only = F.col("of_first").isNotNull() & (F.col("m1") != "") & (F.col("m2") == "")
    reason = F.when((F.col("m1") == "") & (F.col("m2") == ""), "no types").when(F.col("of_first").isNull(), "type 1 unknown").otherwise("pair unknown")
    none = F.array(F.struct(F.lit("No failure mode match found").alias("failure_mode"), F.lit(None).cast("double").alias("ratio")))
    rows = rows.select(
        *keep, F.coalesce("of_pair", F.when(only, F.col("of_first")), none).alias("picked"),
        F.when(F.col("of_pair").isNull() & ~only, reason).alias("no_match"),
    )
    total = F.aggregate(F.transform("picked", lambda m: F.coalesce(m["ratio"], F.lit(0.0))), F.lit(0.0), lambda x, y: x + y)
    rows = rows.select(*keep, "no_match", total.alias("ratio_total"), F.posexplode("picked").alias("n", "m"))
    return rows.select(*keep, "m.failure_mode", "m.ratio", "ratio_total", T.suffix_letters(F.col("n")).alias("suffix"), "no_match")


def components(source: DataFrame, bom: DataFrame, parts: DataFrame, modes: DataFrame) -> DataFrame:
    """The piece-part rows of a source; designators without a BOM row are left out (see ``with_bom``)."""
    rows = with_bom(source, bom).filter("found IS NOT NULL")
    rows = fan_out(with_usage(with_types(rows, parts)), modes)
    issue = F.abs(F.col("ratio_total") - 1) > N.RATIO_TOLERANCE
    kind = F.when(F.col("no_match").isNotNull(), "no_match").when(issue, "validation_warning").otherwise("piece_part")
    return rows.withColumn("fmea_id", T.fmea_id(F.col("label"), F.col("token"), F.col("suffix"))).withColumn("kind", kind).drop("ratio_total")


def piece_parts(source: DataFrame, bom: DataFrame, parts: DataFrame, modes: DataFrame) -> DataFrame:
    """Block headers and their piece parts; order by (row_no, header first, pos, suffix)."""
    rows = components(source, bom, parts, modes).select("row_no", "pos", "label", "token", "fmea_id", "failure_mode", "ratio", "kind")
    heads = source.groupBy("row_no", "label").agg(F.lit(-1).alias("pos")).select("row_no", "pos", "label", F.lit("").alias("token"), F.col("label").alias("fmea_id"), F.lit("").alias("failure_mode"), F.lit(None).cast("double").alias("ratio"), F.lit("header").alias("kind"))
    return heads.unionByName(rows)


# What the union of old and new groups says of groups and designators that one side lacks.
OLD_ONLY, NEW_ONLY = "Component missing from Grouping File but was present in Merged FMEA", "Component present in Grouping File but missing from Merged FMEA"
GROUP_OLD_ONLY, GROUP_NEW = "Function group present in Merged FMEA but absent from Grouping File", "New function group added since last FMEA"


def _side(old: str, new: str, in_old: str, in_new: str) -> Column:
    return F.when(F.col(in_new).isNull(), old).when(F.col(in_old).isNull(), new)


def union_groups(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outer union of two group tables (label, token, description, page), on two levels.

    Groups (label, side, description, page, diagnostic): side is old, new or both; the new description and page hold
    where they are not blank.  Members (label, token, side, diagnostic): the designators of a group on either side.
    The diagnostic is null where both sides have it.
    """
    text = lambda c: F.min(F.when(T.clean(F.col(c)) != "", F.col(c)))
    of = lambda df, name: df.groupBy("label").agg(text("description").alias(f"{name}_description"), text("page").alias(f"{name}_page"), F.lit(True).alias(name))
    side = lambda: F.coalesce(_side("old", "new", "old", "new"), F.lit("both")).alias("side")
    groups = of(old, "old").join(of(new, "new"), "label", "full_outer")
    pick = lambda c: F.coalesce(f"new_{c}", f"old_{c}", F.lit("")).alias(c)
    groups = groups.select("label", side(), pick("description"), pick("page"), _side(GROUP_OLD_ONLY, GROUP_NEW, "old", "new").alias("diagnostic"))
    tokens = lambda df, name: df.filter("token <> ''").select("label", "token").distinct().withColumn(name, F.lit(True))
    members = tokens(old, "old").join(tokens(new, "new"), ["label", "token"], "full_outer")
    return groups, members.select("label", "token", side(), _side(OLD_ONLY, NEW_ONLY, "old", "new").alias("diagnostic"))


def union_diagnostics(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(label, token, source, diagnostic): one row for each group and designator that one side lacks."""
    of_groups = groups.filter("diagnostic IS NOT NULL").select("label", F.lit("").alias("token"), F.lit("group").alias("source"), "diagnostic")
    return of_groups.unionByName(members.filter("diagnostic IS NOT NULL").select("label", "token", F.lit("component").alias("source"), "diagnostic"))


def fill_gaps(old: DataFrame, new: DataFrame, bom: DataFrame, parts: DataFrame, modes: DataFrame) -> DataFrame:
    """(label, token, fmea_id, failure_mode, ratio, kind, description, page, diagnostic): the union's headers and piece parts.

    A designator without a BOM row keeps its place with one row that says so.  Diagnostics are joined by "; ".
    Order by (label, header first, token, fmea_id).
    """
    groups, members = map(once, union_groups(old, new))
    source = members.select(F.lit(0).alias("row_no"), F.lit(0).alias("pos"), "label", "token")
    rows = components(source, bom, parts, modes).select("label", "token", "fmea_id", "failure_mode", F.col("ratio").cast("double").alias("ratio"), "kind", F.lit(None).cast("string").alias("own"))
    lost = with_bom(source, bom).filter("found IS NULL")
    missing = F.concat(F.lit("Component "), "token", F.lit(" present in merge set but missing from BOM."))
    none = F.lit(None).cast("double")
    lost = lost.select("label", "token", F.lit("").alias("fmea_id"), F.lit("").alias("failure_mode"), none.alias("ratio"), F.lit("no_match").alias("kind"), missing.alias("own"))
    joined = lambda *c: F.concat_ws("; ", *c).alias("diagnostic")
    rows = rows.unionByName(lost).join(members.select("label", "token", "diagnostic"), ["label", "token"]).join(groups.select("label", "description", "page"), "label")
    rows = rows.select("label", "token", "fmea_id", "failure_mode", "ratio", "kind", "description", "page", joined("own", "diagnostic"))
    heads = groups.select("label", F.lit("").alias("token"), F.col("label").alias("fmea_id"), F.lit("").alias("failure_mode"), none.alias("ratio"), F.lit("header").alias("kind"), "description", "page", joined("diagnostic"))
    return heads.unionByName(rows)


def functional(passed: DataFrame, generated: DataFrame) -> DataFrame:
    """Rows passed through, then generated ones whose designator they do not hold; columns may differ."""
    held = passed.select("token").distinct()
    return passed.unionByName(generated.join(held, "token", "left_anti"), allowMissingColumns=True)


def guard_output(rows: DataFrame, modes: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(rows, too_many): how many rows the fan-out would make, by aggregates before any join of the rows themselves."""
    per = modes.groupBy(F.lower("commodity1").alias("m1"), F.lower("commodity2").alias("m2")).agg(F.count("*").alias("n"))
    have = rows.groupBy(F.lower("type1").alias("m1"), F.lower("type2").alias("m2")).agg(F.count("*").alias("r"))
    return have.join(per, ["m1", "m2"], "left").agg(F.sum(F.col("r") * F.coalesce("n", F.lit(1))).alias("rows")).withColumn("too_many", F.col("rows") > most)
