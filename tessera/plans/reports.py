"""Queries of header resolution, inspection and the report tables.

Header rules run over column names, so each query gives a view the headers of a foreign sheet and shows
what the resolved columns hold.  A report query writes the sheets of a report, reads them back, and
stacks two columns of each; its SQL stacks the same columns of the sheets' own SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import registry
from tessera.plans.registry import add
from tessera.sources import headers as H
from tessera.sources import readers as R

# ---- headers ----
_messy = {"row_no": "﻿Row  No", "ref_des": "Ref\n Des", "part_number": "Part No", "description": "Part​ No"}
add("prj_normalize_headers", lambda v: H.normalize_columns(v.v_bom.select(*(F.col(a).alias(b) for a, b in _messy.items()))),
    'SELECT row_no AS "Row No", ref_des AS "Ref Des", part_number AS "Part No", description AS "Part No.1" FROM v_bom', ("v_bom",))
add("fn_normalize_header", lambda v: v.v_label.select("k", H.plain_header(F.col("label")).alias("header")), "SELECT k, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS header FROM v_label", ("v_label",))


def _shown(df: DataFrame, **found: str | None) -> DataFrame:
    """row_no and the found columns; an unfound one is null."""
    return df.select("row_no", *((F.col(f"`{c}`") if c else F.lit(None)).cast("string").alias(name) for name, c in found.items()))


def _detected(v) -> DataFrame:
    df = v.v_bom.withColumnsRenamed({"ref_des": "REF DES", "part_number": "Part-No.", "description": "Item description (long)", "page": "Spn"})
    at = lambda name, **how: H.detect_column(df.columns, H.SYNONYMS[name], **how)
    return _shown(df, exact=at("ref_des"), plain=at("part_number"), contained=at("description", substring=True), not_contained=at("description"), bounded=H.detect_column(df.columns, ["pn"], True))


add("prj_detect_column", _detected, "SELECT row_no, ref_des AS exact, part_number AS plain, description AS contained, NULL::VARCHAR AS not_contained, NULL::VARCHAR AS bounded FROM v_bom", ("v_bom",))


def _resolved(v) -> DataFrame:
    df = v.v_bom.withColumnsRenamed({"ref_des": "All designators", "part_number": "Vendor PN", "description": "openness", "page": " Page "})
    at = lambda name: H.resolve_column(df.columns, H.SYNONYMS[name])
    return _shown(df, ref_des=at("ref_des"), part_number=at("part_number"), page=at("page"), ratio=at("ratio"))


add("prj_resolve_column", _resolved, "SELECT row_no, ref_des, part_number, page, NULL::VARCHAR AS ratio FROM v_bom", ("v_bom",))


def _overridden(v) -> DataFrame:
    rows = [
        {"file": "bom", "target": "ref_des", "column": "Part Number"}, {"file": "bom", "target": "description", "column": H.DO_NOT_MAP},
        {"file": "bom", "target": "page", "column": "no such column"}, {"file": "other", "target": "part_number", "column": "page"}, {"file": "bom", "target": "", "column": "k"},
    ]
    return H.map_columns(v.v_bom.withColumnRenamed("part_number", "Part Number"), ["ref_des", "part_number", "description", "page"], overrides=H.overrides_of(rows)["bom"])


add("prj_overrides", _overridden, "SELECT part_number AS ref_des, part_number, page FROM v_bom", ("v_bom",))
_fmea = lambda v: v.v_fmea.withColumnsRenamed({"fmea_id": "FMEA ID No", "level": "Circuit Block / Part", "cause": "Failure Mode Causes", "func": "Function description"})
for _name, _kind, _column in (("prj_fmea_refdes_col", "fmea_refdes", "cause"), ("prj_fmea_id_col", "fmea_id", "fmea_id"), ("prj_block_col", "circuit_block", "level")):
    add(_name, lambda v, kind=_kind: _shown(_fmea(v), found=H.containing(_fmea(v).columns, H.CONTAINED[kind])), f"SELECT row_no, {_column} AS found FROM v_fmea", ("v_fmea",))
add("prj_desc_col",
    lambda v: _shown(v.v_bom, given=H.description_column(v.v_bom.columns, "part_number", False), none=H.description_column(v.v_bom.columns, None, False), detected=H.description_column(v.v_bom.columns, "no such column", True)),
    "SELECT row_no, part_number AS given, NULL::VARCHAR AS none, description AS detected FROM v_bom", ("v_bom",))

# ---- inspection and caps ----
_wide = lambda v: v.v_words.select("word", *(F.lit(k).alias(f"c{k}") for k in range(1, 120)))
_capped = f"least(count(*), {R.MOST_ROWS})"
add("src_inspect", lambda v: R.inspect_table(v.v_words), f"""SELECT unnest(['word', 'page', 'x', 'y', 'txt', 'shape', 'role']) AS "column", unnest(range(0, 7)) AS "position", n AS "rows" FROM (SELECT {_capped} AS n FROM v_words) q""", ("v_words",))
add("lim_caps", lambda v: R.inspect_table(_wide(v)).groupBy("rows").agg(F.count("*").alias("columns"), F.max("column").alias("last_name")),
    f"""SELECT {_capped} AS "rows", {R.MOST_COLUMNS} AS "columns", 'word' AS last_name FROM v_words""", ("v_words",))

# ---- reports ----
#: Report -> sheet -> (query of the sheet, the two columns shown).
REPORTS = {
    "snk_custom_report": {
        "Summary": ("agg_summary", "metric", "value"), "Only In": ("join_full_outer_keys", "token", "status"), "Differences": ("join_column_delta", "token", "column"),
        "Duplicates": ("win_occurrence", "token", "row_no"), "Part Usage": ("agg_usage_dispatch", "reason_code", "n"), "FMR": ("agg_fmr_dispatch", "refdes", "status"),
        "Scope": ("join_scope", "token", "in_other"), "Unified": ("merge_unified", "ref_des", "Status"),
    },
    "snk_fmea_report": {"FMEA": ("gen_piece_part", "fmea_id", "failure_mode"), "Diagnostics": ("gen_diag_frames", "diagnostic", "n"), "No Match": ("join_no_match", "token", "no_match")},
    "snk_extract_report": {
        "Extraction": ("agg_membership", "ref", "groups"), "Component Detail": ("gen_component_detail", "ref", "pages"), "Orphan Pins": ("gen_orphan_pins", "disposition", "n"),
        "Coverage": ("gen_coverage_tables", "status", "n"), "Coverage Detail": ("join_coverage", "base", "status"),
    },
    "snk_snapshot_report": {"Moved Groups": ("join_snapshot", "ref", "change"), "Members": ("agg_membership", "ref", "groups")},
}
_stack = lambda df, sheet, a, b: df.select(F.lit(sheet).alias("sheet"), F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b"))


def _report(sheets: dict[str, tuple[str, str, str]]):
    def build(v) -> DataFrame:
        path = R.report_path(v.spark)
        written = R.write_report({sheet: registry.query(name)(v.spark, v.sf_dir) for sheet, (name, _, _) in sheets.items()}, path)
        out = None
        for sheet in written:
            one = _stack(v.spark.read.parquet(f"{path}/{sheet}"), sheet, *sheets[sheet][1:])
            out = one if out is None else out.unionByName(one)
        return out

    return build


def _report_sql(sheets: dict[str, tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"""SELECT '{sheet}' AS sheet, "{a}"::VARCHAR AS a, "{b}"::VARCHAR AS b FROM ({registry.oracle(name)}) q""" for sheet, (name, a, b) in sheets.items())


for _name, _sheets in REPORTS.items():
    registry.add_whole(_name, _report(_sheets), lambda sheets=_sheets: _report_sql(sheets))

# The fill of a unified row by its status.
STYLES = {"Added": "C6EFCE", "Delete": "FFC7CE", "Superseded": "BDD7EE", "Changed": "FFEB9C", "Carried": "FFEB9C"}


def _through_file(name: str, table):
    """A one-sheet report of what ``table`` gives, written and read back."""
    def build(v) -> DataFrame:
        path = R.report_path(v.spark)
        (sheet,) = R.write_report({name: table(v)}, path)
        return v.spark.read.parquet(f"{path}/{sheet}")

    return build


def _styled(df: DataFrame) -> DataFrame:
    style = F.lit("")
    for status, fill in STYLES.items():
        style = F.when(F.col("Status") == status, fill).otherwise(style)
    return df.select("entry", "carried_row", "gone_row", "ref_des", "Status", style.alias("style"))


_fill = "CASE Status " + " ".join(f"WHEN '{s}' THEN '{f}'" for s, f in STYLES.items()) + " ELSE '' END"
registry.add_whole("snk_unified", _through_file("Unified BOM", lambda v: _styled(registry.query("merge_unified")(v.spark, v.sf_dir))),
    lambda: f"SELECT entry, carried_row, gone_row, ref_des, Status, {_fill} AS style FROM ({registry.oracle('merge_unified')}) q")
_marks = "CASE WHEN k % 7 = 0 THEN NULL ELSE p_name || chr(7) END"
add("snk_styled", _through_file("Parts", lambda v: v.v_part.select("k", F.coalesce(F.expr(_marks), F.lit("")).alias("name"), F.lit(1).alias("_hidden"))),
    f"SELECT k, coalesce(replace({_marks}, chr(7), ''), '') AS name FROM v_part", ("v_part",))


def _verified(v) -> DataFrame:
    path = R.report_path(v.spark)
    (sheet,) = R.write_report({"Grouping": v.v_grouping}, path)
    return v.spark.createDataFrame([(R.verify(v.spark, f"{path}/{sheet}"),)], "n long")


add("snk_verify", _verified, "SELECT count(*) AS n FROM v_grouping", ("v_grouping",))


def _snapshot(v) -> DataFrame:
    path = R.report_path(v.spark)
    R.snapshot_config(v.spark, path, {"mode": "group", "ignore_dnp": True})
    return v.spark.read.text(f"{path}/config")


add("snk_snapshot", _snapshot, """SELECT '{"ignore_dnp": true, "mode": "group"}' AS "value" """)


def _names(v) -> DataFrame:
    taken, rows = set(), []
    for k in range(3):
        rows.append((k, R.output_name("BomCompare", "Group", "20260101_000000", taken)))
        taken.add(rows[-1][1])
    return v.spark.createDataFrame(rows, "k long, name string")


add("snk_name", _names, "SELECT k, 'BomCompare_Group_20260101_000000' || CASE WHEN k = 0 THEN '' ELSE ' (' || (k + 1)::VARCHAR || ')' END AS name FROM range(3) t(k)")
