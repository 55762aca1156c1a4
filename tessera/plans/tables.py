"""Queries of scans, previews, sinks and labels of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import tokens as T
from tessera.plans.registry import add
from tessera.sources import headers, readers

add("src_csv", lambda v: readers.as_strings(v.table("part")).select("p_partkey", "p_name", "p_size"), "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size FROM part", ("v_part",))
add("src_preview", lambda v: readers.preview(v.v_bom.orderBy("row_no"), {"Designator": ["missing", "ref_des"], "Part": ["part_number"]}), 'SELECT ref_des AS "Designator", part_number AS "Part" FROM v_bom ORDER BY row_no LIMIT 20', ("v_bom",))
add("src_preview_file", lambda v: readers.preview(v.v_grouping.orderBy("row_no"), {"Group": ["label"]}), 'SELECT label AS "Group" FROM v_grouping ORDER BY row_no LIMIT 20', ("v_grouping",))
add("prj_ensure", lambda v: headers.map_columns(v.v_bom.withColumnsRenamed({"ref_des": "Reference Designator", "part_number": "Part No"}), ["ref_des", "part_number"], ["ref_des"]), "SELECT ref_des, part_number FROM v_bom", ("v_bom",))
add("snk_group_report", lambda v: v.v_grouping.select("row_no", T.printable(F.col("label")).alias("label")), "SELECT row_no, label FROM v_grouping", ("v_grouping",))
# Reason codes and what they mean to a reader.
REASONS = {
    "PU_EXPECTED_MISMATCH": "Part usage differs from one over the number of instances",
    "PU_RANGE_ABOVE_ONE": "Part usage is above one",
    "PU_RANGE_NON_POSITIVE": "Part usage is zero or negative",
    "FMR_SUM_MISMATCH": "Failure mode ratios do not add to one",
}
_code = "CASE k % 5 WHEN 0 THEN 'PU_EXPECTED_MISMATCH' WHEN 1 THEN 'PU_RANGE_ABOVE_ONE' WHEN 2 THEN 'PU_RANGE_NON_POSITIVE' WHEN 3 THEN 'FMR_SUM_MISMATCH' ELSE 'OTHER' END"
_map = lambda: F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
add("fn_labels", lambda v: v.v_part.select("k", F.expr(_code).alias("c")).select("k", F.coalesce(F.try_element_at(_map(), F.col("c")), F.col("c")).alias("label")),
    "SELECT k, CASE " + " ".join(f"WHEN c = '{k}' THEN '{t}'" for k, t in REASONS.items()) + f" ELSE c END AS label FROM (SELECT k, {_code} AS c FROM v_part) q", ("v_part",))
add("fn_hash", lambda v: v.v_part.select("k", F.substring(F.sha2("p_name", 256), 1, 16).alias("digest")), "SELECT k, substr(sha256(p_name), 1, 16) AS digest FROM v_part", ("v_part",))
