"""Queries of failure-mode generation and its joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import tokens as T
from tessera.operators import classify as K
from tessera.operators import generate as G
from tessera.plans import duck_expr as D
from tessera.plans.audits import BA
from tessera.plans.registry import add

VIEWS = ("v_group_item", "v_bom", "v_hda", "v_fm")
_src = "SELECT g + 2 AS row_no, CAST(k % 8 AS INTEGER) AS pos, 'BLK-' || CAST(g AS VARCHAR(40)) AS label, CASE WHEN k % 10 = 6 THEN ref || '-1' ELSE ref END AS token FROM v_group_item"
source = lambda v: v.v_group_item.selectExpr("g + 2 AS row_no", "CAST(k % 8 AS INT) AS pos", "'BLK-' || g AS label", "CASE WHEN k % 10 = 6 THEN ref || '-1' ELSE ref END AS token")
blanked = lambda v: v.v_bom.withColumn("hda_level2", F.when(F.col("k") % 7 == 3, "").otherwise(F.col("hda_level2"))).withColumn("hda_level1", F.when(F.col("k") % 53 == 9, "Nothing").otherwise(F.col("hda_level1")))
_index = f"{BA}, bi AS (SELECT token, min_by(part_number, row_no * 1000 + pos) AS part_number, min_by(CASE WHEN k % 53 = 9 THEN 'Nothing' ELSE hda_level1 END, row_no * 1000 + pos) AS c1, min_by(CASE WHEN k % 7 = 3 THEN '' ELSE hda_level2 END, row_no * 1000 + pos) AS c2, min_by(part_usage, row_no * 1000 + pos) AS usage FROM ba GROUP BY 1)"
_joined = f"""{_index}, sr AS (SELECT *, {D.stem('token')} AS base FROM ({_src}) q), jb AS (SELECT s.*, CASE WHEN o.token IS NOT NULL THEN 'exact' WHEN f.token IS NOT NULL THEN 'inherited' END AS found,
coalesce(o.part_number, f.part_number) AS part_number, coalesce(o.c1, f.c1) AS c1, coalesce(o.c2, f.c2) AS c2, coalesce(o.usage, f.usage) AS usage FROM sr s LEFT JOIN bi o ON s.token = o.token LEFT JOIN bi f ON s.base = f.token AND o.token IS NULL AND s.base <> s.token)"""
_typed = f"""{_joined}, hi AS (SELECT part_number, min_by(commodity1, row_no) AS h1, min_by(commodity2, row_no) AS h2 FROM v_hda GROUP BY 1),
ty AS (SELECT jb.*, coalesce(nullif(h1, ''), c1) AS type1, coalesce(nullif(h2, ''), c2) AS type2 FROM jb LEFT JOIN hi ON jb.part_number = hi.part_number WHERE found IS NOT NULL)"""
with_bom = lambda v: G.with_bom(source(v), blanked(v))
typed = lambda v: G.with_types(with_bom(v).filter("found IS NOT NULL"), v.v_hda)
add("join_bom_index", lambda v: with_bom(v).select("row_no", "pos", "token", "base", "found", "part_number"), f"WITH {_joined} SELECT row_no, pos, token, base, found, part_number FROM jb", VIEWS)
add("join_hda", lambda v: typed(v).select("row_no", "pos", "token", "type1", "type2"), f"WITH {_typed} SELECT row_no, pos, token, type1, type2 FROM ty", VIEWS)
_used = f"{_typed}, ic AS (SELECT base, count(DISTINCT token) AS n FROM ty GROUP BY 1), us AS (SELECT ty.*, CASE WHEN found = 'inherited' THEN 1.0 / n WHEN usage = '1/2' THEN 0.5 WHEN usage = 'abc' THEN NULL ELSE 1.0 END AS part_usage, CASE WHEN found = 'inherited' THEN 'inherited' WHEN usage = 'abc' THEN 'unparseable' WHEN usage = '' THEN 'blank' ELSE 'explicit' END AS usage_code FROM ty JOIN ic USING (base))"
used = lambda v: G.with_usage(typed(v))
add("fn_usage_resolve", lambda v: used(v).select("row_no", "pos", "token", F.round("part_usage", 6).alias("part_usage"), "usage_code"), f"WITH {_used} SELECT row_no, pos, token, round(part_usage::DOUBLE, 6) AS part_usage, usage_code FROM us", VIEWS)
_counts = lambda v: blanked(v).select(F.explode(T.split_list(F.col("ref_des"))).alias("t")).groupBy(T.usage_base(F.col("t")).alias("base")).agg(F.count("*").alias("n"))
add("fn_usage_check", lambda v: G.usage_checks(used(v).withColumn("part_usage", F.when(F.col("pos") == 3, 0.25).otherwise(F.col("part_usage"))), _counts(v)).select("token", F.round("usage", 6).alias("usage"), F.round("expected", 6).alias("expected")),
    f"WITH {_used}, oc AS (SELECT ubase AS base, count(*) AS n FROM ba GROUP BY 1) SELECT token, round((CASE WHEN pos = 3 THEN 0.25 ELSE part_usage END)::DOUBLE, 6) AS usage, round((1.0 / n)::DOUBLE, 6) AS expected FROM us JOIN oc USING (base) WHERE usage_code = 'explicit' AND abs(CASE WHEN pos = 3 THEN 0.25 ELSE part_usage END - 1.0 / n) > 0.01", VIEWS)
_letters = "chr((64 + {n})::INTEGER)"
_fan = f"""{_typed}, pr AS (SELECT DISTINCT lower(commodity1) AS m1, lower(commodity2) AS m2 FROM v_fm), p1 AS (SELECT DISTINCT m1 FROM pr),
kn AS (SELECT ty.*, pr.m1 IS NOT NULL AS pair, p1.m1 IS NOT NULL AS one FROM ty LEFT JOIN pr ON lower(type1) = pr.m1 AND lower(type2) = pr.m2 LEFT JOIN p1 ON lower(type1) = p1.m1),
fa AS (SELECT kn.row_no, pos, label, token, failure_mode, ratio, row_number() OVER (PARTITION BY kn.row_no, pos, token ORDER BY fm_row, failure_mode) AS n, NULL AS no_match FROM kn JOIN v_fm ON lower(type1) = lower(commodity1) AND lower(type2) = lower(commodity2) WHERE pair
UNION ALL SELECT kn.row_no, pos, label, token, failure_mode, ratio, row_number() OVER (PARTITION BY kn.row_no, pos, token ORDER BY lower(commodity2), fm_row, failure_mode), NULL FROM kn JOIN v_fm ON lower(type1) = lower(commodity1) WHERE NOT pair AND type1 <> '' AND type2 = ''
UNION ALL SELECT row_no, pos, label, token, 'No failure mode match found', NULL, 1, CASE WHEN type1 = '' AND type2 = '' THEN 'no types' WHEN NOT one THEN 'type 1 unknown' ELSE 'pair unknown' END FROM kn WHERE NOT pair AND NOT (one AND type1 <> '' AND type2 = '')),
sf AS (SELECT *, CASE WHEN n <= 26 THEN {_letters.format(n='n')} ELSE chr((65 + (n - 27) // 26)::INTEGER) || chr((65 + (n - 27) % 26)::INTEGER) END AS suffix, CASE WHEN no_match IS NOT NULL THEN 'no_match' WHEN abs(sum(ratio) OVER (PARTITION BY row_no, pos, token) - 1) > 0.001 THEN 'validation_warning' ELSE 'piece_part' END AS kind FROM fa)"""
parts = lambda v: G.components(source(v), blanked(v), v.v_hda, v.v_fm)
_rows = ("row_no", "pos", "token", "failure_mode", "ratio", "suffix")
_dbl = "ratio::DOUBLE AS ratio"
add("join_fm_fanout", lambda v: parts(v).filter("no_match IS NULL").select(*(F.col(c).cast("double") if c == "ratio" else c for c in _rows)), f"WITH {_fan} SELECT row_no, pos, token, failure_mode, {_dbl}, suffix FROM sf WHERE no_match IS NULL", VIEWS)
add("join_no_match", lambda v: parts(v).filter("no_match IS NOT NULL").select("row_no", "pos", "token", "no_match"), f"WITH {_fan} SELECT row_no, pos, token, no_match FROM sf WHERE no_match IS NOT NULL", VIEWS)
add("gen_component", lambda v: parts(v).select("row_no", "pos", "fmea_id", "failure_mode", F.col("ratio").cast("double").alias("ratio"), "kind"), f"WITH {_fan} SELECT row_no, pos, label || '-' || token || '-' || suffix AS fmea_id, failure_mode, {_dbl}, kind FROM sf", VIEWS)
_gen = f"SELECT row_no, pos, label || '-' || token || '-' || suffix AS fmea_id, failure_mode, {_dbl}, kind FROM sf UNION ALL SELECT DISTINCT row_no, -1, label, '', NULL::DOUBLE, 'header' FROM sr"
generated = lambda v: G.piece_parts(source(v), blanked(v), v.v_hda, v.v_fm)
_shape = ("row_no", "pos", "fmea_id", "failure_mode", "ratio", "kind")
_out = lambda df: df.select(*(F.col(c).cast("double").alias(c) if c == "ratio" else c for c in _shape))
add("gen_piece_part", lambda v: _out(generated(v)), f"WITH {_fan} {_gen}", VIEWS)
add("piece_part_generate", lambda v: _out(generated(v)).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("ratio"), 4).alias("ratios")), f"WITH {_fan}, ge AS ({_gen}) SELECT kind, count(*) AS n, round(sum(ratio), 4) AS ratios FROM ge GROUP BY 1", VIEWS)
add("gen_group_rows", lambda v: generated(v).filter("kind = 'header'").select("row_no", "fmea_id"), f"SELECT DISTINCT row_no, label AS fmea_id FROM ({_src}) q", VIEWS)
_bom_src = lambda v: blanked(v).select("row_no", F.posexplode(T.split_list(F.col("ref_des"))).alias("pos", "token"), F.lit("BOM").alias("label"))
add("gen_bom_only", lambda v: G.components(_bom_src(v), blanked(v), v.v_hda, v.v_fm).groupBy("kind").agg(F.count_distinct("token").alias("n")),
    f"WITH {_fan.replace(f'FROM ({_src}) q', 'FROM (SELECT row_no, pos, ' + chr(39) + 'BOM' + chr(39) + ' AS label, token FROM ba) q')} SELECT kind, count(DISTINCT token) AS n FROM sf GROUP BY 1", VIEWS)


def _old_groups(v):
    """The groups of the existing table: parts under the block before them, with its function."""
    rows = K.row_types(v.v_fmea, [], "level", "cause", ["ratio"], "fmea_id")
    heads = rows.filter("row_type = 'circuit_block'").select(F.col("fmea_id").alias("label"), F.col("func").alias("description"))
    held = K.attach_blocks(rows, [], "fmea_id").filter("NOT orphan").select(F.col("block").alias("label"), T.canonical(F.col("cause")).alias("token"))
    return heads.join(held, "label", "left").select("label", F.coalesce("token", F.lit("")).alias("token"), "description", F.lit("").alias("page"))


_kept_old = lambda v: _old_groups(v).filter("label NOT LIKE '%7' AND token NOT LIKE '%3'")
_kept_new = lambda v: source(v).filter("label NOT LIKE '%5' AND pos <> 5").select("label", "token", F.when(F.col("row_no") % 3 == 0, F.concat(F.lit("from "), "label")).otherwise("").alias("description"), (F.col("row_no") % 40).cast("string").alias("page"))
_un = f"""og AS (SELECT label, token, func AS description FROM (SELECT last_value(CASE WHEN level = 'Circuit Block' THEN fmea_id END IGNORE NULLS) OVER w AS label, upper(cause) AS token, last_value(CASE WHEN level = 'Circuit Block' THEN func END IGNORE NULLS) OVER w AS func FROM v_fmea
    WINDOW w AS (ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) q WHERE label NOT LIKE '%7' AND token NOT LIKE '%3'),
ng AS (SELECT label, token, CASE WHEN row_no % 3 = 0 THEN 'from ' || label ELSE '' END AS description, (row_no % 40)::VARCHAR AS page FROM ({_src}) q WHERE label NOT LIKE '%5' AND pos <> 5),
og1 AS (SELECT label, min(description) AS d FROM og GROUP BY 1), ng1 AS (SELECT label, min(nullif(description, '')) AS d, min(page) AS p FROM ng GROUP BY 1),
ug AS (SELECT coalesce(o.label, n.label) AS label, CASE WHEN n.label IS NULL THEN 'old' WHEN o.label IS NULL THEN 'new' ELSE 'both' END AS side, coalesce(n.d, o.d, '') AS description, coalesce(p, '') AS page,
    CASE WHEN n.label IS NULL THEN 'Function group present in Merged FMEA but absent from Grouping File' WHEN o.label IS NULL THEN 'New function group added since last FMEA' END AS diagnostic FROM og1 o FULL JOIN ng1 n ON o.label = n.label),
um AS (SELECT coalesce(o.label, n.label) AS label, coalesce(o.token, n.token) AS token, CASE WHEN n.label IS NULL THEN 'old' WHEN o.label IS NULL THEN 'new' ELSE 'both' END AS side,
    CASE WHEN n.label IS NULL THEN 'Component missing from Grouping File but was present in Merged FMEA' WHEN o.label IS NULL THEN 'Component present in Grouping File but missing from Merged FMEA' END AS diagnostic
    FROM (SELECT DISTINCT label, token FROM og WHERE token <> '') o FULL JOIN (SELECT DISTINCT label, token FROM ng WHERE token <> '') n ON o.label = n.label AND o.token = n.token)"""
UNION = (*VIEWS, "v_fmea")
add("join_union_groups", lambda v: G.union_diagnostics(*G.union_groups(_kept_old(v), _kept_new(v))),
    f"WITH {_un} SELECT label, '' AS token, 'group' AS source, diagnostic FROM ug WHERE diagnostic IS NOT NULL UNION ALL SELECT label, token, 'component', diagnostic FROM um WHERE diagnostic IS NOT NULL", UNION)
_of_union = _fan.replace(f"FROM ({_src}) q", "FROM (SELECT regexp_extract(label, '[0-9]+')::BIGINT AS row_no, 0 AS pos, label, token FROM um) q")
add("gen_fill_gaps", lambda v: G.fill_gaps(_kept_old(v), _kept_new(v), blanked(v), v.v_hda, v.v_fm),
    f"""WITH {_un}, {_of_union}, al AS (SELECT label, token, label || '-' || token || '-' || suffix AS fmea_id, failure_mode, {_dbl}, kind, NULL AS own FROM sf
    UNION ALL SELECT label, token, '', '', NULL, 'no_match', 'Component ' || token || ' present in merge set but missing from BOM.' FROM jb WHERE found IS NULL)
    SELECT al.label, al.token, fmea_id, failure_mode, ratio, kind, description, page, concat_ws('; ', own, um.diagnostic) AS diagnostic FROM al JOIN um ON al.label = um.label AND al.token = um.token JOIN ug ON ug.label = al.label
    UNION ALL SELECT label, '', label, '', NULL, 'header', description, page, coalesce(diagnostic, '') FROM ug""", UNION)  # fmt: skip
add("gen_parse_fmea_groups", lambda v: _old_groups(v).groupBy("label").agg(F.count_distinct(F.when(F.col("token") != "", F.col("token"))).alias("parts"), F.min("description").alias("description")),
    """SELECT label, count(DISTINCT nullif(cause, '')) AS parts, min(func) FILTER (level = 'Circuit Block') AS description FROM (SELECT *, last_value(CASE WHEN level = 'Circuit Block' THEN fmea_id END IGNORE NULLS) OVER (ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM v_fmea) q GROUP BY 1""", ("v_fmea",))  # fmt: skip
_pass = lambda v: parts(v).filter("pos < 4").select("row_no", "token", "fmea_id", F.lit("passed").alias("origin"))
add("join_dedupe_second_pass", lambda v: G.functional(_pass(v).select("token").distinct(), source(v).select("token", "label")).select("token", "label"),
    f"WITH {_fan} SELECT DISTINCT token, NULL::VARCHAR AS label FROM sf WHERE pos < 4 UNION ALL SELECT token, label FROM sr WHERE token NOT IN (SELECT token FROM sf WHERE pos < 4)", VIEWS)
add("gen_functional", lambda v: G.functional(_pass(v), parts(v).select("row_no", "token", "fmea_id", F.lit("generated").alias("origin"))).groupBy("origin").agg(F.count("*").alias("n")),
    f"WITH {_fan} SELECT CASE WHEN pos < 4 THEN 'passed' ELSE 'generated' END AS origin, count(*) AS n FROM sf WHERE pos < 4 OR token NOT IN (SELECT token FROM sf WHERE pos < 4) GROUP BY 1", VIEWS)
add("lim_output_guard", lambda v: G.guard_output(typed(v), v.v_fm, 1000), f"WITH {_typed}, c AS (SELECT lower(commodity1) AS m1, lower(commodity2) AS m2, count(*) AS n FROM v_fm GROUP BY 1, 2) SELECT sum(coalesce(n, 1))::BIGINT AS rows, sum(coalesce(n, 1)) > 1000 AS too_many FROM ty LEFT JOIN c ON lower(type1) = m1 AND lower(type2) = m2", VIEWS)
_diag = "SELECT 'Group missing in BOM' AS diagnostic, count(*) AS n FROM jb WHERE found IS NULL UNION ALL SELECT 'Inherited', count(*) FROM jb WHERE found = 'inherited'"
add("gen_diag_frames", lambda v: with_bom(v).groupBy(F.when(F.col("found").isNull(), "Group missing in BOM").when(F.col("found") == "inherited", "Inherited").alias("diagnostic")).agg(F.count("*").alias("n")).filter("diagnostic IS NOT NULL"), f"WITH {_joined} {_diag}", VIEWS)
add("gen_parse_grouping_groups", lambda v: source(v).groupBy("label").agg(F.min("row_no").alias("row_no"), F.count_distinct("token").alias("n")), f"SELECT label, min(row_no) AS row_no, count(DISTINCT token) AS n FROM ({_src}) q GROUP BY 1", VIEWS)
add("merge_generated_index", lambda v: parts(v).groupBy("label", T.canonical(F.col("token")).alias("ref"), T.failure_mode_key(F.col("failure_mode")).alias("mode")).agg(F.count("*").alias("n")),
    f"WITH {_fan} SELECT label, token AS ref, upper(failure_mode) AS mode, count(*) AS n FROM sf GROUP BY 1, 2, 3", VIEWS)

