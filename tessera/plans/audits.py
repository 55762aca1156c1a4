"""Queries of the token tables and audit rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import tokens as T
from tessera.operators import audit as A
from tessera.operators import compare as C
from tessera.operators import explode as E
from tessera.plans import duck_expr as D
from tessera.plans.registry import add

_dnp = "regexp_matches(ref_des || ' ' || description, '(?i)(\\bDNP\\b|\\bNF\\b|NOT\\s*FITTED|NO[-\\s]?LOAD|DO\\s*NOT\\s*POPULATE)')"
#: Token tables for the SQL twins: b (BOM, fitted parts), ba (all parts), g (grouping).
_b = lambda name, where: (
    f"{name}0 AS (SELECT *, {D.tokens('ref_des')} AS t FROM v_bom {where}), {name}1 AS (SELECT * EXCLUDE (t), unnest(t) AS token, unnest(range(0, len(t))) AS pos FROM {name}0), "
    f"{name} AS (SELECT *, {D.base('token')} AS base, {D.usage_base('token')} AS ubase FROM {name}1)"
)
B, BA = _b("b", f"WHERE NOT {_dnp}"), _b("ba", "")
G = (
    f"g0 AS (SELECT *, {D.tokens('refs')} AS t FROM v_grouping), g1 AS (SELECT * EXCLUDE (t), unnest(t) AS token, unnest(range(0, len(t))) AS pos FROM g0), "
    f"g AS (SELECT *, {D.base('token')} AS base, {D.usage_base('token')} AS ubase FROM g1)"
)
VIEWS = ("v_bom", "v_grouping")
bom = lambda v: E.bom_tokens(v.v_bom, "part_usage")
group = lambda v: E.group_tokens(v.v_grouping)

add("agg_explode_bom", lambda v: E.bom_bases(bom(v)),
    f"WITH {B} SELECT base, coalesce(min_by(description, row_no * 1000 + pos) FILTER (description <> ''), '') AS description, string_agg(DISTINCT token, ', ' ORDER BY token) AS tokens, count(DISTINCT token) AS n_tokens FROM b GROUP BY base", VIEWS)


def _grouping_index(v):
    by_token, by_base = E.group_index(group(v))
    return by_token.join(by_base, "base").select("token", "base", "token_group", "base_group", "n_tokens")


_gi = f"{G}, gt AS (SELECT token, base, max_by(label, row_no * 1000 + pos) AS token_group FROM g GROUP BY token, base), gb AS (SELECT base, min_by(label, row_no * 1000 + pos) AS base_group, count(DISTINCT token) AS n_tokens FROM g GROUP BY base)"
add("agg_explode_grouping", _grouping_index, f"WITH {_gi} SELECT token, base, token_group, base_group, n_tokens FROM gt JOIN gb USING (base)", VIEWS)
_missing = f"WITH {B}, {_gi} SELECT token_group AS \"group\", token, gt.base AS base, '{{}}' AS reason FROM gt WHERE "
add("join_missing_exact", lambda v: C.missing(group(v), bom(v), exact=True), _missing.format("Exact token missing") + "token NOT IN (SELECT token FROM b)", VIEWS)
add("join_missing_base", lambda v: C.missing(group(v), bom(v)), _missing.format("Base RefDes missing") + "base NOT IN (SELECT base FROM b)", VIEWS)
add("join_extra_exact", lambda v: C.extra(group(v), bom(v), exact=True), f"WITH {B}, {G} SELECT DISTINCT base, token AS bom_tokens, 'Exact token missing in Grouping' AS reason FROM b WHERE token NOT IN (SELECT token FROM g)", VIEWS)
_extra = f"SELECT base, string_agg(DISTINCT token, ', ' ORDER BY token) AS bom_tokens, 'Not found in Grouping' AS reason FROM b WHERE base NOT IN (SELECT base FROM g) GROUP BY base"
add("join_extra_base", lambda v: C.extra(group(v), bom(v)), f"WITH {B}, {G} {_extra}", VIEWS)
add("join_loose_prefix", lambda v: C.missing(group(v), bom(v), loose=True),
    _missing.format("Base RefDes missing") + "NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT base FROM b) o WHERE starts_with(o.base, gt.base) AND NOT regexp_matches(substr(o.base, length(gt.base) + 1), '^[0-9]+$'))", VIEWS)


def flagship(v):
    g, b = group(v), bom(v)
    lost = C.missing(g, b).select("reason", "base", F.col("token").alias("tokens"))
    return lost.unionByName(C.extra(g, b).select("reason", "base", F.col("bom_tokens").alias("tokens")))


add("flagship", flagship, f"WITH {B}, {_gi}, e AS ({_extra}) SELECT 'Base RefDes missing' AS reason, base, token AS tokens FROM gt WHERE base NOT IN (SELECT base FROM b) UNION ALL SELECT reason, base, bom_tokens FROM e", VIEWS)
add("agg_summary", lambda v: C.summary(group(v), bom(v)),
    f"WITH {B}, {G} SELECT 'Grouping tokens' AS metric, count(DISTINCT token) AS value FROM g UNION ALL SELECT 'Grouping bases', count(DISTINCT base) FROM g UNION ALL SELECT 'BOM tokens', count(DISTINCT token) FROM b UNION ALL SELECT 'BOM bases', count(DISTINCT base) FROM b", VIEWS)
add("agg_bom_set_norm", lambda v: E.tokens(v.v_bom, "ref_des", "page").groupBy("base").agg(E.joined_set("page").alias("pages")),
    f"WITH {BA} SELECT base, string_agg(DISTINCT page, ', ' ORDER BY page) AS pages FROM ba GROUP BY base", VIEWS)
add("agg_instances", lambda v: bom(v).groupBy(T.usage_base(F.col("token")).alias("base")).agg(F.count_distinct("token").alias("n")), f"WITH {B} SELECT ubase AS base, count(DISTINCT token) AS n FROM b GROUP BY 1", VIEWS)
add("agg_usage_counts", lambda v: bom(v).groupBy(T.usage_base(F.col("token")).alias("base")).agg(F.count("*").alias("n")), f"WITH {B} SELECT ubase AS base, count(*) AS n FROM b GROUP BY 1", VIEWS)

# filters
add("flt_dnp", lambda v: v.v_bom.filter(~T.not_fitted(F.col("ref_des"), F.col("description"))).select("row_no", "ref_des"), f"SELECT row_no, ref_des FROM v_bom WHERE NOT {_dnp}", ("v_bom",))
add("flt_desc_regex", lambda v: E.bom_tokens(v.v_bom, ignore_description="header|rev").select("row_no", "token"), f"WITH {B} SELECT row_no, token FROM b WHERE NOT regexp_matches(description, '(?i)header|rev')", VIEWS)
add("flt_token_regex", lambda v: E.bom_tokens(v.v_bom, ignore="^(CR|VR)").select("row_no", "token"), f"WITH {B} SELECT row_no, token FROM b WHERE NOT regexp_matches(token, '(?i)^(CR|VR)')", VIEWS)
add("flt_prov", lambda v: E.group_tokens(v.v_grouping, provisional=False).select("label", "token", "base"), f"WITH {G} SELECT label, token, base FROM g WHERE NOT contains(upper(label), 'PROV')", VIEWS)
add("flt_blank_label", lambda v: v.v_fmea.filter(T.clean(F.col("level")) != "").select("row_no"), "SELECT row_no FROM v_fmea WHERE level <> ''", ("v_fmea",))
_standards = "CASE fm_row + length(commodity2) % 2 WHEN 1 THEN 'FMD-91' WHEN 2 THEN 'fmd 2016' ELSE 'FMD2016' END"


def by_standard(rows, selector, standard):
    """Rows of a standard, written any way; all rows if none is of it.  The flag is aggregated, not counted on the driver."""
    plain = lambda c: F.regexp_replace(F.upper(c), r"[-\s]", "")
    rows = rows.withColumn("_m", F.coalesce(plain(F.col(selector)) == plain(F.lit(standard)), F.lit(False)))
    any_of = rows.agg(F.coalesce(F.max("_m"), F.lit(False)).alias("_any"))
    return rows.join(F.broadcast(any_of)).filter("_m OR NOT _any").drop("_m", "_any")  # one row


add("flt_standard", lambda v: by_standard(v.v_fm.selectExpr("*", f"{_standards} AS standard"), "standard", "FMD-2016").select("commodity1", "commodity2", "failure_mode", "standard"),
    rf"""WITH p AS (SELECT *, regexp_replace(upper(standard), '[-\s]', '', 'g') = 'FMD2016' AS m FROM (SELECT commodity1, commodity2, failure_mode, {_standards} AS standard FROM v_fm) q)
SELECT commodity1, commodity2, failure_mode, standard FROM p WHERE m OR NOT (SELECT coalesce(bool_or(m), false) FROM p)""", ("v_fm",))  # fmt: skip


def blacklisted(c, exact=("GND", "VCC"), user=(), white=()):
    """White list first, then the exact lists, then voltages."""
    t = F.upper(T.clean(c))
    return ~t.isin(*white, "") & (t.isin(*exact, *user) | t.rlike(r"^\d+\.?\d*V$"))


_net = "CASE k % 5 WHEN 0 THEN 'GND' WHEN 1 THEN '3.3V' WHEN 2 THEN 'vcc' WHEN 3 THEN ref ELSE '5V0' END"
add("flt_blacklist", lambda v: v.v_part.selectExpr("k", f"{_net} AS t").filter(~blacklisted(F.col("t"), white=("VCC",))),
    rf"SELECT k, t FROM (SELECT k, t, upper(trim(coalesce(t, ''))) AS u FROM (SELECT k, {_net} AS t FROM v_part) p) q WHERE u IN ('VCC', '') OR NOT (u = 'GND' OR regexp_matches(u, '^\d+\.?\d*V$'))", ("v_part",))
_note = "CASE k % 4 WHEN 0 THEN 'Block roll-up of 3; ' WHEN 1 THEN 'Block roll-up of 3; Invalid Ratio' WHEN 2 THEN '' ELSE 'Circuit-block roll-up of 2; Block roll-up of 1' END"


def informational(note):
    """Whether a note has segments, and all of them only inform."""
    parts = F.filter(F.transform(F.split(F.coalesce(note, F.lit("")), ";"), T.clean), lambda s: s != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda s: s.rlike("^(?:Circuit-block|Block) roll-up of"))


add("flt_informational", lambda v: v.v_part.selectExpr("k", f"{_note} AS n").select("k", informational(F.col("n")).alias("value")),
    f"""SELECT k, len(parts) > 0 AND len([s FOR s IN parts IF NOT regexp_matches(s, '^(?:Circuit-block|Block) roll-up of')]) = 0 AS value
FROM (SELECT k, [trim(s) FOR s IN string_split({_note}, ';') IF trim(s) <> ''] AS parts FROM v_part) q""", ("v_part",))  # fmt: skip

# duplicates, ratios, usages
_double = "SELECT row_no, label, refs FROM v_grouping UNION ALL SELECT row_no + 100000, label, refs FROM v_grouping WHERE row_no % 5 = 0"
add("agg_dup_group", lambda v: A.group_duplicates(E.group_tokens(v.v_grouping.unionByName(v.v_grouping.filter("row_no % 5 = 0").withColumn("row_no", F.col("row_no") + 100000)))),
    f"WITH {G}, d AS (SELECT token, label FROM g UNION ALL SELECT token, label FROM g WHERE row_no % 5 = 0) SELECT token, count(*) AS n, string_agg(label, ', ' ORDER BY label) AS groups FROM d GROUP BY token HAVING count(*) > 1", VIEWS)
_bb = lambda v: E.bom_tokens(v.v_bom.unionByName(v.v_bom.filter("k % 9 = 0").withColumn("row_no", F.col("row_no") + 100000)))
add("agg_dup_bom", lambda v: A.bom_duplicates(_bb(v)), f"WITH {B} SELECT token, count(*) + count(*) FILTER (k % 9 = 0) AS n FROM b GROUP BY token HAVING count(*) + count(*) FILTER (k % 9 = 0) > 1", VIEWS)
add("agg_dups_generic", lambda v: v.v_bom.groupBy("part_number").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("row_no")), ",").alias("rows")).filter("n > 1"),
    "SELECT part_number, count(*) AS n, string_agg(row_no::VARCHAR, ',' ORDER BY row_no) AS rows FROM v_bom GROUP BY 1 HAVING count(*) > 1", ("v_bom",))
_ratio = "CASE WHEN row_no % 97 = 3 THEN 'n/a' WHEN row_no % 89 = 4 THEN '' ELSE ratio END"
_sums = f"""SELECT refdes, round(s, 6) AS sum, status FROM (SELECT refdes, s, CASE WHEN bad AND s IS NULL THEN 'Non-numeric ratio cell' WHEN bad THEN 'Non-numeric ratio cell (sum incomplete)' WHEN abs(s - 1) > 0.001 THEN 'FMR != 1.0' END AS status
FROM (SELECT {{key}} AS refdes, sum(TRY_CAST(r AS DOUBLE)) AS s, bool_or(r = 'n/a') AS bad FROM (SELECT *, {_ratio} AS r FROM v_fmea) q WHERE r <> '' AND cause <> '' GROUP BY 1) p) o WHERE status IS NOT NULL"""
_rounded = lambda df: df.withColumn("sum", F.round("sum", 6))
add("agg_fmr_sum", lambda v: _rounded(A.ratio_sums(v.v_fmea.selectExpr("cause", f"{_ratio} AS r"), "cause", "r")), _sums.format(key=D.canon("cause")), ("v_fmea",))
add("agg_fmr_sum_custom", lambda v: _rounded(A.ratio_sums(v.v_fmea.selectExpr("cause", f"{_ratio} AS r"), "cause", "r", canonical=False)), _sums.format(key=f"upper({D.trim('cause')})"), ("v_fmea",))
add("agg_fmr_invalid", lambda v: _rounded(A.ratio_sums(v.v_fmea, "cause", "ratio")).filter("status = 'FMR != 1.0'").select("refdes", "sum"),
    "SELECT cause AS refdes, round(sum(TRY_CAST(ratio AS DOUBLE)), 6) AS sum FROM v_fmea WHERE cause <> '' GROUP BY 1 HAVING abs(sum(TRY_CAST(ratio AS DOUBLE)) - 1) > 0.001", ("v_fmea",))
_fmr_dispatch = "SELECT * FROM (SELECT 'BOM' AS source, refdes, sum, status FROM (" + _sums.format(key=D.canon("cause")) + ") z) y"
add("agg_fmr_dispatch", lambda v: _rounded(A.ratio_sums(v.v_fmea.selectExpr("cause", f"{_ratio} AS r"), "cause", "r")).select(F.lit("BOM").alias("source"), "refdes", "sum", "status"), _fmr_dispatch, ("v_fmea",))


def _usages(v):
    return bom(v).withColumn("usage", N.parse_usage(F.col("part_usage"))["value"] * F.when(F.col("row_no") % 13 == 4, 3.0).when(F.col("row_no") % 29 == 5, -1.0).otherwise(1.0)).filter("usage IS NOT NULL").select("row_no", "pos", "token", "usage")


_u = f"{B}, u AS (SELECT row_no, pos, token, ubase AS base, CASE part_usage WHEN '1/2' THEN 0.5 WHEN 'abc' THEN NULL ELSE 1.0 END * CASE WHEN row_no % 13 = 4 THEN 3.0 WHEN row_no % 29 = 5 THEN -1.0 ELSE 1.0 END AS usage FROM b), c AS (SELECT u.*, n FROM u JOIN (SELECT base, count(DISTINCT token) AS n FROM u WHERE usage IS NOT NULL GROUP BY base) t USING (base) WHERE usage IS NOT NULL)"
_shown = lambda df: df.withColumns({"usage": F.round("usage", 6), "expected": F.round("expected", 6)})
_num = "round({u}::DOUBLE, 6) AS usage, round({e}::DOUBLE, 6) AS expected"
add("agg_usage_basic", lambda v: _shown(A.usage_basic(_usages(v))),
    f"WITH {_u} SELECT token AS refdes, base, {_num.format(u='usage', e='1.0 / n')}, n AS count, 'PU_EXPECTED_MISMATCH_BASIC' AS reason_code FROM c WHERE abs(usage - 1.0 / n) > 0.01", VIEWS)
add("agg_usage_format", lambda v: _shown(A.usage_range(_usages(v))),
    f"WITH {_u} SELECT token AS refdes, '' AS base, {_num.format(u='usage', e='NULL')}, NULL::BIGINT AS count, CASE WHEN usage > 1 THEN 'PU_RANGE_ABOVE_ONE' ELSE 'PU_RANGE_NON_POSITIVE' END AS reason_code FROM c WHERE usage > 1 OR usage <= 0", VIEWS)
_other = "SELECT base, count(DISTINCT token) AS m FROM (SELECT ubase AS base, token FROM g UNION ALL SELECT ubase, token || '-9' FROM g WHERE row_no % 3 = 0) x GROUP BY base"
_more = lambda v: group(v).select("token").unionByName(group(v).filter("row_no % 3 = 0").select(F.concat("token", F.lit("-9")).alias("token")))
add("join_cross_usage", lambda v: _shown(A.cross_usage(_usages(v), _more(v))),
    f"""WITH {_u}, {G}, f AS (SELECT base, count(DISTINCT token) AS n, min_by(usage, row_no * 1000 + pos) AS usage, min_by(token, row_no * 1000 + pos) AS refdes FROM c GROUP BY base), o AS ({_other}),
    x AS (SELECT *, CASE WHEN abs(usage - 1.0 / n) <= 0.01 AND abs(usage - 1.0 / m) <= 0.01 THEN NULL WHEN abs(usage - 1.0 / n) <= 0.01 THEN 'PU_COUNT_MATCHES_THIS_FILE_ONLY' WHEN abs(usage - 1.0 / m) <= 0.01 THEN 'PU_COUNT_MATCHES_OTHER_FILE_ONLY' ELSE 'PU_CROSS_COUNT_CONFLICT' END AS reason_code FROM f JOIN o USING (base) WHERE n <> m AND usage > 0)
    SELECT refdes, base, {_num.format(u='usage', e='1.0 / n')}, n AS count, reason_code FROM x WHERE reason_code IS NOT NULL""", VIEWS)  # fmt: skip


def _rated(v):
    rows = v.v_fmea.filter("cause <> ''").select("row_no", F.lit(0).alias("pos"), F.col("cause").alias("token"), F.coalesce(N.number(F.col("usage")), F.lit(1.0)).alias("usage"), N.number(F.col("ratio")).alias("ratio"))
    return rows.withColumn("ratio", F.when(F.col("row_no") % 37 != 6, F.col("ratio"))).withColumn("usage", F.when(F.col("row_no") % 41 == 7, 0.5).otherwise(F.col("usage")))


add("agg_fmr_usage", lambda v: _shown(A.ratio_and_usage(_rated(v))),
    f"""WITH r AS (SELECT row_no, cause AS token, {D.usage_base('cause')} AS base, CASE WHEN row_no % 41 = 7 THEN 0.5 ELSE coalesce(TRY_CAST(nullif(usage, '') AS DOUBLE), 1.0) END AS usage, CASE WHEN row_no % 37 <> 6 THEN TRY_CAST(ratio AS DOUBLE) END AS ratio FROM v_fmea WHERE cause <> ''),
    s AS (SELECT base, count(DISTINCT token) AS n, bool_or(ratio IS NULL) AS gap, sum(ratio * usage) AS product, min_by(token, row_no) AS ft FROM r GROUP BY base),
    q AS (SELECT r.*, n, gap, row_number() OVER (PARTITION BY r.base, token ORDER BY row_no) AS nth, first_value(usage) OVER (PARTITION BY r.base, token ORDER BY row_no) AS seen FROM r JOIN s USING (base))
    SELECT ft AS refdes, base, NULL::DOUBLE AS usage, NULL::DOUBLE AS expected, n AS count, 'FMR_MISSING_PP' AS reason_code FROM s WHERE gap
    UNION ALL SELECT token, base, round(usage, 6), round(1.0 / n, 6), n, 'PU_EXPECTED_MISMATCH' FROM q WHERE gap AND nth = 1 AND abs(usage - 1.0 / n) > 0.01
    UNION ALL SELECT token, base, round(usage, 6), round(seen, 6), n, 'PU_INCONSISTENT_DUPLICATE' FROM q WHERE gap AND nth > 1 AND abs(usage - seen) > 0.01
    UNION ALL SELECT token, base, NULL, 1.0, n, 'FMR_SUM_MISMATCH' FROM q WHERE NOT gap GROUP BY token, base, n HAVING abs(sum(ratio) - 1) > 0.001
    UNION ALL SELECT ft, base, round(product, 6), 1.0, n, 'FMR_USAGE_PRODUCT_MISMATCH' FROM s WHERE NOT gap AND abs(product - 1) > 0.01""", ("v_fmea",))  # fmt: skip


def _usage_checks(v):
    rows = _usages(v)
    return _shown(A.usage_basic(rows).unionByName(A.usage_range(rows)).unionByName(A.cross_usage(rows, _more(v)))).groupBy("reason_code").agg(F.count("*").alias("n"))


add("agg_usage_dispatch", _usage_checks,
    f"""WITH {_u}, {G}, f AS (SELECT base, count(DISTINCT token) AS n, min_by(usage, row_no * 1000 + pos) AS usage FROM c GROUP BY base), o AS ({_other}),
    x AS (SELECT CASE WHEN abs(usage - 1.0 / n) <= 0.01 AND abs(usage - 1.0 / m) <= 0.01 THEN NULL WHEN abs(usage - 1.0 / n) <= 0.01 THEN 'PU_COUNT_MATCHES_THIS_FILE_ONLY' WHEN abs(usage - 1.0 / m) <= 0.01 THEN 'PU_COUNT_MATCHES_OTHER_FILE_ONLY' ELSE 'PU_CROSS_COUNT_CONFLICT' END AS code FROM f JOIN o USING (base) WHERE n <> m AND usage > 0),
    y AS (SELECT code FROM x WHERE code IS NOT NULL UNION ALL SELECT 'PU_EXPECTED_MISMATCH_BASIC' FROM c WHERE abs(usage - 1.0 / n) > 0.01 UNION ALL SELECT CASE WHEN usage > 1 THEN 'PU_RANGE_ABOVE_ONE' ELSE 'PU_RANGE_NON_POSITIVE' END FROM c WHERE usage > 1 OR usage <= 0)
    SELECT code AS reason_code, count(*) AS n FROM y GROUP BY 1""", VIEWS)  # fmt: skip
from tessera.plans.scalars import _expected  # noqa: E402

add("join_warn_counts", lambda v: A.count_warnings(E.bom_bases(bom(v)), E.group_index(group(v))[1]),
    f"""WITH {B}, {G}, d AS (SELECT base, coalesce(min_by(description, row_no * 1000 + pos) FILTER (description <> ''), '') AS description, count(DISTINCT token) AS own FROM b GROUP BY base),
    j AS (SELECT d.base, description, own, coalesce(gn, 0) AS observed, ({_expected})::BIGINT AS promised FROM d LEFT JOIN (SELECT base, count(DISTINCT token) AS gn FROM g GROUP BY base) t ON d.base = t.base)
    SELECT base, promised AS expected, observed, 'count' AS kind FROM j WHERE promised > 0 AND observed < promised
    UNION ALL SELECT base, own, observed, 'connector' FROM j WHERE regexp_matches(description, '(?i){N.CONNECTOR_WORDS}') AND observed > 0 AND observed < own * 0.5""", VIEWS)  # fmt: skip
