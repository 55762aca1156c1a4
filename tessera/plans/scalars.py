"""Queries of the scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import labels as L
from tessera.functions import numeric as N
from tessera.functions import tokens as T
from tessera.plans import duck_expr as D
from tessera.plans.registry import add



def _one(name, view, column, spark, sql):
    """k and one value of a function over a column of a view."""
    add(name, lambda v: getattr(v, view).select("k", spark(F.col(column)).alias("value")), f"SELECT k, {sql} AS value FROM {view}", (view,))


_one("fn_canonicalize", "v_tok", "tok", T.canonical, D.canon("tok"))
_one("fn_clean", "v_tok", "tok", T.clean, D.trim("tok"))
_one("fn_base", "v_tok", "tok", T.base, D.base("tok"))
_one("fn_usage_base", "v_tok", "tok", T.usage_base, D.usage_base("tok"))
_one("fn_prefix", "v_tok", "tok", T.prefix, D.prefix("tok"))
_one("fn_norm_lookup", "v_tok", "tok", T.lookup_key, D.lookup("tok"))
_one("fn_strip_instance", "v_tok", "tok", T.strip_instance, D.strip_instance("tok"))
_one("fn_strip_suffix", "v_tok", "tok", T.strip_instance, D.strip_instance("tok"))
_one("fn_canonical_pn", "v_tok", "tok", T.part_number, "regexp_replace(upper(tok), '[^A-Z0-9]', '', 'g')")
_one("fn_identity_upper", "v_tok", "tok", T.identity_text, f"upper({D.trim('tok')})")
_one("fn_coverage_norm", "v_tok", "tok", T.coverage_key, f"CASE WHEN regexp_matches({D.usage_base('tok')}, '[0-9]') THEN {D.usage_base('tok')} ELSE '' END")
_one("fn_pin_id", "v_tok", "tok", T.pin_id, "regexp_replace(regexp_replace(upper(tok), '\\s+', '', 'g'), '^(.+)[-.:]([^-.:]+)$', '\\1-\\2')")
_one(
    "fn_norm_bom_token", "v_tok", "tok", T.bom_token,
    f"CASE WHEN {D.valid(D.canon('tok'))} THEN {D.strip_instance(D.canon('tok'))} WHEN {D.valid('split_part(' + D.canon('tok') + ', ' + chr(39) + '-' + chr(39) + ', 1)')} "
    f"THEN {D.strip_instance('split_part(' + D.canon('tok') + ', ' + chr(39) + '-' + chr(39) + ', 1)')} ELSE '' END",
)
_one(
    "fn_verif_base", "v_tok", "tok", T.verification_base,
    f"CASE WHEN starts_with(upper({D.trim('tok')}), 'PIN-') THEN NULL ELSE regexp_replace(split_part(upper({D.trim('tok')}), '-', 1), '([0-9])[A-Z]+$', '\\1') END",
)
_one("fn_extract_base", "v_text", "txt", T.find_base, "upper(regexp_extract(txt, '(?i)\\b([A-Z]{1,6}[0-9]{1,5}[A-Z]?)\\b', 1))")
_one("fn_extract_instance", "v_text", "txt", T.find_instance, "upper(regexp_extract(txt, '(?i)\\b(?:[A-Z0-9]+(?:-[A-Z0-9/]+)+|[A-Z]{1,6}[0-9]{1,5}[A-Z]?)\\b', 0))")
_one("fn_split", "v_cell", "cell", lambda c: F.array_join(T.split_list(c), "|"), f"array_to_string({D.tokens('cell')}, '|')")
_one("fn_row_tokens", "v_cell", "cell", lambda c: F.size(T.split_list(c)).cast("long"), f"len({D.tokens('cell')})::BIGINT")
_one(
    "fn_refdes_count", "v_cell", "cell", lambda c: T.designator_count(c).cast("long"),
    f"len(list_filter({D.tokens('cell')}, lambda y: regexp_extract(y, '^([A-Z]+)', 1) IN ({D.KNOWN})))::BIGINT",
)
_range = "regexp_extract({c}, '^([A-Z]+)([0-9]+)\\s*(?:-|–|—|\\.\\.)\\s*([A-Z]+)?([0-9]+)$', {k})"


def _part(k):
    return _range.format(c="c", k=k)


add(
    "fn_expand_range", lambda v: v.v_tok.select("k", F.array_join(T.expand_range(F.col("tok")), "|").alias("value")),
    f"""WITH c AS (SELECT k, {D.canon('tok')} AS c FROM v_tok), p AS (SELECT k, c, {_part(1)} AS p1, {_part(2)} AS n1, {_part(3)} AS p2, {_part(4)} AS n2 FROM c)
    SELECT k, CASE WHEN p1 <> '' AND p2 IN ('', p1) AND TRY_CAST(n1 AS BIGINT) <= TRY_CAST(n2 AS BIGINT) AND TRY_CAST(n2 AS BIGINT) - TRY_CAST(n1 AS BIGINT) < 5000 AND NOT {D.instance('c')}
    THEN array_to_string(list_transform(range(TRY_CAST(n1 AS BIGINT), TRY_CAST(n2 AS BIGINT) + 1), lambda i: p1 || lpad(i::VARCHAR, greatest(length(n1), length(i::VARCHAR))::INTEGER, '0')), '|')
    ELSE c END AS value FROM p""",
    ("v_tok",),
)
add("lim_expansion", lambda v: v.v_tok.select("k", F.size(T.expand_range(F.col("tok"), 2)).cast("long").alias("n")),
    f"""WITH c AS (SELECT k, {D.canon('tok')} AS c FROM v_tok), p AS (SELECT k, c, {_part(1)} AS p1, {_part(2)} AS n1, {_part(3)} AS p2, {_part(4)} AS n2 FROM c)
    SELECT k, CASE WHEN p1 <> '' AND p2 IN ('', p1) AND TRY_CAST(n2 AS BIGINT) - TRY_CAST(n1 AS BIGINT) BETWEEN 0 AND 1 AND NOT {D.instance('c')} THEN TRY_CAST(n2 AS BIGINT) - TRY_CAST(n1 AS BIGINT) + 1 ELSE 1 END AS n FROM p""",
    ("v_tok",))
add("fn_is_suffix", lambda v: v.v_tok.select("k", T.is_suffix_of(F.col("tok"), T.canonical(F.col("ref"))).alias("value")),
    f"SELECT k, {D.suffix('c', 'ref')} AS value FROM (SELECT k, ref, {D.canon('tok')} AS c FROM v_tok) q", ("v_tok",))
_one("fn_failure_mode_id", "v_part", "p_name", T.failure_mode_key, "upper(regexp_replace(p_name, '\\s+', ' ', 'g'))")
_one("fn_sanitize_xml", "v_part", "p_name", T.printable, "p_name")
_one("fn_func_base_id", "v_label", "label", T.function_base, f"regexp_replace(upper({D.trim('label')}), '-([A-Z]|FM[0-9]+)$', '')")
_pairs = "(CASE k % 4 WHEN 0 THEN CAST(k AS VARCHAR(20)) WHEN 1 THEN CAST(k AS VARCHAR(20)) || '.0' WHEN 2 THEN '0' || CAST(k AS VARCHAR(20)) ELSE upper(p_name) END)"
_other = "(CASE k % 4 WHEN 3 THEN p_name ELSE CAST(k AS VARCHAR(20)) END)"
add("fn_value_equal", lambda v: v.v_part.selectExpr("k", f"{_pairs} AS a", f"{_other} AS b").select("k", T.same_value(F.col("a"), F.col("b")).alias("value")),
    "SELECT k, k % 4 <> 2 AS value FROM v_part", ("v_part",))
add("fn_merge_equal",
    lambda v: v.v_num.select("k", F.coalesce(N.number(F.col("txt")) == N.number(F.concat(F.lit("0"), F.col("txt"))), T.clean(F.col("txt")) == T.clean(F.concat(F.lit("0"), F.col("txt")))).alias("value")),
    f"SELECT k, coalesce({D.number('txt')} = {D.number(chr(39) + '0' + chr(39) + ' || txt')}, {D.trim('txt')} = {D.trim(chr(39) + '0' + chr(39) + ' || txt')}) AS value FROM v_num", ("v_num",))
add("fn_fmea_id", lambda v: v.v_part.select("k", T.fmea_id(F.concat(F.lit("BLK-"), F.col("k")), F.col("ref"), T.suffix_letters(F.col("k") % 800)).alias("value")),
    """SELECT k, 'BLK-' || k || '-' || ref || '-' || CASE WHEN n < 26 THEN chr(65 + n) WHEN n < 702 THEN chr(65 + (n - 26) // 26) || chr(65 + (n - 26) % 26)
    ELSE 'A' || chr(65 + (n - 702) // 26) || chr(65 + (n - 702) % 26) END AS value FROM (SELECT k, ref, CAST(k % 800 AS INTEGER) AS n FROM v_part) q""", ("v_part",))  # fmt: skip
add("win_suffix_ordinal", lambda v: v.v_part.select("k", T.suffix_letters(F.col("k") % 800).alias("value")),
    """SELECT k, CASE WHEN n < 26 THEN chr(65 + n) WHEN n < 702 THEN chr(65 + (n - 26) // 26) || chr(65 + (n - 26) % 26) ELSE 'A' || chr(65 + (n - 702) // 26) || chr(65 + (n - 702) % 26) END AS value
    FROM (SELECT k, CAST(k % 800 AS INTEGER) AS n FROM v_part) q""", ("v_part",))  # fmt: skip
_levels = "(CASE k % 6 WHEN 0 THEN 'Circuit Block' WHEN 1 THEN 'CB 4' WHEN 2 THEN 'CBT Capacitor' WHEN 3 THEN 'Piece-Part' WHEN 4 THEN 'pp' ELSE 'PPM' END)"
add("fn_block_text", lambda v: v.v_part.selectExpr("k", f"{_levels} AS t").select("k", T.circuit_block_text(F.col("t")).alias("value")), "SELECT k, k % 6 IN (0, 1) AS value FROM v_part", ("v_part",))
add("fn_pp_text", lambda v: v.v_part.selectExpr("k", f"{_levels} AS t").select("k", T.piece_part_text(F.col("t")).alias("value")), "SELECT k, k % 6 IN (3, 4) AS value FROM v_part", ("v_part",))

# predicates
_one("prd_known_prefix", "v_tok", "tok", lambda c: T.known_prefix(T.prefix(c)), D.known("tok"))
_one("prd_analyze_pins", "v_tok", "tok", lambda c: T.analyze_pins(T.prefix(c)), f"coalesce({D.prefix('tok')} NOT IN ({D.NO_PINS}), true)")
_one("prd_valid_refdes", "v_tok", "tok", T.valid_designator, D.valid("tok"))
_one("prd_pin_notation", "v_tok", "tok", lambda c: T.pin_notation(T.canonical(c)), D.pin(D.canon("tok")))
_one("prd_instance_notation", "v_tok", "tok", lambda c: T.instance_notation(T.canonical(c)), D.instance(D.canon("tok")))
_pin_text = "(CASE k % 7 WHEN 0 THEN 'A1' WHEN 1 THEN '5V' WHEN 2 THEN '10K' WHEN 3 THEN 'A/B' WHEN 4 THEN 'NET_1' WHEN 5 THEN CAST(k % 99 AS VARCHAR(9)) ELSE 'CLOCK' END)"
add("prd_pin_candidate", lambda v: v.v_part.selectExpr("k", f"{_pin_text} AS t").select("k", T.pin_candidate(F.col("t")).alias("value")), "SELECT k, k % 7 IN (0, 3, 5) AS value FROM v_part", ("v_part",))

# labels
_status = "regexp_replace({x}, '(?i)(\\s*\\((UNVERIFIED|VERIFIED|PARTIAL)\\))+$', '')"
_bare = D.trim(_status.format(x=D.trim("label")))
_mode = f"(CASE WHEN {D.trim('regexp_replace(' + _bare + ', ' + chr(39) + '(?i)(-FN|-PN)$' + chr(39) + ', ' + chr(39) * 2 + ')')} = '' THEN {_bare} ELSE {D.trim('regexp_replace(' + _bare + ', ' + chr(39) + '(?i)(-FN|-PN)$' + chr(39) + ', ' + chr(39) * 2 + ')')} END)"
_plain = lambda x: f"upper({D.trim(f'regexp_replace({x}, {chr(39)}[^A-Za-z0-9 _/.-]{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')})"
_class = lambda x: (
    f"(CASE WHEN {x} = '' OR {x} IN ({D.STOPS}) OR length({x}) > 60 OR regexp_matches({x}, '^[0-9]+$') OR regexp_matches({x}, '(?i)^[0-9]+(\\.[0-9]+)?\\s*[VA]$') OR regexp_matches({x}, '^[A-Z]{{1,2}}[0-9]+[A-Z]?$') THEN 'noise' "
    f"WHEN regexp_matches({x}, '[A-Za-z]') AND regexp_matches({x}, '[0-9]') THEN 'strong' WHEN regexp_matches({x}, '[A-Za-z]') AND length({x}) <= 20 THEN 'weak' ELSE 'noise' END)"
)
_one("fn_strip_status", "v_label", "label", L.strip_status, _bare)
_one("fn_strip_mode", "v_label", "label", lambda c: L.strip_mode(L.strip_status(c)), _mode)
_one("fn_strip_mode_label", "v_label", "label", lambda c: L.strip_mode(L.strip_status(c)), _mode)
_one("fn_sanitize_label", "v_label", "label", L.sanitize, _plain("label"))
_one("fn_vu_strip", "v_label", "label", L.without_verified, D.trim("regexp_replace(label, '\\s*\\((Verified|Unverified)\\)$', '')"))
_one("fn_group_mode", "v_label", "label", lambda c: L.group_mode(c, "piece_part"), f"CASE WHEN upper({_bare}) LIKE '%-FN' THEN 'functional' ELSE 'piece_part' END")
_one("prd_group_label", "v_label", "label", lambda c: L.label_class(L.sanitize(c)), _class(f"{_plain('label')}"))
_seq = """CASE WHEN regexp_matches({x}, '^(.+?)([0-9]+([.][0-9]+)+)$') THEN regexp_replace({x}, '[0-9]+$', '') || '|' || regexp_extract({x}, '[.]([0-9]+)$', 1)::BIGINT || '|' || length(regexp_extract({x}, '[.]([0-9]+)$', 1)) || '|dotted'
WHEN regexp_matches({x}, '^(.+?)([0-9]{{2,}})$') THEN regexp_extract({x}, '^(.+?)([0-9]{{2,}})$', 1) || '|' || regexp_extract({x}, '^(.+?)([0-9]{{2,}})$', 2)::BIGINT || '|' || length(regexp_extract({x}, '^(.+?)([0-9]{{2,}})$', 2)) || '|plain' END"""


def _sequence_text(s):
    return F.when(s.isNotNull(), F.concat_ws("|", s["prefix"], s["number"], s["width"], s["kind"]))


_one("fn_sequence", "v_label", "label", lambda c: _sequence_text(L.sequence(L.sanitize(L.strip_status(c)))), _seq.format(x=_plain(_bare)))
add(
    "fn_partition_id",
    lambda v: v.v_label.select("k", L.partition_id(F.col("label"), modes=True).alias("p")).select("k", F.col("p.label").alias("label"), F.col("p.mode").alias("mode"), F.col("p.class").alias("class"), _sequence_text(F.col("p.sequence")).alias("sequence")),
    f"SELECT k, label2 AS label, upper(regexp_extract(bare, '(?i)(-FN|-PN)$', 1)) AS mode, {_class('label2')} AS class, {_seq.format(x='label2')} AS sequence FROM (SELECT k, {_bare} AS bare, {_plain(_mode)} AS label2 FROM v_label) q",
    ("v_label",),
)
_one("fn_ordinal", "v_part", "k", L.ordinal, "k || CASE WHEN k % 100 BETWEEN 11 AND 13 THEN 'th' WHEN k % 10 = 1 THEN 'st' WHEN k % 10 = 2 THEN 'nd' WHEN k % 10 = 3 THEN 'rd' ELSE 'th' END")

# numbers
_frac = "'(?i)^([0-9]+(?:\\.[0-9]+)?)\\s*(?:/|of)\\s*([0-9]+(?:\\.[0-9]+)?)$'"
_usage_value = f"CASE WHEN txt = '' THEN 1.0::DOUBLE WHEN regexp_matches(txt, {_frac}) THEN TRY_CAST(regexp_extract(txt, {_frac}, 1) AS DOUBLE) / nullif(TRY_CAST(regexp_extract(txt, {_frac}, 2) AS DOUBLE), 0) ELSE {D.number('txt')} END"
add("fn_parse_usage", lambda v: v.v_num.select("k", N.parse_usage(F.col("txt")).alias("u")).select("k", F.col("u.value").alias("value"), F.col("u.text").alias("formula")),
    f"""SELECT k, {_usage_value} AS value, CASE WHEN txt = '' THEN '1' WHEN regexp_matches(txt, {_frac}) AND TRY_CAST(regexp_extract(txt, {_frac}, 2) AS DOUBLE) <> 0
    THEN '=' || regexp_extract(txt, {_frac}, 1) || '/' || regexp_extract(txt, {_frac}, 2) END AS formula FROM v_num""", ("v_num",))  # fmt: skip
_fin = lambda x: f"coalesce({x} < 'inf'::DOUBLE AND {x} > '-inf'::DOUBLE, false)"
add("fn_fr_clean", lambda v: v.v_num.select("k", N.clean_rate(F.col("txt")).alias("r")).select("k", F.col("r.rate").alias("rate"), F.col("r.flagged").alias("flagged")),
    f"SELECT k, CASE WHEN {_fin('n')} THEN n ELSE 0 END AS rate, txt <> '' AND NOT {_fin('n')} AS flagged FROM (SELECT k, txt, {D.number('txt')} AS n FROM v_num) q", ("v_num",))
add("fn_unit", lambda v: v.v_part.select("k", *(F.round(N.clean_rate(F.col("p_retailprice").cast("string"), u)["rate"] * m, 6).alias(u) for u, m in (("per_hour", 1.0), ("per_million_hours", 1e6), ("per_billion_hours", 1e9)))),
    "SELECT k, round(p_retailprice, 6) AS per_hour, round(p_retailprice, 6) AS per_million_hours, round(p_retailprice, 6) AS per_billion_hours FROM v_part", ("v_part",))
_cu = f"CASE WHEN n IS NULL OR NOT {_fin('n')} OR n <= 0 OR n > 1e6 THEN 1.0 ELSE n END"
add("fn_usage_clean", lambda v: v.v_num.select("k", N.clean_usage(F.col("txt"), F.col("rate")).alias("u")).select("k", F.col("u.usage").alias("usage"), F.col("u.gap").alias("gap")),
    f"SELECT k, {_cu} AS usage, n IS NULL AND rate > 0 AS gap FROM (SELECT k, rate, {D.number('txt')} AS n FROM v_num) q", ("v_num",))
add("fn_ratio_clean", lambda v: v.v_num.select("k", N.clean_ratio(F.col("txt")).alias("ratio")),
    f"SELECT k, CASE WHEN n IS NULL OR NOT {_fin('n')} OR n < 0 OR n > 10 THEN 1.0 ELSE n END AS ratio FROM (SELECT k, {D.number('txt')} AS n FROM v_num) q", ("v_num",))
add("fn_mode_fr",
    lambda v: v.v_num.select("k", "rate", N.clean_usage(F.col("txt"), F.col("rate")).alias("u"), N.clean_ratio(F.col("txt")).alias("r")).select("k", F.round(F.when(~F.col("u.gap"), F.col("rate") * F.col("u.usage") * F.col("r")), 6).alias("mode_fr")),
    f"SELECT k, round(CASE WHEN NOT (n IS NULL AND rate > 0) THEN rate * {_cu} * CASE WHEN n IS NULL OR NOT {_fin('n')} OR n < 0 OR n > 10 THEN 1.0 ELSE n END END, 6) AS mode_fr FROM (SELECT k, rate, {D.number('txt')} AS n FROM v_num) q",
    ("v_num",))
_words = "CASE " + " ".join(f"WHEN regexp_matches(description, '(?i)\\b{w}\\b') THEN {n}" for w, n in N.MULTIPLIERS)
_expected = _words + (
    f" WHEN regexp_matches(description, '(?i){N.NOT_A_COUNT}') THEN 0 WHEN regexp_matches(description, '(?i)[0-9]+\\s*x\\s*[0-9]+') THEN TRY_CAST(regexp_extract(description, '(?i)([0-9]+)\\s*x\\s*([0-9]+)', 1) AS BIGINT) * TRY_CAST(regexp_extract(description, '(?i)([0-9]+)\\s*x\\s*([0-9]+)', 2) AS BIGINT)"
    f" WHEN regexp_matches(description, '(?i){N.CONNECTOR_WORDS}') THEN coalesce(TRY_CAST(regexp_extract(description, '(?i)([0-9]+)\\s*-?\\s*pins?', 1) AS BIGINT), 0) ELSE 0 END"
)
add("fn_expected_count", lambda v: v.v_bom.select("k", N.expected_count(F.col("description")).alias("expected")), f"SELECT k, ({_expected})::BIGINT AS expected FROM v_bom", ("v_bom",))
_pages = "'Sheet ' || CAST(k % 60 + 1 AS VARCHAR(9)) || '-' || CAST(k % 60 + k % 5 AS VARCHAR(9)) || ', ' || CAST(k % 7 AS VARCHAR(9))"
add("fn_pages", lambda v: v.v_part.selectExpr("k", f"{_pages} AS t").select("k", F.array_join(N.pages(F.col("t")), ",").alias("pages")),
    """SELECT k, array_to_string(list_sort(list_distinct(list_filter(CASE WHEN k % 5 = 0 THEN [k % 60 + 1, k % 60, k % 7] ELSE list_concat(range(k % 60 + 1, k % 60 + k % 5 + 1), [k % 7]) END, lambda p: p BETWEEN 1 AND 9999))), ',') AS pages FROM v_part""", ("v_part",))  # fmt: skip
add("fn_page_csv", lambda v: v.v_part.selectExpr("k", "concat(k % 9, ', ', k % 4, ',', k % 9) AS t").select("k", F.array_join(F.array_sort(F.transform(F.array_distinct(F.split("t", r"\s*,\s*")), lambda p: p.cast("long"))), ", ").alias("pages")),
    "SELECT k, array_to_string(list_sort(list_distinct([k % 9, k % 4])), ', ') AS pages FROM v_part", ("v_part",))
add("fn_min_page", lambda v: v.v_part.selectExpr("k", "CASE WHEN k % 6 = 0 THEN 'none' ELSE concat('p', k % 50 + 2, ', ', k % 11 + 1) END AS t").select("k", F.coalesce(F.array_min(N.pages(F.col("t"))), F.lit(1_000_000_000)).cast("long").alias("page")),
    "SELECT k, CASE WHEN k % 6 = 0 THEN 1000000000 ELSE least(k % 50 + 2, k % 11 + 1) END AS page FROM v_part", ("v_part",))

# geometry
_a, _b = (lambda: G.rect("a_")), (lambda: G.rect("b_"))
#: All pairs of boxes of a page, each once.
_pairs_of_boxes = "SELECT a.box AS a, b.box AS b, a.x0 AS a_x0, a.y0 AS a_y0, a.x1 AS a_x1, a.y1 AS a_y1, b.x0 AS b_x0, b.y0 AS b_y0, b.x1 AS b_x1, b.y1 AS b_y1 FROM v_boxes a JOIN v_boxes b ON a.page = b.page AND a.box < b.box"


def _boxes(v):
    """A merge by page, which holds one page's boxes at a time and spills them if they are many; none is broadcast."""
    named = lambda p: v.v_boxes.select("page", F.col("box").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1")))
    return named("a").join(named("b").hint("merge"), "page").filter("a < b")


_inter = "greatest(0, least(a_x1, b_x1) - greatest(a_x0, b_x0)) * greatest(0, least(a_y1, b_y1) - greatest(a_y0, b_y0))"
_union = f"((a_x1 - a_x0) * (a_y1 - a_y0) + (b_x1 - b_x0) * (b_y1 - b_y0) - {_inter})"
add("fn_iou", lambda v: _boxes(v).select("a", "b", F.round(G.iou(_a(), _b()), 9).alias("iou")), f"WITH p AS ({_pairs_of_boxes}) SELECT a, b, round({_inter} / {_union}, 9) AS iou FROM p", ("v_boxes",))
add("fn_rects", lambda v: _boxes(v).select("a", "b", G.centre(_a())[0].alias("cx"), G.centre(_a())[1].alias("cy"), G.area(_a()).alias("area"), G.intersection(_a(), _b()).alias("both"), G.contains(_b(), *G.centre(_a()), margin=5.0).alias("inside"), F.round(G.distance_to(_b(), *G.centre(_a())), 9).alias("distance")),
    f"""WITH p AS ({_pairs_of_boxes}), c AS (SELECT *, (a_x0 + a_x1) / 2 AS cx, (a_y0 + a_y1) / 2 AS cy FROM p)
    SELECT a, b, cx, cy, (a_x1 - a_x0) * (a_y1 - a_y0) AS area, ({_inter})::DOUBLE AS both, cx BETWEEN b_x0 - 5 AND b_x1 + 5 AND cy BETWEEN b_y0 - 5 AND b_y1 + 5 AS inside,
    round(sqrt(pow(greatest(b_x0 - cx, 0, cx - b_x1), 2) + pow(greatest(b_y0 - cy, 0, cy - b_y1), 2)), 9) AS distance FROM c""", ("v_boxes",))  # fmt: skip
add("fn_pin_score", lambda v: _boxes(v).select("a", "b", F.round(G.pin_score(_a(), _b()), 9).alias("score")),
    f"""WITH p AS ({_pairs_of_boxes}) SELECT a, b, round(0.7 * least(1, greatest(0, least(a_y1, b_y1) - greatest(a_y0, b_y0)) / greatest(a_y1 - a_y0, 1)) - 0.3 * least(1, greatest(b_x0 - a_x1, a_x0 - b_x1, 0) / 50), 9) AS score FROM p""", ("v_boxes",))
add("fn_bias_distance", lambda v: _boxes(v).select("a", "b", F.round(G.biased_distance(F.col("a_x0"), F.col("a_y0"), *G.centre(_b())), 9).alias("distance")),
    f"""WITH p AS ({_pairs_of_boxes}), c AS (SELECT *, (b_x0 + b_x1) / 2 AS cx, (b_y0 + b_y1) / 2 AS cy FROM p)
    SELECT a, b, round(sqrt(pow(a_x0 - cx, 2) + pow(a_y0 - cy, 2)) * CASE WHEN a_x0 <= cx AND a_y0 <= cy THEN 0.8 ELSE 1 END, 9) AS distance FROM c""", ("v_boxes",))  # fmt: skip
add("fn_cells_radius", lambda v: v.v_boxes.select("box", F.explode(G.cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 120.0)).alias("c")).select("box", F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy")),
    "WITH x AS (SELECT *, unnest(range(floor(x0 / 120)::BIGINT, floor(x1 / 120)::BIGINT + 1)) AS cx FROM v_boxes) SELECT box, cx, unnest(range(floor(y0 / 120)::BIGINT, floor(y1 / 120)::BIGINT + 1)) AS cy FROM x", ("v_boxes",))
