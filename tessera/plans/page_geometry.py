"""Queries of the page pipeline: primitives, classes, pins, parts, mappings, and the gated run."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cluster as P
from tessera.operators import pages as A
from tessera.operators import qualify as Q
from tessera.operators import spatial as S
from tessera.plans import duck_expr as D
from tessera.plans import qualification as QP
from tessera.plans import scalars as SC
from tessera.plans.registry import add
from tessera.sources.readers import once, report_path

VIEWS = ("v_drawing", "v_token")
_gap = "sqrt(pow(greatest({b}.x0 - {p}.x, 0, {p}.x - {b}.x1), 2) + pow(greatest({b}.y0 - {p}.y, 0, {p}.y - {b}.y1), 2))"
_level, _upright = "p.y BETWEEN b.y0 AND b.y1", "p.x BETWEEN b.x0 AND b.x1"
_far = "'inf'::DOUBLE"
_side = lambda d, ok: f"CASE WHEN {ok} OR NOT ({_level} OR {_upright}) THEN abs({d}) ELSE {_far} END"
_sides = [_side("p.x - b.x0", _level), _side("p.x - b.x1", _level), _side("p.y - b.y0", _upright), _side("p.y - b.y1", _upright)]
_nearest = f"least({', '.join(_sides)})"
_edge = f"CASE {_nearest} WHEN {_sides[0]} THEN 'left' WHEN {_sides[1]} THEN 'right' WHEN {_sides[2]} THEN 'top' ELSE 'bottom' END"
_to_edge = f"CASE WHEN {_level} OR {_upright} THEN {_nearest} ELSE {_gap.format(b='b', p='p')} END"


def _suppressed(rects: str, page: str, box: str) -> str:
    """The rectangles kept page by page: each is compared with the list of those kept before it."""
    both = "greatest(0, least(q.x1, r.x1) - greatest(q.x0, r.x0)) * greatest(0, least(q.y1, r.y1) - greatest(q.y0, r.y0))"
    return f"""nr AS (SELECT {page} AS page, {box} AS box, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS a, row_number() OVER (PARTITION BY {page} ORDER BY (x1 - x0) * (y1 - y0) DESC, {box}) AS n FROM {rects}),
nk AS (SELECT page, 1::BIGINT AS n, [{{'box': box, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'a': a}}] AS kept FROM nr WHERE n = 1
    UNION ALL SELECT k.page, r.n, CASE WHEN len(list_filter(kept, lambda q: {both} > 0.8 * (q.a + r.a - {both}))) > 0 THEN kept ELSE list_append(kept, {{'box': r.box, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1, 'a': r.a}}) END
    FROM nk k JOIN nr r ON r.page = k.page AND r.n = k.n + 1),
nb AS (SELECT page, k.box AS body, k.x0 AS x0, k.y0 AS y0, k.x1 AS x1, k.y1 AS y1, k.a AS a FROM (SELECT page, unnest(arg_max(kept, n)) AS k FROM nk GROUP BY page) z)"""


_base = f"""WITH RECURSIVE re AS (SELECT page, item, least(x0, x1) AS x0, least(y0, y1) AS y0, greatest(x0, x1) AS x1, greatest(y0, y1) AS y1 FROM v_drawing WHERE kind = 're'),
rf AS (SELECT * FROM re WHERE x1 - x0 BETWEEN 20 AND 500 AND y1 - y0 BETWEEN 20 AND 500 AND (x1 - x0) / (y1 - y0) BETWEEN 0.3 AND 3),
{_suppressed('rf', 'page', 'item')},
li AS (SELECT page, item, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM v_drawing WHERE kind = 'l' AND sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) BETWEEN 2 AND 25),
ci AS (SELECT page, item, x0 AS x, y0 AS y FROM v_drawing WHERE kind = 'c' AND radius BETWEEN 1 AND 8),
tk AS (SELECT p.*, b.body, b.a, CASE WHEN abs(p.x - b.x0) < 5 AND {_level} THEN 'left' WHEN abs(p.x - b.x1) < 5 AND {_level} THEN 'right' WHEN abs(p.y - b.y0) < 5 AND {_upright} THEN 'top' WHEN abs(p.y - b.y1) < 5 AND {_upright} THEN 'bottom' END AS side FROM li p JOIN nb b USING (page)),
bl AS (SELECT p.*, b.body, b.a, {_edge} AS side FROM ci p JOIN nb b USING (page) WHERE {_to_edge} < 15),
dp AS (SELECT page, 'tick' AS kind, item, x, y, side FROM (SELECT *, row_number() OVER (PARTITION BY page, item ORDER BY a DESC, body) AS rn FROM tk WHERE side IS NOT NULL) q WHERE rn = 1
    UNION ALL SELECT page, 'ball', item, x, y, side FROM (SELECT *, row_number() OVER (PARTITION BY page, item ORDER BY a DESC, body) AS rn FROM bl) q WHERE rn = 1),
we AS (SELECT page, item, unnest([x0, x1]) AS x, unnest([y0, y1]) AS y FROM v_drawing WHERE kind = 'l' AND sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) >= 50),
nt AS (SELECT p.*, EXISTS (SELECT 1 FROM nb b WHERE b.page = p.page AND {_gap.format(b='b', p='p')} <= 50) AS by_body, EXISTS (SELECT 1 FROM we w WHERE w.page = p.page AND pow(p.x - w.x, 2) + pow(p.y - w.y, 2) < 400) AS by_wire FROM v_token p),
np AS (SELECT *, NOT contains(txt, '_') AND NOT regexp_matches(txt, '(?i)^[0-9]+([.][0-9]+)?([VAKMRUNPF]|OHM|HZ|MHZ|UF|NF|PF|UH|MH)$') AND length(txt) <= 4 AND regexp_matches(txt, '^[A-Za-z0-9]+$') AS pin,
    upper(txt) = txt AND lower(txt) <> txt AND length(txt) >= 3 AND by_wire AS net FROM nt),
tc AS (SELECT page, word, x, y, txt, CASE WHEN contains(txt, '_') THEN CASE WHEN net THEN 'NET_LABEL' ELSE 'JUNK' END WHEN regexp_matches(txt, '(?i)^P(IN)?[-_]?[0-9]+$') THEN 'PIN_LABEL'
    WHEN {D.valid('txt')} AND {D.known('txt')} THEN CASE WHEN pin AND by_body THEN 'PIN_LABEL' ELSE 'REFDES' END WHEN pin AND by_body THEN 'PIN_LABEL' WHEN net THEN 'NET_LABEL' ELSE 'JUNK' END AS class,
    CASE WHEN contains(txt, '_') THEN CASE WHEN net THEN 0.7 ELSE 0 END WHEN regexp_matches(txt, '(?i)^P(IN)?[-_]?[0-9]+$') THEN 0.85
    WHEN {D.valid('txt')} AND {D.known('txt')} THEN CASE WHEN pin AND by_body THEN 0.7 ELSE 0.9 END WHEN pin AND by_body THEN 0.75 WHEN net THEN 0.7 ELSE 0 END::DOUBLE AS confidence FROM np),
tp AS (SELECT * FROM (SELECT p.*, {_edge} AS side, row_number() OVER (PARTITION BY p.word ORDER BY round({_to_edge}, 9), b.a DESC, b.body) AS rn FROM tc p JOIN nb b USING (page) WHERE class = 'PIN_LABEL' AND round({_to_edge}, 9) < 50) q WHERE rn = 1),
pn AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY rank, item) - 1 AS n FROM (SELECT page, CASE kind WHEN 'tick' THEN 0 ELSE 1 END AS rank, item, NULL AS label, 0.5::DOUBLE AS confidence, x, y, side FROM dp
    UNION ALL SELECT page, 2, word, txt, confidence, x, y, side FROM tp) q),
sc AS (SELECT p.page, p.n, b.body, b.a, {_level} AND {_upright} AS inside, round(0.7 * CASE WHEN greatest(b.y0 - p.y, p.y - b.y1) <= 0.5 THEN 1 ELSE greatest(0, 1 - greatest(b.y0 - p.y, p.y - b.y1) / (b.y1 - b.y0)) END
    - 0.3 * CASE p.side WHEN 'left' THEN abs(p.x - b.x0) WHEN 'right' THEN abs(p.x - b.x1) ELSE least(abs(p.x - b.x0), abs(p.x - b.x1)) END / (b.x1 - b.x0), 9) AS score FROM pn p JOIN nb b USING (page) WHERE {_gap.format(b='b', p='p')} <= 50),
pa AS (SELECT page, n, body FROM (SELECT *, row_number() OVER (PARTITION BY page, n ORDER BY NOT inside, CASE WHEN inside THEN a ELSE -score END, CASE WHEN inside THEN 0 ELSE -a END, body) AS rn FROM sc WHERE inside OR score > 0) q WHERE rn = 1),
rd AS (SELECT b.page, b.body, p.word, p.txt, greatest(100, 0.3 * sqrt(pow(b.x1 - b.x0, 2) + pow(b.y1 - b.y0, 2))) AS reach, round(sqrt(pow(p.x - (b.x0 + b.x1) / 2, 2) + pow(p.y - (b.y0 + b.y1) / 2, 2)) * CASE WHEN p.x < (b.x0 + b.x1) / 2 AND p.y < (b.y0 + b.y1) / 2 THEN 0.8 ELSE 1 END, 9) AS d FROM nb b JOIN tc p USING (page) WHERE class = 'REFDES'),
nm AS (SELECT page, body, txt AS refdes FROM (SELECT *, row_number() OVER (PARTITION BY page, body ORDER BY d, word) AS rn FROM rd WHERE d < reach) q WHERE rn = 1),
mp AS (SELECT page, 'p' || page || '_pin_' || n AS pin, refdes, coalesce(label, 'PIN' || n) AS label, refdes || '-' || coalesce(label, 'PIN' || n) AS "full", confidence FROM pn JOIN pa USING (page, n) JOIN nm USING (page, body)),
br AS (SELECT page, refdes, x0, y0, x1, y1 FROM (SELECT nb.*, refdes, row_number() OVER (PARTITION BY page, refdes ORDER BY a, nb.body DESC) AS rn FROM nb JOIN nm USING (page, body)) q WHERE rn = 1)"""

found = lambda v: A.extracted(v.v_drawing, v.v_token)
add("sp_nms", lambda v: P.suppress_overlaps(v.v_boxes), f"WITH RECURSIVE {_suppressed('v_boxes', 'page', 'box')} SELECT page, body AS box FROM nb", ("v_boxes",))
add("sp_extract_page", lambda v: A.tagged(found(v)),
    f"""{_base} SELECT page, 'body' AS kind, body AS item, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, NULL::VARCHAR AS value FROM nb UNION ALL SELECT page, kind, item, x, y, side FROM dp
    UNION ALL SELECT page, 'wire', item, x, y, NULL FROM we UNION ALL SELECT page, 'token', word, x, y, class FROM tc""", VIEWS)  # fmt: skip
add("sp_classify", lambda v: found(v)["tokens"].select("word", F.col("class").alias("kind"), "confidence"), f"{_base} SELECT word, class AS kind, confidence FROM tc", VIEWS)

add("sj_box_from_drawing", lambda v: A.labelled_holders(v.v_drawing, v.v_token),
    f"""WITH rc AS (SELECT * FROM (SELECT page, item, least(x0, x1) AS x0, least(y0, y1) AS y0, greatest(x0, x1) AS x1, greatest(y0, y1) AS y1 FROM v_drawing WHERE kind = 're') q WHERE x1 - x0 >= 150 AND y1 - y0 >= 100 AND (x1 - x0) * (y1 - y0) >= 10000),
    tl AS (SELECT * FROM (SELECT page, word, x, y, {SC._plain('txt')} AS label FROM v_token) q WHERE label <> '' AND NOT regexp_matches(label, '^[A-Z]{{1,3}}[0-9]+[A-Z]?$') AND {SC._class('label')} <> 'noise'),
    nl AS (SELECT r.*, label, row_number() OVER (PARTITION BY r.page, item ORDER BY t.y, t.word) AS rn FROM rc r JOIN tl t ON t.page = r.page AND t.x BETWEEN r.x0 AND r.x1 AND t.y BETWEEN r.y0 - 20 AND r.y0 + 30)
    SELECT page, min(item) AS item, label, min_by(x0, item) AS x0, min_by(y0, item) AS y0, min_by(x1, item) AS x1, min_by(y1, item) AS y1 FROM nl WHERE rn = 1 GROUP BY page, label, round_even(x0, 0), round_even(y0, 0), round_even(x1, 0), round_even(y1, 0)""", VIEWS)  # fmt: skip


def _text_pins(v):
    f = found(v)
    return A.text_pins(f["tokens"], f["bodies"]).select("page", "word", F.col("txt").alias("label"), "side")


def _pin_bodies(v):
    f = found(v)
    return A.assigned(A.numbered_pins(f), f["bodies"], ["page", "n"])


def _named_bodies(v):
    f = found(v)
    return A.part_names(f["tokens"], f["bodies"])


add("sp_text_pins", _text_pins, f"{_base} SELECT page, word, txt AS label, side FROM tp", VIEWS)
add("sj_pin_body", _pin_bodies, f"{_base} SELECT page, n, body FROM pa", VIEWS)
add("sj_refdes_body", _named_bodies, f"{_base} SELECT page, body, refdes FROM nm", VIEWS)
add("sp_process_page", lambda v: A.mapped(found(v))[0], f"{_base} SELECT * FROM mp", VIEWS)
add("sp_mappings", lambda v: A.mapped(found(v))[0].select("page", "pin", "full", "confidence"), f'{_base} SELECT page, pin, "full", confidence FROM mp', VIEWS)


#: Pages with drawings, and as many of the first ones again without any.
_pages = lambda v: v.v_drawing.select("page").distinct().unionByName(v.v_drawing.filter("page < 5").select((-1 - F.col("page")).alias("page")).distinct())


def page_counts(v):
    """What the pin list left of the pin labels of each page."""
    return Q.page_features(_pages(v), v.v_entry, v.v_pinlist)


def analysis(v):
    """Stored by page, then the pages whose pin labels the pin list left without parents are read and analyzed."""
    paths = [f"{report_path(v.spark)}/{name}" for name in VIEWS]
    for path, df in zip(paths, (v.v_drawing, v.v_token), strict=True):
        A.store(df, path)
    maps, rects = A.analyzed(v.spark, *paths, gate=S.gated_pages(once(page_counts(v))))
    nothing = F.lit(None).cast("string")
    pins = maps.select("page", F.lit("pin").alias("kind"), F.col("pin").alias("name"), "full", F.lit(None).cast("double").alias("x0"), F.lit(None).cast("double").alias("y1"))
    return pins.unionByName(rects.select("page", F.lit("body").alias("kind"), F.col("refdes").alias("name"), nothing.alias("full"), "x0", "y1"))


#: Pages with counts; ``gt`` has those worth a pass.
counted = """pc AS (SELECT *, pins - parented AS orphans, coalesce((pins - parented) / nullif(pins, 0), 0)::DOUBLE AS ratio FROM (SELECT d.page, count(lb.word) AS pins, count(lb.word) FILTER (drop_reason IS NULL AND parent IS NOT NULL) AS parented,
    count(lb.word) FILTER (status = 'ambiguous_tie') AS tied, count(lb.word) FILTER (regexp_matches(label, '^[A-Z]{1,2}[0-9]{1,2}$')) AS grid
    FROM (SELECT DISTINCT page FROM v_drawing UNION ALL SELECT DISTINCT -1 - page FROM v_drawing WHERE page < 5) d LEFT JOIN lb ON lb.page = d.page LEFT JOIN cs USING (cluster) GROUP BY 1) z),
gt AS (SELECT * FROM pc WHERE pins >= 3 AND orphans >= 5 AND ratio >= 0.30),
rk AS (SELECT page, round(orphans + 100 * ratio + 2 * tied + 0.5 * grid, 9) AS score FROM gt ORDER BY score DESC, page LIMIT 10)"""
PAGES = ("v_drawing", *QP.VIEWS)
_round = lambda df: df.withColumn("ratio", F.round("ratio", 9))
_top = lambda v: S.ranked_pages(S.gated_pages(once(page_counts(v))))
add("agg_page_metrics", lambda v: _round(page_counts(v)), f"{QP.base}, {counted} SELECT page, pins, parented, orphans, round(ratio, 9) AS ratio, tied, grid FROM pc", PAGES)
add("sp_gate", lambda v: S.gated_pages(page_counts(v)).select("page"), f"{QP.base}, {counted} SELECT page FROM gt", PAGES)
add("sp_sparse", lambda v: page_counts(v).filter("pins > 0 AND parented * 2 < pins").select("page"), f"{QP.base}, {counted} SELECT page FROM pc WHERE pins > 0 AND parented * 2 < pins", PAGES)
add("win_rank_pages", lambda v: _top(v).select("page", "score"), f"{QP.base}, {counted} SELECT page, score FROM rk", PAGES)
both_bases = _base.replace("WITH RECURSIVE ", QP.base + ", ", 1)
add("sp_analyze_document", analysis,
    f"""{both_bases}, {counted} SELECT page, 'pin' AS kind, pin AS name, "full", NULL::DOUBLE AS x0, NULL::DOUBLE AS y1 FROM mp WHERE page IN (SELECT page FROM gt)
    UNION ALL SELECT page, 'body', refdes, NULL, x0, y1 FROM br WHERE page IN (SELECT page FROM gt)""", (*VIEWS, *QP.VIEWS))  # fmt: skip
