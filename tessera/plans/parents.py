"""Queries of the parts that groups of pin labels belong to, from bodies, designators, the pin list and the BOM's pages."""

from __future__ import annotations

from tessera.operators import adaptive as AD
from tessera.operators import pages as A
from tessera.operators import parents as R
from tessera.plans import duck_expr as D
from tessera.plans import page_geometry as PG
from tessera.plans import qualification as QP
from tessera.plans.audits import BA
from tessera.plans.registry import add

VIEWS = (*PG.VIEWS, *QP.VIEWS, "v_bom")
#: Entries (en), their pin labels (el), boxes of groups (gb), and the pages of parts by the BOM (hm).
_entries = f"""{BA}, en AS (SELECT page, grp, word, x, y, txt, {D.valid('txt')} AND {D.known('txt')} AND NOT regexp_matches(txt, '(?i)^P([0-9]+([.][0-9]+)?V|[0-9]V[0-9])\\b') AS part FROM v_entry),
el AS (SELECT page, grp, word, x, y, txt FROM en WHERE NOT part AND length(txt) <= 4 AND regexp_matches(txt, '^[A-Za-z0-9]+(/[A-Za-z0-9]+)?$') AND NOT regexp_matches(txt, '{QP._valued}')),
gb AS (SELECT *, (x0 + x1) / 2 AS gx, (y0 + y1) / 2 AS gy FROM (SELECT page, grp, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM en WHERE grp IS NOT NULL GROUP BY 1, 2) q),
hm AS (SELECT {D.strip_instance('token')} AS parent, list(DISTINCT page::BIGINT) AS listed FROM ba WHERE regexp_matches(page, '^[0-9]+$') AND TRY_CAST(page AS BIGINT) BETWEEN 1 AND 9999 GROUP BY 1)"""
_far = "(pow(gx - p.x, 2) + pow(gy - p.y, 2))"
_touch = "g.x0 <= b.x1 AND b.x0 <= g.x1 AND g.y0 <= b.y1 AND b.y0 <= g.y1"
#: Candidates (ca) of groups, each once (cb), with hits and pages (ch), ranked (fp); br has the bodies with names.
_parents = f"""ca AS (SELECT page, grp, parent, 0 AS source, d FROM (SELECT g.page, grp, {D.strip_instance('refdes')} AS parent, pow(gx - (b.x0 + b.x1) / 2, 2) + pow(gy - (b.y0 + b.y1) / 2, 2) AS d,
    row_number() OVER (PARTITION BY g.page, grp, {D.strip_instance('refdes')} ORDER BY (b.x1 - b.x0) * (b.y1 - b.y0), refdes) AS rn FROM gb g JOIN br b ON g.page = b.page AND {_touch}) q WHERE rn = 1
    UNION ALL SELECT g.page, g.grp, {D.strip_instance('p.txt')}, 1, min({_far} * CASE WHEN p.x < gx AND p.y < gy THEN 0.8 WHEN p.x > gx AND p.y > gy THEN 1.4 ELSE 1 END) FROM gb g JOIN en p ON g.page = p.page AND p.part AND {_far} <= 250000 GROUP BY 1, 2, 3),
cb AS (SELECT page, grp, parent, min(source) AS source, min_by(d, source) AS d FROM ca GROUP BY 1, 2, 3),
ig AS (SELECT DISTINCT regexp_extract(pin, '^(.+)-([^-]+)$', 2) AS label, regexp_extract(pin, '^(.+)-([^-]+)$', 1) AS parent FROM v_pinlist),
hi AS (SELECT el.page, el.grp, cb.parent, count(*) AS hits FROM el JOIN cb ON cb.page = el.page AND cb.grp = el.grp JOIN ig ON ig.parent = cb.parent AND ig.label = upper(el.txt) GROUP BY 1, 2, 3),
ch AS (SELECT cb.*, coalesce(hits, 0) AS hits, CASE WHEN listed IS NULL OR list_contains(listed, page + 1) THEN 0 ELSE 1 END AS away FROM cb LEFT JOIN hi USING (page, grp, parent) LEFT JOIN hm USING (parent)),
fp AS (SELECT *, count(*) OVER (PARTITION BY page, grp) AS candidates, row_number() OVER (PARTITION BY page, grp ORDER BY hits DESC, away, source, round(d, 6), parent) AS rn FROM ch)"""
#: Pins with bodies (cm), those that have a label's text (dc), ranked (dk).
_choice = f"""cm AS (SELECT mp.page, pin, label, "full", split_part(pin, '_pin_', 2)::BIGINT AS n, x0, y0, x1, y1, coalesce(list_contains(listed, mp.page + 1), false) AS home FROM mp JOIN br USING (page, refdes) LEFT JOIN hm ON hm.parent = {D.strip_instance('refdes')}),
dc AS (SELECT el.page, el.grp, word, pin, "full", n, home, CASE WHEN (b.x0 + b.x1) / 2 BETWEEN g.x0 AND g.x1 AND (b.y0 + b.y1) / 2 BETWEEN g.y0 AND g.y1 THEN 0 WHEN {_touch} THEN 1 ELSE 2 END AS tier,
    pow(el.x - (b.x0 + b.x1) / 2, 2) + pow(el.y - (b.y0 + b.y1) / 2, 2) AS d FROM el JOIN cm b ON b.page = el.page AND b.label = el.txt JOIN gb g ON g.page = el.page AND g.grp = el.grp),
dk AS (SELECT *, CASE WHEN homes > 0 THEN homes ELSE n_all END AS candidates FROM (SELECT *, count(*) OVER (PARTITION BY word) AS n_all, count(*) FILTER (home) OVER (PARTITION BY word) AS homes,
    row_number() OVER (PARTITION BY word ORDER BY NOT home, tier, CASE WHEN tier = 2 THEN d ELSE 0 END, n) AS rn FROM dc) q WHERE rn = 1)"""
_found = lambda v: A.mapped(PG.found(v))


def _group_parents(v):
    return R.parents_of(R.read(v.v_entry), A.body_rects(_found(v)[1]), v.v_pinlist, R.listed_pages(v.v_bom))


add("sj_parent", _group_parents,
    f"{PG._base}, {_entries}, {_parents} SELECT page, grp, parent, hits, candidates, CASE source WHEN 0 THEN 'body' ELSE 'text' END AS source FROM fp WHERE rn = 1", VIEWS)


def _pins_chosen(v):
    maps, named = _found(v)
    return R.chosen_pins(R.read(v.v_entry), maps, A.body_rects(named), R.listed_pages(v.v_bom))


add("sj_disambiguate", _pins_chosen,
    f"""{PG._base}, {_entries}, {_choice} SELECT page, grp, word, pin, "full", CASE WHEN candidates = 1 THEN 'only' WHEN tier = 0 THEN 'inside' WHEN tier = 1 THEN 'overlapping' ELSE 'nearest' END AS tier, candidates FROM dk""", VIEWS)

#: Labels by geometry (lt), on the pages chosen and looked up in the pin list (ls).
_late = f"""bt AS (SELECT word, boxed FROM (SELECT el.word, upper(p.txt) AS boxed, row_number() OVER (PARTITION BY el.word ORDER BY pow(el.x - p.x, 2) + pow(el.y - p.y, 2), p.word) AS rn
    FROM el JOIN gb g ON g.page = el.page AND g.grp = el.grp JOIN en p ON p.page = el.page AND p.part AND p.x BETWEEN g.x0 AND g.x1 AND p.y BETWEEN g.y0 AND g.y1) q WHERE rn = 1),
lt AS (SELECT el.page, el.word, txt, coalesce("full", f.parent || '-' || txt, boxed || '-' || txt, 'PIN-' || txt) AS value, coalesce({D.prefix('coalesce("full", f.parent)')} IN ({D.NO_PINS}), false) AS passive,
    CASE WHEN "full" IS NOT NULL THEN 'geometry' WHEN f.parent IS NOT NULL THEN 'parent' WHEN boxed IS NOT NULL THEN 'box text' ELSE 'unqualified' END AS how
    FROM el LEFT JOIN dk ON dk.word = el.word LEFT JOIN fp f ON f.page = el.page AND f.grp = el.grp AND f.rn = 1 LEFT JOIN bt ON bt.word = el.word WHERE el.page IN (SELECT page FROM rk)),
ls AS (SELECT lt.*, ig.label IS NOT NULL AS known FROM (SELECT *, {D.strip_instance("regexp_extract(value, '^(.+)-[^-]+$', 1)")} AS ref FROM lt) lt LEFT JOIN ig ON ig.parent = ref AND ig.label = upper(txt))"""
add("sp_adaptive", lambda v: AD.extracted(v.v_entry, v.v_pinlist, v.v_bom, v.v_drawing, v.v_token, PG._pages(v)),
    f"""{PG.both_bases}, {PG.counted}, {_entries}, {_parents}, {_choice}, {_late} SELECT lb.page, lb.grp, lb.word, CASE WHEN drop_reason IS NULL THEN cs.parent || '-' || lb.label WHEN kind <> 'passive_like' AND NOT passive AND known THEN value END AS value,
    CASE WHEN drop_reason IS NULL THEN 'pin list' WHEN kind = 'passive_like' THEN 'suppressed' WHEN ls.word IS NULL THEN 'dropped' WHEN passive THEN 'passive prefix' WHEN known THEN how ELSE 'filtered' END AS source
    FROM lb JOIN cs ON cs.cluster = lb.cluster LEFT JOIN ls ON ls.word = lb.word""", VIEWS)  # fmt: skip
