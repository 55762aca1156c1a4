"""Queries of pin clusters and of the parents that a pin list gives them."""

from __future__ import annotations

from tessera.functions import tokens as T
from tessera.operators import qualify as Q
from tessera.plans import duck_expr as D
from tessera.plans.registry import add

_parents = ", ".join(f"'{p}'" for p in T.PARENT_PREFIXES)
_value = "(?i)^([0-9]+([.][0-9]+)?[munpkMG]?[FfHhVvAaWwRrΩ]+|[0-9]+([.][0-9]+)?(uF|nF|pF|mF|uH|nH|mH|ohm|k|meg))$"
_valued = "(?i)^[0-9]+([.][0-9]+)?([VAKMRUNPF]|OHM|HZ|MHZ|UF|NF|PF|UH|MH)$"
#: Entries, pin labels, clusters by reach over pairs in neighbouring cells, kinds, votes; ``of`` has one row for each cluster.
base = f"""WITH RECURSIVE e AS (SELECT *, {D.valid('txt')} AND {D.known('txt')} AS part, {D.prefix('txt')} AS pfx FROM v_entry),
p AS (SELECT page, grp, word, x, y, upper(txt) AS label FROM e WHERE NOT part AND length(txt) <= 4 AND regexp_matches(txt, '^[A-Za-z0-9]+(/[A-Za-z0-9]+)?$') AND NOT regexp_matches(txt, '{_valued}')),
links AS (SELECT a.word AS u, b.word AS v FROM p a JOIN p b ON a.page = b.page AND a.grp = b.grp AND a.word <> b.word
    AND abs(floor(a.x / 120) - floor(b.x / 120)) <= 1 AND abs(floor(a.y / 120) - floor(b.y / 120)) <= 1 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 150),
reach AS (SELECT word AS a, word AS b FROM p UNION SELECT r.a, l.v FROM reach r JOIN links l ON l.u = r.b),
cl AS (SELECT a AS word, min(b) AS cluster FROM reach GROUP BY a),
lb AS (SELECT p.*, cluster FROM p JOIN cl USING (word)),
passive AS (SELECT page, x, y FROM e WHERE (part AND pfx IN ({D.NO_PINS})) OR (NOT part AND regexp_matches(txt, '{_value}'))),
beside AS (SELECT DISTINCT cluster FROM lb JOIN passive q ON lb.page = q.page AND sqrt(pow(lb.x - q.x, 2) + pow(lb.y - q.y, 2)) <= 120),
owned AS (SELECT DISTINCT page, grp FROM e WHERE part AND pfx IN ({_parents})),
sets AS (SELECT page, grp, cluster, count(DISTINCT label) AS n_labels, bool_and(regexp_matches(label, '^[0-9]+$')) AS num, bool_and(label IN ('1', '2')) AS terminals FROM lb GROUP BY 1, 2, 3),
kinds AS (SELECT page, grp, cluster, n_labels, num, CASE WHEN terminals THEN CASE WHEN (page, grp) IN (SELECT (page, grp) FROM owned) THEN 'ambiguous' ELSE 'passive_like' END WHEN n_labels >= 4 THEN 'ic_like'
    WHEN cluster IN (SELECT cluster FROM beside) AND num AND n_labels <= 2 THEN 'passive_like' WHEN cluster IN (SELECT cluster FROM beside) THEN 'ambiguous' ELSE 'ic_like' END AS kind FROM sets),
box AS (SELECT page, grp, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM e GROUP BY 1, 2),
near AS (SELECT DISTINCT b.page, b.grp, upper(r.txt) AS parent FROM box b JOIN e r ON r.page = b.page AND r.part AND r.pfx IN ({_parents})
    AND sqrt(pow(greatest(b.x0 - r.x, 0, r.x - b.x1), 2) + pow(greatest(b.y0 - r.y, 0, r.y - b.y1), 2)) <= 300),
ix AS (SELECT DISTINCT regexp_extract(pin, '^(.+)-([^-]+)$', 2) AS label, regexp_extract(pin, '^(.+)-([^-]+)$', 1) AS parent FROM v_pinlist),
act AS (SELECT DISTINCT page, grp, cluster, label FROM lb WHERE cluster IN (SELECT cluster FROM kinds WHERE kind <> 'passive_like')),
votes AS (SELECT act.page, act.grp, cluster, near.parent, count(*) AS hits FROM act JOIN near USING (page, grp) JOIN ix ON ix.label = act.label AND ix.parent = near.parent GROUP BY 1, 2, 3, 4),
top AS (SELECT cluster, max(hits) AS hits FROM votes GROUP BY 1),
best AS (SELECT cluster, top.hits, count(*) AS n, min(parent) AS parent FROM votes JOIN top USING (cluster, hits) GROUP BY 1, 2),
res AS (SELECT act.cluster, CASE WHEN n = 1 THEN any_value(best.parent) END AS parent, coalesce(best.hits, 0) AS hits,
    CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous_tie' WHEN bool_or(label IN (SELECT label FROM ix WHERE {D.prefix('parent')} IN ({_parents}))) THEN 'no_nearby_candidates' ELSE 'no_hits' END AS status
    FROM act LEFT JOIN best USING (cluster) GROUP BY act.cluster, best.hits, n),
cs AS (SELECT kinds.*, parent, hits, status, CASE WHEN kind = 'passive_like' THEN 'passive_cluster' WHEN status = 'ambiguous_tie' THEN 'ambiguous_tie' WHEN parent IS NULL THEN 'no_parent_resolved'
    WHEN kind = 'ambiguous' AND hits < 2 THEN 'ambiguous_low_hits' WHEN kind = 'ambiguous' AND num AND hits < 3 THEN 'ambiguous_numeric' END AS drop_reason FROM kinds LEFT JOIN res USING (cluster))"""
VIEWS = ("v_entry", "v_pinlist")
_clusters = lambda v: Q.qualified_clusters(v.v_entry, v.v_pinlist)[1]


def _kinds(v):
    entries = Q.marked(v.v_entry)
    return Q.classified(Q.clusters_of(entries), entries).select("cluster", "n_labels", "kind")



add("sp_qualify", lambda v: Q.qualify(v.v_entry, v.v_pinlist),
    f"{base} SELECT lb.page, lb.grp, word, label, lb.cluster, kind, CASE WHEN drop_reason IS NULL THEN parent END AS parent, kind = 'passive_like' AS suppressed, CASE WHEN kind <> 'passive_like' THEN drop_reason END AS drop_reason FROM lb JOIN cs USING (cluster)", VIEWS)
add("sp_cluster_class", _kinds, f"{base} SELECT cluster, n_labels, kind FROM kinds", VIEWS)
add("sp_resolve_parent", lambda v: _clusters(v).filter("status IS NOT NULL").select("cluster", "parent", "hits", "status"), f"{base} SELECT cluster, parent, hits, status FROM res", VIEWS)
add("sp_accept", lambda v: _clusters(v).select("cluster", "kind", "drop_reason"), f"{base} SELECT cluster, kind, drop_reason FROM cs", VIEWS)
add("agg_pinlist_index", lambda v: Q.pinlist_index(v.v_pinlist), "SELECT DISTINCT regexp_extract(pin, '^(.+)-([^-]+)$', 2) AS label, regexp_extract(pin, '^(.+)-([^-]+)$', 1) AS parent FROM v_pinlist", VIEWS)
