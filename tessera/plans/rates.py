"""Queries of the failure-rate link and its roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import tokens as T
from tessera.operators import classify as K
from tessera.operators import link as R
from tessera.plans import duck_expr as D
from tessera.plans.registry import add
from tessera.sources.readers import once

VIEWS = ("v_fmea", "v_pred")
rates = lambda v: R.rates(v.v_pred)
linked = lambda v: R.link(K.row_types(v.v_fmea, [], "level", "cause", ["ratio"], "fmea_id"), rates(v))
_rate = f"""ra AS (SELECT {D.lookup('pred_ref')} AS ref, CASE WHEN pred_fr = 'TBD' THEN 0 ELSE TRY_CAST(pred_fr AS DOUBLE) END AS r, pred_fr = 'TBD' AS bad, pred_ref || '=' || pred_fr AS pair FROM v_pred),
rt AS (SELECT ref, max(r)::DOUBLE AS rate, bool_or(bad) AS flagged, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT r) = 1 THEN 'benign' ELSE 'conflict' END AS kind, string_agg(DISTINCT pair, ', ' ORDER BY pair) AS p FROM ra GROUP BY 1)"""
add("agg_pred_max", rates, f"WITH {_rate} SELECT ref, rate, flagged, kind, CASE WHEN kind = 'conflict' THEN p END AS pairs FROM rt", VIEWS)
_link = f"""{_rate}, fm AS (SELECT *, CASE WHEN level = 'Circuit Block' THEN 'circuit_block' ELSE 'piece_part' END AS row_type FROM v_fmea),
li AS (SELECT f.row_no, f.fmea_id, f.row_type, f.func, f.cause, f.cause AS ref, coalesce(rate, 0) AS part_fr, coalesce(flagged, false) AS flagged, kind, rate IS NULL AS lost,
usage = '' AND coalesce(rate, 0) > 0 AS gap, CASE WHEN TRY_CAST(nullif(usage, '') AS DOUBLE) > 0 THEN TRY_CAST(usage AS DOUBLE) ELSE 1.0 END AS usage, usage AS u0, coalesce(TRY_CAST(nullif(ratio, '') AS DOUBLE), 1.0) AS ratio, ratio AS r0 FROM fm f LEFT JOIN rt ON f.cause = rt.ref),
lk AS (SELECT *, CASE WHEN NOT gap THEN part_fr * usage * ratio END AS mode_fr, concat_ws('; ', CASE WHEN NOT lost AND flagged THEN 'rate unparseable' END, CASE WHEN kind = 'conflict' THEN 'rate conflict' END, CASE WHEN ref <> '' AND lost THEN 'not in prediction' END,
CASE WHEN gap THEN 'usage missing' WHEN u0 IN ('', '-3') THEN 'usage invalid' END, CASE WHEN r0 = '' THEN 'ratio invalid' END) AS notes FROM li)"""
_m = lambda c: F.round(F.col(c), 6).alias(c)
add("join_fr_lookup", lambda v: linked(v).select("row_no", "ref", "part_fr", _m("mode_fr"), F.array_join("notes", "; ").alias("notes")), f"WITH {_link} SELECT row_no, ref, part_fr::DOUBLE AS part_fr, round(mode_fr, 6) AS mode_fr, notes FROM lk", VIEWS)
_summed = "sn AS (SELECT row_no, CASE WHEN ref <> '' THEN sum(ratio) OVER (PARTITION BY ref) END AS s FROM lk)"
add("agg_fmr_note", lambda v: R.note_ratio_sums(linked(v)).select("row_no", _m("ratio_sum"), F.array_contains("notes", "ratio sum").alias("off")), f"WITH {_link}, {_summed} SELECT row_no, round(s, 6) AS ratio_sum, coalesce(abs(s - 1) > 0.001, false) AS off FROM sn", VIEWS)
add("win_fmr_broadcast", lambda v: R.note_ratio_sums(linked(v)).filter("ref <> ''").select("row_no", "instance", _m("ratio_sum")), f"WITH {_link}, {_summed} SELECT lk.row_no, ref AS instance, round(s, 6) AS ratio_sum FROM lk JOIN sn USING (row_no) WHERE ref <> ''", VIEWS)
add("agg_function_fr", lambda v: R.function_rates(linked(v)).select("func", F.round("function_fr", 4).alias("function_fr")), f"WITH {_link} SELECT func, round(coalesce(sum(mode_fr), 0), 4) AS function_fr FROM lk WHERE func <> '' GROUP BY 1", VIEWS)
_kids = "ki AS (SELECT k.row_no, max_by(b.row_no, length(b.fmea_id)) AS block_row FROM lk k JOIN (SELECT fmea_id, row_no FROM lk WHERE row_type = 'circuit_block') b ON k.fmea_id = b.fmea_id OR starts_with(k.fmea_id, b.fmea_id || '-') WHERE k.row_type <> 'circuit_block' GROUP BY 1)"
add("join_children_by_id", lambda v: R.children_by_id(linked(v)), f"WITH {_link}, {_kids} SELECT row_no, block_row FROM ki", VIEWS)


def _listed(v):
    """Blocks that list the designators of their first children."""
    refs = v.v_group_item.filter("k % 2 = 0").groupBy("g").agg(F.array_join(F.array_sort(F.collect_list("ref")), ", ").alias("refs"))
    rows = v.v_fmea.withColumn("g", F.floor(F.col("row_no") / 100)).join(refs, "g", "left")
    rows = rows.withColumn("cause", F.when(F.col("level") == "Circuit Block", F.coalesce("refs", F.lit(""))).otherwise(F.col("cause"))).drop("g", "refs")
    return rows.withColumn("row_type", F.when(F.col("level") == "Circuit Block", "circuit_block").otherwise("piece_part")).withColumn("ref", T.lookup_key(F.col("cause")))


add("join_children_by_list", lambda v: R.children_by_list(_listed(v)),
    """WITH r AS (SELECT g, string_agg(ref, ', ' ORDER BY ref) AS refs FROM v_group_item WHERE k % 2 = 0 GROUP BY g),
f AS (SELECT row_no, level, CASE WHEN level = 'Circuit Block' THEN coalesce(refs, '') ELSE cause END AS cause FROM v_fmea LEFT JOIN r ON row_no // 100 = g),
l AS (SELECT trim(t) AS ref, min(row_no) AS block_row FROM (SELECT row_no, unnest(string_split(cause, ',')) AS t FROM f WHERE level = 'Circuit Block') q WHERE trim(t) <> '' GROUP BY 1)
SELECT f.row_no, block_row FROM f JOIN l ON cause = ref WHERE level <> 'Circuit Block'""", ("v_fmea", "v_group_item"))  # fmt: skip


def _rolled(v):
    """The linked rows serve the children and the roll-up, the rates the link and the lists."""
    rate = once(rates(v))
    rows = once(R.link(K.row_types(v.v_fmea, [], "level", "cause", ["ratio"], "fmea_id"), rate))
    out = R.roll_up(rows, R.children_by_id(rows), rate)
    return out.select("row_no", "rolled", F.round("mode_fr", 4).alias("mode_fr"), F.round("function_fr", 4).alias("function_fr"))


_roll = f"""{_link}, {_kids}, ks AS (SELECT block_row, sum(mode_fr) AS s FROM ki JOIN lk USING (row_no) GROUP BY 1),
ru AS (SELECT lk.row_no, func, block_row IS NOT NULL AS rolled, CASE WHEN block_row IS NOT NULL THEN s ELSE mode_fr END AS mode_fr FROM lk LEFT JOIN ks ON lk.row_no = ks.block_row)"""
_out = "SELECT row_no, rolled, round(mode_fr, 4) AS mode_fr, round(sum(CASE WHEN rolled THEN 0 ELSE coalesce(mode_fr, 0) END) OVER (PARTITION BY func), 4) AS function_fr FROM ru"
add("agg_block_rollup", _rolled, f"WITH {_roll} {_out}", VIEWS)
add("failure_rate_link", _rolled, f"WITH {_roll} {_out}", VIEWS)
add("snk_fr_report", lambda v: linked(v).filter(F.size("notes") > 0).select("row_no", F.array_join("notes", "; ").alias("notes")), f"WITH {_link} SELECT row_no, notes FROM lk WHERE notes <> ''", VIEWS)
add("agg_warning_count", lambda v: linked(v).select(F.explode("notes").alias("note")).groupBy("note").agg(F.count("*").alias("n")), f"WITH {_link} SELECT note, count(*) AS n FROM (SELECT unnest(string_split(notes, '; ')) AS note FROM lk WHERE notes <> '') q GROUP BY 1", VIEWS)
