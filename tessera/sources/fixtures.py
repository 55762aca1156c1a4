"""Reliability tables derived from the driver tables, by SQL that Spark and DuckDB both read.

``{name}`` stands for a driver table.  Texts that differ between the two have one for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PFX = "CASE p_partkey % 8 WHEN 0 THEN 'R' WHEN 1 THEN 'C' WHEN 2 THEN 'U' WHEN 3 THEN 'L' WHEN 4 THEN 'Q' WHEN 5 THEN 'CR' WHEN 6 THEN 'VR' ELSE 'K' END"
_s = lambda x: f"CAST({x} AS VARCHAR(40))"
_both = lambda text: (text, text)
#: One number for each row of lineitem: the order's, and the row's place in it.
_word = "l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)"

_ref_of = lambda k: _PFX.replace("p_partkey", k) + f" || {_s(k + ' + 1')}"

VIEWS: dict[str, tuple[str, str]] = {
    "v_part": _both(
        f"SELECT p_partkey AS k, {_PFX} || {_s('p_partkey + 1')} AS ref, p_name, split_part(p_type, ' ', 1) AS c1, p_brand AS c2, p_retailprice FROM {{part}}"
    ),
    "v_tok": _both(
        f"""SELECT k, CASE k % 16 WHEN 0 THEN ref WHEN 1 THEN lower(ref) WHEN 2 THEN '  ' || ref || ' ' WHEN 3 THEN ref || 'A' WHEN 4 THEN ref || '-1'
        WHEN 5 THEN ref || '-2-B' WHEN 6 THEN '"' || ref || '"' WHEN 7 THEN '=' || ref WHEN 8 THEN 'J' || {_s('k')} || '-4' WHEN 9 THEN 'CN' || {_s('k')} || '-A'
        WHEN 10 THEN 'R' || {_s('k % 50')} || '-R' || {_s('k % 50 + k % 4')} WHEN 11 THEN 'Q' || {_s('k')} || '-B' WHEN 12 THEN '---'
        WHEN 13 THEN 'C00' || {_s('k')} WHEN 14 THEN 'U' || {_s('k')} || '.' || {_s('k % 7')} ELSE 'XYZ' || {_s('k')} END AS tok, ref, p_name, c1, c2 FROM v_part"""
    ),
    "v_cell": _both(
        f"SELECT k, CASE k % 5 WHEN 0 THEN ref || ', ' || lower(ref) || '-1' WHEN 1 THEN ref || ';' || ref || 'B | Q' || {_s('k')} WHEN 2 THEN ref WHEN 3 THEN '' ELSE ' -- ,' || ref || ' TP' || {_s('k')} END AS cell, ref FROM v_part"
    ),
    "v_text": _both(f"SELECT k, 'Failure in ' || ref || '-' || {_s('k % 3 + 1')} || ' caused by ' || p_name AS txt, ref, p_name FROM v_part"),
    "v_label": _both(
        f"""SELECT k, CASE k % 10 WHEN 0 THEN 'BLK-' || {_s('k')} || ' (Verified)' WHEN 1 THEN 'DIG-' || {_s('k')} || '-FN' WHEN 2 THEN 'PWR.' || {_s('k % 9')} || '.' || {_s('k')}
        WHEN 3 THEN 'note' WHEN 4 THEN '5.0V' WHEN 5 THEN ref WHEN 6 THEN 'Analog front end' WHEN 7 THEN {_s('k')} WHEN 8 THEN 'CPU#' || {_s('k')} || ' (PARTIAL) (unverified)' ELSE '  adc_' || {_s('k')} || '-PN  ' END AS label FROM v_part"""
    ),
    "v_num": _both(
        f"""SELECT k, CASE k % 12 WHEN 0 THEN '1/2' WHEN 1 THEN '1 of 4' WHEN 2 THEN '' WHEN 3 THEN 'abc' WHEN 4 THEN '3/0' WHEN 5 THEN '0.25' WHEN 6 THEN '1e3' WHEN 7 THEN '-2' WHEN 8 THEN '1e999'
        WHEN 9 THEN {_s('k')} WHEN 10 THEN '1_000' ELSE '.5' END AS txt, CASE WHEN k % 4 = 0 THEN 0.0 ELSE p_retailprice END AS rate, p_retailprice FROM v_part"""
    ),
    "v_bom": _both(
        f"""SELECT k + 2 AS row_no, k, CASE WHEN k % 11 = 0 THEN ref || '-1, ' || ref || '-2' ELSE ref END AS ref_des,
        'PN-' || lpad({_s('k % 997')}, 4, '0') AS part_number,
        CASE WHEN k % 13 = 0 THEN p_name || ' DNP' WHEN k % 37 = 0 THEN p_name || ' dual op amp' WHEN k % 41 = 0 THEN p_name || ' header 4 pin' ELSE p_name END AS description,
        c1 AS hda_level1, c2 AS hda_level2, CASE WHEN k % 11 = 0 THEN '1/2' WHEN k % 17 = 0 THEN 'abc' WHEN k % 19 = 0 THEN '' ELSE '1' END AS part_usage, {_s('k % 40 + 1')} AS page FROM v_part"""
    ),
    "v_group_item": _both(
        f"""SELECT CAST(floor(k / 8.0) AS BIGINT) AS g, ref, k FROM v_part WHERE k % 9 <> 4 AND CAST(floor(k / 8.0) AS BIGINT) % 23 NOT IN (5, 6)
        UNION ALL SELECT CAST(floor(k / 8.0) AS BIGINT) AS g, 'TP' || {_s('k')} AS ref, k FROM v_part WHERE k % 50 = 7"""
    ),
    "v_grouping": (
        f"SELECT g + 2 AS row_no, 'BLK-' || lpad({_s('g')}, 5, '0') || CASE WHEN g % 31 = 3 THEN ' PROV' ELSE '' END AS label, array_join(array_sort(collect_list(ref)), ', ') AS refs, {_s('g % 40 + 1')} AS page FROM v_group_item GROUP BY g",
        f"SELECT g + 2 AS row_no, 'BLK-' || lpad({_s('g')}, 5, '0') || CASE WHEN g % 31 = 3 THEN ' PROV' ELSE '' END AS label, string_agg(ref, ', ' ORDER BY ref) AS refs, {_s('g % 40 + 1')} AS page FROM v_group_item GROUP BY g",
    ),
    "v_pred": _both(
        f"""SELECT k + 2 AS row_no, CASE WHEN k % 5 = 0 THEN {_PFX.replace('p_partkey', 'k')} || '0' || {_s('k + 1')} ELSE ref END AS pred_ref,
        CASE WHEN k % 29 = 0 THEN 'TBD' ELSE {_s('k % 1000')} END AS pred_fr FROM v_part
        UNION ALL SELECT k + 1000002 AS row_no, ref AS pred_ref, {_s('k % 1000 * 2')} AS pred_fr FROM v_part WHERE k % 31 = 0
        UNION ALL SELECT k + 2000002 AS row_no, ref AS pred_ref, {_s('k % 1000')} AS pred_fr FROM v_part WHERE k % 43 = 0"""
    ),
    "v_fm": _both(
        """SELECT DISTINCT c1 AS commodity1, c2 AS commodity2, m.mode AS failure_mode, CASE WHEN m.mode = 'Open' THEN 0.6 WHEN c2 LIKE 'Brand#3%' THEN 0.3 ELSE 0.4 END AS ratio, m.fm_row
        FROM v_part CROSS JOIN (SELECT 'Open' AS mode, 1 AS fm_row UNION ALL SELECT 'Short' AS mode, 2 AS fm_row) m WHERE c2 NOT LIKE 'Brand#5%'"""
    ),
    "v_hda": _both(
        """SELECT row_no, part_number, hda_level1 AS commodity1, hda_level2 AS commodity2
        FROM (SELECT *, row_number() OVER (PARTITION BY part_number ORDER BY k) AS n FROM v_bom ) q WHERE n = 1 AND k % 41 <> 0"""
    ),
    "v_fmea": _both(
        f"""SELECT g * 100 + 2 AS row_no, 'BLK-' || {_s('g')} AS fmea_id, 'Circuit Block' AS level, CAST('' AS VARCHAR(40)) AS cause, CAST('' AS VARCHAR(40)) AS ratio, CAST('' AS VARCHAR(40)) AS usage, 'F' || {_s('g % 50')} AS func
        FROM (SELECT DISTINCT g FROM v_group_item) b
        UNION ALL SELECT g * 100 + 3 + (k % 8) * 2 + n AS row_no, 'BLK-' || {_s('g')} || '-' || ref || CASE WHEN n = 0 THEN '-A' ELSE '-B' END AS fmea_id,
        CASE WHEN k % 5 = 0 THEN '' ELSE 'Piece Part' END AS level, ref AS cause, CASE WHEN n = 0 THEN '0.6' WHEN k % 7 = 0 THEN '0.3' ELSE '0.4' END AS ratio,
        CASE WHEN k % 19 = 0 THEN '' WHEN k % 23 = 0 THEN '-3' ELSE '1' END AS usage, 'F' || {_s('g % 50')} AS func
        FROM v_group_item CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n) t WHERE ref NOT LIKE 'TP%'"""
    ),
    "v_sheet": _both(
        f"""SELECT k + 2 AS row_no, CASE m WHEN 0 THEN 'Circuit Block' WHEN 1 THEN 'Piece Part' WHEN 2 THEN 'PP' WHEN 3 THEN 'see note' ELSE '' END AS level,
        CASE WHEN m IN (0, 4) THEN ref || ', C' || {_s('k')} WHEN m IN (1, 5) THEN ref ELSE '' END AS cause, CASE WHEN m IN (1, 6) THEN '0.4' ELSE '' END AS ratio,
        CASE WHEN m = 7 THEN '1' ELSE '' END AS usage, CASE WHEN m IN (0, 8, 9) THEN 'BLK-' || {_s('k')} ELSE '' END AS fmea_id FROM (SELECT *, (k * 7 + CAST(floor(k / 13.0) AS BIGINT)) % 17 AS m FROM v_part ) q"""
    ),
    "v_template": _both(
        """SELECT * FROM (SELECT row_no, CASE WHEN level = 'Circuit Block' THEN 'circuit_block' ELSE 'piece_part' END AS row_type, fmea_id, cause, CASE WHEN level = 'Circuit Block' THEN '' WHEN fmea_id LIKE '%-A' THEN 'Open' ELSE 'Short  to ground' END AS failure_mode, ratio, usage FROM v_fmea
        UNION ALL SELECT row_no + 50 AS row_no, 'piece_part' AS row_type, fmea_id, cause, CASE WHEN fmea_id LIKE '%-A' THEN 'OPEN' ELSE 'short to ground' END AS failure_mode, ratio, usage FROM v_fmea WHERE level <> 'Circuit Block' AND row_no % 13 = 4) q WHERE row_no % 7 <> 3 AND row_no % 2900 <> 302"""
    ),
    "v_generated": _both(
        """SELECT * FROM (SELECT row_no, CASE WHEN level = 'Circuit Block' THEN 'circuit_block' ELSE 'piece_part' END AS row_type, fmea_id, cause, CASE WHEN level = 'Circuit Block' THEN '' WHEN fmea_id LIKE '%-A' THEN 'open' ELSE 'Short to ground' END AS failure_mode,
        CASE WHEN row_no % 5 = 1 THEN '0.90' WHEN row_no % 5 = 2 THEN '' ELSE ratio END AS ratio, CASE WHEN row_no % 11 = 4 THEN '2' ELSE usage END AS usage FROM v_fmea
        UNION ALL SELECT row_no + 60 AS row_no, 'piece_part' AS row_type, fmea_id, lower(cause) AS cause, CASE WHEN fmea_id LIKE '%-A' THEN 'Open' ELSE 'Short to ground' END AS failure_mode, ratio, usage FROM v_fmea WHERE level <> 'Circuit Block' AND row_no % 17 = 6) q WHERE row_no % 9 <> 5"""
    ),
    "v_old_bom": _both(
        f"""SELECT row_no, CASE WHEN k % 35 = 4 THEN ref_des || ', ' || {_ref_of('(k - 1)')} WHEN k % 30 = 7 THEN ref_des || ', TP' || {_s('k')} ELSE ref_des END AS ref_des, part_number,
        CASE WHEN k % 44 = 11 THEN '' ELSE description END AS description, page, CASE WHEN k % 6 = 0 THEN 'lot ' || {_s('k % 5')} ELSE '' END AS legacy FROM v_bom WHERE k % 12 <> 1"""
    ),
    "v_new_bom": _both(
        f"""SELECT row_no, CASE WHEN k % 22 = 0 THEN split_part(ref_des, '-1', 1) WHEN k % 20 = 9 THEN ref_des || ', ' || {_ref_of('(k + 1)')} WHEN k % 50 = 3 THEN ref_des || ', NT' || {_s('k')} ELSE ref_des END AS ref_des, part_number,
        CASE WHEN k % 21 = 0 OR k % 20 = 9 THEN '' WHEN k % 7 = 0 THEN description || ' rev B' ELSE description END AS description, CASE WHEN k % 44 = 22 THEN '' ELSE page || CASE WHEN k % 3 = 0 THEN '.0' ELSE '' END END AS page, hda_level1 AS grade FROM v_bom WHERE k % 12 <> 2"""
    ),
    "v_snap_a": _both(f"SELECT 'GRP-' || {_s('g')} || CASE WHEN k % 4 = 0 THEN ' (Verified)' ELSE '' END AS grp, ref, {_s('k % 30 + 1')} AS pages FROM v_group_item WHERE k % 9 <> 2"),
    "v_snap_b": _both(f"SELECT 'GRP-' || {_s('CASE WHEN k % 15 = 0 THEN g + 1 ELSE g END')} AS grp, ref, {_s('k % 30 + 1')} AS pages FROM v_group_item WHERE k % 9 <> 3"),
    "v_boxes": _both(
        """SELECT CAST(o_orderkey AS BIGINT) AS box, CAST(floor(o_orderkey / 375.0) AS BIGINT) AS page, CAST((o_custkey * 29) % 700 AS DOUBLE) AS x0, CAST((o_orderkey * 13) % 500 AS DOUBLE) AS y0,
        CAST((o_custkey * 29) % 700 + 40 + o_custkey % 200 AS DOUBLE) AS x1, CAST((o_orderkey * 13) % 500 + 30 + o_custkey % 150 AS DOUBLE) AS y1 FROM {orders}"""
    ),
    "v_words": _both(
        f"""SELECT {_word} AS word, CAST(floor(l_orderkey / 375.0) AS BIGINT) AS page, CAST((l_partkey * 37) % 800 AS DOUBLE) AS x, CAST((l_suppkey * 53 + l_linenumber * 11) % 600 AS DOUBLE) AS y,
        CASE l_partkey % 3 WHEN 0 THEN 'R' ELSE 'U' END || {_s('l_partkey + 1')} AS txt,
        CASE (l_orderkey * 10 + l_linenumber) % 10 WHEN 2 THEN 'tick' WHEN 3 THEN 'circle' ELSE 'text' END AS shape,
        CASE (l_orderkey * 10 + l_linenumber) % 40 WHEN 1 THEN 'label' ELSE 'other' END AS role FROM {{lineitem}}"""
    ),
    "v_drawing": _both(
        """SELECT o_orderkey * 3 AS item, CAST(floor(o_orderkey / 375.0) AS BIGINT) AS page, 're' AS kind, CAST((o_custkey * 29) % 3000 + CASE WHEN o_orderkey % 9 = 0 THEN w ELSE 0 END AS DOUBLE) AS x0, CAST((o_orderkey * 13) % 2400 AS DOUBLE) AS y0,
        CAST((o_custkey * 29) % 3000 + CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE w END AS DOUBLE) AS x1, CAST((o_orderkey * 13) % 2400 + 12 + o_custkey % 190 AS DOUBLE) AS y1, CAST(0 AS DOUBLE) AS radius
        FROM (SELECT *, 15 + o_custkey % 230 AS w FROM {orders}) q
        UNION ALL SELECT o_orderkey * 3 + 1000000001 AS item, CAST(floor(o_orderkey / 375.0) AS BIGINT) AS page, 're' AS kind, CAST((o_custkey * 29) % 3000 + 3 AS DOUBLE) AS x0, CAST((o_orderkey * 13) % 2400 + 2 AS DOUBLE) AS y0,
        CAST((o_custkey * 29) % 3000 + 15 + o_custkey % 230 - o_orderkey % 11 AS DOUBLE) AS x1, CAST((o_orderkey * 13) % 2400 + 12 + o_custkey % 190 AS DOUBLE) AS y1, CAST(0 AS DOUBLE) AS radius FROM {orders} WHERE o_orderkey % 4 = 1
        UNION ALL SELECT o_orderkey * 3 + 1 AS item, CAST(floor(o_orderkey / 375.0) AS BIGINT) AS page, 'l' AS kind, CAST((o_custkey * 29) % 3000 - o_orderkey % 9 AS DOUBLE) AS x0, CAST((o_orderkey * 13) % 2400 + o_orderkey % 12 AS DOUBLE) AS y0,
        CAST((o_custkey * 29) % 3000 - o_orderkey % 9 + o_orderkey % 70 AS DOUBLE) AS x1, CAST((o_orderkey * 13) % 2400 + o_orderkey % 12 AS DOUBLE) AS y1, CAST(0 AS DOUBLE) AS radius FROM {orders}
        UNION ALL SELECT o_orderkey * 3 + 2 AS item, CAST(floor(o_orderkey / 375.0) AS BIGINT) AS page, 'c' AS kind, CAST((o_custkey * 29) % 3000 + o_custkey % 60 AS DOUBLE) AS x0, CAST((o_orderkey * 13) % 2400 - 10 + o_orderkey % 31 AS DOUBLE) AS y0,
        CAST(0 AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS y1, CAST(o_orderkey % 11 AS DOUBLE) AS radius FROM {orders}"""
    ),
    "v_token": _both(
        f"""SELECT word, page, CAST((k * 37 + j * 11) % 3200 AS DOUBLE) AS x, CAST((j * 53 + k) % 2500 AS DOUBLE) AS y,
        CASE m WHEN 0 THEN 'U' || {_s('k % 900 + 1')} WHEN 1 THEN 'R' || {_s('k % 90 + 1')} WHEN 2 THEN 'CONN' || {_s('k % 90 + 1')} WHEN 3 THEN {_s('k % 40')} WHEN 4 THEN 'A' || {_s('k % 40')} WHEN 5 THEN 'P' || {_s('k % 40')} WHEN 6 THEN 'MISO_' || {_s('k')}
        WHEN 7 THEN 'CLOCK' WHEN 8 THEN 'note ' || {_s('k')} WHEN 9 THEN '10uF' WHEN 10 THEN 'miso_1' ELSE '24/22' END AS txt
        FROM (SELECT {_word} AS word, CAST(floor(l_orderkey / 375.0) AS BIGINT) AS page, l_partkey AS k, l_suppkey * 7 + l_linenumber AS j, (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 12 AS m FROM {{lineitem}}) q"""
    ),
    "v_entry": _both(
        f"""SELECT word, page, grp, CAST((grp % 10) * 620 + CASE WHEN k % 13 < 4 THEN 330 ELSE 0 END + (k * 37) % 190 AS DOUBLE) AS x, CAST(CAST(floor(grp / 10.0) AS BIGINT) % 10 * 700 + (j * 53) % 240 AS DOUBLE) AS y,
        CASE WHEN page % 4 = 3 THEN 'NET_' || {_s('k')} WHEN grp % 11 = 7 THEN 'B' || {_s('k % 3 + 1')} WHEN m = 0 AND k % 3 > 0 THEN 'U' || {_s('k % 60 + 1')} WHEN m = 0 THEN 'J' || {_s('k % 60 + 1')} WHEN m = 1 AND grp % 3 = 0 THEN 'R' || {_s('k % 60 + 1')} WHEN m = 2 AND grp % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN '10uF' ELSE '22K' END
        WHEN grp % 4 = 1 THEN {_s('k % 2 + 1')} WHEN m < 6 THEN {_s('k % 9 + 1')} WHEN m < 9 THEN 'A' || {_s('k % 6 + 1')} WHEN m = 9 THEN 'VCC' WHEN m = 10 THEN 'NET_' || {_s('k')} ELSE 'gnd' END AS txt
        FROM (SELECT {_word} AS word, CAST(floor(l_orderkey / 375.0) AS BIGINT) AS page, CAST(floor(l_orderkey / 3.0) AS BIGINT) AS grp, l_partkey AS k, l_suppkey + l_linenumber AS j, (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 12 AS m FROM {{lineitem}}) q"""
    ),
    "v_pinlist": _both(
        f"""SELECT DISTINCT CASE k % 4 WHEN 0 THEN 'J' WHEN 1 THEN 'R' ELSE 'U' END || {_s('k % 60 + 1')} || '-' || CASE k % 7 WHEN 0 THEN 'VCC' WHEN 1 THEN 'GND' WHEN 2 THEN 'A' || {_s('k % 6 + 1')} WHEN 3 THEN 'A' || {_s('k % 5 + 1')} ELSE {_s('k % 9 + 1')} END AS pin FROM v_part WHERE k % 60 < 45"""
    ),
}
TABLES = ("part", "orders", "lineitem")
_NEEDS = {n: [m for m in VIEWS if m != n and m in " ".join(t).replace(",", " ").split()] for n, t in VIEWS.items()}


def _ordered(names) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS[name]:
            add(n)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def duck(body: str, *names: str) -> str:
    """body for DuckDB, with the named views before it."""
    heads = [f"{n} AS ({VIEWS[n][1].format(**{t: t for t in TABLES})})" for n in _ordered(names)]
    inner = body.lstrip()
    if not heads:
        return inner
    if inner[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ", ".join(heads) + ", " + inner[15:]
    if inner[:5].upper() == "WITH ":
        return "WITH " + ", ".join(heads) + ", " + inner[5:]
    return "WITH " + ", ".join(heads) + " " + inner


class Views:
    """The views as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        heads = [f"{n} AS ({VIEWS[n][0]})" for n in _ordered([name])]
        used = {t: self.table(t) for t in TABLES if any("{" + t + "}" in h for h in heads)}
        return self.spark.sql("WITH " + ", ".join(heads) + f" SELECT * FROM {name}", **used)
