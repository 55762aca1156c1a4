"""Every registered reliability query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return repr(round(x, 6) + 0.0) if isinstance(x, float) and not math.isnan(x) else repr(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())


def test_only_page_kernels_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"sp_cluster"}
