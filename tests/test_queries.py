"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return list(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    theirs = sorted((repr([plain(r[columns.index(c)]) for c in order]) for r in result.fetchall()))
    ours = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    assert ours == theirs


ROWS_ONLY = sorted(n for n in QUERIES if n not in ORACLES and not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_disc_joins_are_equi_joins(spark):
    plan = QUERIES["disc_join_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_box_filters_reach_the_scan(spark, tmp_path):
    from arbora import fixtures
    from arbora.sources.catalog import PointTable

    table = PointTable(spark, str(tmp_path / "t")).create()
    table.write(fixtures.points(spark, SF))
    plan = table.query_bbox(308010.0, 4688010.0, 308050.0, 4688050.0, attributes=["Z"], year=2021)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(X,308010.0)" in plan and "PartitionFilters: [" in plan
    assert "ReadSchema: struct<X:double,Y:double,Z:double>" in plan
    assert os.path.isdir(tmp_path / "t/points")
