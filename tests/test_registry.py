"""Every registered query against its DuckDB oracle on the smallest tables, and the entry smoke check."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from barquet.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"

_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
         "date": "DATE"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["index", "ISIN", "Date"]


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    otypes = {d[0]: str(d[1]) for d in cur.description}
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert {c: _DUCK.get(t, t) for c, t in df.dtypes} == otypes
    assert _canon(df.columns, rows) == _canon(ocols, orows)


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    df = E.queries()[name](spark, SF)
    assert df.count() >= 0 and len(df.columns) > 0


@pytest.mark.parametrize("name", ["d1_daily_report", "w6_lag_windows", "m1_fitted_values", "s1_s3_extract_dated_csv"])
def test_correct_without_aqe_or_auto_broadcast(spark, con, name):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "37"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = E.queries()[name](spark, SF)
        rows = [tuple(r) for r in df.collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    cur = con.execute(E.oracle_sql()[name])
    assert _canon(df.columns, rows) == _canon([d[0] for d in cur.description], cur.fetchall())
