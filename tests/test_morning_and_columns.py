"""Morning report (D2), scalar helpers and exploration counts on literal rows."""

import math

from pyspark.sql import functions as F

from barquet.functions import columns as C
from barquet.operators.bars import distinct_with_missing, explore, group_count
from barquet.plans.reports import morning_report


def b(isin, time, start, end=None, lo=None, hi=None, vol=1, date="2024-01-02"):
    end = start if end is None else end
    lo = min(start, end) if lo is None else lo
    hi = max(start, end) if hi is None else hi
    return (isin, date, time, float(start), float(hi), float(lo), float(end), vol)


def test_window_bounds_are_exclusive(bars):
    df = bars([b("A", "08:00", 1, lo=0.1, vol=100), b("A", "08:01", 2, lo=2, vol=1),
               b("A", "11:59", 3, hi=30, vol=2), b("A", "12:00", 4, hi=99, vol=100)])
    r = morning_report(df).collect()[0]
    assert (r.minimum_price, r.maximum_price, r.daily_traded_volume) == (2.0, 30.0, 3)


def test_open_comes_from_whole_day(bars):
    df = bars([b("A", "07:59", 10, lo=1), b("A", "09:00", 11, lo=11)])
    r = morning_report(df).collect()[0]
    assert r.start_price == 10.0 and r.minimum_price == 11.0


def test_no_bar_in_window_gives_no_row(bars):
    assert morning_report(bars([b("A", "13:00", 5)])).count() == 0


def test_currency_and_row_std(bars):
    r = morning_report(bars([b("A", "09:00", 1, end=2), b("A", "10:00", 3, end=4)])).collect()[0]
    assert r.end_price_mx == 4 * 19.08
    assert math.isclose(r.standard_deviation, 2.1213203435596424, rel_tol=0, abs_tol=1e-15)


def test_row_std_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, None)], "a double, b double")
    got = [r.s for r in df.select(C.row_stddev("a", "b").alias("s")).collect()]
    assert math.isclose(got[0], 2.1213203435596424) and got[1] is None


def test_half_even_and_labels(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (1.005,)], "x double")
    rows = df.select(C.round_half_even("x", 2).alias("r"), C.two_decimal_label("x").alias("l")).collect()
    assert [r.r for r in rows] == [0.12, 2.68, 1.0]
    assert [r.l for r in rows] == ["0.12", "2.68", "1.00"]


def test_pct_change_zero_and_null(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, None), (6.0, 4.0)], "c double, p double")
    assert [r.x for r in df.select(C.pct_change("c", "p").alias("x")).collect()] == [None, None, 50.0]


def test_dates_times_and_sigmoid(spark):
    df = spark.createDataFrame([("2024-01-01", "08:30", 0.0)], "d string, t string, x double")
    r = df.select(C.previous_day("d").alias("p"), C.is_hhmm("t").alias("ok"), C.sigmoid("x").alias("s"),
                  C.sigmoid_derivative_from_output(C.sigmoid("x")).alias("ds"),
                  F.size(C.date_sequence("d", 3)).alias("n"),
                  C.key_first_part(F.lit("2024-01-01/file.csv")).alias("k")).collect()[0]
    assert str(r.p) == "2023-12-31" and r.ok and r.s == 0.5 and r.ds == 0.25 and r.n == 3
    assert r.k == "2024-01-01"


def test_distinct_count_counts_missing_once(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), (None,)], "ISIN string")
    assert df.agg(distinct_with_missing("ISIN").alias("n")).collect()[0].n == 3


def test_group_count_skips_missing_keys(spark):
    df = spark.createDataFrame([("a", "d1"), ("a", "d1"), (None, "d1"), ("b", None), ("b", "d2")],
                               "ISIN string, Date string")
    assert group_count(df, ["ISIN", "Date"]).collect()[0].n_groups == 2
    r = explore(df).collect()[0]
    assert (r.n_rows, r.n_columns, r.n_securities, r.n_groups) == (5, 2, 3, 2)


def test_sizing_conf():
    from barquet.session import sizing_conf
    c = sizing_conf(100 * 1024 ** 4)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert sizing_conf(1)["spark.sql.shuffle.partitions"] == "8"


def test_parse_and_dates(spark):
    import datetime as dt

    import pytest
    from barquet.sources.files import report_stamp
    df = spark.createDataFrame([("2024-02-29", "12", "1.5")], "d string, i string, f string")
    r = df.select(C.to_date("d").alias("d"), C.parse_int("i").alias("i"), C.parse_float("f").alias("f"),
                  C.report_stamp(F.lit("2023-02-17 23:24:55").cast("timestamp")).alias("s")).collect()[0]
    assert (r.d, r.i, r.f, r.s) == (dt.date(2024, 2, 29), 12, 1.5, "20230217_232455")
    assert report_stamp(dt.datetime(2023, 3, 28, 0, 5, 9)) == "20230328_000509"
    bad = spark.createDataFrame([("x1",)], "i string").select(C.parse_int("i"))
    with pytest.raises(Exception):
        bad.collect()


def test_head_latest_and_counts(spark):
    from barquet.operators.bars import global_max, row_count, select_columns
    from barquet.operators.ordering import head, latest_value
    df = spark.createDataFrame([(i % 4, f"r{i}") for i in range(20)], "k int, s string")
    assert [r.k for r in head(df, ["k", "s"], 3).collect()] == [0, 0, 0]
    assert sorted(r.s for r in latest_value(df, "k").collect()) == sorted(f"r{i}" for i in range(3, 20, 4))
    rc = row_count(df).collect()[0]
    assert (rc.n_rows, rc.n_columns) == (20, 2)
    assert global_max(df, "k").collect()[0].max_k == 3
    assert select_columns(df, ["s"]).columns == ["s"]


def test_explore_approximate_and_clustered_report(spark):
    from barquet.plans.reports import daily_report
    from barquet.sources import fixtures as fx
    t = fx.trades_dirty(spark, "/root/testdata/sf0.001")
    exact, approx = explore(t).collect()[0], explore(t, approximate=True).collect()[0]
    assert exact.n_rows == approx.n_rows and abs(exact.n_groups - approx.n_groups) <= 0.05 * exact.n_groups
    a = sorted(tuple(r) for r in daily_report(t, arg_date="2024-01-10").collect())
    b = sorted(tuple(r) for r in daily_report(t, arg_date="2024-01-10", sort=False).collect())
    assert a == b


def test_half_even_matches_numpy_property(spark):
    import numpy as np
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.floats(min_value=-1e9, max_value=1e9, allow_nan=False), min_size=1, max_size=200))
    def check(xs):
        df = spark.createDataFrame([(float(x),) for x in xs], "x double")
        got = [r.r for r in df.select(C.round_half_even("x", 2).alias("r")).collect()]
        assert got == [float(v) for v in np.round(np.array(xs, dtype=float), 2)]

    check()


def test_drop_missing_subset_and_nan(spark):
    from barquet.operators.bars import drop_missing
    df = spark.createDataFrame([("A", 1.0, None), ("B", float("nan"), "x"), (None, 2.0, "y"), ("C", 3.0, "z")],
                               "ISIN string, EndPrice double, extra string")
    assert sorted(r.ISIN for r in drop_missing(df).collect()) == ["A", "C"]          # bar columns only
    assert sorted(r.ISIN for r in drop_missing(df, None).collect()) == ["C"]         # every column
    assert sorted(r.ISIN or "-" for r in drop_missing(df, ["extra"]).collect()) == ["-", "B", "C"]
