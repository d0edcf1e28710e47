"""Daily report (D1) and its parts on literal rows (edge cases of FIXTURES.md)."""

from barquet.plans.reports import daily_report
from barquet.operators.bars import daily_ohlcv


def bar(isin, date, time, start, end, lo=None, hi=None, vol=1):
    lo = min(start, end) if lo is None else lo
    hi = max(start, end) if hi is None else hi
    return (isin, date, time, float(start), float(hi), float(lo), float(end), vol)


def test_first_day_change_is_null_and_second_uses_previous_row(bars):
    df = bars([bar("A", "2024-01-05", "09:00", 10, 10), bar("A", "2024-01-08", "09:00", 11, 11)])
    rows = daily_report(df, with_index=False).collect()
    assert rows[0]["change_prev_closing_%"] is None
    # Monday after Friday: previous row, not previous calendar day
    assert rows[1]["change_prev_closing_%"] == 10.0


def test_zero_previous_close_gives_null(bars):
    df = bars([bar("A", "2024-01-01", "09:00", 0, 0), bar("A", "2024-01-02", "09:00", 5, 5)])
    rows = daily_report(df, with_index=False).collect()
    assert rows[1]["change_prev_closing_%"] is None


def test_half_even_rounding(bars):
    df = bars([bar("A", "2024-01-01", "09:00", 0.125, 2.675, lo=1.005, hi=3.0)])
    r = daily_report(df, with_index=False).collect()[0]
    assert (r.opening_price_eur, r.closing_price_eur, r.minimum_price_eur) == (0.12, 2.68, 1.0)


def test_open_close_by_time_and_volume(bars):
    df = bars([bar("A", "2024-01-01", "10:00", 3, 4, vol=5), bar("A", "2024-01-01", "09:00", 1, 2, vol=7),
               bar("A", "2024-01-01", "11:00", 5, 6, lo=0.5, hi=9, vol=1)])
    r = daily_ohlcv(df).collect()[0]
    assert (r.opening_price_eur, r.closing_price_eur) == (1.0, 6.0)
    assert (r.minimum_price_eur, r.maximum_price_eur, r.daily_traded_volume) == (0.5, 9.0, 13)


def test_tie_on_time_uses_tiebreak(spark):
    df = spark.createDataFrame(
        [("A", "2024-01-01", "09:00", 1.0, 1.0, 1.0, 1.0, 1, 2), ("A", "2024-01-01", "09:00", 2.0, 2.0, 2.0, 2.0, 1, 1)],
        "ISIN string, Date string, Time string, StartPrice double, MaxPrice double, MinPrice double, "
        "EndPrice double, TradedVolume bigint, seq int")
    r = daily_ohlcv(df, tiebreak="seq").collect()[0]
    assert (r.opening_price_eur, r.closing_price_eur) == (2.0, 1.0)


def test_missing_key_rows_dropped(bars):
    df = bars([bar(None, "2024-01-01", "09:00", 1, 1), bar("A", "2024-01-01", "09:00", 2, 2)])
    rows = daily_report(df).collect()
    assert [r.ISIN for r in rows] == ["A"]


def test_index_counts_before_date_filter(bars):
    rows = [bar(i, d, "09:00", 1, 1) for i in ("A", "B") for d in ("2024-01-01", "2024-01-02", "2024-01-03")]
    out = daily_report(bars(rows), arg_date="2024-01-02")
    got = [(r["index"], r.ISIN, r.Date) for r in out.collect()]
    assert got == [(1, "A", "2024-01-02"), (2, "A", "2024-01-03"), (4, "B", "2024-01-02"), (5, "B", "2024-01-03")]


def test_dense_index_many_partitions(spark):
    from barquet.operators.ordering import with_dense_index
    df = spark.range(0, 1000).selectExpr("(id * 7919) % 1000 as k")
    out = with_dense_index(df, ["k"], partitions=13).collect()
    assert sorted((r["index"], r.k) for r in out) == [(i, i) for i in range(1000)]


def test_dense_index_with_aqe_sized_split(spark):
    from barquet.operators.ordering import with_dense_index
    df = spark.range(0, 5000, numPartitions=7).selectExpr("(id * 7919) % 5000 as k")
    out = with_dense_index(df, ["k"]).collect()
    assert sorted((r["index"], r.k) for r in out) == [(i, i) for i in range(5000)]


def test_indexed_report_comes_out_in_key_order(spark):
    from barquet.sources import fixtures as fx
    rep = daily_report(fx.trades_wide(spark, "/root/testdata/sf0.01"), arg_date="2024-01-10")
    rows = rep.collect()
    keys = [(r.ISIN, r.Date) for r in rows]
    assert keys == sorted(keys) and len(rows) > 1000
    idx = [r["index"] for r in rows]
    assert idx == sorted(idx)
    assert "rangepartitioning" not in rep._jdf.queryExecution().executedPlan().toString()


def test_empty_inputs(spark):
    from barquet.operators.forecast import arma11_forecast
    from barquet.operators.ordering import with_dense_index
    from barquet.plans.reports import morning_report
    empty = spark.createDataFrame([], "ISIN string, Date string, Time string, StartPrice double, MaxPrice double, "
                                      "MinPrice double, EndPrice double, TradedVolume bigint")
    assert daily_report(empty, arg_date="2024-01-01").count() == 0
    assert morning_report(empty).count() == 0
    assert with_dense_index(spark.range(0).toDF("k"), ["k"]).count() == 0
    s = spark.createDataFrame([], "k string, idx int, v double")
    assert arma11_forecast(s, "k", "idx", "v", days=3).count() == 0


def test_time_key_seconds_and_bad_times(spark):
    df = spark.createDataFrame(
        [("A", "2024-01-01", "09:00:30", 2.0, 2.0, 2.0, 2.0, 1), ("A", "2024-01-01", "09:00:05", 1.0, 1.0, 1.0, 1.0, 1),
         ("A", "2024-01-01", "xx", 9.0, 9.0, 0.1, 9.0, 1), ("A", "2024-01-01", "10:00", 3.0, 3.0, 3.0, 3.0, 1)],
        "ISIN string, Date string, Time string, StartPrice double, MaxPrice double, MinPrice double, "
        "EndPrice double, TradedVolume bigint")
    r = daily_ohlcv(df).collect()[0]
    assert (r.opening_price_eur, r.closing_price_eur) == (1.0, 3.0)
    assert (r.minimum_price_eur, r.maximum_price_eur, r.daily_traded_volume) == (0.1, 9.0, 4)
