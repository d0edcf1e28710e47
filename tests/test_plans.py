"""Physical-plan properties that matter at scale (checked on the small tables)."""

from barquet.operators.bars import daily_ohlcv
from barquet.operators.ordering import last_k_per_key
from barquet.operators.series import with_shifts
from barquet.plans.reports import morning_report
from barquet.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_last_aggregates_are_hash_based(spark):
    for df in (daily_ohlcv(fx.trades(spark, SF)), morning_report(fx.trades(spark, SF))):
        p = _plan(df)
        assert "HashAggregate" in p and "SortAggregate" not in p


def test_scan_reads_only_used_columns(spark):
    p = _plan(morning_report(fx.trades(spark, SF)))
    schema = p[p.index("ReadSchema"):].split("\n")[0]
    assert "props" not in schema and "user_id" not in schema


def test_key_filter_reaches_the_scan(spark):
    from pyspark.sql import functions as F
    ev = fx.table(spark, SF, "events").filter(F.col("event_type") == "click").select("event_type", "value")
    p = _plan(ev)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in p


def test_lags_shuffle_on_key_and_block(spark):
    s = fx.closes(spark, SF).repartition("series_id")  # input already clustered on the key alone
    p = _plan(with_shifts(s, "series_id", "idx", "Close", lags=[1, 2]))
    assert "hashpartitioning(series_id" in p and "_bq_blk" in p
    assert p.count("Exchange hashpartitioning(series_id#") >= 1
    assert any("hashpartitioning(series_id" in line and "_bq_blk" in line for line in p.split("\n"))


def test_last_k_limits_before_the_window(spark):
    p = _plan(last_k_per_key(fx.closes(spark, SF), ["series_id"], "idx", 10))
    assert "WindowGroupLimit" in p


def test_missing_key_filter_reaches_the_scan(spark):
    from barquet.operators.bars import drop_missing
    bars = spark.read.parquet(f"{SF}/events.parquet").selectExpr(
        "event_type as ISIN", "cast(ts as string) as Date", "value as EndPrice")
    p = _plan(drop_missing(bars, ["ISIN", "EndPrice"]))
    assert "IsNotNull(event_type)" in p and "IsNotNull(value)" in p


def test_exploration_counts_have_no_row_expansion(spark):
    from barquet.operators.bars import explore
    p = _plan(explore(fx.trades_dirty(spark, SF)))
    assert "Expand" not in p and "SortAggregate" not in p


def test_daily_window_reuses_the_index_split(spark):
    from barquet.operators.bars import daily_ohlcv, drop_missing
    from barquet.plans.reports import previous_close
    day = daily_ohlcv(drop_missing(fx.trades(spark, SF))).repartitionByRange("ISIN").sortWithinPartitions("ISIN", "Date")
    p = _plan(previous_close(day))
    assert "rangepartitioning(ISIN" in p
    assert not any("hashpartitioning(ISIN#" in ln and "Date" not in ln for ln in p.split("\n"))


def test_day_bounds_reach_the_scan(spark):
    p = _plan(morning_report(fx.trades(spark, SF, "2024-01-08", "2024-01-10")))
    assert "GreaterThanOrEqual(ts," in p and "LessThan(ts," in p
