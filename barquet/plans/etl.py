"""End-to-end dated runs: extract -> report -> store -> read back (D3 + D1/D2 + D4)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from barquet.plans.reports import daily_report, morning_report
from barquet.sources.files import extract, latest_report, write_report


def run_daily(spark: SparkSession, source_base: str, report_base: str, arg_date: str,
              run_ts: dt.datetime | str | None = None, lookback_days: int = 1,
              every_column: bool = False) -> tuple[str, DataFrame]:
    """Daily report for ``arg_date`` and later from a dated CSV tree; returns (path written, latest report).

    ``every_column`` drops bars with a missing value in any column of their
    file, not only in the used ones.
    """
    bars = extract(spark, source_base, arg_date, lookback_days, every_column=every_column)
    path = write_report(daily_report(bars, arg_date=arg_date), report_base, run_ts)
    return path, latest_report(spark, report_base)


def run_morning(spark: SparkSession, source_base: str, report_base: str, arg_date: str,
                run_ts: dt.datetime | str | None = None, lookback_days: int = 1,
                every_column: bool = True) -> tuple[str, DataFrame]:
    """Morning report of the extracted days; returns (path written, latest report).

    By default bars with a missing value in any column of their file are
    dropped first; ``every_column=False`` looks at the used columns only.
    """
    bars = extract(spark, source_base, arg_date, lookback_days, every_column=every_column)
    path = write_report(morning_report(bars, sort=True), report_base, run_ts)
    return path, latest_report(spark, report_base)


def run_morning_with_model(spark: SparkSession, source_base: str, report_base: str, arg_date: str,
                           run_ts: dt.datetime | str | None = None, lookback_days: int = 1,
                           every_column: bool = True) -> tuple[str, DataFrame, DataFrame]:
    """The class-based job: extract, morning report, OLS of close on open for the
    run date minus one day (P8, M1), store the report.

    Returns (path written, the report read back, the one-row model).
    """
    from barquet.plans.models import fit_open_close
    bars = extract(spark, source_base, arg_date, lookback_days, every_column=every_column)
    report = morning_report(bars, sort=True)
    day = (dt.datetime.strptime(arg_date, "%Y-%m-%d").date() - dt.timedelta(days=1)).isoformat()
    path = write_report(report, report_base, run_ts)
    stored = latest_report(spark, report_base)
    return path, stored, fit_open_close(stored, day)


def run_report_models(spark: SparkSession, report: DataFrame, csv_path: str, time_step: int = 10, horizon: int = 7) -> dict[str, DataFrame]:
    """Write a morning report as CSV without an index and run the models on that file.

    Returns ``forecast`` and ``forecast_errors`` (lag windows), ``regression``
    (end price on the other columns) and ``later`` (the sigmoid unit).
    """
    from barquet.operators.mlmodels import multi_feature_regression, sigmoid_unit
    from barquet.plans.analytics import report_lag_forecast
    from barquet.sources.files import write_report_csv
    write_report_csv(report, csv_path)
    stored = spark.read.schema(report.schema).option("header", True).option("enforceSchema", False).csv(csv_path)
    forecast, errors = report_lag_forecast(stored, time_step, horizon)
    _, summary, _ = multi_feature_regression(stored, "end_price", ["start_price", "minimum_price", "maximum_price", "daily_traded_volume"])
    _, later = sigmoid_unit(stored.select("ISIN", "Date", "end_price"), "ISIN", "Date", "end_price", horizon)
    return {"forecast": forecast, "forecast_errors": errors, "regression": summary, "later": later}
