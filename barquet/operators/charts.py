"""Chart-ready tables (M8, U3): the data behind the reference's plots, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.functions.columns import two_decimal_label


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def actual_and_forecast(series: DataFrame, forecast: DataFrame, key: str | Sequence[str], idx: str,
                        value: str, forecast_col: str = "forecast") -> DataFrame:
    """Actual values followed by forecasts on one position axis, with 2-decimal labels."""
    keys = _keys(key)
    act = series.select(*keys, F.col(idx).cast("long").alias("idx"), F.lit("actual").alias("kind"),
                        F.col(value).cast("double").alias("value"))
    fc = forecast.select(*keys, F.col(idx).cast("long").alias("idx"), F.lit("forecast").alias("kind"),
                         F.col(forecast_col).cast("double").alias("value"))
    u = act.unionByName(fc)
    return u.withColumn("label", two_decimal_label("value"))


def forecast_only(forecast: DataFrame, key: str | Sequence[str], idx: str, forecast_col: str = "forecast") -> DataFrame:
    """Forecast rows with their labels (the forecast-only chart)."""
    keys = _keys(key)
    return forecast.select(*keys, F.col(idx).cast("long").alias("idx"), F.col(forecast_col).alias("value"),
                           two_decimal_label(forecast_col).alias("label"))


def anomaly_points(scored: DataFrame, key: str | Sequence[str], idx: str, value: str,
                   flag: str = "is_anomaly") -> DataFrame:
    """Positions and values of flagged rows (the anomaly markers)."""
    keys = _keys(key)
    return scored.filter(F.col(flag)).select(*keys, F.col(idx).cast("long").alias("idx"), F.col(value).alias("value"))
