"""Series analytics jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from barquet.operators.anomaly import one_class_fit, one_class_score
from barquet.operators.charts import actual_and_forecast, anomaly_points, forecast_only
from barquet.operators.forecast import arma11_forecast
from barquet.operators.mlmodels import lag_forecast, series_positions
from barquet.session import materialize


def analyze_series(series: DataFrame, days: int, nu: float, key: str | Sequence[str] = "series_id",
                   idx: str = "idx", value: str = "Close",
                   method: str = "likelihood") -> dict[str, DataFrame]:
    """The web form's job for every series at once.

    ``days``: forecast horizon (``days + 1`` ARMA(1,1) steps are returned);
    ``nu``: the one-class model's bound on the anomaly share;
    ``method``: how the ARMA is fitted, by default by exact maximum likelihood
    as the form did (see :func:`barquet.operators.forecast.arma11_forecast`).
    Returns
    ``forecast`` (labelled forecast rows), ``chart`` (actual then forecast
    on one position axis), ``scored`` (every row with score and flag) and
    ``anomalies`` (positions and prices of flagged rows).
    """
    if days < 0:
        raise ValueError("days must be >= 0")
    keys = [key] if isinstance(key, str) else list(key)
    # the forecast, the anomaly model and the chart each read the series:
    # write its three columns once instead of recomputing whatever produced it
    series = materialize(series.select(*keys, idx, value), merge=True)
    # the forecast and the one-class model each feed two outputs; both are
    # small (days + 1 rows, one row per series): write them once
    fc = materialize(arma11_forecast(series, key, idx, value, days, method=method), merge=True)
    model = materialize(one_class_fit(series, key, value, nu), merge=True)
    scored = one_class_score(series, model, key, value)
    return {
        "forecast": forecast_only(fc, key, idx),
        "chart": actual_and_forecast(series, fc, key, idx, value),
        "scored": scored,
        "anomalies": anomaly_points(scored, key, idx, value),
    }


def report_lag_forecast(report: DataFrame, time_step: int = 10, horizon: int = 7, key: str = "ISIN",
                        order: str = "Date", value: str = "end_price", kind: str = "linear",
                        fit_on: str = "all"):
    """Lag-window forecast of each security's close from a report (D7): (forecast, errors)."""
    # the report is read several times by the forecaster: write the narrow series once
    series = materialize(series_positions(report.select(key, order, value).na.drop(), key, order))
    return lag_forecast(series, key, "idx", value, time_step, horizon, kind=kind, fit_on=fit_on)
