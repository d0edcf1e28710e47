"""Model jobs over the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.operators.regression import ols_fit


def fit_open_close(report: DataFrame, start_date: str, end_date: str | None = None,
                   y: str = "end_price", x: str = "start_price") -> DataFrame:
    """OLS of the close on the open across securities for one day or a closed date range.

    One row: slope, intercept, r2, n.
    """
    if end_date is None:
        rows = report.filter(F.col("Date") == F.lit(start_date))
    else:
        rows = report.filter(F.col("Date").between(start_date, end_date))
    return ols_fit(rows, y, x)
