"""Error metrics as grouped aggregates (A7 RMSE, A8 MSE)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.functions.columns import squared_error


def errors_by(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE and MSE of prediction ``p`` against ``y`` per group (rows with either missing skipped)."""
    sq = squared_error(y, p)
    agg = [F.sqrt(F.avg(sq)).alias("rmse"), F.avg(sq).alias("mse")]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)
