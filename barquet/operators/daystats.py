"""Statistics kept a day and merged over any range of days, without the bars behind them.

*Moments* (for M1, M1b, D5): per day (and group) the count, means and centred
sums of squares and products of a pair of columns. Two days merge exactly, so
the fit of any closed range of days is an aggregate over one row a day.

*Sketches* (for A5, A6, D8): per day the row count and HyperLogLog sketches
(4 to 16 KB) of the securities and groups, which merge by union.

Both tables are written once a day, partitioned by the day, and read with a
filter on it, which prunes folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sketch size: 2 ** 14 registers, a relative standard error of about 0.8 %.
SKETCH_BITS = 14
MOMENTS = ("n", "mean_x", "mean_y", "cxx", "cxy", "cyy")


def _keys(by: str | Sequence[str] | None) -> list[str]:
    return [] if by is None else [by] if isinstance(by, str) else list(by)


def day_moments(rows: DataFrame, y: str, x: str, by: str | Sequence[str] | None = None, day: str = "Date") -> DataFrame:
    """Per day and group: n, mean_x, mean_y, cxx, cxy, cyy of the rows that have both columns."""
    keys = list(dict.fromkeys([day, *_keys(by)]))
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    pairs = rows.filter(xs.isNotNull() & ys.isNotNull())
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(xs).alias("mean_x"), F.avg(ys).alias("mean_y"),
        (F.var_pop(xs) * F.count(F.lit(1))).alias("cxx"), (F.covar_pop(xs, ys) * F.count(F.lit(1))).alias("cxy"), (F.var_pop(ys) * F.count(F.lit(1))).alias("cyy"))


def merge_moments(moments: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """One row of moments a group (one in all without ``by``) from any rows of moments.

    The means are merged first and the spread of the parts' means about them
    is added to their own, so nothing cancels where means are large.
    """
    keys = _keys(by)
    m = moments if keys else moments.withColumn("_bq_one", F.lit(1))
    on = keys or ["_bq_one"]
    total = m.groupBy(*on).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean_x")) / F.sum("n")).alias("_mx"), (F.sum(F.col("n") * F.col("mean_y")) / F.sum("n")).alias("_my"))
    dx, dy = F.col("mean_x") - F.col("_mx"), F.col("mean_y") - F.col("_my")
    out = m.join(total, on).groupBy(*on, "_n", "_mx", "_my").agg(
        F.sum(F.col("cxx") + F.col("n") * dx * dx).alias("cxx"), F.sum(F.col("cxy") + F.col("n") * dx * dy).alias("cxy"), F.sum(F.col("cyy") + F.col("n") * dy * dy).alias("cyy"))
    return out.select(*keys, F.col("_n").alias("n"), F.col("_mx").alias("mean_x"), F.col("_my").alias("mean_y"), "cxx", "cxy", "cyy")


def _between(table: DataFrame, start: str | None, end: str | None, day: str) -> DataFrame:
    if start is not None:
        table = table.filter(F.col(day) >= F.lit(start))
    return table if end is None else table.filter(F.col(day) <= F.lit(end))


def ols_between(moments: DataFrame, start: str | None = None, end: str | None = None, by: str | Sequence[str] | None = None, day: str = "Date") -> DataFrame:
    """Simple OLS of y on x over the days of a closed range (M1, D5): slope, intercept, r2, n, as :func:`barquet.operators.regression.ols_fit` gives them."""
    m = merge_moments(_between(moments, start, end, day), by)
    const = F.col("cxx") == 0
    slope = F.when(const, F.lit(0.0)).otherwise(F.try_divide("cxy", "cxx"))
    r2 = F.when(F.col("cyy") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("cxy") * F.col("cxy"), F.col("cxx") * F.col("cyy")))
    return m.select(*_keys(by), slope.alias("slope"), (F.col("mean_y") - slope * F.col("mean_x")).alias("intercept"),
                    F.when(F.col("n") < 2, F.lit(None).cast("double")).when(const, F.when(F.col("cyy") == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(r2).alias("r2"),
                    F.col("n").cast("long").alias("n"))


def linregress_between(moments: DataFrame, start: str | None = None, end: str | None = None, by: str | Sequence[str] | None = None, day: str = "Date") -> DataFrame:
    """slope, intercept, r, stderr, intercept_stderr, n over the days of a closed range (M1b without the p value); errors are NULL below three points or for a constant x."""
    m = merge_moments(_between(moments, start, end, day), by)
    slope = F.try_divide("cxy", "cxx")
    raw = F.try_divide(F.col("cxy"), F.sqrt(F.col("cxx") * F.col("cyy")))
    r = F.when(raw.isNotNull(), F.greatest(F.least(raw, F.lit(1.0)), F.lit(-1.0)))
    error = F.when(F.col("n") > 2, F.sqrt(F.try_divide((1 - r * r) * F.col("cyy"), F.col("cxx") * (F.col("n") - 2))))
    return m.select(*_keys(by), slope.alias("slope"), (F.col("mean_y") - slope * F.col("mean_x")).alias("intercept"), r.alias("r"), error.alias("stderr"),
                    (error * F.sqrt(F.col("cxx") / F.col("n") + F.col("mean_x") * F.col("mean_x"))).alias("intercept_stderr"), F.col("n").cast("long").alias("n"))


def day_sketches(bars: DataFrame, key: str = "ISIN", day: str = "Date", bits: int = SKETCH_BITS) -> DataFrame:
    """Per day: n_rows, whether a security is missing, and a sketch of the securities (NULL where a day has none)."""
    return bars.groupBy(day).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.max(F.col(key).isNull()), F.lit(False)).alias("missing"),
                                 F.hll_sketch_agg(key, F.lit(bits)).alias("securities"))


def explore_between(sketches: DataFrame, start: str | None = None, end: str | None = None, day: str = "Date") -> DataFrame:
    """Rows (exact), distinct securities (a missing one counted once) and (security, day) groups of a closed range of days, from the days' sketches."""
    held = _between(sketches, start, end, day)
    groups = F.when(F.col(day).isNotNull(), F.hll_sketch_estimate("securities"))
    return held.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
                    (F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("securities")), F.lit(0)) + F.coalesce(F.max(F.col("missing").cast("int")), F.lit(0))).cast("long").alias("n_securities"),
                    F.coalesce(F.sum(groups), F.lit(0)).cast("long").alias("n_groups"))
