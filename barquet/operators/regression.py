"""Least-squares fits as aggregates.

A simple regression is a handful of sums, so it is a grouped aggregate
with a map-side stage: no rows are collected anywhere, and one model per
group (per day, per security) costs the same single shuffle as one model.
Scoring joins the one-row-per-group model table back to the rows; the join
carries no hint, so AQE broadcasts it once its measured size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from barquet.operators.bars import time_order_key


def _keys(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def ols_fit(df: DataFrame, y: str, x: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Simple OLS of ``y`` on ``x`` per group: slope, intercept, r2, n.

    Matches ordinary least squares as fitted by common libraries, including
    the constant-``x`` case (slope 0, intercept = mean of y, r2 = 1 if y is
    constant too, else 0). r2 is NULL below two points.
    """
    keys = _keys(by)
    xc, yc = F.col(x), F.col(y)
    pair = xc.isNotNull() & yc.isNotNull()
    xs, ys = F.when(pair, xc), F.when(pair, yc)
    agg = [F.regr_slope(yc, xc).alias("_s"), F.regr_intercept(yc, xc).alias("_i"), F.regr_r2(yc, xc).alias("_r2"),
           F.regr_count(yc, xc).alias("n"), F.avg(ys).alias("_my"), F.var_pop(xs).alias("_vx"),
           F.var_pop(ys).alias("_vy")]
    g = df.groupBy(*keys).agg(*agg) if keys else df.agg(*agg)
    const_x = F.col("_vx") == 0
    return g.select(
        *keys,
        F.when(const_x, F.lit(0.0)).otherwise(F.col("_s")).alias("slope"),
        F.when(const_x, F.col("_my")).otherwise(F.col("_i")).alias("intercept"),
        F.when(F.col("n") < 2, F.lit(None).cast("double"))
         .when(const_x, F.when(F.col("_vy") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
         .otherwise(F.col("_r2")).alias("r2"),
        F.col("n").cast("long").alias("n"))


def ols_predict(df: DataFrame, model: DataFrame, x: str, by: str | Sequence[str] | None = None,
                name: str = "prediction") -> DataFrame:
    """Fitted values ``slope * x + intercept`` with the group's model."""
    keys = _keys(by)
    m = model.select(*keys, F.col("slope").alias("_bq_slope"), F.col("intercept").alias("_bq_icpt"))
    if keys:
        j = df.join(m, on=keys, how="left")
    else:  # a single global model: exactly one row, so broadcasting it is bounded
        j = df.withColumn("_bq_one", F.lit(1)).join(F.broadcast(m.withColumn("_bq_one", F.lit(1))),
                                                   on="_bq_one", how="left").drop("_bq_one")
    return j.withColumn(name, F.col("_bq_slope") * F.col(x) + F.col("_bq_icpt")).drop("_bq_slope", "_bq_icpt")


def linregress(df: DataFrame, y: str, x: str, by: str | Sequence[str] | None = None,
               p_value: bool = True) -> DataFrame:
    """slope, intercept, r, stderr (of the slope), intercept_stderr, n and the two-sided p value.

    ``r`` is clamped to [-1, 1] against rounding, and NULL (with what follows
    from it) where a column is constant. The p value tests slope = 0
    with Student's t on n - 2 degrees of freedom; it is computed on the one-row-per-group result by a vectorised
    pandas function.
    """
    keys = _keys(by)
    xc, yc = F.col(x), F.col(y)
    pair = xc.isNotNull() & yc.isNotNull()
    xs, ys = F.when(pair, xc), F.when(pair, yc)
    agg = [F.regr_slope(yc, xc).alias("slope"), F.regr_intercept(yc, xc).alias("intercept"),
           F.covar_pop(xs, ys).alias("_cxy"),
           F.regr_count(yc, xc).cast("long").alias("n"),
           F.var_pop(xs).alias("_vx"), F.var_pop(ys).alias("_vy"), F.avg(xs).alias("_mx")]
    g = df.groupBy(*keys).agg(*agg) if keys else df.agg(*agg)
    raw = F.try_divide(F.col("_cxy"), F.sqrt(F.col("_vx") * F.col("_vy")))
    g = g.withColumn("r", F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(-1.0)), F.lit(1.0))))
    dof = F.col("n") - 2
    se = F.sqrt(F.try_divide((F.lit(1.0) - F.col("r") * F.col("r")) * F.col("_vy"), F.col("_vx") * dof))
    out = g.select(*keys, "slope", "intercept", "r", se.alias("stderr"),
                   (se * F.sqrt(F.col("_vx") + F.col("_mx") * F.col("_mx"))).alias("intercept_stderr"), "n")
    if p_value:
        t = F.try_divide(F.col("r") * F.sqrt(dof.cast("double")), F.sqrt(F.lit(1.0) - F.col("r") * F.col("r")))
        out = out.withColumn("p_value", student_t_two_sided_p(t, dof.cast("double")))
    return out


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)


def _two_sided_tail(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """``P(|T| >= t)`` of Student's t by quadrature.

    With ``T = sqrt(dof) tan(phi)`` the density is proportional to
    ``cos(phi)^(dof - 1)``. For small ``t`` the middle part is integrated over
    ``phi``; for larger ``t`` the tail, over ``v`` in
    ``cos(phi) = cos(theta) exp(-v^2 / dof)``, which is smooth and carries the
    tail's size as a factor, so small probabilities keep their digits.
    """
    from math import exp, lgamma, log, pi
    half = np.array([exp(lgamma((n + 1) / 2) - lgamma(n / 2)) if n < 1e4
                     else (n / 2) ** 0.5 * (1 - 1 / (4 * n) + 1 / (32 * n * n)) for n in dof])
    scale = half / pi ** 0.5  # 1 / B(1/2, dof/2)
    n, angle = dof[:, None], np.arctan(t / np.sqrt(dof))[:, None]
    phi = angle * (_NODES + 1) / 2
    with np.errstate(under="ignore"):
        middle = (np.exp((n - 1) * np.log(np.cos(phi))) * _WEIGHTS).sum(1) * angle[:, 0] / 2
        log_cos2 = -np.log1p((t * t / dof))[:, None]
        v = 3.5 * (_NODES + 1)
        inner = 1.0 - np.exp(log_cos2 - 2.0 * v * v / n)
        tail = (np.exp(-v * v) * 2.0 * v / np.sqrt(inner) * _WEIGHTS).sum(1) * 3.5 / dof
        far = 2.0 * scale * np.exp(dof / 2 * log_cos2[:, 0]) * tail
    return np.where(t < 1.5, 1.0 - 2.0 * scale * middle, np.minimum(far, 1.0))


@F.pandas_udf(DoubleType())
def _t_p_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    tv, dv = t.to_numpy(dtype=float, na_value=np.nan), dof.to_numpy(dtype=float, na_value=np.nan)
    out = np.full(len(tv), np.nan)
    ok = np.isfinite(tv) & np.isfinite(dv) & (dv > 0)
    if ok.any():
        out[ok] = _two_sided_tail(np.abs(tv[ok]), dv[ok])
    inf = np.isinf(tv) & (dv > 0)
    out[inf] = 0.0
    return pd.Series(out)


def student_t_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p value ``P(|T| >= |t|)`` for Student's t (NULL when undefined)."""
    p = _t_p_udf(t, dof)
    return F.when(F.isnan(p), F.lit(None).cast("double")).otherwise(p)


def predict_days_ahead(bars: DataFrame, model: DataFrame, start_date: str, periods: int = 3,
                       by: str | Sequence[str] | None = "ISIN", x: str = "StartPrice", time_col: str = "Time",
                       name: str = "predicted_EndPrice", tiebreak: str | None = None) -> DataFrame:
    """For each key (or once, with ``by=None``) and each of ``periods`` dates from
    ``start_date``: the day's first ``x`` by time (then ``tiebreak``), scored
    with the model; NULL where the day has no data (M1c).
    """
    keys = _keys(by)
    d0 = F.to_date(F.lit(start_date))
    base = model.select(*keys).distinct() if keys else model.select(F.lit(1).alias("_bq_one"))
    days = base.select(*keys, F.explode(F.sequence(d0, F.date_add(d0, periods - 1))).alias("_d")) \
        .select(*keys, F.date_format("_d", "yyyy-MM-dd").alias("Date"))
    in_days = bars.filter(F.col(x).isNotNull()) \
        .filter(F.col("Date").between(F.date_format(d0, "yyyy-MM-dd"),
                                      F.date_format(F.date_add(d0, periods - 1), "yyyy-MM-dd"))) \
        .withColumn("_bq_ord", time_order_key(time_col))
    # first by time with the long key (a hash aggregate over the bars); a text
    # tiebreak is applied afterwards, on one row per (day, tiebreak value)
    if tiebreak:
        per = in_days.groupBy(*keys, "Date", tiebreak).agg(
            F.min("_bq_ord").alias("_bq_o"), F.min_by(x, F.col("_bq_ord")).alias("_bq_x"))
        firsts = per.groupBy(*keys, "Date").agg(
            F.min_by("_bq_x", F.struct("_bq_o", tiebreak)).alias(f"first_{x}"))
    else:
        firsts = in_days.groupBy(*keys, "Date").agg(F.min_by(x, F.col("_bq_ord")).alias(f"first_{x}"))
    j = days.join(firsts, on=keys + ["Date"], how="left")
    return ols_predict(j, model, f"first_{x}", by=keys or None, name=name)
