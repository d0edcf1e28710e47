"""Series forecasts as aggregates (M6b AR(1), M6 ARMA(1,1)).

Each fit reduces a series to a few sums per key (grouped aggregates with a
map-side stage, so a series holding a third of all rows is pre-reduced in
every scan task). What is left is one small row per key; where a linear
system has to be solved on it, a vectorised pandas function does that
over batches of keys (``mapInPandas``: no extra shuffle). Forecast rows are
generated per key with ``explode(sequence(1, h))``.

The fits here are conditional least squares (Hannan-Rissanen for the ARMA,
refined on request); the exact likelihood of the ARMA is in
:mod:`barquet.operators.arma`, and ``method="likelihood"`` forecasts from it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barquet.operators import arma
from barquet.operators.series import DEFAULT_BLOCK, with_shifts
from barquet.session import materialize


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def ar1_fit(series: DataFrame, key: str | Sequence[str], idx: str, value: str,
            block: int = DEFAULT_BLOCK, lagged: DataFrame | None = None) -> DataFrame:
    """AR(1) with constant per key: ``phi``, ``c``, last value, last position, n."""
    keys = _keys(key)
    if lagged is None:
        lagged = with_shifts(series, keys, idx, value, lags=[1], block=block, lag_name="_bq_y1")
    y, y1 = F.col(value), F.col("_bq_y1")
    return lagged.groupBy(*keys).agg(
        F.regr_slope(y, y1).alias("phi"), F.regr_intercept(y, y1).alias("c"),
        F.max_by(y, F.col(idx)).alias("last_value"), F.max(idx).cast("long").alias("last_idx"),
        F.count(F.lit(1)).alias("n"))


def ar1_forecast(series: DataFrame, key: str | Sequence[str], idx: str, value: str, steps: int = 100,
                 block: int = DEFAULT_BLOCK) -> DataFrame:
    """``steps`` forecasts per key: ``mu + phi^h (y_n - mu)``, ``mu = c / (1 - phi)``.

    NULL when the fit is not stationary (``|phi| >= 1``) or undefined.
    """
    keys = _keys(key)
    fit = ar1_fit(series, keys, idx, value, block)
    mu = F.col("c") / (F.lit(1.0) - F.col("phi"))
    h = F.col("step")
    fc = F.when(F.abs(F.col("phi")) < 1, mu + F.pow(F.col("phi"), h) * (F.col("last_value") - mu))
    return (fit.select(*keys, "phi", "c", "last_value", "last_idx",
                       F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
            .withColumn("step", F.col("step").cast("long"))
            .select(*keys, "step", (F.col("last_idx") + h).alias(idx), fc.alias("forecast")))


def ar1_fitted(series: DataFrame, key: str | Sequence[str], idx: str, value: str,
               block: int = DEFAULT_BLOCK, name: str = "prediction") -> DataFrame:
    """One-step in-sample predictions ``c + phi * y_(t-1)`` (first row of each key has none)."""
    keys = _keys(key)
    lagged = materialize(with_shifts(series, keys, idx, value, lags=[1], block=block, lag_name="_bq_y1"))
    fit = ar1_fit(series, keys, idx, value, block, lagged=lagged).select(*keys, "phi", "c")
    return (lagged.join(fit, on=keys, how="left")
            .withColumn(name, F.col("c") + F.col("phi") * F.col("_bq_y1"))
            .drop("_bq_y1", "phi", "c"))


# --- normal equations -------------------------------------------------------

def _sym_sums(z: list, y, prefix: str) -> list:
    """Sums of z_i z_j (i <= j) and z_i y as aggregate columns."""
    out = []
    d = len(z)
    for i in range(d):
        for j in range(i, d):
            out.append(F.sum(z[i] * z[j]).alias(f"{prefix}_xx_{i}_{j}"))
        out.append(F.sum(z[i] * y).alias(f"{prefix}_xy_{i}"))
    return out


def solve_normal_equations(sums: DataFrame, keys: Sequence[str], dim: int, prefix: str,
                           out_names: Sequence[str]) -> DataFrame:
    """Solve ``(Z'Z) b = Z'y`` for every row of a sums table (one row per key).

    Runs over batches of keys with ``mapInPandas`` (least squares, so a
    singular system still gives the minimum-norm answer).
    """
    keys = list(keys)
    key_fields = [f for f in sums.schema.fields if f.name in keys]
    schema = StructType(key_fields + [StructField(n, DoubleType()) for n in out_names])

    def solve(batches):
        for pdf in batches:
            m = len(pdf)
            a = np.empty((m, dim, dim))
            b = np.empty((m, dim))
            for i in range(dim):
                b[:, i] = pdf[f"{prefix}_xy_{i}"].to_numpy(dtype=float, na_value=np.nan)
                for j in range(i, dim):
                    v = pdf[f"{prefix}_xx_{i}_{j}"].to_numpy(dtype=float, na_value=np.nan)
                    a[:, i, j] = v
                    a[:, j, i] = v
            ok = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
            coef = np.full((m, dim), np.nan)
            if ok.any():
                # batched pseudo-inverse: the minimum-norm least-squares answer, also for singular systems
                coef[ok] = np.einsum("kij,kj->ki", np.linalg.pinv(a[ok]), b[ok])
            out = pdf[keys].reset_index(drop=True).copy()
            for i, n in enumerate(out_names):
                out[n] = coef[:, i]
            yield out

    return sums.mapInPandas(solve, schema)


def arma11_css_refine(lagged: DataFrame, params: DataFrame, keys: Sequence[str], idx: str, iterations: int,
                      max_root: float = 0.999) -> DataFrame:
    """Gauss-Newton steps on the conditional sum of squares of ARMA(1,1): keys, c, phi, theta, converged.

    ``lagged`` has the centred value ``_bq_y``; ``params`` has ``c, phi,
    theta`` per key (the two-stage estimate as a start). The values are laid
    out once in blocks; a step is one pass over them and one small shuffle
    (:func:`barquet.operators.arma.css_refine`). The start is set back inside
    ``max_root``, and of a step that would leave it the largest halving that
    stays inside is taken. Steps stop early once no estimate moves by more
    than 1e-9; ``converged`` says for which series that held.
    """
    keys = list(keys)
    laid = arma.layout(lagged, keys, idx, "_bq_y")
    before = laid.select(*keys, (F.col("_block") + 1).alias("_block"), F.element_at("_y", -1).alias("_before"))
    joined = materialize(laid.drop("_prev").join(before, [*keys, "_block"], "left"), merge=True)  # once, not in every step
    return arma.css_refine(joined, params, keys, iterations, max_root)


def _two_stage(batches, keys: list[str], p: int, names: list[str]):
    """Both regressions of every key from its moment matrix of (1, y, lag 1 .. lag p + 1)."""
    d = p + 3
    for pdf in batches:
        out = pdf[keys].reset_index(drop=True).copy()
        coef = np.full((len(pdf), 3), np.nan)
        m = np.empty((len(pdf), d, d))
        for i in range(d):
            for j in range(i, d):
                m[:, i, j] = m[:, j, i] = pdf[f"m_{i}_{j}"].to_numpy(dtype=float, na_value=np.nan)
        for k in np.flatnonzero(np.isfinite(m).all(axis=(1, 2))):
            own = m[k]
            x1 = [0, *range(2, p + 2)]
            a = np.linalg.pinv(own[np.ix_(x1, x1)]) @ own[x1, 1]
            z = np.zeros((3, d))  # 1, lag 1, residual of the long regression one step back
            z[0, 0] = z[1, 2] = z[2, 2] = 1.0
            z[2, 0] -= a[0]
            z[2, 3:3 + p] -= a[1:]
            coef[k] = np.linalg.pinv(z @ own @ z.T) @ (z @ own[:, 1])
        for i, n in enumerate(names):
            out[n] = coef[:, i]
        yield out


def arma11_fit(series: DataFrame, key: str | Sequence[str], idx: str, value: str, ar_order: int = 10,
               block: int = DEFAULT_BLOCK, css_iterations: int = 0, max_root: float = 0.999) -> DataFrame:
    """ARMA(1,1) with constant per key by two-stage regression.

    (1) long AR by least squares on the centred series, (2) its residuals
    stand in for the innovations, (3) regress ``y_t`` on ``1, y_(t-1),
    e_(t-1)`` for ``c, phi, theta``, (4) the last innovation in closed form
    ``e_n = sum (-theta)^(n-t) u_t`` with ``u_t = y_t - c - phi y_(t-1)``.
    A residual is linear in the lags, so both regressions come from one
    aggregate, the moment matrix of (1, y, lags) per key; no lag table is
    written. All its entries use the same rows: those whose value and lags
    are all there, so a missing value takes out the rows that it touches.

    The long order is ``ar_order``, less in a series of fewer than
    ``3 * ar_order + 4`` rows. Returns per key: mean, c, phi, theta, last
    centred value, last innovation, last position, n, and ``ok``: false where
    an estimate was at or beyond the unit root and was set back to
    ``max_root``. A series too short for a regression (under six rows) has
    NULL estimates. ``css_iterations`` > 0 refines the estimate by that many
    Gauss-Newton steps on the conditional sum of squares
    (:func:`arma11_css_refine`), which moves it toward the likelihood fit, and
    adds the column ``converged``.
    """
    keys = _keys(key)
    p = ar_order
    stats = series.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"),
                                      F.max(idx).cast("long").alias("last_idx"))
    order = F.least(F.lit(p), F.greatest(F.lit(1), F.floor((F.col("n") - 4) / 3))).cast("int")
    centred = series.join(stats.select(*keys, "mean", F.col("n").alias("_bq_n"), order.alias("_bq_p")), on=keys).withColumn("_bq_y", F.col(value) - F.col("mean"))
    rows = with_shifts(centred.select(*keys, idx, "_bq_n", "_bq_p", "_bq_y"), keys, idx, "_bq_y", lags=list(range(1, p + 2)), block=block, lag_name="_bq_y{k}")
    used = [F.lit(k) <= F.col("_bq_p") + 1 for k in range(1, p + 2)]
    whole = F.col("_bq_y").isNotNull()
    for k, u in enumerate(used, 1):
        whole = whole & (~u | F.col(f"_bq_y{k}").isNotNull())
    z = [F.lit(1.0), F.col("_bq_y"), *[F.when(u, F.col(f"_bq_y{k}")).otherwise(F.lit(0.0)) for k, u in enumerate(used, 1)]]
    zs = rows.filter(whole & (F.col("_bq_n") >= 6)).select(*keys, *[c.alias(f"z{i}") for i, c in enumerate(z)])
    moments = zs.groupBy(*keys).agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"m_{i}_{j}") for i in range(p + 3) for j in range(i, p + 3)])
    names = ["c", "phi", "theta"]
    schema = StructType([f for f in moments.schema.fields if f.name in keys] + [StructField(n, DoubleType()) for n in names])
    raw = moments.mapInPandas(lambda batches: _two_stage(batches, keys, p, names), schema)
    inside = [F.greatest(F.least(F.col(n), F.lit(max_root)), F.lit(-max_root)) for n in ("phi", "theta")]
    estimates = raw.select(*keys, "c", inside[0].alias("phi"), inside[1].alias("theta"),
                      ((F.abs("phi") < max_root) & (F.abs("theta") < max_root)).alias("ok"))
    one = with_shifts(centred.select(*keys, idx, "_bq_y"), keys, idx, "_bq_y", lags=[1], block=block, lag_name="_bq_y{k}")
    if css_iterations > 0:
        start = materialize(estimates, merge=True)
        estimates = (arma11_css_refine(centred, start, keys, idx, css_iterations, max_root)
                     .join(start.select(*keys, "ok"), on=keys))

    # the last innovation
    fit = stats.join(estimates, on=keys, how="left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    u = F.col("_bq_y") - F.col("c") - F.col("phi") * F.col("_bq_y1")
    weight = F.pow(-F.col("theta"), (F.col("last_idx") - F.col(idx)).cast("double"))
    tail = (one.join(fit.select(*keys, "c", "phi", "theta", "last_idx"), on=keys)
            .groupBy(*keys).agg(F.coalesce(F.sum(weight * u), F.lit(0.0)).alias("last_innovation"),
                                F.max_by(F.col("_bq_y"), F.when(F.col("_bq_y").isNotNull(), F.col(idx))).alias("last_centred")))
    return fit.join(tail, on=keys)


#: Steps of the conditional least-squares refinement, unless told otherwise.
CSS_ITERATIONS = 8


def arma11_forecast(series: DataFrame, key: str | Sequence[str], idx: str, value: str, days: int,
                    ar_order: int = 10, block: int = DEFAULT_BLOCK, css_iterations: int = 0, method: str | None = None) -> DataFrame:
    """``days + 1`` forecasts per key after the last position (M6); NULL only where the series is too short for the fit.

    ``method``: ``"two_stage"``, ``"css"`` (the two-stage estimate refined on
    the conditional sum of squares), or ``"likelihood"`` (exact maximum
    likelihood, :func:`barquet.operators.arma.arma11_likelihood`). Without it,
    ``css_iterations`` tells whether to refine.
    """
    keys = _keys(key)
    if method not in (None, "two_stage", "css", "likelihood"):
        raise ValueError(f"unknown method {method!r}")
    h = F.col("step")
    if method == "likelihood":
        fit = arma.arma11_likelihood(series, keys, idx, value)
        fc = F.col("mean") + F.pow("phi", (h - 1).cast("double")) * F.col("next_centred")
        columns = ["mean", "phi", "next_centred"]
    else:
        css = css_iterations or CSS_ITERATIONS if method == "css" else 0 if method == "two_stage" else css_iterations
        fit = arma11_fit(series, keys, idx, value, ar_order, block, css_iterations=css)
        c, phi, theta = F.col("c"), F.col("phi"), F.col("theta")
        f1 = c + phi * F.col("last_centred") + theta * F.col("last_innovation")
        mu = c / (F.lit(1.0) - phi)
        fc = F.col("mean") + mu + F.pow(phi, (h - 1).cast("double")) * (f1 - mu)
        columns = ["mean", "c", "phi", "theta", "last_centred", "last_innovation"]
    return (fit.select(*keys, *columns, "last_idx", F.explode(F.sequence(F.lit(1), F.lit(days + 1))).alias("step"))
            .withColumn("step", F.col("step").cast("long"))
            .select(*keys, "step", (F.col("last_idx") + h).alias(idx),
                    fc.alias("forecast")))
