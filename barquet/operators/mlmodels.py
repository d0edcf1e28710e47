"""Models fitted with MLlib (M3, M4, M5).

MLlib estimators fit in distributed passes (the normal-equation solver of
``LinearRegression`` is one aggregation of the Gram matrix; GBT and GLM
iterate over cached partitions), so training rows never go through the
driver. ``fit`` is eager: it runs Spark jobs when called.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquet.operators.metrics import errors_by
from barquet.session import materialize
from barquet.operators.series import lag_windows, lead_pairs, minmax_fit, minmax_inverse, minmax_scale


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _regressor(kind: str, features: str, label: str):
    if kind == "linear":
        return LinearRegression(featuresCol=features, labelCol=label, solver="normal", regParam=0.0)
    if kind == "gbt":
        return GBTRegressor(featuresCol=features, labelCol=label, maxIter=50, maxDepth=4, seed=7)
    raise ValueError(f"unknown model kind {kind!r}")


def multi_feature_regression(df: DataFrame, label: str, features: Sequence[str], kind: str = "linear"):
    """Regress ``label`` on several columns (M3). Returns (model, one-row summary, predictions).

    The summary has the coefficients (linear only), intercept, and the
    training MSE and RMSE (A8, A7) computed as aggregates of the predictions.
    The model is a pipeline over the feature columns as they are:
    :func:`multi_feature_predict` scores new rows with it.
    """
    rows = df.na.drop(subset=[label, *features])
    va = VectorAssembler(inputCols=list(features), outputCol="_bq_x", handleInvalid="keep")
    data = materialize(va.transform(rows))
    model = _regressor(kind, "_bq_x", label).fit(data)
    pred = model.transform(data).drop("_bq_x")
    err = errors_by(pred, label, "prediction")
    if kind == "linear":
        coef = F.array(*[F.lit(float(c)) for c in model.coefficients])
        summary = err.select(coef.alias("coefficients"), F.lit(float(model.intercept)).alias("intercept"),
                             "mse", "rmse")
    else:
        summary = err
    return PipelineModel([va, model]), summary, pred


def multi_feature_predict(model: PipelineModel, rows: DataFrame, name: str = "prediction") -> DataFrame:
    """New rows with the prediction of a :func:`multi_feature_regression` model; NULL where a feature is missing."""
    missing = F.lit(False)
    for c in model.stages[0].getInputCols():
        missing = missing | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    scored = model.transform(rows).drop("_bq_x")
    return scored.withColumn("prediction", F.when(~missing, F.col("prediction"))).withColumnRenamed("prediction", name)


def series_positions(df: DataFrame, key: str | Sequence[str], order: str, name: str = "idx") -> DataFrame:
    """Dense positions 0..n-1 per key in ``order`` (for report rows: one per key and day)."""
    w = Window.partitionBy(*_keys(key)).orderBy(order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def lag_forecast(series: DataFrame, key: str | Sequence[str], idx: str, value: str, time_step: int = 10,
                 horizon: int = 7, frac: float = 0.8, kind: str = "linear", fit_on: str = "all"):
    """Lag-window forecaster.

    Scale each key to [0, 1] (fitted on all rows as the reference does, or on
    the training part with ``fit_on="train"``), build ``time_step`` lag
    windows inside the chronological parts, fit one regressor on the training
    windows of all keys, report RMSE per key and part in price units, and
    forecast ``horizon`` steps per key by feeding each prediction back.

    The linear model needs no table of windows: one aggregate per key and part
    holds all sums of products of (1, target, lags), whose total over the
    training parts gives the coefficients and whose own form in them each
    part's squared error. The trees of ``kind="gbt"`` are fitted on the
    windows themselves, which are written once.

    Returns ``(forecast, errors)``: ``forecast`` has key, step, idx,
    forecast; ``errors`` has key, split, rmse, mse. ``series`` is read three
    times (statistics, windows, last values): pass a materialized DataFrame
    when it is expensive to produce (:func:`barquet.plans.analytics.report_lag_forecast` does).
    """
    keys = _keys(key)
    # one pass for every per-key number the job needs (length, last position,
    # scaling bounds), written once: it is read four times below
    x = F.col(value)
    stats = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(idx).alias("_last"),
                                      F.min(x).alias("_min_all"), F.max(x).alias("_max_all"))
    if fit_on == "train":
        cut = series.join(stats.select(*keys, "n"), on=keys) \
                    .filter(F.col(idx) < F.floor(F.col("n") * F.lit(frac)))
        bounds = cut.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        stats = stats.join(bounds, on=keys)
    else:
        stats = stats.withColumn("_lo", F.col("_min_all")).withColumn("_hi", F.col("_max_all"))
    stats = materialize(stats.select(
        *keys, "n", "_last", F.col("_lo").alias("scale_min"),
        F.coalesce(F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(1.0)).alias("scale_range")))
    fit = stats.select(*keys, "scale_min", "scale_range")
    scaled = minmax_scale(series, keys, value, name="_bq_v", fit=fit)
    windows = lag_windows(scaled, keys, idx, "_bq_v", time_step=time_step, frac=frac,
                          features="_bq_f", target="_bq_t", lengths=stats.select(*keys, "n"))
    if kind == "linear":
        moments = materialize(_lag_moments(windows, keys, time_step))
        weights = _lag_weights(moments, time_step)
        errors = _lag_errors(moments, weights, fit, keys)
        predict = lambda w: F.aggregate(F.zip_with(w, F.array(*[F.lit(c) for c in weights[1:]]), lambda x, c: x * c), F.lit(weights[0]), lambda acc, t: acc + t)
    else:
        # The solver makes several passes over its input: write the windows once
        # (reliable checkpoint in the shared folder) instead of recomputing the
        # scans, aggregates and windows behind them on every pass.
        windows = materialize(windows.withColumn("_bq_x", array_to_vector("_bq_f")))
        model = _regressor(kind, "_bq_x", "_bq_t").fit(windows.filter(F.col("split") == "train"))
        pred = model.transform(windows).join(fit, on=keys)
        pred = pred.select(*keys, idx, "split", minmax_inverse("_bq_t").alias("actual"),
                           minmax_inverse("prediction").alias("predicted"))
        errors = errors_by(pred, "actual", "predicted", [*keys, "split"])

    # the last time_step scaled values of each key, oldest first (a bounded group of time_step rows)
    tail = scaled.join(stats.select(*keys, "_last"), on=keys).filter(F.col(idx) > F.col("_last") - time_step)
    state = tail.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col("_bq_v").alias("v")))),
                    lambda s: s["v"]).alias("_bq_w"),
        F.max(idx).alias("_last"))
    if kind == "linear":
        # all steps in one expression: each appends the prediction from the last time_step entries
        grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("_bq_w"),
                            lambda acc, _: F.concat(acc, F.array(predict(F.slice(acc, -time_step, time_step)))))
        state = state.withColumn("_bq_out", F.when(F.size("_bq_w") == time_step, F.slice(grown, time_step + 1, horizon)).otherwise(F.array().cast("array<double>")))
    else:
        state = state.withColumn("_bq_out", F.array().cast("array<double>"))
        for _ in range(horizon):
            stepped = model.transform(state.withColumn("_bq_x", array_to_vector("_bq_w")))
            state = stepped.select(
                *keys, "_last",
                F.slice(F.concat("_bq_w", F.array(F.col("prediction"))), 2, time_step).alias("_bq_w"),
                F.concat("_bq_out", F.array(F.col("prediction"))).alias("_bq_out"))
    fc = (state.select(*keys, "_last", F.posexplode("_bq_out").alias("_p", "_v"))
          .join(fit, on=keys)
          .select(*keys, (F.col("_p") + 1).cast("long").alias("step"), (F.col("_last") + F.col("_p") + 1).alias(idx),
                  minmax_inverse("_v").alias("forecast")))
    return fc, errors


def _lag_moments(windows: DataFrame, keys: list[str], time_step: int) -> DataFrame:
    """Per key and part, the sums of products of (1, target, oldest to newest lag): m_i_j, i <= j."""
    z = [F.lit(1.0), F.col("_bq_t"), *[F.col("_bq_f")[i] for i in range(time_step)]]
    flat = windows.select(*keys, "split", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    return flat.groupBy(*keys, "split").agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"m_{i}_{j}") for i in range(len(z)) for j in range(i, len(z))])


def _lag_weights(moments: DataFrame, time_step: int) -> list[float]:
    """Intercept and coefficients from the total over the training parts (one row reaches the driver)."""
    d = time_step + 2
    total = moments.filter(F.col("split") == "train").agg(*[F.sum(f"m_{i}_{j}").alias(f"m_{i}_{j}") for i in range(d) for j in range(i, d)]).collect()[0]
    if total["m_0_0"] is None:
        raise ValueError(f"no training part has more than {time_step + 1} rows")
    m = np.array([[total[f"m_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    x = [0, *range(2, d)]
    return [float(c) for c in np.linalg.pinv(m[np.ix_(x, x)], rcond=1e-15, hermitian=True) @ m[x, 1]]


def _lag_errors(moments: DataFrame, weights: list[float], fit: DataFrame, keys: list[str]) -> DataFrame:
    """rmse and mse per key and part in price units: the squared error is a form in the moments."""
    v = [-weights[0], 1.0, *[-c for c in weights[1:]]]
    square = F.lit(0.0)
    for i in range(len(v)):
        for j in range(i, len(v)):
            square = square + F.lit(v[i] * v[j] * (1 if i == j else 2)) * F.col(f"m_{i}_{j}")
    mse = F.greatest(square, F.lit(0.0)) / F.col("m_0_0") * F.col("scale_range") * F.col("scale_range")
    return moments.join(fit, on=keys).withColumn("mse", mse).select(*keys, "split", F.sqrt("mse").alias("rmse"), "mse")


def sigmoid_unit(series: DataFrame, key: str | Sequence[str], order: str, value: str, shift: int = 7,
                 max_iter: int = 100):
    """One sigmoid unit without bias from a scaled price to the scaled price ``shift`` rows later (M5).

    Fitted as a logistic-link GLM with no intercept (the same functional form
    as the reference's hand-written unit; fractional labels in [0, 1] are
    accepted). Returns ``(model, predictions)``: the fitted MLlib model (its
    single coefficient is the unit's weight) and, for the last ``shift`` rows
    of each key, the predicted price ``shift`` rows later.
    """
    keys = _keys(key)
    # the input feeds the pairs and the last rows, the pairs feed two scalers
    # and the training set: write each once
    series = materialize(series.select(*keys, order, value))
    pairs = materialize(lead_pairs(series, keys, order, value, shift, name="_bq_y"))
    xfit = minmax_fit(pairs, keys, value)
    yfit = minmax_fit(pairs, keys, "_bq_y") \
        .withColumnRenamed("scale_min", "y_min").withColumnRenamed("scale_range", "y_range")
    data = (minmax_scale(pairs, keys, value, name="_bq_xs", fit=xfit).join(yfit, on=keys)
            .withColumn("_bq_ys", (F.col("_bq_y") - F.col("y_min")) / F.col("y_range"))
            .withColumn("_bq_x", array_to_vector(F.array("_bq_xs"))))
    data = materialize(data)  # the GLM solver iterates over its input
    glm = GeneralizedLinearRegression(family="binomial", link="logit", fitIntercept=False, maxIter=max_iter,
                                      featuresCol="_bq_x", labelCol="_bq_ys")
    model = glm.fit(data)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    last = series.withColumn("_bq_rn", F.row_number().over(w)).filter(F.col("_bq_rn") <= shift)
    last = minmax_scale(last, keys, value, name="_bq_xs", fit=xfit).join(yfit, on=keys) \
        .withColumn("_bq_x", array_to_vector(F.array("_bq_xs")))
    pred = model.transform(last).select(
        *keys, order, value, (F.col("prediction") * F.col("y_range") + F.col("y_min")).alias("predicted_later"))
    return model, pred
