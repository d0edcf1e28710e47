"""MLlib-backed operators (M3, M4, M5) and the series analytics job."""

import math

import numpy as np

from barquet.operators.mlmodels import lag_forecast, multi_feature_regression, sigmoid_unit
from barquet.plans.analytics import analyze_series, report_lag_forecast
from barquet.plans.reports import morning_report
from barquet.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_multi_feature_regression_is_ols(spark):
    m = morning_report(fx.trades_wide(spark, "/root/testdata/sf0.01"))
    feats = ["start_price", "minimum_price", "maximum_price", "daily_traded_volume"]
    _, summary, pred = multi_feature_regression(m, "end_price", feats)
    rows = m.select("end_price", *feats).collect()
    x = np.array([[1.0] + [float(r[f]) for f in feats] for r in rows])
    y = np.array([r.end_price for r in rows])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    s = summary.collect()[0]
    assert math.isclose(s.intercept, beta[0], rel_tol=1e-6, abs_tol=1e-6)
    assert np.allclose(s.coefficients, beta[1:], rtol=1e-6, atol=1e-9)
    mse = float(np.mean((y - x @ beta) ** 2))
    assert math.isclose(s.mse, mse, rel_tol=1e-6)
    assert pred.count() == len(rows)


def test_new_rows_are_scored_by_their_own_columns(spark):
    from barquet.operators.mlmodels import multi_feature_predict
    rows = [(float(i), float(i % 7), 3.0 * i - 2.0 * (i % 7) + 5.0) for i in range(40)]
    model, summary, _ = multi_feature_regression(spark.createDataFrame(rows, "a double, b double, y double"), "y", ["a", "b"])
    new = spark.createDataFrame([(100.0, 3.0, "x"), (None, 1.0, "y"), (1.0, float("nan"), "z")], "a double, b double, tag string")
    got = {r.tag: r.guess for r in multi_feature_predict(model, new, "guess").collect()}
    assert math.isclose(got["x"], 299.0, rel_tol=1e-9) and got["y"] is None and got["z"] is None
    assert np.allclose(summary.collect()[0].coefficients, [3.0, -2.0])


def _walk(spark, n, keys=("a", "b")):
    rng = np.random.default_rng(2)
    rows = []
    for k in keys:
        v = 100 + np.cumsum(rng.normal(0, 1, n))
        rows += [(k, i, float(x)) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "k string, idx int, v double")


def test_lag_forecast_shapes(spark):
    fc, err = lag_forecast(_walk(spark, 120), "k", "idx", "v", time_step=10, horizon=7)
    f = fc.collect()
    assert len(f) == 14 and {(r.k, r.step) for r in f} == {(k, s) for k in "ab" for s in range(1, 8)}
    assert all(r.idx == 119 + r.step for r in f) and all(math.isfinite(r.forecast) for r in f)
    e = {(r.k, r.split): r for r in err.collect()}
    assert set(e) == {(k, s) for k in "ab" for s in ("train", "test")}
    assert all(r.rmse > 0 and math.isclose(r.rmse ** 2, r.mse) for r in e.values())


def test_lag_forecast_fit_on_train_and_report_form(spark):
    fc, _ = lag_forecast(_walk(spark, 60), "k", "idx", "v", time_step=5, horizon=3, fit_on="train")
    assert fc.count() == 6
    rfc, rerr = report_lag_forecast(morning_report(fx.trades(spark, "/root/testdata/sf0.01")), horizon=2)
    # 30 days per security: the test part (6 rows) is shorter than a 10-step window, so only train errors
    assert rfc.count() == 10 and {r.split for r in rerr.collect()} == {"train"} and rerr.count() == 5


def test_sigmoid_unit_outputs_in_target_range(spark):
    m = morning_report(fx.trades(spark, "/root/testdata/sf0.01")).select("ISIN", "Date", "end_price")
    model, pred = sigmoid_unit(m, "ISIN", "Date", "end_price", 7)
    rows = pred.collect()
    assert len(rows) == 35
    lo_hi = {}
    for r in m.collect():
        lo_hi.setdefault(r.ISIN, []).append(r.end_price)
    for r in rows:
        assert min(lo_hi[r.ISIN]) - 1e-9 <= r.predicted_later <= max(lo_hi[r.ISIN]) + 1e-9
    assert len(model.coefficients) == 1 and not model.getFitIntercept()


def test_analyze_series_outputs(spark):
    s = fx.closes_smooth(spark, SF)
    n = {r.series_id: r["count"] for r in s.groupBy("series_id").count().collect()}
    out = analyze_series(s, days=4, nu=0.05)
    assert set(out) == {"forecast", "chart", "scored", "anomalies"}
    assert out["forecast"].count() == 5 * len(n)
    chart = out["chart"].groupBy("series_id", "kind").count().collect()
    for r in chart:
        assert r["count"] == (n[r.series_id] if r.kind == "actual" else 5)
    scored = out["scored"].collect()
    assert len(scored) == sum(n.values())
    assert out["anomalies"].count() == sum(1 for r in scored if r.is_anomaly)


def test_gbt_variants(spark):
    m = morning_report(fx.trades_wide(spark, "/root/testdata/sf0.01"))
    _, summary, pred = multi_feature_regression(m, "end_price", ["start_price", "minimum_price"], kind="gbt")
    s = summary.collect()[0]
    assert s.mse >= 0 and math.isclose(s.rmse ** 2, s.mse)
    fc, err = lag_forecast(_walk(spark, 80), "k", "idx", "v", time_step=5, horizon=2, kind="gbt")
    assert fc.count() == 4 and err.count() == 4
