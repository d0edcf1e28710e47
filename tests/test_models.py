"""Model operators: OLS edge cases, p values, AR(1)/ARMA(1,1) recovery, one-class bounds."""

import math

import numpy as np
import pytest

from barquet.operators.anomaly import one_class_fit, one_class_flags, solve_one_class_dual
from barquet.operators.forecast import ar1_forecast, arma11_fit, arma11_forecast
from barquet.operators.regression import linregress, ols_fit, ols_predict
from barquet.operators.metrics import errors_by


def test_constant_x_regression(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "x double, y double")
    r = ols_fit(df, "y", "x").collect()[0]
    assert (r.slope, r.intercept, r.r2, r.n) == (0.0, 2.0, 0.0, 2)
    p = ols_predict(df, ols_fit(df, "y", "x"), "x").collect()
    assert [q.prediction for q in p] == [2.0, 2.0]


def test_ols_matches_numpy_per_group(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in ("a", "b"):
        x = rng.normal(size=50)
        y = 3 * x + (1 if g == "a" else -2) + rng.normal(scale=0.1, size=50)
        rows += [(g, float(u), float(v)) for u, v in zip(x, y)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in ols_fit(df, "y", "x", by="g").collect()}
    for g in ("a", "b"):
        x = np.array([r[1] for r in rows if r[0] == g])
        y = np.array([r[2] for r in rows if r[0] == g])
        slope, icpt = np.polyfit(x, y, 1)
        r2 = 1 - np.sum((y - (slope * x + icpt)) ** 2) / np.sum((y - y.mean()) ** 2)
        assert math.isclose(got[g].slope, slope, rel_tol=1e-9)
        assert math.isclose(got[g].intercept, icpt, rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(got[g].r2, r2, rel_tol=1e-9)


def test_linregress_p_value(spark):
    # perfectly known case: r from data, t on n - 2 dof; reference values of Student's t
    x = np.arange(12, dtype=float)
    y = x * 0.1 + np.array([0.3, -0.2, 0.1, 0.4, -0.5, 0.2, -0.1, 0.3, -0.4, 0.2, 0.1, -0.3])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = linregress(df, "y", "x").collect()[0]
    rr = np.corrcoef(x, y)[0, 1]
    t = rr * math.sqrt(10 / (1 - rr * rr))
    assert math.isclose(r.r, rr, rel_tol=1e-9)
    # two-sided p from the t statistic by numerical integration of the t density
    grid = np.linspace(abs(t), 200, 400001)
    dens = math.gamma(5.5) / (math.sqrt(10 * math.pi) * math.gamma(5)) * (1 + grid ** 2 / 10) ** -5.5
    p = 2 * np.trapezoid(dens, grid)
    assert math.isclose(r.p_value, p, rel_tol=1e-4)
    se = math.sqrt((1 - rr ** 2) * y.var() / x.var() / 10)
    assert math.isclose(r.stderr, se, rel_tol=1e-9)


def _arma(n, phi, theta, mean, seed):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 200)
    y = np.zeros(n + 200)
    for t in range(1, n + 200):
        y[t] = phi * y[t - 1] + e[t] + theta * e[t - 1]
    return y[200:] + mean


def test_arma11_recovers_parameters(spark):
    y = _arma(20000, 0.8, 0.4, 50.0, 3)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "k string, idx int, v double")
    fit = arma11_fit(df, "k", "idx", "v").collect()[0]
    mean = fit["mean"] + fit.c / (1 - fit.phi)
    assert abs(fit.phi - 0.8) < 0.02 and abs(fit.theta - 0.4) < 0.02 and abs(mean - 50.0) < 0.5
    fc = arma11_forecast(df, "k", "idx", "v", days=5).orderBy("step").collect()
    assert len(fc) == 6 and fc[0].idx == 20000 and all(r.forecast is not None for r in fc)
    # forecasts decay toward the mean
    assert abs(fc[-1].forecast - mean) < abs(fc[0].forecast - mean) + 1e-9


def test_arma_short_series_and_missing_values(spark):
    rows = [("s", i, float(i % 3)) for i in range(20)] + [("tiny", i, float(i)) for i in range(4)] + [("thirty", i, math.sin(i)) for i in range(30)]
    y = _arma(400, 0.7, 0.4, 30.0, 3)
    rows += [("whole", i, float(v)) for i, v in enumerate(y)] + [("holes", i, None if i in (50, 51, 200, 333) else float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, idx int, v double")
    fc = arma11_forecast(df, "k", "idx", "v", days=2).collect()
    assert all((r.forecast is None) == (r.k == "tiny") for r in fc) and len(fc) == 15
    fit = {r.k: r for r in arma11_fit(df, "k", "idx", "v").collect()}
    assert abs(fit["whole"].theta - fit["holes"].theta) < 0.03 and abs(fit["whole"].phi - fit["holes"].phi) < 0.03


def test_css_from_a_start_beyond_the_unit_root(spark):
    from barquet.operators.forecast import arma11_css_refine
    from barquet.operators.series import with_shifts
    y = _arma(400, 0.7, 0.4, 0.0, 5)
    df = spark.createDataFrame([("s", i, float(v - y.mean())) for i, v in enumerate(y)], "k string, idx int, _bq_y double")
    lagged = with_shifts(df, ["k"], "idx", "_bq_y", lags=[1], lag_name="_bq_y{k}")
    for theta in (1.0, 1.2):
        start = spark.createDataFrame([("s", 0.0, 0.5, theta)], "k string, c double, phi double, theta double")
        r = arma11_css_refine(lagged, start, ["k"], "idx", 4).collect()[0]
        assert abs(r.theta) <= 0.999 and abs(r.phi) <= 0.999 and r.theta < 0.999


def test_ar1_forecast_formula(spark):
    y = _arma(5000, 0.6, 0.0, 10.0, 5)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "k string, idx int, v double")
    rows = ar1_forecast(df, "k", "idx", "v", steps=3).orderBy("step").collect()
    x, z = y[:-1], y[1:]
    phi, c = np.polyfit(x, z, 1)
    mu = c / (1 - phi)
    for h, r in enumerate(rows, start=1):
        assert math.isclose(r.forecast, mu + phi ** h * (y[-1] - mu), rel_tol=1e-9)


def test_one_class_bounds_random_walk(spark):
    rng = np.random.default_rng(11)
    walk = np.round(50 + np.cumsum(rng.choice([-0.1, 0.0, 0.1], size=257)), 1)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(walk)], "k string, idx int, Close double")
    scored = one_class_flags(df, "k", "Close", nu=0.05).collect()
    model = one_class_fit(df, "k", "Close", nu=0.05).collect()[0]
    flagged = sum(r.is_anomaly for r in scored) / 257
    sv_values = set(model.support_values)
    sv_share = sum(1 for v in walk if float(v) in sv_values) / 257
    assert flagged <= 0.05 + 1e-9 <= sv_share + 1e-9
    assert math.isclose(sum(model.support_weights), 0.05 * 257, rel_tol=1e-9)
    assert model.at_bound <= sum(r.is_anomaly for r in scored) + 2


def test_one_class_nu_one_fills_bounds():
    v = np.array([1.0, 2.0, 3.5])
    w = np.array([2.0, 1.0, 3.0])
    a, _ = solve_one_class_dual(v, w, 1.0, 0.5)
    assert np.allclose(a, w)


def test_errors_by(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 1.0), ("b", 1.0, None)], "g string, y double, p double")
    got = {r.g: r for r in errors_by(df, "y", "p", ["g"]).collect()}
    assert math.isclose(got["a"].mse, 2.5) and math.isclose(got["a"].rmse, math.sqrt(2.5))
    assert got["b"].mse is None


@pytest.mark.parametrize("nu", [0.01, 0.2])
def test_one_class_share_property(spark, nu):
    rng = np.random.default_rng(7)
    vals = np.round(rng.normal(100, 5, size=400), 2)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(vals)], "k string, idx int, Close double")
    scored = one_class_flags(df, "k", "Close", nu=nu).collect()
    flagged = sum(r.is_anomaly for r in scored)
    on_boundary = sum(not r.is_anomaly and abs(r.score) < 1e-5 for r in scored)
    assert flagged / 400 <= nu + 1e-9 <= (flagged + on_boundary) / 400 + 1e-9


def _decision(values, a, rho, gamma, x):
    return (a[None, :] * np.exp(-gamma * (x[:, None] - values[None, :]) ** 2)).sum(axis=1) - rho


def test_one_class_kkt_and_grouping():
    rng = np.random.default_rng(5)
    rows = np.round(50 + np.cumsum(rng.normal(0, 0.3, size=300)), 1)
    gamma = 1.0 / rows.var()
    nu = 0.1
    vals, counts = np.unique(rows, return_counts=True)
    a, rho = solve_one_class_dual(vals, counts.astype(float), nu, gamma)
    g = _decision(vals, a, 0.0, gamma, vals)
    free = (a > 1e-9) & (a < counts - 1e-9)
    assert np.all(np.abs(g[free] - rho) < 1e-6)
    assert np.all(g[a <= 1e-9] >= rho - 1e-6) and np.all(g[a >= counts - 1e-9] <= rho + 1e-6)
    # one variable per row (duplicates not merged): same decision function
    a1, rho1 = solve_one_class_dual(rows, np.ones(len(rows)), nu, gamma)
    grid = np.linspace(rows.min() - 1, rows.max() + 1, 200)
    d_grouped = _decision(vals, a, rho, gamma, grid)
    d_rows = _decision(rows, a1, rho1, gamma, grid)
    assert np.max(np.abs(d_grouped - d_rows)) < 1e-6


def test_predict_days_ahead_global_and_missing_day(spark):
    from barquet.operators.regression import predict_days_ahead
    bars = spark.createDataFrame(
        [("A", "2022-12-29", "09:00", 10.0, 11.0), ("A", "2022-12-29", "08:00", 9.0, 9.5),
         ("B", "2022-12-30", "10:00", 20.0, 21.0), ("B", "2022-12-30", "11:00", 21.0, 22.0)],
        "ISIN string, Date string, Time string, StartPrice double, EndPrice double")
    model = linregress(bars, "EndPrice", "StartPrice", by=None, p_value=False)
    rows = sorted(predict_days_ahead(bars, model, "2022-12-29", 3, by=None).collect(), key=lambda r: r.Date)
    assert [r.Date for r in rows] == ["2022-12-29", "2022-12-30", "2022-12-31"]
    assert rows[0].first_StartPrice == 9.0 and rows[1].first_StartPrice == 20.0
    assert rows[2].first_StartPrice is None and rows[2].predicted_EndPrice is None
    m = model.collect()[0]
    assert math.isclose(rows[0].predicted_EndPrice, m.slope * 9.0 + m.intercept)


def _hannan_rissanen(y, p=10):
    yc = y - y.mean()
    n = len(yc)
    # long AR(p) on the rows of both regressions, those with p + 1 lags
    z = np.column_stack([np.ones(n - p)] + [yc[p - k:n - k] for k in range(1, p + 1)])
    a = np.linalg.lstsq(z[1:], yc[p + 1:], rcond=None)[0]
    resid = np.full(n, np.nan)
    resid[p:] = yc[p:] - z @ a
    # regress y_t on 1, y_(t-1), e_(t-1) for t >= p + 1
    t = np.arange(p + 1, n)
    z2 = np.column_stack([np.ones(len(t)), yc[t - 1], resid[t - 1]])
    c, phi, theta = np.linalg.lstsq(z2, yc[t], rcond=None)[0]
    u = yc[1:] - c - phi * yc[:-1]
    w = (-theta) ** (n - 1 - np.arange(1, n))
    return y.mean(), c, phi, theta, float(np.sum(w * u))


def test_arma11_fit_equals_direct_two_stage(spark):
    y = _arma(3000, 0.6, -0.3, 20.0, 9)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "k string, idx int, v double")
    fit = arma11_fit(df, "k", "idx", "v", block=700).collect()[0]
    mean, c, phi, theta, e_n = _hannan_rissanen(y)
    assert math.isclose(fit["mean"], mean, rel_tol=1e-12)
    assert math.isclose(fit.phi, phi, rel_tol=1e-8) and math.isclose(fit.theta, theta, rel_tol=1e-8)
    assert math.isclose(fit.c, c, rel_tol=1e-6, abs_tol=1e-9)
    assert math.isclose(fit.last_innovation, e_n, rel_tol=1e-7, abs_tol=1e-9)


def test_p_value_matches_mllib_normal_solver(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    y = 0.3 * x + rng.normal(size=60)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    ours = linregress(df, "y", "x").collect()[0]
    data = VectorAssembler(inputCols=["x"], outputCol="f").transform(df)
    model = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(data)
    assert math.isclose(model.coefficients[0], ours.slope, rel_tol=1e-9)
    assert math.isclose(model.summary.pValues[0], ours.p_value, rel_tol=1e-6)
    assert math.isclose(model.summary.coefficientStandardErrors[0], ours.stderr, rel_tol=1e-6)


def _css_gauss_newton(y, c, phi, theta, iters):
    yc = y - y.mean()
    n = len(yc)
    for _ in range(iters):
        e, a, b, g = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for t in range(1, n):
            e[t] = yc[t] - c - phi * yc[t - 1] - theta * e[t - 1]
            a[t] = -1 - theta * a[t - 1]
            b[t] = -yc[t - 1] - theta * b[t - 1]
            g[t] = -e[t - 1] - theta * g[t - 1]
        jac = np.column_stack([a[1:], b[1:], g[1:]])
        step = np.linalg.lstsq(jac.T @ jac, -jac.T @ e[1:], rcond=None)[0]
        c, phi, theta = c + step[0], phi + step[1], theta + step[2]
    return c, phi, theta


def test_arma11_css_refinement_equals_sequential(spark):
    y = _arma(2500, 0.7, 0.45, 30.0, 13)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "k string, idx int, v double")
    hr = arma11_fit(df, "k", "idx", "v").collect()[0]
    ref = arma11_fit(df, "k", "idx", "v", css_iterations=3).collect()[0]
    c, phi, theta = _css_gauss_newton(y, hr.c, hr.phi, hr.theta, 3)
    assert math.isclose(ref.phi, phi, rel_tol=1e-7) and math.isclose(ref.theta, theta, rel_tol=1e-7)
    assert math.isclose(ref.c, c, rel_tol=1e-5, abs_tol=1e-8)
    # the refined fit has a smaller conditional sum of squares than the two-stage start
    def sse(c, phi, theta):
        yc = y - y.mean()
        e = np.zeros(len(yc))
        for t in range(1, len(yc)):
            e[t] = yc[t] - c - phi * yc[t - 1] - theta * e[t - 1]
        return float(np.sum(e ** 2))
    assert sse(ref.c, ref.phi, ref.theta) <= sse(hr.c, hr.phi, hr.theta)


def test_one_class_gamma_is_inverse_population_variance(spark):
    rng = np.random.default_rng(21)
    vals = np.round(rng.normal(300000, 900, size=700), 2)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(vals)], "k string, idx int, Close double")
    m = one_class_fit(df, "k", "Close", nu=0.05).collect()[0]
    assert math.isclose(m.gamma, 1.0 / vals.var(), rel_tol=1e-9)


def test_one_class_far_outlier_and_ties():
    for vals in (np.r_[np.random.default_rng(1).normal(size=500), 80.0], np.repeat([1.0, 2.0, 3.0], [5, 100, 7]), np.ones(5)):
        v, c = np.unique(vals, return_counts=True)
        gamma = 1.0 / (np.var(vals) or 1.0)
        a, rho = solve_one_class_dual(v, c, 0.3, gamma)
        g = _decision(v, a, rho, gamma, v)
        assert math.isclose(a.sum(), 0.3 * len(vals), rel_tol=1e-7)
        assert np.all(g[a <= 1e-9] >= -1e-5) and np.all(g[a >= c - 1e-9] <= 1e-5)
