"""Exact ARMA(1,1) likelihood over blocks, against a plain Kalman filter; and the least-squares steps over the same layout."""
import math

import numpy as np
import pytest

from barquet.operators import arma
from barquet.operators.forecast import arma11_forecast


def simulate(n, phi, theta, mean, seed, missing=()):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 200)
    x = np.zeros(n + 200)
    for t in range(1, n + 200):
        x[t] = phi * x[t - 1] + e[t] + theta * e[t - 1]
    y = mean + x[200:]
    y[list(missing)] = np.nan
    return y


def kalman(y, phi, theta, mean):
    """(log likelihood with the variance at its best, variance, prediction of the next value less the mean): two-dimensional state, one value at a time."""
    t = np.array([[phi, 1.0], [0.0, 0.0]])
    r = np.array([[1.0], [theta]])
    q = r @ r.T
    p = np.linalg.solve(np.eye(4) - np.kron(t, t), q.reshape(-1)).reshape(2, 2)
    a, squares, logs, n = np.zeros(2), 0.0, 0.0, 0
    for v in y:
        if math.isnan(v):
            a, p = t @ a, t @ p @ t.T + q
            continue
        f = p[0, 0]
        e = v - mean - a[0]
        squares += e * e / f
        logs += math.log(f)
        n += 1
        k = p[:, 0] / f
        a, p = t @ (a + k * e), t @ (p - np.outer(k, p[0])) @ t.T + q
    s = squares / n
    return -0.5 * (n * math.log(2 * math.pi * s) + logs + n), s, a[0]


def frame(spark, series):
    rows = [(k, i, None if math.isnan(v) else float(v)) for k, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "k string, idx int, v double").repartition(5)


SERIES = {"long": (3000, 0.8, 0.4, 50.0, 1), "short": (257, 0.6, -0.3, 9.0, 2), "gaps": (1500, 0.7, 0.5, -3.0, 3, [0, 5, 6, 7, 499, 500, 501, 998, 1200]), "near": (2000, 0.97, 0.3, 100.0, 4)}


@pytest.mark.parametrize("block", [arma.BLOCK, 500])
@pytest.mark.parametrize("phi,theta", [(0.7, 0.4), (-0.5, 0.2), (0.95, -0.6), (0.0, 0.0)])
def test_likelihood_equals_a_kalman_filter(spark, block, phi, theta):
    series = {k: simulate(*v) for k, v in SERIES.items()}
    for r in arma.arma11_loglik(frame(spark, series), ["k"], "idx", "v", phi, theta, block=block).collect():
        want, s, following = kalman(series[r.k], phi, theta, r["mean"])
        assert abs(r.loglik - want) < 1e-6 and math.isclose(r.sigma2, s, rel_tol=1e-9) and abs(r.next_centred - following) < 1e-8
        for off in (-1e-3, 1e-3):  # the mean is the best one
            assert kalman(series[r.k], phi, theta, r["mean"] + off)[0] < want


def test_fit_is_the_maximum(spark):
    series = {k: simulate(*v) for k, v in SERIES.items()} | {"tiny": np.array([1.0, 2.0, 1.5]), "one": np.full(40, np.nan)}
    fits = {r.k: r for r in arma.arma11_likelihood(frame(spark, series), ["k"], "idx", "v", block=500).collect()}
    assert set(fits) == set(series) and fits["tiny"].phi is None and fits["one"].phi is None and fits["one"].n == 0
    for k in SERIES:
        r = fits[k]
        y = series[k]
        assert r.converged and r.passes < 25 and r.last_idx == len(y) - 1 and r.n == int((~np.isnan(y)).sum())
        best, s, following = kalman(y, r.phi, r.theta, r["mean"])
        assert abs(r.loglik - best) < 1e-6 and abs(r.next_centred - following) < 1e-6
        for d_phi in (-1e-4, 0, 1e-4):
            for d_theta in (-1e-4, 0, 1e-4):
                assert kalman(y, r.phi + d_phi, r.theta + d_theta, r["mean"])[0] <= best + 1e-9
        for phi in np.linspace(-0.9, 0.9, 7):  # and not only nearby
            for theta in np.linspace(-0.9, 0.9, 7):
                assert kalman(y, phi, theta, r["mean"])[0] <= best + 1e-9
        assert abs(r.phi - SERIES[k][1]) < 0.25 and abs(r.theta - SERIES[k][2]) < 0.3


def test_forecasts_follow_the_fit(spark):
    series = {k: simulate(*v) for k, v in SERIES.items()} | {"tiny": np.array([1.0, 2.0, 1.5])}
    df = frame(spark, series)
    fits = {r.k: r for r in arma.arma11_likelihood(df, ["k"], "idx", "v").collect()}
    got = arma11_forecast(df, "k", "idx", "v", days=3, method="likelihood").collect()
    assert len(got) == 4 * len(series)
    for r in got:
        f = fits[r.k]
        if r.k == "tiny":
            assert r.forecast is None and r.idx == 2 + r.step
        else:
            assert math.isclose(r.forecast, f["mean"] + f.phi ** (r.step - 1) * f.next_centred, rel_tol=1e-9)
            assert r.idx == len(series[r.k]) - 1 + r.step
    with pytest.raises(ValueError):
        arma11_forecast(df, "k", "idx", "v", days=3, method="guess")


def test_elements_combine_in_any_grouping():
    y = simulate(1300, 0.7, 0.5, 2.0, 7, [3, 700])
    phi, theta = np.array([0.7, 0.2]), np.array([0.5, -0.9])
    whole = arma.element(y, 0, None, phi, theta)
    parts, prev = [], None
    for a in range(0, 1300, 400):
        parts.append(arma.element(y[a:a + 400], a, prev, phi, theta))
        prev = y[a:a + 400] if np.isnan(y[a:a + 400]).any() else None
    left = arma.joined(arma.joined(arma.joined(parts[0], parts[1]), parts[2]), parts[3])
    right = arma.joined(parts[0], arma.joined(parts[1], arma.joined(parts[2], parts[3])))
    for k in arma.SUMS:
        assert np.allclose(left[k], right[k], rtol=1e-9, atol=1e-9)
        assert np.allclose(whole[k], left[k], rtol=1e-6, atol=1e-6)


def test_css_grams_equal_the_recurrence():
    rng = np.random.default_rng(3)
    y = rng.normal(size=900).cumsum() * 0.1 + rng.normal(size=900)
    c, phi, theta = 0.1, 0.6, -0.35
    before = np.r_[np.nan, y[:-1]]
    u, xb = np.where(np.isnan(before), 0, y - c - phi * before), np.where(np.isnan(before), 0, -before)
    e, j = np.zeros(900), np.zeros((900, 3))
    for t in range(1, 900):
        e[t] = u[t] - theta * e[t - 1]
        j[t] = [-1 - theta * j[t - 1, 0], xb[t] - theta * j[t - 1, 1], -e[t - 1] - theta * j[t - 1, 2]]
    rows = [arma.gram(u[a:a + 250], xb[a:a + 250], a, theta) for a in range(0, 900, 250)]
    a, b = arma.css_step(rows)
    assert np.allclose(a, j.T @ j, rtol=1e-9) and np.allclose(b, -j.T @ e, rtol=1e-9)


def test_passes_do_not_deal_a_few_series_over_all_shuffle_partitions(spark):
    """A pass over a few short series is a few tasks, however many partitions a shuffle has; ended series do not pile up as empty parts."""
    df = frame(spark, {k: simulate(*SERIES[k]) for k in ("short", "near")})
    sc, before, group = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions"), "arma-passes"
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    sc.setJobGroup(group, group)
    try:
        fits = arma.arma11_likelihood(df, ["k"], "idx", "v", block=500)
        passes = max(r.passes for r in fits.collect())
        steps = arma11_forecast(df, "k", "idx", "v", days=1, method="css").collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(steps) == 4 and passes > 2 and fits.rdd.getNumPartitions() <= 16
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    ran = [tracker.getStageInfo(s) for s in stages]
    assert max(s.numTasks for s in ran if s is not None and s.numCompletedTasks) < 64
