"""ARMA(1,1) with a mean: exact Gaussian likelihood and conditional least squares over one blocked layout (M6).

A series is laid out once as rows of up to ``block`` consecutive values
(``(key, block)``: one grouped aggregate), so one series with a third of all
rows is spread over all tasks. Every step of either fit then is one pass over
these rows that gives a few numbers a row, and one task a series that folds
them in order: the values themselves are not shuffled again.

*Exact likelihood.* With ``a_t`` the prediction of ``x_t`` from what came
before and ``P_t`` its error beyond the innovation's variance,

    v_t = x_t - a_t,   F_t = 1 + P_t,
    a_(t+1) = phi a_t + (phi P_t + phi + theta) / F_t v_t,   P_(t+1) = theta^2 P_t / F_t,

(a missing value: ``a_(t+1) = phi a_t``, ``P_(t+1) = phi^2 P_t + (phi + theta)^2``),
from ``a = 0``, ``P = (phi + theta)^2 / (1 - phi^2)``. ``P`` is a fractional
linear map of its start and has a closed form where nothing is missing;
``a`` is an affine map of its start, so a stretch of a series is an element
(offset, factor, and the quadratic sums of ``v / F`` in the start), and two
neighbouring stretches combine to one: an associative scan. The same is run
on a constant series, which gives the mean in closed form (``x = y - mean``
is linear in it), so only ``phi`` and ``theta`` are searched: Newton steps on
``tanh`` scales, from the values at a nine-point stencil and on the way back
to the last point, all of them in one pass.

*Conditional sum of squares.* ``e_t = u_t - theta e_(t-1)`` and its derivatives
are linear in their start, so a row's sums of products follow from a Gram
matrix of six sequences, and a step is one pass as well.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from barquet.session import materialize, ship_package

#: Values in a row of the layout. What a missing value leaves behind has faded after so many (theta up to MAX_ROOT).
BLOCK = 1 << 16
#: Values that are stepped through one by one, for all stretches of a row at once.
STRETCH = 256
MAX_ROOT = 0.999
#: Offsets of the points that one pass looks at: a stencil around a centre, and parts of the step that led there.
STENCIL = [(i, j) for i in (0, -1, 1) for j in (0, -1, 1)]
WAY_BACK = (0.5, 0.2, 0.05, 0.01)
WIDTH = 1e-4
#: A Newton step (on the tanh scales) below this ends the search.
MOVED = 1e-7
#: phi and theta of the starts, and the least number of values for a fit.
GRID, LEAST = (-0.8, -0.4, 0.0, 0.4, 0.8, 0.97), 6
SUMS = ("yy", "yo", "oo", "yc", "oc", "cc", "ay", "ao", "c", "logf")


def layout(series: DataFrame, keys: Sequence[str], idx: str, value: str, block: int = BLOCK) -> DataFrame:
    """Rows (keys, _block, _y, _prev): values in order, NaN where missing, and those of the row before if it misses any."""
    i = F.col(idx).cast("long")
    rows = series.select(*keys, F.floor(i / block).alias("_block"), i.alias("_i"), F.col(value).cast("double").alias("_v"))
    laid = rows.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_v", F.lit(float("nan"))).alias("_v")))).alias("_r"))
    laid = materialize(laid.select(*keys, "_block", F.transform("_r", lambda r: r["_v"]).alias("_y")), merge=True)
    missing = laid.filter(F.exists("_y", F.isnan)).select(*keys, (F.col("_block") + 1).alias("_block"), F.col("_y").alias("_prev"))
    return laid.join(missing, [*keys, "_block"], "left")


# --- exact likelihood --------------------------------------------------------

def _errors_after(p: np.ndarray, theta: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """P after so many observed values, from ``p``; (steps, points)."""
    s = theta ** 2
    power = s[None, :] ** steps[:, None]
    pole = 1 / (s - 1)
    return power * p / (1 - pole * p + pole * p * power)


def _errors(seen: np.ndarray, start: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P before every value of a stretch, and after the last."""
    n = len(seen)
    if seen.all():
        return _errors_after(start, theta, np.arange(n + 1.0))
    out, p = np.empty((n + 1, len(phi))), start
    for t in range(n):
        out[t] = p
        p = theta ** 2 * p / (1 + p) if seen[t] else phi ** 2 * p + (phi + theta) ** 2
    out[n] = p
    return out


def joined(one: dict, two: dict) -> dict:
    """The element of two stretches, the second following the first."""
    ay, ao, c = one["ay"], one["ao"], one["c"]
    return {
        "yy": one["yy"] + two["yy"] - 2 * ay * two["yc"] + ay ** 2 * two["cc"],
        "yo": one["yo"] + two["yo"] - ao * two["yc"] - ay * two["oc"] + ay * ao * two["cc"],
        "oo": one["oo"] + two["oo"] - 2 * ao * two["oc"] + ao ** 2 * two["cc"],
        "yc": one["yc"] + c * (two["yc"] - ay * two["cc"]),
        "oc": one["oc"] + c * (two["oc"] - ao * two["cc"]),
        "cc": one["cc"] + c ** 2 * two["cc"],
        "ay": two["ay"] + two["c"] * ay, "ao": two["ao"] + two["c"] * ao, "c": c * two["c"],
        "logf": one["logf"] + two["logf"]}


def element(y: np.ndarray, first: int, prev: np.ndarray | None, phi: np.ndarray, theta: np.ndarray) -> dict:
    """The element of one row of the layout at each point (phi, theta); ``first`` is its first position."""
    start = (phi + theta) ** 2 / (1 - phi ** 2)
    seen = ~np.isnan(y)
    if prev is not None:
        start = _errors_after(start, theta, np.array([float(first - len(prev))]))[0]
        start = _errors(~np.isnan(prev), start, phi, theta)[-1]
    else:
        start = _errors_after(start, theta, np.array([float(first)]))[0]
    p = _errors(seen, start, phi, theta)[:-1]
    f = 1 + p
    n, g = len(y), len(phi)
    s = -(-n // STRETCH)
    pad = s * STRETCH - n
    # (step, stretch, point); what fills the last stretch changes nothing: it is not seen and keeps a
    deal = lambda x, fill: np.concatenate([x, np.full((pad, *x.shape[1:]), fill)]).reshape(s, STRETCH, *x.shape[1:]).swapaxes(0, 1)
    keep = deal(np.where(seen[:, None], -theta / f, phi), 1.0)
    gain = deal(np.where(seen[:, None], (phi * p + phi + theta) / f, 0.0), 0.0)
    weight = deal(np.where(seen[:, None], 1 / f, 0.0), 0.0)
    x = deal(np.where(seen, y, 0.0), 0.0)[:, :, None]
    out = {k: np.zeros((s, g)) for k in SUMS}
    ay, ao, c = np.zeros((s, g)), np.zeros((s, g)), np.ones((s, g))
    for t in range(STRETCH if s > 1 else n):
        w, vy, vo = weight[t], x[t] - ay, 1 - ao
        wc = w * c
        out["yy"] += w * vy * vy
        out["yo"] += w * vy * vo
        out["oo"] += w * vo * vo
        out["yc"] += wc * vy
        out["oc"] += wc * vo
        out["cc"] += wc * c
        ay, ao, c = keep[t] * ay + gain[t] * x[t], keep[t] * ao + gain[t], keep[t] * c
    out["ay"], out["ao"], out["c"] = ay, ao, c
    whole = {k: v[0] for k, v in out.items()}
    for i in range(1, s):
        whole = joined(whole, {k: v[i] for k, v in out.items()})
    return whole | {"logf": np.log(f[seen]).sum(0) if seen.any() else np.zeros(g)}


def likelihood(e: dict, n: float) -> dict:
    """Mean, variance, next centred value and minus twice the log likelihood at each point, from a whole series' element."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = e["yo"] / e["oo"]
        s = np.maximum(e["yy"] - mean * e["yo"], 0.0)
        loss = n * np.log(2 * np.pi * s / n) + e["logf"] + n
    return {"mean": mean, "sigma2": s / n, "next": e["ay"] - mean * e["ao"], "loss": loss}


def _elements(laid: DataFrame, points: DataFrame, keys: list[str], block: int) -> DataFrame:
    """One pass: an element for each row of the layout at its series' points; ``_state`` is passed on."""
    fields = [f for f in laid.schema.fields if f.name in keys]
    doubles = ArrayType(DoubleType())
    schema = StructType(fields + [StructField("_block", LongType()), StructField("_seen", LongType()), StructField("_size", LongType()),
                                  StructField("_state", doubles), StructField("_phi", doubles), StructField("_theta", doubles)] + [StructField(f"_{k}", doubles) for k in SUMS])

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                y = np.asarray(r["_y"], float)
                prev = None if r["_prev"] is None else np.asarray(r["_prev"], float)
                e = element(y, int(r["_block"]) * block, prev, np.asarray(r["_phi"], float), np.asarray(r["_theta"], float))
                out.append({**{k: r[k] for k in keys}, "_block": r["_block"], "_seen": int((~np.isnan(y)).sum()), "_size": len(y), "_state": r["_state"],
                            "_phi": r["_phi"], "_theta": r["_theta"], **{f"_{k}": e[k] for k in SUMS}})
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])
    return laid.join(points, keys).select(*keys, "_block", "_y", "_prev", "_state", "_phi", "_theta").mapInPandas(run, schema)


def _whole(pdf: pd.DataFrame) -> tuple[dict, int]:
    """A series' element from its rows' ones, and how many values it has."""
    pdf = pdf.sort_values("_block")
    whole = None
    for r in pdf.to_dict("records"):
        e = {k: np.asarray(r[f"_{k}"], float) for k in SUMS}
        whole = e if whole is None else joined(whole, e)
    return whole, int(pdf["_seen"].sum())


def _points(z: np.ndarray, back: np.ndarray) -> tuple[list[float], list[float]]:
    """phi and theta of the points that a pass looks at: around ``z``, and on the way to it from ``back``."""
    at = [z + WIDTH * np.array(s) for s in STENCIL] + [back + f * (z - back) for f in WAY_BACK]
    return np.tanh([p[0] for p in at]).tolist(), np.tanh([p[1] for p in at]).tolist()


def newton_step(loss: np.ndarray, z: np.ndarray, n: int, limit: float) -> np.ndarray:
    """From the losses at the stencil: the step to take, held back at the limits and where the loss is flat or bent the other way."""
    at = {s: loss[i] for i, s in enumerate(STENCIL)}
    h = WIDTH
    grad = np.array([at[1, 0] - at[-1, 0], at[0, 1] - at[0, -1]]) / (2 * h)
    cross = (at[1, 1] - at[1, -1] - at[-1, 1] + at[-1, -1]) / (4 * h * h)
    hess = np.array([[(at[1, 0] - 2 * at[0, 0] + at[-1, 0]) / h ** 2, cross], [cross, (at[0, 1] - 2 * at[0, 0] + at[0, -1]) / h ** 2]])
    out = (np.abs(z) >= limit - 1e-12) & (grad * z < 0)  # pushed outward at a limit
    free = ~out
    step = np.zeros(2)
    if free.any():
        vals, vecs = np.linalg.eigh(hess[np.ix_(free, free)])
        step[free] = -vecs @ ((vecs.T @ grad[free]) / np.maximum(np.abs(vals), 1e-6 * n))
    long = np.abs(step).max()
    step *= min(1.0, 1.0 / long) if long > 0 else 1.0
    return np.clip(z + step, -limit, limit) - z


def arma11_likelihood(series: DataFrame, keys: Sequence[str], idx: str, value: str, max_passes: int = 60,
                      max_root: float = MAX_ROOT, block: int = BLOCK) -> DataFrame:
    """Maximum likelihood fit per key.

    The first pass looks at a grid of starts, the search goes on from the best
    of them. Returns keys, mean, phi, theta, sigma2, loglik, next_centred (the
    first forecast less the mean), n (values that are not missing), last_idx,
    converged (false where ``max_passes`` did not end the search; it is the
    best point seen) and passes. A series of under ``LEAST`` values has nulls.
    """
    keys = list(keys)
    ship_package(series.sparkSession)
    laid = materialize(layout(series, keys, idx, value, block), merge=True)  # joined once, not in every pass
    limit = float(np.arctanh(max_root))
    fields = [f for f in laid.schema.fields if f.name in keys]
    doubles = ArrayType(DoubleType())
    points_schema = StructType(fields + [StructField("_state", doubles), StructField("_phi", doubles), StructField("_theta", doubles)])
    names = ["mean", "phi", "theta", "sigma2", "loglik", "next_centred"]
    longs = ["n", "last_idx", "passes"]
    schema = StructType(points_schema.fields + [StructField(x, DoubleType()) for x in names] + [StructField(x, LongType()) for x in longs]
                        + [StructField("converged", BooleanType()), StructField("_done", BooleanType())])

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, n = _whole(pdf)
        phi, theta, state = (np.asarray(pdf[c].iloc[0], float) for c in ("_phi", "_theta", "_state"))
        at = likelihood(whole, max(n, 1))
        # the state is the best point so far, its loss, and the passes
        loss, passes = np.where(np.isfinite(at["loss"]), at["loss"], np.inf), int(state[3]) + 1
        best, least = state[:2], state[2]
        row = {k: pdf[k].iloc[0] for k in keys} | {"n": n, "passes": passes, "last_idx": int((pdf["_block"] * block + pdf["_size"] - 1).max())}
        if n < LEAST or not np.isfinite(loss).any():
            return pd.DataFrame([row | {"_state": [], "_phi": [], "_theta": [], "converged": False, "_done": True}], columns=[f.name for f in schema.fields]).astype({x: float for x in names})
        if passes == 1:
            i = int(np.argmin(loss))
            z = np.arctanh([phi[i], theta[i]])
            p, t = _points(z, z)
            return pd.DataFrame([row | {"_state": [*z, np.inf, 1.0], "_phi": p, "_theta": t, "converged": False, "_done": False}],
                                columns=[f.name for f in schema.fields]).astype({x: float for x in names})
        centre = np.arctanh([phi[0], theta[0]])
        done = converged = False
        if loss[0] <= least + 1e-9 * max(1.0, abs(least)) if np.isfinite(least) else True:
            best, least, pick = centre, loss[0], 0
            move = newton_step(loss, best, n, limit) if np.isfinite(loss[:9]).all() else np.zeros(2)
            target = best + move
            done = converged = bool(np.abs(move).max() < MOVED)
        else:
            pick = 9 + int(np.argmin(loss[9:]))
            if loss[pick] < least:
                best, least = np.arctanh([phi[pick], theta[pick]]), loss[pick]
                target = best
            else:  # even a hundredth of the step is no better: on the spot, or a shorter step
                done = converged = bool(np.abs(centre - best).max() < 100 * MOVED)
                target = best + 0.01 * (centre - best)
        done = done or passes >= max_passes
        p, t = _points(target, best)
        row |= {"_state": [*best, least, float(passes)], "_phi": p, "_theta": t, "mean": at["mean"][pick], "phi": phi[pick], "theta": theta[pick], "sigma2": at["sigma2"][pick],
                "loglik": -loss[pick] / 2, "next_centred": at["next"][pick], "converged": converged, "_done": done}
        return pd.DataFrame([row], columns=[f.name for f in schema.fields])

    grid = [[x for x in GRID for _ in GRID], [x for _ in GRID for x in GRID]]
    points = laid.select(*keys).distinct().select(*keys, *[F.array(*[F.lit(float(x)) for x in v]).alias(c) for c, v in (("_state", [0, 0, np.inf, 0]), ("_phi", grid[0]), ("_theta", grid[1]))])
    fits = None
    while True:
        now = materialize(_elements(laid, points, keys, block).groupBy(*keys).applyInPandas(step, schema), merge=True)
        ended, searched = now.agg(F.count_if("_done"), F.count_if(~F.col("_done"))).first()
        if ended or fits is None:
            those = now.filter("_done").select(*keys, *[F.when(~F.isnan(x), F.col(x)).alias(x) for x in names], *longs, "converged")
            fits = those if fits is None else fits.unionByName(those)
        if not searched:
            return fits
        points = now.filter(~F.col("_done")).select(*keys, "_state", "_phi", "_theta")


def arma11_loglik(series: DataFrame, keys: Sequence[str], idx: str, value: str, phi: float, theta: float, block: int = BLOCK) -> DataFrame:
    """Exact log likelihood per key at given phi and theta, the mean and variance at their best: keys, n, mean, sigma2, loglik, next_centred."""
    keys = list(keys)
    ship_package(series.sparkSession)
    laid = layout(series, keys, idx, value, block)
    points = laid.select(*keys).distinct().select(*keys, F.array().cast("array<double>").alias("_state"), F.array(F.lit(float(phi))).alias("_phi"), F.array(F.lit(float(theta))).alias("_theta"))
    schema = StructType([f for f in laid.schema.fields if f.name in keys] + [StructField("n", LongType())] + [StructField(x, DoubleType()) for x in ("mean", "sigma2", "loglik", "next_centred")])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, n = _whole(pdf)
        at = likelihood(whole, max(n, 1))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "n": n, "mean": at["mean"][0], "sigma2": at["sigma2"][0], "loglik": -at["loss"][0] / 2, "next_centred": at["next"][0]}],
                            columns=[f.name for f in schema.fields])
    return _elements(laid, points, keys, block).groupBy(*keys).applyInPandas(fold, schema)


# --- conditional sum of squares ----------------------------------------------

def _recur(x: np.ndarray, r: float) -> np.ndarray:
    """z_t = x_t + r z_(t-1), by stretches that are stepped through together."""
    n = len(x)
    s = -(-n // STRETCH)
    m = np.concatenate([x, np.zeros(s * STRETCH - n)]).reshape(s, STRETCH)
    z, now = np.empty_like(m), np.zeros(s)
    for t in range(STRETCH):
        now = m[:, t] + r * now
        z[:, t] = now
    fade = r ** np.arange(1, STRETCH + 1)
    carry = 0.0
    for i in range(s):
        z[i] += fade * carry
        carry = z[i, -1]
    return z.reshape(-1)[:n]


def gram(u: np.ndarray, xb: np.ndarray, first: int, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Products of a row's sequences (e, its derivatives in phi and theta from a zero start, in c, and the two answers to a start) and their ends.

    Position 0 of a series is no equation: it has no value before it.
    """
    r, n = -theta, len(u)
    e, b = _recur(u, r), _recur(xb, r)
    g = _recur(np.concatenate([[0.0], -e[:-1]]), r)
    k = np.arange(1.0, n + 1)
    fade = r ** k
    late = -k * r ** (k - 1)
    t = first + np.arange(n)
    d_c = -(1 - r ** t) / (1 - r)
    z = np.stack([e, b, g, d_c, fade, late])
    return z[:, t >= 1] @ z[:, t >= 1].T, z[[0, 1, 2, 4, 5], -1]


def css_step(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """J'J and -J'e of a whole series from its rows' (gram, ends), in order."""
    a, b, start = np.zeros((3, 3)), np.zeros(3), np.zeros(3)
    for g, ends in rows:
        e0, b0, g0 = start
        # e, and derivatives in c, phi, theta, in terms of the six sequences
        e = np.array([1, 0, 0, 0, e0, 0.0])
        j = np.array([[0, 0, 0, 1, 0, 0], [0, 1, 0, 0, b0, 0], [0, 0, 1, 0, g0, e0]], float)
        a += j @ g @ j.T
        b -= j @ g @ e
        fade, late = ends[3], ends[4]
        start = np.array([ends[0] + fade * e0, ends[1] + fade * b0, ends[2] + fade * g0 + late * e0])
    return a, b


def css_refine(laid: DataFrame, params: DataFrame, keys: Sequence[str], iterations: int, max_root: float = MAX_ROOT, block: int = BLOCK) -> DataFrame:
    """Gauss-Newton steps per key on the conditional sum of squares.

    ``laid`` is the :func:`layout` of the centred values with each row's last
    value before it (``_before``); ``params`` has c, phi, theta. Returns keys,
    c, phi, theta and ``converged``: whether the last step moved nothing by
    more than 1e-9.
    """
    keys = list(keys)
    fields = [f for f in laid.schema.fields if f.name in keys]
    doubles = ArrayType(DoubleType())
    sums = StructType(fields + [StructField("_block", LongType()), StructField("_p", doubles), StructField("_gram", doubles), StructField("_ends", doubles)])
    out = StructType(fields + [StructField(x, DoubleType()) for x in ("c", "phi", "theta")] + [StructField("converged", BooleanType())])

    def products(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                y = np.asarray(r["_y"], float)
                before = np.concatenate([[np.nan if r["_before"] is None else r["_before"]], y[:-1]])
                has = ~np.isnan(before)
                u = np.where(has & ~np.isnan(y), y - r["c"] - r["phi"] * before, 0.0)
                z, ends = gram(u, np.where(has, -before, 0.0), int(r["_block"]) * block, r["theta"])
                rows.append({**{k: r[k] for k in keys}, "_block": r["_block"], "_p": [r["c"], r["phi"], r["theta"]], "_gram": z.reshape(-1), "_ends": ends})
            yield pd.DataFrame(rows, columns=[f.name for f in sums.fields])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        a, b = css_step([(np.asarray(g, float).reshape(6, 6), np.asarray(e, float)) for g, e in zip(pdf["_gram"], pdf["_ends"])])
        p, moved = np.asarray(pdf["_p"].iloc[0], float), 0.0
        if np.isfinite(a).all() and np.isfinite(b).all():
            d = np.linalg.pinv(a) @ b
            for halving in range(31):  # the largest part of the step that stays inside
                q = p + 0.5 ** halving * d
                if np.abs(q[1:]).max() <= max_root:
                    moved, p = float(np.abs(d[1:]).max()), q
                    break
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "c": p[0], "phi": p[1], "theta": p[2], "converged": moved <= 1e-9}], columns=[f.name for f in out.fields])

    ship_package(laid.sparkSession)
    inside = lambda c: F.greatest(F.least(F.col(c), F.lit(max_root)), F.lit(-max_root)).alias(c)
    fit = params.select(*keys, "c", inside("phi"), inside("theta"), F.lit(False).alias("converged"))
    for _ in range(iterations):
        known = fit.filter(F.col("c").isNotNull() & F.col("phi").isNotNull() & F.col("theta").isNotNull() & ~F.isnan("c"))
        fit = materialize(laid.join(known.drop("converged"), keys).mapInPandas(products, sums).groupBy(*keys).applyInPandas(solve, out), merge=True)
        if fit.filter(~F.col("converged")).isEmpty():
            break
    return fit
