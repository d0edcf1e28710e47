"""One-class anomaly flags per series (M7): RBF one-class SVM on one feature.

The dual ``min a'Ka/2, 0 <= a_v <= count_v, sum a = nu * n`` over a series'
distinct values is solved without gathering the values. With
``gamma = 1 / var`` the kernel is as smooth as the values are wide, and the
optimal weights are known up to a few values: all of a value's rows where the
score is below 0, none where it is above. So values are first put together in
*atoms*, whose rows share one weight ratio, and only atoms in which the score
changes its sign are cut further:

1. ``groupBy(key, value).count()`` collapses repeated values (one scan of the
   series) and is written once; mean and variance come from it.
2. An aggregate gives each atom's mass, least and greatest value and
   ``MOMENTS`` moments about its middle. The first atoms are the values
   themselves for series of up to ``DIRECT`` distinct ones, else cells of
   ``1 / PER_WIDTH`` of a kernel width. Everything that grows with the rows
   happens here, in map-side combined aggregates that no key makes uneven.
3. One task a series solves the dual over its atoms by an interior-point
   method until the duality gap is ``GAP`` of the objective; kernels between
   cells follow from their moments (Hermite expansion, exact to rounding at
   this width). A series that misses the gap raises.
4. Cells that hold a change of sign, or a ratio between none and all, are cut
   in ``SPLIT`` parts between their least and greatest values; a join on
   (key, cell) aggregates just their values, and 3 is repeated for the series
   concerned. No cut is left when every cell is wholly at its bound with no
   score above 0, or wholly out with none below, or a single value: these are
   the optimality conditions of the dual over all values. No value is moved,
   merged or left out.

Memory of a solve is bounded by the atoms. Cells that hold values at distance
z (in standard deviations) number at most ``2 * PER_WIDTH * z``, and as the
squares of all distances sum to the rows, n rows occupy at most about
``2 * PER_WIDTH * cbrt(3 n / (2 * PER_WIDTH)) + DIRECT`` atoms
(:func:`most_atoms`) besides ``SPLIT`` a change of sign and cut, however far
an outlier lies.

Scoring evaluates ``sum_v a_v exp(-gamma (x - v)^2) - rho`` once for each
distinct value, from the single values and the cells' expansions, and joins
the scores to the rows. A row is an anomaly when its score is below 0, as a
prediction of -1 is; values on the boundary score 0 up to rounding, so
"below" means by more than ``ZERO`` of ``rho``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from barquet.session import materialize, ship_package

#: Duality gap at the end, as a share of the objective.
GAP = 1e-12
#: Scores within this share of rho are zero.
ZERO = 1e-6
#: Series of up to so many distinct values are solved over the values themselves.
DIRECT = 1024
#: Cells a kernel width, parts that a cell is cut in, and moments kept of a cell (orders 0 to MOMENTS - 1).
PER_WIDTH, SPLIT, MOMENTS = 8, 32, 14
#: Points at which a cell's scores are looked at.
POINTS = 17


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _kernel_factor(u: np.ndarray) -> np.ndarray:
    """Columns F with ``F F' = exp(-(u_i - u_j)^2)`` to rounding: the kernel at Chebyshev points, interpolated in both arguments."""
    lo, hi = float(u.min()), float(u.max())
    m = int(28 + 9 * (hi - lo))
    if m >= len(u):
        at, weights = u, np.eye(len(u))
    else:
        j = np.arange(m)
        at = (lo + hi) / 2 + (hi - lo) / 2 * np.cos(np.pi * (j + 0.5) / m)
        apart = u[:, None] - at[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            weights = (-1.0) ** j * np.sin(np.pi * (j + 0.5) / m) / apart
            weights /= weights.sum(1, keepdims=True)
        hit = apart == 0
        weights[hit.any(1)] = hit[hit.any(1)]
    vals, vecs = np.linalg.eigh(np.exp(-(at[:, None] - at[None, :]) ** 2))
    keep = vals > 1e-17 * vals[-1]
    return weights @ (vecs[:, keep] * np.sqrt(vals[keep]))


def solve_one_class_dual(values: np.ndarray, counts: np.ndarray, nu: float, gamma: float,
                         gap: float = GAP, max_iter: int = 200) -> tuple[np.ndarray, float]:
    """Solve ``min a'Ka/2`` s.t. ``0 <= a <= counts``, ``sum a = nu * sum(counts)``; the kernel is ``exp(-gamma d^2)``.

    Returns the weights ``a`` and ``rho``. Raises ``ArithmeticError`` when
    ``max_iter`` steps do not close the duality gap.
    """
    v, c = np.asarray(values, dtype=float), np.asarray(counts, dtype=float)
    return _interior_point(_kernel_factor(np.sqrt(gamma) * (v - v.mean())), c, nu, gap, max_iter)


def _interior_point(f: np.ndarray, c: np.ndarray, nu: float, gap: float = GAP, max_iter: int = 200) -> tuple[np.ndarray, float]:
    """The dual for the kernel ``f f'`` and the upper bounds ``c``."""
    if nu >= 1 or len(c) == 1:
        a = nu * c
        return a, float((f @ (f.T @ a)).max())
    n = len(c)
    a = nu * c
    g = f @ (f.T @ a)
    rho = float(g.mean())
    z, y = np.maximum(g - rho, 0) + g.max(), np.maximum(rho - g, 0) + g.max()
    for _ in range(max_iter):
        slack = c - a
        open_gap = float(z @ a + y @ slack)
        dual = g - rho - z + y
        if open_gap <= gap * max(1.0, float(a @ g)) and np.abs(dual).max() <= 1e-9 * max(1.0, abs(rho)):
            break
        mu = 0.1 * open_gap / (2 * n)
        d = z / a + y / slack
        r = g - rho - mu / a + mu / slack
        fd = f / d[:, None]
        core = np.linalg.cholesky(np.eye(f.shape[1]) + f.T @ fd)

        def solve(b, d=d, fd=fd, core=core):
            return b / d - fd @ np.linalg.solve(core.T, np.linalg.solve(core, fd.T @ b))

        mr, m1 = solve(r), solve(np.ones(n))
        drho = float(mr.sum() / m1.sum())
        da = drho * m1 - mr
        dz, dy = mu / a - z - z / a * da, mu / slack - y + y / slack * da
        with np.errstate(divide="ignore", invalid="ignore"):
            room = [np.where(s < 0, -x / s, np.inf).min() for x, s in ((a, da), (slack, -da))]
            room_d = [np.where(s < 0, -x / s, np.inf).min() for x, s in ((z, dz), (y, dy))]
        step, step_d = min(1.0, 0.995 * min(room)), min(1.0, 0.995 * min(room_d))
        step = step_d = min(step, step_d)  # one length keeps the dual residual shrinking
        a = a + step * da
        a *= nu * c.sum() / a.sum()
        a = np.clip(a, c * 1e-15, c * (1 - 1e-15))
        rho, z, y = rho + step * drho, z + step_d * dz, y + step_d * dy
        g = f @ (f.T @ a)
    else:
        raise ArithmeticError(f"one-class dual: gap {open_gap:.3g} after {max_iter} steps")
    # what complementarity has decided goes to its bound
    a = np.where(z > a / c * max(1.0, rho), 0.0, np.where(y > (c - a) / c * max(1.0, rho), c, a))
    return a, float(rho)


def _values(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    x = F.col(value).cast("double")
    clean = series.filter(x.isNotNull() & ~F.isnan(x))
    return clean.groupBy(*keys, x.alias("_v")).agg(F.count(F.lit(1)).alias("_w"))


def most_atoms(n: int) -> int:
    """A bound on the atoms of a series of n rows before cuts."""
    return DIRECT + 2 * PER_WIDTH * (2 + int(np.cbrt(3 * n / (2 * PER_WIDTH))))


class Atoms:
    """A series' atoms: centres (in kernel widths from the mean), masses, and moments of the masses about the centres over their factorials."""

    def __init__(self, centre: np.ndarray, mass: np.ndarray, moments: np.ndarray):
        self.c, self.mass = centre, mass
        factorial = np.cumprod(np.r_[1.0, np.arange(1.0, MOMENTS)])
        self.q = moments / mass[:, None] / factorial

    def kernel(self) -> np.ndarray:
        """Mean kernel between the values of every two atoms."""
        y = self.c[:, None] - self.c[None, :]
        near, out = np.exp(-y * y), np.zeros_like(y)
        before, now = np.zeros_like(y), np.ones_like(y)
        sign = (-1.0) ** np.arange(MOMENTS)
        whole = np.any(self.q[:, 1:])
        for n in range(MOMENTS if whole else 1):
            out += now * ((self.q[:, :n + 1] * sign[:n + 1]) @ self.q[:, n::-1].T)
            before, now = now, 2 * y * now - 2 * n * before
        out *= near
        return (out + out.T) / 2

    def factor(self) -> np.ndarray:
        vals, vecs = np.linalg.eigh(self.kernel())
        keep = vals > 1e-17 * vals[-1]
        return vecs[:, keep] * np.sqrt(vals[keep])

    def potential(self, x: np.ndarray, a: np.ndarray) -> np.ndarray:
        """sum of a times the mean kernel to each point of x (any shape)."""
        flat, out = x.reshape(-1), np.zeros(x.size)
        for s in range(0, len(flat), 4096):
            y = flat[s:s + 4096, None] - self.c[None, :]
            terms, before, now = np.zeros_like(y), np.zeros_like(y), np.ones_like(y)
            for n in range(MOMENTS):
                terms += now * self.q[None, :, n]
                before, now = now, 2 * y * now - 2 * n * before
            out[s:s + 4096] = (terms * np.exp(-y * y)) @ a
        return out.reshape(x.shape)


def _solve_atoms(u0, u1, several, atoms: Atoms, nu: float, gap: float) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, rho, which atoms to cut) for atoms with the given least and greatest values in kernel widths."""
    a, rho = _interior_point(atoms.factor(), atoms.mass, nu, gap)
    own = np.flatnonzero(several)
    cut = np.zeros(len(a), bool)
    if not len(own):
        return a, rho, cut
    points = u0[own, None] + (u1 - u0)[own, None] * np.linspace(0, 1, POINTS)
    p = atoms.potential(points, a)
    # between two points a curve leaves its chord by at most spacing^2 / 8 times its second derivative
    apart = np.maximum(np.abs(atoms.c[own, None] - atoms.c[None, :]) - 2.0 / PER_WIDTH, 0)
    leave = ((u1 - u0)[own] / (POINTS - 1)) ** 2 / 8 * (((4 * apart ** 2 + 2) * np.exp(-apart ** 2)) @ a)
    if nu >= 1:
        ends = np.concatenate([atoms.potential(u0, a), atoms.potential(u1, a)])  # least and greatest are values
        rho = float(ends.max())
        cut[own] = p.max(1) + leave > rho * (1 + 1e-12)
        return a, rho, cut
    s, zero = p - rho, 1e-9 * abs(rho)
    share = a[own] / atoms.mass[own]
    cut[own] = np.where(share >= 1, s.max(1) + leave > zero, np.where(share <= 0, s.min(1) - leave < -zero, True))
    return a, rho, cut


def _atoms_of(located: DataFrame, by: list, centre, extra: list) -> DataFrame:
    """Atoms of rows (.., _v, _w, _u), grouped by ``by``: least and greatest value, distinct values, mass and moments about ``centre``."""
    d = F.col("_u") - F.col("_c")
    powers, x = [], F.col("_w").cast("double")
    for p in range(MOMENTS):
        powers.append(F.sum(x).alias(f"_m{p}"))
        x = x * d
    return located.withColumn("_c", centre).groupBy(*by, "_c", *extra).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_distinct"), *powers)


def one_class_fit(series: DataFrame, key: str | Sequence[str], value: str, nu: float, gap: float = GAP) -> DataFrame:
    """Per key: ``gamma``, ``rho``, ``n``, the rows ``at_bound``, and the support.

    ``support_values`` and ``support_weights`` are the single values with a
    weight; ``support_cells`` the cells with one: least and greatest value,
    weight, and the polynomial ``coefs`` about ``at`` whose product with
    ``exp(-gamma (x - at)^2)`` is the cell's part of the score (empty for
    series of up to ``DIRECT`` distinct values). The fit runs when called.
    """
    if not 0 < nu <= 1:
        raise ValueError("nu must be in (0, 1]")
    keys = _keys(key)
    counts = materialize(_values(series, keys, value), merge=True)
    sums = counts.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.count(F.lit(1)).alias("_values"))
    sums = sums.withColumn("_mean", F.col("_s") / F.col("_n")).drop("_s")
    spread = counts.join(sums, keys).groupBy(*keys, "_n", "_values", "_mean").agg((F.sum(F.col("_w") * F.pow(F.col("_v") - F.col("_mean"), 2)) / F.first("_n")).alias("_var"))
    stats = materialize(spread.withColumn("_g", F.when(F.col("_var") > 0, 1 / F.col("_var")).otherwise(F.lit(1.0))).drop("_var"), merge=True)
    located = (counts.join(stats, keys).withColumn("_u", F.sqrt("_g") * (F.col("_v") - F.col("_mean")))
               .withColumn("_cell", F.floor(F.col("_u") * PER_WIDTH)))
    single = F.col("_values") <= DIRECT
    pending = materialize(_atoms_of(located.withColumn("_own", F.when(single, F.col("_v"))), [*keys, "_cell", "_own"],
                                    F.when(single, F.col("_u")).otherwise((F.col("_cell") + 0.5) / PER_WIDTH), []).drop("_own").join(stats, keys), merge=True)
    key_fields = [f for f in series.schema.fields if f.name in keys]
    cell = StructType([StructField(x, DoubleType()) for x in ("at", "lo", "hi", "weight")] + [StructField("coefs", ArrayType(DoubleType()))])
    zone = StructType([StructField("cell", LongType()), StructField("lo", DoubleType()), StructField("hi", DoubleType())])
    schema = StructType(key_fields + [
        StructField("gamma", DoubleType()), StructField("rho", DoubleType()),
        StructField("support_values", ArrayType(DoubleType())), StructField("support_weights", ArrayType(DoubleType())), StructField("support_cells", ArrayType(cell)),
        StructField("n", LongType()), StructField("at_bound", LongType()), StructField("_zones", ArrayType(zone))])
    names = [f.name for f in schema.fields]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_lo")
        lo, hi, mass = (pdf[x].to_numpy(dtype=float) for x in ("_lo", "_hi", "_m0"))
        g, mean, several = float(pdf["_g"].iloc[0]), float(pdf["_mean"].iloc[0]), pdf["_distinct"].to_numpy() > 1
        if int(pdf["_values"].iloc[0]) <= DIRECT:
            a, rho = solve_one_class_dual(lo, mass, nu, g, gap)
            cut, atoms = np.zeros(len(lo), bool), None
        else:
            u0, u1 = np.sqrt(g) * (lo - mean), np.sqrt(g) * (hi - mean)
            moments = pdf[[f"_m{p}" for p in range(MOMENTS)]].to_numpy(dtype=float)
            moments[~several, 1:] = 0
            atoms = Atoms(np.where(several, pdf["_c"].to_numpy(dtype=float), u0), mass, moments)
            a, rho, cut = _solve_atoms(u0, u1, several, atoms, nu, gap)
        sv = (a > 0) & ~several
        cells = [] if atoms is None else [
            {"at": mean + atoms.c[i] / np.sqrt(g), "lo": lo[i], "hi": hi[i], "weight": a[i], "coefs": np.polynomial.hermite.herm2poly(a[i] * atoms.q[i]).tolist()}
            for i in np.flatnonzero((a > 0) & several)]
        row = {k: pdf[k].iloc[0] for k in keys}
        row.update(gamma=g, rho=rho, support_values=lo[sv].tolist(), support_weights=a[sv].tolist(), support_cells=cells, n=int(pdf["_n"].iloc[0]),
                   at_bound=int(mass[a >= mass].sum()), _zones=[{"cell": int(c), "lo": x, "hi": y} for c, x, y in zip(pdf["_cell"][cut], lo[cut], hi[cut])])
        return pd.DataFrame([row], columns=names)

    spark = series.sparkSession
    ship_package(spark)
    models, unsolved, most = None, stats.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # a solve takes long for its few atoms: dealt by series, not merged by size
        dealt = pending.repartition(max(1, min(unsolved, most)), *keys)
        solved = materialize(dealt.groupBy(*keys).applyInPandas(solve, schema), merge=True)
        ended, unsolved = solved.agg(F.count_if(F.size("_zones") == 0), F.count_if(F.size("_zones") > 0)).first()
        if ended or models is None:
            done = solved.filter(F.size("_zones") == 0).drop("_zones")
            models = done if models is None else models.unionByName(done)
        if not unsolved:
            return models
        zones = solved.filter(F.size("_zones") > 0).select(*keys, F.explode("_zones").alias("_z")).select(
            *keys, F.col("_z.cell").alias("_cell"), F.col("_z.lo").alias("_lo"), F.col("_z.hi").alias("_hi"))
        inside = located.join(zones, [*keys, "_cell"]).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        part = F.least(F.lit(SPLIT - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SPLIT))
        parts = _atoms_of(inside.withColumn("_part", part).withColumnRenamed("_lo", "_zlo").withColumnRenamed("_hi", "_zhi"), [*keys, "_cell", "_zlo", "_part"],
                          F.expr(f"sqrt(_g) * (_zlo + (_part + 0.5) / {SPLIT} * (_zhi - _zlo) - _mean)"), [])
        open_keys = zones.select(*keys).distinct()
        kept = pending.join(open_keys, keys, "left_semi").join(zones.drop("_cell"), [*keys, "_lo", "_hi"], "left_anti")
        pending = materialize(kept.unionByName(parts.drop("_zlo", "_part").join(stats, keys)), merge=True)


def one_class_score(series: DataFrame, model: DataFrame, key: str | Sequence[str], value: str,
                    score: str = "score", flag: str = "is_anomaly") -> DataFrame:
    """Decision value per row and the anomaly flag (score below 0)."""
    keys = _keys(key)
    m = model.select(*keys, F.col("gamma").alias("_g"), F.col("rho").alias("_rho"),
                     F.col("support_values").alias("_sv"), F.col("support_weights").alias("_sw"), F.col("support_cells").alias("_sc"))
    x = F.col("_v")
    terms = F.zip_with("_sv", "_sw", lambda v, a: a * F.exp(-F.col("_g") * (x - v) * (x - v)))
    # a cell's part: a polynomial times the kernel about its middle, nothing beyond thirty kernel widths
    ys = F.transform("_sc", lambda c: F.struct((F.sqrt("_g") * (x - c["at"])).alias("y"), c["coefs"].alias("coefs")))
    parts = F.transform(F.filter(ys, lambda c: F.abs(c["y"]) < 30.0),
                        lambda c: F.exp(-c["y"] * c["y"]) * F.aggregate(F.reverse(c["coefs"]), F.lit(0.0), lambda acc, b: acc * c["y"] + b))
    s = F.aggregate(F.concat(terms, parts), F.lit(0.0), lambda acc, t: acc + t) - F.col("_rho")
    scored = _values(series, keys, value).drop("_w").join(m, on=keys).select(
        *keys, "_v", s.alias(score), (s < F.lit(-ZERO) * F.greatest(F.abs("_rho"), F.lit(1e-300))).alias(flag))
    return series.withColumn("_v", F.col(value).cast("double")).join(scored, on=[*keys, "_v"], how="left").drop("_v")


def one_class_flags(series: DataFrame, key: str | Sequence[str], value: str, nu: float, gap: float = GAP) -> DataFrame:
    """Fit and score in one call: every row with ``score`` and ``is_anomaly``.

    ``series`` is read three times (the fit's counts, the distinct values to
    score, the rows).
    """
    return one_class_score(series, one_class_fit(series, key, value, nu, gap), key, value)
