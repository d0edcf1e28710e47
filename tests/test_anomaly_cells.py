"""The one-class fit over cells: equal to the dual over all values, bounded atoms, no key in one task."""
import numpy as np
import pytest

from barquet.operators import anomaly
from barquet.operators.anomaly import Atoms, most_atoms, one_class_fit, one_class_score, solve_one_class_dual


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    return {
        "norm": rng.normal(10, 2, 3000),
        "outlier": np.r_[rng.normal(0, 1, 3000), 900.0, -4000.0],
        "mixed": np.r_[rng.normal(0, 1, 1500), rng.normal(9, 0.3, 1200), rng.uniform(-30, 60, 300)],
        "short": np.r_[1.0, 1.0, 2.0, 7.0],
        "constant": np.full(9, 3.0),
    }


@pytest.fixture(scope="module")
def table(spark, series):
    rows = [(k, float(x)) for k, v in series.items() for x in v] + [("norm", None), ("none", None), ("norm", float("nan"))]
    return spark.createDataFrame(rows, "k string, x double").repartition(6).cache()


@pytest.mark.parametrize("nu", [0.05, 0.4, 1.0])
def test_cells_give_the_solution_over_all_values(table, series, nu):
    model = anomaly.materialize(one_class_fit(table, "k", "x", nu))
    scored = one_class_score(table, model, "k", "x").toPandas()
    models = {r.k: r for r in model.collect()}
    assert set(models) == set(series)
    for k, rows in series.items():
        v, c = np.unique(rows, return_counts=True)
        g = 1 / (np.var(rows) or 1.0)
        a, rho = solve_one_class_dual(v, c, nu, g)
        want = np.array([(a * np.exp(-g * (x - v) ** 2)).sum() - rho for x in v])
        got = scored[scored.k == k].dropna().groupby("x")["score"].first().to_numpy()
        m = models[k]
        assert np.abs(got - want).max() < 1e-6 * rho and abs(m.rho - rho) < 1e-6 * rho
        assert np.isclose(sum(m.support_weights) + sum(x.weight for x in m.support_cells), nu * len(rows), rtol=1e-6)
        assert (len(m.support_cells) > 0) == (len(v) > anomaly.DIRECT)
    flagged = scored[scored.is_anomaly.eq(True)].groupby("k").size()
    assert all(flagged.get(k, 0) <= nu * len(v) + 1e-9 for k, v in series.items()), (flagged, nu)


def test_atoms_do_not_follow_the_range(table, series, spark):
    """Before cuts, a series' atoms stay under the bound however far its outliers lie (and follow its rows by a cube root)."""

    rng = np.random.default_rng(1)
    for n, far in ((4000, 1e3), (4000, 1e9), (60000, 1e9)):
        rows = np.r_[rng.normal(size=n), far]
        u = (rows - rows.mean()) / rows.std()
        assert len(np.unique(np.floor(u * anomaly.PER_WIDTH))) <= most_atoms(n) - anomaly.DIRECT
    # spread as widely as the variance allows, a cell a row
    u = np.arange(1, 4000.0)
    u /= u.std()
    assert len(np.unique(np.floor(u * anomaly.PER_WIDTH))) <= most_atoms(len(u)) - anomaly.DIRECT
    assert most_atoms(10 ** 9) < 11_000


def test_moments_stand_for_the_values():
    rng = np.random.default_rng(2)
    cells = [rng.uniform(i / 8, (i + 1) / 8, 20) for i in range(-20, 20)]
    centre = np.array([(i + 0.5) / 8 for i in range(-20, 20)])
    mass = np.full(40, 20.0)
    moments = np.array([[((v - c) ** p).sum() for p in range(anomaly.MOMENTS)] for v, c in zip(cells, centre)])
    atoms = Atoms(centre, mass, moments)
    exact = np.array([[np.exp(-(v[:, None] - w[None, :]) ** 2).mean() for w in cells] for v in cells])
    assert np.abs(atoms.kernel() - exact).max() < 1e-14
    x, a = np.linspace(-4, 4, 50), rng.uniform(0, 20, 40)
    exact = np.array([sum(ai * np.exp(-(xi - v) ** 2).mean() for ai, v in zip(a, cells)) for xi in x])
    assert np.abs(atoms.potential(x, a) - exact).max() < 1e-12 * a.sum()


def test_one_series_is_spread_over_all_tasks(spark):
    """A series with all rows: what its solving task reads is atoms, not values."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("s", float(x)) for x in rng.normal(size=20000)], "k string, x double").repartition(8)
    seen = []
    real = anomaly._atoms_of

    def counted(located, by, centre, extra):
        out = real(located, by, centre, extra)
        seen.append(out.count())
        return out
    anomaly._atoms_of = counted
    try:
        model = one_class_fit(df, "k", "x", 0.1).collect()[0]
    finally:
        anomaly._atoms_of = real
    assert model.n == 20000 and max(seen) < 700 and sum(seen) < 2500


def test_rounds_do_not_pile_up_empty_parts(spark, table):
    """A round over a few series is a few tasks, however many partitions a shuffle has, and what rounds leave is not added up over them."""
    sc, before, group = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions"), "one-class-rounds"
    table.count()
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    sc.setJobGroup(group, group)
    try:
        model = one_class_fit(table, "k", "x", 0.05)
        assert {r.k for r in model.collect()} == {"norm", "outlier", "mixed", "short", "constant"}
        assert model.rdd.getNumPartitions() <= 25
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    ran = [tracker.getStageInfo(s) for s in stages]
    assert max(s.numTasks for s in ran if s is not None and s.numCompletedTasks) < 64
