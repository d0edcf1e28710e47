"""Statistics kept a day: any range merges to what the rows themselves give; the report in steps equals the report at once."""
import math

import numpy as np
import pytest

from barquet.operators.bars import explore
from barquet.operators.daystats import day_moments, day_sketches, explore_between, linregress_between, merge_moments, ols_between
from barquet.operators.regression import linregress, ols_fit
from barquet.plans.reports import daily_report, daily_report_step


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for d in range(1, 13):
        for g in ("a", "b", "c"):
            for _ in range(int(rng.integers(0, 9))):
                x = 1e6 + float(rng.normal())
                out.append((f"2024-01-{d:02d}", g, None if rng.random() < 0.1 else x, 3 * x + float(rng.normal()) if g != "c" else 7.0))
    out += [("2024-01-05", "flat", 2.0, 1.0), ("2024-01-06", "flat", 2.0, 4.0), ("2024-01-07", "one", 2.0, 4.0)]
    return spark.createDataFrame(out, "Date string, g string, x double, y double").cache()


@pytest.mark.parametrize("start,end", [("2024-01-03", "2024-01-09"), ("2024-01-05", "2024-01-05"), (None, None), ("2024-01-08", None)])
def test_a_range_of_moments_is_the_fit_of_its_rows(rows, start, end):
    part = rows.filter(f"Date >= '{start or '0'}' AND Date <= '{end or '9'}'")
    near = lambda a, b: (a is None and b is None) or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    for by in (None, "g"):
        moments = day_moments(rows, "y", "x", by=by)
        got = {r.g if by else 0: r for r in ols_between(moments, start, end, by=by).collect()}
        want = {r.g if by else 0: r for r in ols_fit(part, "y", "x", by=by).collect() if r.n}
        assert set(got) == set(want)
        for k, w in want.items():
            assert all(near(got[k][c], w[c]) for c in ("slope", "r2", "n")) and math.isclose(got[k].intercept, w.intercept, rel_tol=1e-6, abs_tol=1e-2)
    got = {r.g: r for r in linregress_between(day_moments(rows, "y", "x", by="g"), start, end, by="g").collect()}
    for r in linregress(part, "y", "x", by="g", p_value=False).collect():
        assert r.n == 0 or near(got[r.g].r, r.r)
        assert (r.r is None) == (r.g in ("c", "flat", "one") or r.n < 2)  # a constant column has no correlation
        if r.r is not None and r.n > 2:
            assert math.isclose(got[r.g].stderr, r.stderr, rel_tol=1e-4)


def test_merging_in_parts_changes_nothing(rows):
    moments = day_moments(rows, "y", "x", by="g")
    half = merge_moments(moments.filter("Date <= '2024-01-06'"), "g").unionByName(merge_moments(moments.filter("Date > '2024-01-06'"), "g"))
    once, twice = ({r.g: r for r in merge_moments(m, "g").collect()} for m in (moments, half))
    assert set(once) == set(twice)
    for g, r in once.items():
        assert all(math.isclose(r[c], twice[g][c], rel_tol=1e-9, abs_tol=1e-9) for c in ("n", "mean_x", "mean_y", "cxx", "cxy", "cyy"))


def test_ranges_of_sketches(spark):
    bars = spark.range(60000).selectExpr("concat('S', cast(id % 7001 as string)) as ISIN", "concat('2024-01-', lpad(cast(id % 9 + 1 as string), 2, '0')) as Date") \
        .unionByName(spark.createDataFrame([(None, "2024-01-03"), ("S1", "2024-01-03")], "ISIN string, Date string"))
    sketches = day_sketches(bars)
    for start, end in (("2024-01-02", "2024-01-04"), (None, None), ("2024-01-09", "2024-01-09")):
        part = bars.filter(f"Date >= '{start or '0'}' AND Date <= '{end or '9'}'")
        got, want = explore_between(sketches, start, end).collect()[0], explore(part).collect()[0]
        assert got.n_rows == want.n_rows
        assert abs(got.n_securities - want.n_securities) <= 0.04 * want.n_securities and abs(got.n_groups - want.n_groups) <= 0.04 * want.n_groups
    assert tuple(explore_between(sketches, "2025-01-01", None).collect()[0]) == (0, 0, 0)


def test_report_in_steps_is_the_report(spark, bars):
    rng = np.random.default_rng(8)
    rows = [(s, f"2024-01-{d:02d}", f"{9 + h:02d}:00", *[float(x) for x in rng.uniform(10, 20, 4)], int(rng.integers(1, 9)))
            for d in range(1, 11) for s in "ABCDE" if rng.random() < 0.6 for h in range(3)]
    whole = sorted(tuple(r) for r in daily_report(bars(rows), with_index=False).collect())
    got, last = [], None
    for a, b in ((1, 3), (4, 4), (5, 8), (9, 10)):
        rep, last = daily_report_step(bars([r for r in rows if a <= int(r[1][-2:]) <= b]), last)
        got += [tuple(r) for r in rep.collect()]
        last = spark.createDataFrame(last.collect(), last.schema)  # what a run would store
    assert sorted(got) == whole
    # a day that is run again finds its own close among the stored ones and does not use it
    again, _ = daily_report_step(bars([r for r in rows if r[1] == "2024-01-10"]), last)
    for r in again.collect():
        kept = [w for w in whole if w[0] == r.ISIN and w[1] == "2024-01-10"][0]
        assert tuple(r)[:7] == kept[:7]
