"""Property tests (random inputs) for the distributed building blocks against sequential references."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from barquet.operators.ordering import with_dense_index
from barquet.operators.series import discounted_cumsum, with_shifts

SETTINGS = settings(max_examples=6, deadline=None)


def test_dense_index_property(spark):
    @SETTINGS
    @given(st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50)), min_size=1, max_size=300, unique=True),
           st.integers(1, 9))
    def check(rows, parts):
        df = spark.createDataFrame(rows, "k int, v int")
        got = with_dense_index(df, ["v"], partition_cols=["k"], partitions=parts).collect()
        for k in {r[0] for r in rows}:
            ordered = sorted(v for kk, v in rows if kk == k)
            assert sorted((r["index"], r.v) for r in got if r.k == k) == list(enumerate(ordered))

    check()


def test_shifts_property(spark):
    @SETTINGS
    @given(st.lists(st.integers(1, 60), min_size=1, max_size=4), st.integers(6, 20))
    def check(lengths, block):
        rows = [(f"s{j}", i, float(i * 3 + j)) for j, n in enumerate(lengths) for i in range(n)]
        df = spark.createDataFrame(rows, "k string, idx int, v double")
        got = with_shifts(df, "k", "idx", "v", lags=[1, 5], leads=[2], block=block).collect()
        by = {(k, i): v for k, i, v in rows}
        for r in got:
            assert r.v_lag1 == by.get((r.k, r.idx - 1)) and r.v_lag5 == by.get((r.k, r.idx - 5))
            assert r.v_lead2 == by.get((r.k, r.idx + 2))
        assert len(got) == len(rows)

    check()


def test_discounted_cumsum_property(spark):
    @SETTINGS
    @given(st.lists(st.floats(-0.95, 0.95), min_size=1, max_size=3), st.integers(1, 400), st.integers(0, 10_000))
    def check(rs, n, seed):
        rng = np.random.default_rng(seed)
        rows, want = [], {}
        for j, r in enumerate(rs):
            x = rng.normal(size=n)
            z, prev = [], 0.0
            for v in x:
                prev = v + r * prev
                z.append(prev)
            want[j] = z
            rows += [(j, t, float(v), float(r)) for t, v in enumerate(x)]
        df = spark.createDataFrame(rows, "k int, idx int, x double, r double")
        for row in discounted_cumsum(df, "k", "idx", ["x"], "r", ["z"]).collect():
            w = want[row.k][row.idx]
            assert abs(row.z - w) <= 1e-9 * (1 + abs(w))

    check()
