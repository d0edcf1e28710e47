import hashlib
import math

import numpy as np
import pytest

from barquet.llm import orchard

SCHEMA = "vec_id long, embedding array<float>, label int, VEC_ID string"


def plain(rows, dims, k, rounds):
    """Every distance of every vector, in Python integers."""
    kept = [(i, [math.floor(256.0 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    by = {j: sum(d for _, c, d in out if c == j) for j in range(len(centroids))}
    digest = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return sorted(((i, c, d, by[c], sum(by.values()), digest(c)) for i, c, d in out), key=str)


def odd(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dims).round(1)]) for i in range(n)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (7, rows[9][1]), (None, rows[3][1]), (None, rows[4][1]), (500, None), (501, []), (502, [0.5] * (dims + 1)),
             (503, [None] + [0.0] * (dims - 1)), (504, [float("nan")] + [0.0] * (dims - 1)), (505, [float("-inf")] + [0.0] * (dims - 1)), (506, [-0.001] * dims)]
    return rows + [(600 + i, [0.5] * dims) for i in range(n // 2)]


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x") for i, e in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("dims,k,n", [(2, 5, 60), (4, 12, 120), (3, 40, 20)])
def test_equals_all_distances(spark, dims, k, n):
    rows = odd(n, dims)
    got = orchard.cluster_report(frame(spark, rows), dims=dims, k=k, rounds=3).drop("n_measured").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, dims, k, 3)


def test_search_agrees_on_ties_and_saves_distances():
    rng = np.random.default_rng(1)
    grid = rng.integers(-3, 4, (30, 2)) * 4
    number, d, measured = orchard.Lists(grid).nearest(v := rng.integers(-14, 15, (5000, 2)))
    every = ((v[:, None] - grid[None]) ** 2).sum(2)
    assert (d == every.min(1)).all() and (number == every.argmin(1)).all()  # argmin takes the smaller number
    spread = rng.integers(-1000, 1000, (64, 2))
    assert orchard.Lists(spread).nearest(spread.repeat(20, 0) + rng.integers(-9, 10, (1280, 2)))[2].mean() < 40


def test_no_vectors_and_one(spark):
    assert orchard.cluster_report(frame(spark, [])).collect() == []
    assert orchard.cluster_report(frame(spark, [(1, None)])).collect() == []
    only = orchard.cluster_report(frame(spark, [(1, [0.25] * 64)])).collect()
    assert [(r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in only] == [(1, 0, 0, 0)]


def test_component_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="27 bits"):
        orchard.cluster_report(frame(spark, [(1, [1e9] * 64)])).collect()


def test_one_cluster_with_most_vectors_sends_one_row_a_task(spark):
    vectors = orchard.integer_vectors(frame(spark, [(i, [0.5, float(i % 2)]) for i in range(4000)]), dims=2)
    centroids = orchard.seeds(vectors, 2)
    assert len(orchard._means(vectors, centroids)) == 2
    assert orchard.assign(vectors, centroids).count() == 4000
