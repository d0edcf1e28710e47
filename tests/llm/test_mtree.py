import random

import numpy as np
from pyspark.sql import functions as F

from barquet.llm import mtree


def brute(rows, k=5, every=50):
    own = [(i, np.floor(256.0 * np.array(v, np.float64))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in own), default=0)
    own = [(i, np.pad(v, (0, dim - len(v)))) for i, v in own]
    out = []
    for i, q in own:
        if i % every == 0:
            best = sorted((-int(q @ v), j) for j, v in own if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def found(spark, rows, **k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, VEC_ID string") if rows and len(rows[0]) == 3 else spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    points = mtree.integer_vectors(df.repartition(3))
    return sorted(map(tuple, mtree.top_k(points, points.filter(F.col("vec_id") % 50 == 0), **k).collect()))


def test_clusters_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    f = lambda v: [float(np.float32(x)) for x in v]
    centers = rng.normal(size=(8, 12)) * 2
    rows = [(i, f(centers[i % 8] + rng.normal(size=12) * 0.1)) for i in range(500)]
    rows += [(1000 + i, f(centers[0])) for i in range(300)]  # one vector many times
    rows += [(2000, None), (None, f(centers[1])), (2050, [1.0, None]), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (2200, []), (2250, [1.0, 2.0]), (2300, [0.0] * 12)]
    assert found(spark, rows) == brute(rows)


def test_norms_that_differ_and_small_tables(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5) * rng.choice([0.01, 1, 30])]) for i in range(260)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:3]) == brute(rows[:3])
    assert found(spark, rows[:1]) == []
    assert found(spark, []) == []


def test_pages_are_left_out_by_their_bounds():
    rng = np.random.default_rng(3)
    x = np.concatenate([np.floor(256 * (c + 0.02 * rng.normal(size=(200, 8)))) for c in rng.normal(size=(10, 8)) * 3])
    space = mtree.Space(8, float((x * x).sum(1).max()))
    pivot = space.lift(x[:1])[0]
    tree = mtree.Tree.build(np.arange(len(x)), x, space, pivot)
    assert np.all(np.diff(tree.cut) <= mtree.PAGE)
    for p in range(len(tree.centers)):
        own = space.distance(tree.points[tree.cut[p]:tree.cut[p + 1]], tree.centers[p][None, :])[:, 0]
        assert own.max() <= tree.radius[p] + 1e-5
        assert np.allclose(own, tree.own[tree.cut[p]:tree.cut[p + 1]], atol=1e-3)
    again = mtree.Tree.unpack(tree.pack())
    q = x[5:6]
    r, ids, s = again.search(space, np.array([-1]), q, np.array([-np.inf]), pivot, 5)
    want = np.sort(x @ q[0])[::-1][:5]
    assert np.array_equal(np.sort(s)[::-1], want)


def test_queries_travel_once_a_group_of_trees(spark, monkeypatch):
    """Vectors without clusters: bounds leave out next to nothing, so every query has to be compared with every part."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1600, 64))
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]
    made, real = [], mtree.in_arrow
    monkeypatch.setattr(mtree, "in_arrow", lambda *a: made.append(real(*a)) or made[-1])
    monkeypatch.setattr(mtree, "LEAST_PART", 8)
    assert found(spark, rows) == brute(rows)
    # the last is what the second pass sends: not 32 queries to each of over 64 parts
    assert made[-1].count() <= int(spark.conf.get("spark.sql.shuffle.partitions")) ** 2


def test_components_beyond_short_numbers_and_floats(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5) * rng.choice([1, 1e4])]) for i in range(260)]
    rows += [(1000 + 50 * i, [0.0] * 5) for i in range(2)] + [(300, [1.0, 2.0]), (350, [])]
    assert found(spark, rows) == brute(rows)


def test_trees_share_the_best_and_ties_go_to_the_smaller_id():
    rng = np.random.default_rng(6)
    x = np.concatenate([np.floor(256 * rng.normal(size=(300, 16))), np.zeros((300, 16)) + 700.0])
    ids = rng.permutation(600)
    space = mtree.Space(16, float((x * x).sum(1).max()))
    pivot = space.lift(x[:1])[0]
    q, q_ids, best = x[::40], ids[::40], mtree.Best(np.full(15, -np.inf), 5)
    for own in np.array_split(rng.permutation(600), 4):
        mtree.Tree.unpack(mtree.Tree.build(ids[own], x[own], space, pivot).pack()).improve(space, q_ids, q, best, pivot, np.arange(15))
    r, i, s = best.hits()
    want = [sorted((-int(q[n] @ v), int(j)) for j, v in zip(ids, x) if j != q_ids[n])[:5] for n in range(15)]
    assert [[(-int(b), int(a)) for a, b in zip(i[r == n], s[r == n])] for n in range(15)] == want
