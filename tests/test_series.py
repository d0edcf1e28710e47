"""Series operators: blocked lags, splits, lag windows, scaling, tails."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barquet.operators.ordering import last_k_per_key
from barquet.operators.series import (chrono_split, lag_windows, lead_pairs, minmax_inverse, minmax_scale,
                                      series_tail, with_shifts)


def _series(spark, lengths):
    rows = [(k, i, float(i * 10 + len(k))) for k, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "k string, idx int, v double")


def test_blocked_shifts_equal_plain_window(spark):
    df = _series(spark, {"a": 23, "bb": 9, "c": 1})
    got = with_shifts(df, "k", "idx", "v", lags=[1, 3], leads=[2], block=4)
    w = Window.partitionBy("k").orderBy("idx")
    ref = df.select("k", "idx", "v", F.lag("v", 1).over(w).alias("v_lag1"), F.lag("v", 3).over(w).alias("v_lag3"),
                    F.lead("v", 2).over(w).alias("v_lead2"))
    assert sorted(got.collect()) == sorted(ref.collect())


def test_split_80_20(spark):
    rows = chrono_split(_series(spark, {"a": 11}), "k", "idx", 0.8).groupBy("split").count().collect()
    assert dict((r.split, r["count"]) for r in rows) == {"train": 8, "test": 3}


def test_lag_matrix_row_count_and_order(spark):
    df = _series(spark, {"a": 20})
    out = lag_windows(df, "k", "idx", "v", time_step=10, frac=None, block=13).orderBy("idx").collect()
    assert len(out) == 9
    assert out[0].features == [float(i * 10 + 1) for i in range(10)] and out[0].target == 101.0
    assert out[-1].idx == 18


def test_lag_windows_stay_inside_parts(spark):
    df = _series(spark, {"a": 100})
    out = lag_windows(df, "k", "idx", "v", time_step=10, frac=0.8).collect()
    # train part of 80 -> 69 windows, test part of 20 -> 9 windows
    counts = {}
    for r in out:
        counts[r.split] = counts.get(r.split, 0) + 1
        if r.split == "test":
            assert min(r.features) >= 80 * 10 + 1
    assert counts == {"train": 69, "test": 9}


def test_constant_series_scaling(spark):
    df = spark.createDataFrame([("a", 0, 7.0), ("a", 1, 7.0), ("a", 2, 7.0)], "k string, idx int, v double")
    s = minmax_scale(df, "k", "v", name="s")
    rows = s.select("s", minmax_inverse("s").alias("back")).collect()
    assert [r.s for r in rows] == [0.0, 0.0, 0.0] and [r.back for r in rows] == [7.0, 7.0, 7.0]


def test_lead_pairs_and_tails(spark):
    df = _series(spark, {"a": 10, "b": 3})
    pairs = lead_pairs(df, "k", "idx", "v", 7).collect()
    assert len(pairs) == 3 and all(p.target == p.v + 70 for p in pairs)
    t1 = sorted((r.k, r.idx) for r in series_tail(df, "k", "idx", 2).collect())
    t2 = sorted((r.k, r.idx) for r in last_k_per_key(df, ["k"], "idx", 2).collect())
    assert t1 == t2 == [("a", 8), ("a", 9), ("b", 1), ("b", 2)]


def test_one_long_series_is_split_across_tasks(spark):
    n, block = 200_000, 16_384
    # at this size AQE would rightly merge everything into one partition; switch that off to see the split
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(0, n).selectExpr("'hot' as k", "cast(id as int) as idx", "cast(id as double) * 2 as v")
    out = with_shifts(df, "k", "idx", "v", lags=[1, 5], block=block).withColumn("pid", F.spark_partition_id())
    stats = out.agg(F.countDistinct("pid").alias("tasks"), F.count(F.lit(1)).alias("rows"),
                    F.sum(F.when(F.col("v_lag1") == F.col("v") - 2, 1).otherwise(0)).alias("ok1"),
                    F.sum(F.when(F.col("v_lag5") == F.col("v") - 10, 1).otherwise(0)).alias("ok5")).collect()[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert stats.rows == n and stats.ok1 == n - 1 and stats.ok5 == n - 5
    assert stats.tasks >= 4  # 13 blocks of one series spread over several shuffle partitions


def test_discounted_cumsum_equals_recurrence(spark):
    import numpy as np
    from barquet.operators.series import discounted_cumsum
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k, (n, r) in {"a": (500, -0.7), "b": (300, 0.95), "c": (50, 0.0), "d": (200, 1e-4)}.items():
        x = rng.normal(size=n)
        x[5] = np.nan if k == "a" else x[5]
        z, prev = np.zeros(n), 0.0
        for t in range(n):
            prev = (0.0 if np.isnan(x[t]) else x[t]) + r * prev
            z[t] = prev
        want[k] = z
        rows += [(k, t, None if np.isnan(v) else float(v), r) for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, idx int, x double, r double")
    got = discounted_cumsum(df, "k", "idx", ["x"], "r", ["z"]).collect()
    for row in got:
        assert abs(row.z - want[row.k][row.idx]) <= 1e-9 * (1 + abs(want[row.k][row.idx]))
    assert len(got) == 1050
