"""Global order, row positions and first/last rows.

A keyless ``row_number()`` window pulls every row into one task. The dense
index here is the distributed form: range-partition on the order columns
(AQE sizes the split unless a count is given), take each row's position inside its
partition from ``monotonically_increasing_id`` (partition id in the upper
bits, position in the lower 33), count rows per partition, and add the
running count of the earlier partitions. The per-partition table has one
row per partition, so broadcasting it is bounded by the partition count,
not by the data.

The range split is sampled, and two evaluations of it could draw different
bounds; the split rows are therefore written once with ``checkpoint()``
(to the session's ``spark.checkpoint.dir``) and both the counts and the
positions read that copy. In the reports that copy is the reduced table
(one row per security and day); it survives executor loss and cuts the
lineage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.session import materialize

_POS_BITS = 33


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def with_dense_index(df: DataFrame, order_cols: Sequence[str | Column], name: str = "index",
                     partitions: int | None = None, first: bool = True,
                     partition_cols: Sequence[str] = ()) -> DataFrame:
    """Add ``name`` = 0..n-1 in ``order_cols`` order.

    The order should be unique (ties get an arbitrary but consistent order).
    With ``partition_cols`` the index restarts at 0 for every key: the global
    index over (keys, order) minus each key's smallest index, taken from a
    one-row-per-key aggregate, so a key spanning many partitions is still
    numbered by many tasks.
    """
    keys = list(partition_cols)
    order = _cols(keys) + _cols(order_cols)
    # Without an explicit count AQE sizes the split to the data (adjacent
    # ranges are merged, which keeps the order); the split is written before
    # partition ids are read, so they cannot change afterwards.
    split = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    out = index_ordered_partitions(materialize(split.sortWithinPartitions(*order)), name)
    if keys:
        base = out.groupBy(*keys).agg(F.min(name).alias("_bq_base"))
        out = out.join(base, on=keys).withColumn(name, F.col(name) - F.col("_bq_base")).drop("_bq_base")
    cols = [c for c in out.columns if c != name]
    ordered = [name] + cols if first else cols + [name]
    return out.select(*[F.col(f"`{c}`") for c in ordered])


def index_ordered_partitions(ranged: DataFrame, name: str = "index") -> DataFrame:
    """Number the rows of a materialized DataFrame whose partitions are already in order.

    ``ranged`` must come from :func:`barquet.session.materialize` of a range
    split sorted within partitions (partition i holds keys before partition
    i + 1), so partition ids and positions are fixed. Adds ``name`` =
    running count of earlier partitions + position inside the partition.
    """
    mid = F.monotonically_increasing_id()
    tagged = ranged.withColumn("_bq_mid", mid)
    pid = F.shiftright(F.col("_bq_mid"), _POS_BITS)
    pos = F.col("_bq_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    counts = ranged.groupBy(F.spark_partition_id().alias("_bq_pid")).agg(F.count(F.lit(1)).alias("_bq_n"))
    offsets = counts.select(
        "_bq_pid",
        F.coalesce(F.sum("_bq_n").over(Window.orderBy("_bq_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_bq_off"))
    return (tagged.withColumn("_bq_pid", pid)
            .join(F.broadcast(offsets), on="_bq_pid", how="left")
            .withColumn(name, (F.col("_bq_off") + pos).cast("bigint"))
            .drop("_bq_pid", "_bq_off", "_bq_mid"))


def head(df: DataFrame, order_cols: Sequence[str | Column], k: int = 10) -> DataFrame:
    """First ``k`` rows in a given order (O4): a top-k, never a full sort."""
    return df.orderBy(*_cols(order_cols)).limit(k)


def last_k_per_key(df: DataFrame, keys: Sequence[str], order_col: str, k: int,
                   name: str | None = None) -> DataFrame:
    """Last ``k`` rows of each key by ``order_col``.

    ``row_number() <= k`` over a descending order lets Spark insert a
    per-partition group limit before the shuffle, so a hot key sends at most
    ``k`` rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order_col).desc())
    rn = name or "_bq_rn"
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)
    return out if name else out.drop(rn)


def latest_value(df: DataFrame, c: str) -> DataFrame:
    """Rows whose ``c`` equals the maximum of ``c`` (O5: the last key of a sorted listing)."""
    top = df.agg(F.max(c).alias("_bq_max"))
    return df.join(F.broadcast(top), F.col(c) == F.col("_bq_max"), "left_semi")
