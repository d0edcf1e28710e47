"""Session construction and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every barquet job relies on. AQE re-plans joins from measured
# sizes (a small side becomes a broadcast only after its size is known) and
# splits skewed join partitions; ANSI mode stays on, so every division that
# may hit zero goes through ``try_divide``.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint copies written by ``materialize`` are deleted once nothing
    # references them (matters for long-running incremental jobs)
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


PARTITION_BYTES = 256 * 1024 * 1024


def sizing_conf(input_bytes: int, partition_bytes: int = PARTITION_BYTES) -> dict[str, str]:
    """Partition settings for a job reading ``input_bytes``.

    Scan splits and shuffle partitions target ``partition_bytes`` each, so a
    task's share fits in executor memory with room for the aggregation and
    sort buffers; AQE then merges small shuffle partitions toward the same
    size and splits skewed ones. For 100 TB of bars that is ~400,000 scan
    tasks and as many initial shuffle partitions; the map-side combine of the
    daily aggregate shrinks the shuffled bytes by orders of magnitude, and
    AQE coalesces accordingly.
    """
    n = max(8, -(-int(input_bytes) // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
    }


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "barquet", extra: dict | None = None,
              input_bytes: int | None = None) -> SparkSession:
    """Build (or reuse) a session with barquet's defaults.

    On a cluster leave ``master`` unset and pass ``input_bytes`` (see
    :func:`sizing_conf`); locally pass ``local[N]`` and a small
    ``shuffle_partitions``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if input_bytes:
        conf.update(sizing_conf(input_bytes))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def work_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh directory under the cluster's shared checkpoint folder.

    The base is ``spark.checkpoint.dir`` as the session reports it. Only when
    the session has none (a bare local test session) is one created and set,
    so that lineage cuts and scratch tables never land on a machine-local
    folder of a cluster node.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="barquet-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return os.path.join(base, "barquet", *parts, uuid.uuid4().hex)


def materialize(df, merge: bool = False):
    """Write ``df`` once to the shared checkpoint folder and return a DataFrame over that copy.

    Used where a reduced table is read several times (solver passes,
    several aggregates over the same lags) or must not be recomputed (a
    sampled range split). The copy survives executor loss and cuts the
    lineage. The input is persisted for the duration of the write so the
    checkpoint job does not recompute it, then released.

    A persisted plan keeps its last shuffle's partitions, mostly empty where a
    table is small. ``merge`` leaves the persisting out: AQE then merges them
    by size, and an eager checkpoint computes the input once all the same.
    Loops use it, whose tasks would otherwise be rounds times partitions.
    """
    from pyspark import StorageLevel
    work_dir(df.sparkSession)
    if merge:
        return df.checkpoint(eager=True)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, as a zip of its sources.

    Python workers import the functions they run by name; a session started
    outside the repository has no other way to find them. The archive is
    served by the driver itself, so no shared folder is needed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_barquet_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="barquet-src-")), "barquet_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._barquet_shipped = True
