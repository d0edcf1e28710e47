"""The dated daily run as an incremental file stream.

The reference runs once per date: list the files from the run date minus
one day, rebuild the report for them, filter to the run date. Here the
heavy part, bars to one row per (security, day), is a Structured Streaming
aggregation over the dated CSV tree:

* the file source picks up new day directories (and late files of earlier
  days) on every trigger;
* the grouped aggregate keeps the partial open/close/low/high/volume per
  (ISIN, Date) in the state store, so a day whose files arrive in several
  batches is still aggregated exactly (all five parts merge);
* ``update`` output hands each trigger the full current value of every
  changed (ISIN, Date) to ``foreachBatch``, which replaces those rows in a
  Parquet table partitioned by ``Date`` (the touched days only, so a replayed
  batch rewrites the same rows). New days are written aside, a journal names
  them, and only then do folders change places; a run that dies on the way is
  finished from the journal by the next upsert or read (:func:`recover`);
* a watermark (``late_days``, 31 by default) bounds the state: bars older than
  that many days behind the newest day seen are not added any more, and
  :func:`late_bars` counts them; ``None`` keeps every (ISIN, Date) in the
  state for good.

The light part, previous close, change and rounding, is a batch job over
that small table (:func:`report_from_daily_table`).

A file stream reads every file with one declared schema; the header of each
file is checked against it (``enforceSchema=false``), so a file with other
columns fails the batch instead of yielding shifted values. Trees with
mixed headers go through the batch reader
(:func:`barquet.sources.files.read_csv_by_name`).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from barquet.functions.columns import (EUR_TO_MXN, MORNING_CLOSE, MORNING_OPEN, convert_currency, pct_change,
                                       round_numeric_columns, row_stddev)
from barquet.operators.bars import daily_ohlcv, drop_missing, morning_ohlcv
from barquet.plans.reports import CHANGE, previous_close
from barquet.sources.files import missing_tokens_to_null
from barquet.sources.schemas import BAR_SCHEMA

KEYS = ["ISIN", "Date"]
#: Days behind the newest one for which late bars are still added, unless told otherwise.
LATE_DAYS = 31

# The incremental table; declared on read so the ``Date`` partition value
# stays text (partition discovery would turn it into a date).
DAILY_TABLE_DDL = ("ISIN string, opening_price_eur double, closing_price_eur double, minimum_price_eur double, "
                   "maximum_price_eur double, daily_traded_volume bigint, Date string")
MORNING_TABLE_DDL = ("ISIN string, start_price double, end_price double, minimum_price double, "
                     "maximum_price double, daily_traded_volume bigint, Date string")


#: Folders of a table that readers do not look into: days written aside, and journals of changes under way.
ASIDE, JOURNAL = "_aside", "_journal"


class _Folders:
    """The table's folders through the file system that Spark writes with."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, "/".join(parts))

    def has(self, *parts: str) -> bool:
        return self.fs.exists(self.at(*parts))

    def names(self, *parts: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(*parts))) if self.has(*parts) else []

    def drop(self, *parts: str) -> None:
        self.fs.delete(self.at(*parts), True)

    def move(self, source: tuple[str, ...], target: tuple[str, ...]) -> None:
        if not self.fs.rename(self.at(*source), self.at(*target)):
            raise OSError(f"{'/'.join(source)} could not be moved to {'/'.join(target)} in {self.root}")


def _put_in_place(folders: _Folders, change: str) -> None:
    """Let the days written aside by a journalled change take their places; may be repeated from any point."""
    for day in folders.names(ASIDE, change):
        if day.startswith("Date="):
            if folders.has(day):
                folders.drop(day)
            folders.move((ASIDE, change, day), (day,))
    folders.drop(JOURNAL, change)
    folders.drop(ASIDE, change)


def recover(spark: SparkSession, table_path: str) -> list[str]:
    """Finish the changes that a run journalled and did not end; returns their names. What was not journalled has changed nothing."""
    folders = _Folders(spark, table_path)
    changes = folders.names(JOURNAL)
    for change in changes:
        _put_in_place(folders, change)
    for left in folders.names(ASIDE):  # written aside, never journalled
        folders.drop(ASIDE, left)
    return changes


def upsert_days(batch: DataFrame, table_path: str, ddl: str = DAILY_TABLE_DDL) -> None:
    """Replace the rows of ``batch``'s (ISIN, Date) keys in the day-partitioned table.

    The merged days are written aside; a journal entry, made by one rename,
    says that they are whole; then each takes its place. A run that dies
    before the entry has changed nothing, one that dies after it is finished
    by :func:`recover`, which every upsert and report begins with. One writer
    at a time, as a stream's batches are.

    The micro-batch is used several times (touched days, anti-join, union),
    so it is persisted for the call instead of re-running the batch's plan.
    """
    from pyspark import StorageLevel
    spark = batch.sparkSession
    recover(spark, table_path)
    folders = _Folders(spark, table_path)
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        dates = [r.Date for r in batch.select("Date").distinct().collect()]  # days touched: a short list
        if not dates:
            return
        present = [d for d in dates if folders.has(f"Date={d}")]
        merged = batch
        if present:
            # only the touched days' files are listed and read
            kept = (spark.read.schema(ddl).option("basePath", table_path)
                    .parquet(*[os.path.join(table_path, f"Date={d}") for d in present])
                    .join(batch.select(*KEYS), on=KEYS, how="left_anti"))
            merged = kept.unionByName(batch.select(*kept.columns))
        change = uuid.uuid4().hex
        merged.write.partitionBy("Date").parquet(os.path.join(table_path, ASIDE, change))
        folders.fs.mkdirs(folders.at(JOURNAL))
        folders.fs.create(folders.at(ASIDE, change, "_whole")).close()
        folders.move((ASIDE, change, "_whole"), (JOURNAL, change))
        _put_in_place(folders, change)
    finally:
        batch.unpersist()


def late_bars(query: StreamingQuery) -> int:
    """Bars that the watermark kept out in the batches that the query still knows of (the last hundred by default)."""
    return sum(int(state.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for state in p["stateOperators"])


def _start(spark: SparkSession, source_base: str, table_path: str, checkpoint_location: str, schema: StructType,
           late_days: int | None, available_now: bool, processing_time: str | None, aggregate, ddl: str
           ) -> StreamingQuery:
    bars = (spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
            .csv(os.path.join(source_base.rstrip("/"), "*")))
    bars = drop_missing(missing_tokens_to_null(bars))
    extra: list[str] = []
    if late_days is not None:
        # the event day is a grouping key, so the watermark can drop finished days from the state
        bars = bars.withColumn("_bq_day", F.to_timestamp("Date")).withWatermark("_bq_day", f"{late_days} days")
        extra = ["_bq_day"]
    day = aggregate(bars, extra)

    def write(batch: DataFrame, epoch_id: int) -> None:  # noqa: ARG001 (idempotent per key)
        upsert_days(batch.drop(*extra), table_path, ddl)

    w = (day.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def start_daily_aggregation(spark: SparkSession, source_base: str, table_path: str, checkpoint_location: str,
                            schema: StructType = BAR_SCHEMA, late_days: int | None = LATE_DAYS,
                            available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Start the incremental bars -> daily OHLCV job; returns the running query.

    ``available_now`` processes everything present and stops (the scheduled
    daily run); otherwise ``processing_time`` (e.g. ``"10 minutes"``) keeps
    it running.
    """
    return _start(spark, source_base, table_path, checkpoint_location, schema, late_days, available_now,
                  processing_time, lambda b, extra: daily_ohlcv(b, extra_keys=extra), DAILY_TABLE_DDL)


def start_morning_aggregation(spark: SparkSession, source_base: str, table_path: str, checkpoint_location: str,
                              lo: str = MORNING_OPEN, hi: str = MORNING_CLOSE, schema: StructType = BAR_SCHEMA,
                              late_days: int | None = LATE_DAYS, available_now: bool = True,
                              processing_time: str | None = None) -> StreamingQuery:
    """Start the incremental bars -> morning aggregate job (whole-day open/close, window low/high/volume).

    A (security, day) appears once it has a bar inside the window; its
    conditional aggregates only grow, so an emitted row is never withdrawn.
    """
    return _start(spark, source_base, table_path, checkpoint_location, schema, late_days, available_now,
                  processing_time, lambda b, extra: morning_ohlcv(b, lo, hi, extra_keys=extra), MORNING_TABLE_DDL)


def report_from_daily_table(spark: SparkSession, table_path: str, arg_date: str | None = None,
                            decimals: int = 2) -> DataFrame:
    """Daily report columns from the incremental table (no ``index``; D1's light part)."""
    recover(spark, table_path)
    day = spark.read.schema(DAILY_TABLE_DDL).parquet(table_path).select(
        "ISIN", "Date", "opening_price_eur", "closing_price_eur", "minimum_price_eur", "maximum_price_eur",
        "daily_traded_volume")
    rep = previous_close(day).withColumn(CHANGE, pct_change("closing_price_eur", "prev_closing_price")) \
                            .drop("prev_closing_price")
    rep = round_numeric_columns(rep, decimals)
    if arg_date is not None:
        rep = rep.filter(F.col("Date") >= F.lit(arg_date))
    return rep.orderBy("ISIN", "Date")


def report_from_morning_table(spark: SparkSession, table_path: str, rate: float = EUR_TO_MXN) -> DataFrame:
    """Morning report columns from the incremental morning table (D2's light part)."""
    recover(spark, table_path)
    m = spark.read.schema(MORNING_TABLE_DDL).parquet(table_path)
    return m.select("ISIN", "Date", "start_price", "end_price", "minimum_price", "maximum_price",
                    "daily_traded_volume", convert_currency("end_price", rate).alias("end_price_mx"),
                    row_stddev("start_price", "end_price").alias("standard_deviation"))
