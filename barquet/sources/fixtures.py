"""Bar-shaped views over the driver's tables.

The driver's data has no minute prices, so these views give the shapes the
reports need: ``events`` grouped by type and minute become minute bars, and
daily maxima of ``orders`` per priority become close series. Each view has
a Spark form (a DataFrame) and the DuckDB text used by the oracles.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# event ids stay below 2^37 in the driver's tables (100,000 x sf rows); checked in _bars
_ID_BITS = 37


def _bars(events: DataFrame, isin: F.Column) -> DataFrame:
    # Orders as struct(ts, event_id) inside a minute: microseconds into the
    # minute (< 2^26) above the event id (< 2^37) in one long, so the
    # aggregation buffer is fixed-width and the aggregate is hash-based.
    # A larger id would mix with the time: it raises.
    micros = F.unix_micros(F.col("ts").cast("timestamp")) % F.lit(60_000_000)
    order = F.when(F.col("event_id").between(0, (1 << _ID_BITS) - 1), F.shiftleft(micros, _ID_BITS) + F.col("event_id")) \
        .otherwise(F.raise_error(F.lit("event_id outside [0, 2^37)")))
    return (events
            .groupBy(isin.alias("ISIN"),
                     F.date_format("ts", "yyyy-MM-dd").alias("Date"),
                     F.date_format("ts", "HH:mm").alias("Time"))
            .agg(F.min_by("value", order).alias("StartPrice"),
                 F.max("value").alias("MaxPrice"),
                 F.min("value").alias("MinPrice"),
                 F.max_by("value", order).alias("EndPrice"),
                 F.sum(F.lit(1) + F.col("event_id") % 500).cast("bigint").alias("TradedVolume")))


def _events(spark: SparkSession, sf_dir: str, since: str | None, until: str | None) -> DataFrame:
    """Events of a closed range of days; the bounds are on ``ts`` itself, so they reach the scan."""
    e = table(spark, sf_dir, "events")
    kind = e.schema["ts"].dataType
    if since is not None:
        e = e.filter(F.col("ts") >= F.lit(f"{since} 00:00:00").cast(kind))
    if until is not None:
        e = e.filter(F.col("ts") < F.date_add(F.lit(until).cast("date"), 1).cast(kind))
    return e


def trades(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Minute bars, one security per event type (5 securities, 30 days); ``since`` and ``until`` bound the days."""
    return _bars(_events(spark, sf_dir, since, until), F.col("event_type"))


def trades_wide(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Minute bars, one security per user (many securities, few bars each); ``since`` and ``until`` bound the days."""
    return _bars(_events(spark, sf_dir, since, until), F.concat(F.lit("U"), F.col("user_id").cast("string")))


def trades_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trades`` with missing keys (minute 17) and missing closes (minute 13)."""
    t = trades(spark, sf_dir)
    return t.select(
        F.when(F.col("Time").like("%:17"), F.lit(None)).otherwise(F.col("ISIN")).alias("ISIN"),
        "Date", "Time", "StartPrice", "MaxPrice", "MinPrice",
        F.when(F.col("Time").like("%:13"), F.lit(None)).otherwise(F.col("EndPrice")).alias("EndPrice"),
        "TradedVolume")


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close series: daily maximum order price per priority, positions 0..n-1.

    One row per (priority, day), so each series is bounded by the number of
    calendar days; the per-series ``row_number`` is over that small table.
    """
    o = table(spark, sf_dir, "orders")
    daily = o.groupBy(F.col("o_orderpriority").alias("series_id"), "o_orderdate") \
             .agg(F.max("o_totalprice").alias("Close"))
    w = Window.partitionBy("series_id").orderBy("o_orderdate")
    return daily.select("series_id", (F.row_number().over(w) - 1).cast("int").alias("idx"), "Close")


def closes_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-point trailing mean of ``closes`` (lag-1 slope about 0.8)."""
    w = Window.partitionBy("series_id").orderBy("idx").rowsBetween(-4, 0)
    return closes(spark, sf_dir).select("series_id", "idx", F.avg("Close").over(w).alias("Close"))


VIEWS = {"trades": trades, "trades_wide": trades_wide, "trades_dirty": trades_dirty,
         "closes": closes, "closes_smooth": closes_smooth}


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register the driver's tables and the fixture views as temp views."""
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            spark.read.parquet(path).createOrReplaceTempView(name)
    for name, fn in VIEWS.items():
        fn(spark, sf_dir).createOrReplaceTempView(name)


# DuckDB text of the same views, for the oracle side.
_DUCK_BARS = """select {isin} as ISIN, strftime(ts, '%Y-%m-%d') as Date, strftime(ts, '%H:%M') as Time,
  arg_min(value, row(ts, event_id)) as StartPrice, max(value) as MaxPrice, min(value) as MinPrice,
  arg_max(value, row(ts, event_id)) as EndPrice, cast(sum(1 + event_id % 500) as bigint) as TradedVolume
  from events group by 1, 2, 3"""

DUCKDB_VIEWS = {
    "trades": _DUCK_BARS.format(isin="event_type"),
    "trades_wide": _DUCK_BARS.format(isin="concat('U', cast(user_id as varchar))"),
    "trades_dirty": """select case when Time like '%:17' then null else ISIN end as ISIN, Date, Time,
  StartPrice, MaxPrice, MinPrice, case when Time like '%:13' then null else EndPrice end as EndPrice,
  TradedVolume from trades""",
    "closes": """select o_orderpriority as series_id,
  cast(row_number() over (partition by o_orderpriority order by o_orderdate) - 1 as int) as idx,
  max(o_totalprice) as Close from orders group by o_orderpriority, o_orderdate""",
    "closes_smooth": """select series_id, idx,
  avg(Close) over (partition by series_id order by idx rows between 4 preceding and current row) as Close
  from closes""",
}

_DEPENDS = {"trades_dirty": ["trades"], "closes_smooth": ["closes"]}


def duckdb_with(*names: str) -> str:
    """``WITH`` clause defining the named fixture views (and what they use)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({DUCKDB_VIEWS[n]})" for n in order) + "\n"
