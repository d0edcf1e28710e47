"""Operators on minute bars: cleaning, per-day open/close, OHLCV aggregates.

The reference attaches the first and last price of each (security, day) to
every row with a sorted window and then dedupes with ``min`` inside a group
by. Here the same values come out of one grouped aggregate with ``min_by`` /
``max_by``: it has a partial (map-side) stage, so a security holding a
third of all bars is pre-reduced in every scan task before the shuffle, and
no task ever holds a whole group.

The order key is a ``long`` (seconds of the day, times 2^46, plus an
optional integer tiebreak), not the ``HH:mm`` text or a struct: with only
fixed-width values in the aggregation buffer Spark runs a hash aggregate;
a text or struct key would force a sort of every input row on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.functions.columns import MORNING_CLOSE, MORNING_OPEN, time_between_exclusive
from barquet.sources.schemas import BAR_COLUMNS

KEYS = ["ISIN", "Date"]

_ALL = object()


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the named columns (column pruning reaches the scan)."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def drop_missing(df: DataFrame, subset: Sequence[str] | None | object = _ALL) -> DataFrame:
    """Drop rows with a missing value (NULL, or NaN in a floating column).

    ``subset`` defaults to the bar columns the reports use (the notebook
    behaviour, after projection). ``subset=None`` checks every column of
    ``df`` (the function/class behaviour, before any projection); note that
    this reads every column of the source. Written as plain ``IS NOT NULL``
    predicates so that Catalyst can push them into the scan (and through
    aggregates onto grouping keys).
    """
    if subset is _ALL:
        subset = [c for c in BAR_COLUMNS if c in df.columns]
    cols = df.columns if subset is None else list(subset)
    types = dict(df.dtypes)
    cond = F.lit(True)
    for c in cols:
        col = F.col(f"`{c}`")
        cond = cond & col.isNotNull()
        if types.get(c) in ("double", "float"):
            cond = cond & ~F.isnan(col)
    return df.filter(cond)


_TIEBREAK_BITS = 46


def time_order_key(time_col: str = "Time", tiebreak: str | None = None) -> Column:
    """``HH:mm`` or ``HH:mm:ss`` text (plus an optional tiebreak) as one ``long`` sort key.

    Orders exactly as ``(Time, tiebreak)`` for valid times; the tiebreak must
    be an integer in [0, 2^46), or the query raises. An unparsable time gives NULL (the row is
    then not a first/last candidate).
    """
    parts = F.split(F.col(time_col), ":")
    secs = (F.try_element_at(parts, F.lit(1)).try_cast("long") * 3600
            + F.try_element_at(parts, F.lit(2)).try_cast("long") * 60
            + F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("long"), F.lit(0)))
    key = F.shiftleft(secs, _TIEBREAK_BITS)
    if not tiebreak:
        return key
    t = F.col(tiebreak).cast("long")
    return F.when(t.between(0, (1 << _TIEBREAK_BITS) - 1), key + t).when(
        t.isNotNull(), F.raise_error(F.lit(f"{tiebreak} outside [0, 2^{_TIEBREAK_BITS})")).cast("long"))


_ORD = "_bq_ord"


def with_order_key(bars: DataFrame, time_col: str = "Time", tiebreak: str | None = None) -> DataFrame:
    """Add the ``long`` time order key once per row (shared by first/last aggregates)."""
    return bars.withColumn(_ORD, time_order_key(time_col, tiebreak))


def first_by_key(value: str, key: str = _ORD) -> Column:
    """Aggregate: the non-missing ``value`` with the smallest order key."""
    v = F.col(value)
    return F.min_by(v, F.when(v.isNotNull(), F.col(key)))


def last_by_key(value: str, key: str = _ORD) -> Column:
    """Aggregate: the non-missing ``value`` with the largest order key."""
    v = F.col(value)
    return F.max_by(v, F.when(v.isNotNull(), F.col(key)))


def daily_ohlcv(bars: DataFrame, open_col: str = "StartPrice", close_col: str = "EndPrice",
                tiebreak: str | None = None, extra_keys: Sequence[str] = ()) -> DataFrame:
    """One row per (ISIN, Date): open, close, low, high, volume (A1).

    ``close_col="StartPrice"`` gives the early variant whose close is the
    last start price of the day. ``extra_keys`` are grouped on as well (a
    column determined by the day, such as a watermarked event time).
    """
    return with_order_key(bars, tiebreak=tiebreak).groupBy(*KEYS, *extra_keys).agg(
        first_by_key(open_col).alias("opening_price_eur"),
        last_by_key(close_col).alias("closing_price_eur"),
        F.min("MinPrice").alias("minimum_price_eur"),
        F.max("MaxPrice").alias("maximum_price_eur"),
        F.sum("TradedVolume").cast("bigint").alias("daily_traded_volume"),
    )


def morning_ohlcv(bars: DataFrame, lo: str = MORNING_OPEN, hi: str = MORNING_CLOSE,
                  tiebreak: str | None = None, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Morning aggregate (A2) in one pass.

    Open and close come from the whole day; low, high and volume only from
    bars strictly inside ``(lo, hi)``. A (security, day) with no bar in the
    window has no row.
    """
    inside = time_between_exclusive("Time", lo, hi)
    return (with_order_key(bars, tiebreak=tiebreak).groupBy(*KEYS, *extra_keys).agg(
        first_by_key("StartPrice").alias("start_price"),
        last_by_key("EndPrice").alias("end_price"),
        F.min(F.when(inside, F.col("MinPrice"))).alias("minimum_price"),
        F.max(F.when(inside, F.col("MaxPrice"))).alias("maximum_price"),
        F.sum(F.when(inside, F.col("TradedVolume"))).cast("bigint").alias("daily_traded_volume"),
        F.count_if(inside).alias("_n_inside"))
        .filter(F.col("_n_inside") > 0)
        .drop("_n_inside"))


def attach_open_close(bars: DataFrame, open_col: str = "StartPrice", close_col: str = "EndPrice",
                      tiebreak: str | None = None, open_name: str = "opening_price",
                      close_name: str = "closing_price") -> DataFrame:
    """Every bar with its day's first open and last close as columns.

    The reference's per-group window is an aggregate joined back to its
    rows: the aggregate is pre-reduced map-side and has one row per group,
    and the join lets AQE broadcast it when its measured size is small or
    split a hot key's partition (skew join) when it is not.
    """
    day = with_order_key(bars, tiebreak=tiebreak).groupBy(*KEYS).agg(
        first_by_key(open_col).alias(open_name), last_by_key(close_col).alias(close_name))
    return bars.join(day, on=KEYS, how="left")


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows and number of columns, as one row (A4)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def distinct_with_missing(c: str, approximate: bool = False, rsd: float = 0.01) -> Column:
    """Aggregate: distinct values, a missing value counted as one more (A5).

    ``approximate=True`` uses a HyperLogLog++ sketch (relative error ``rsd``):
    a fixed-size buffer per task instead of a distinct-value exchange.
    """
    col = F.col(c)
    distinct = F.approx_count_distinct(col, rsd) if approximate else F.count_distinct(col)
    return (distinct + F.coalesce(F.max(col.isNull().cast("int")), F.lit(0))).cast("bigint")


def group_count(df: DataFrame, keys: Sequence[str], with_missing: bool = False) -> DataFrame:
    """Number of groups (A6), as one row.

    Default: rows with a missing key are left out, as a grouped aggregation
    leaves them out (``count(DISTINCT k1, k2, ...)`` skips a row when any key
    is NULL). ``with_missing=True`` counts every distinct key combination,
    missing values included, which is what pandas' ``len(df.groupby(keys))``
    returns (it counts the ``groups`` mapping, NaN keys included, although the
    aggregation drops them).
    """
    if with_missing:
        return df.groupBy(*keys).agg(F.lit(1).alias("_bq")).agg(F.count(F.lit(1)).alias("n_groups"))
    return df.agg(F.count_distinct(*[F.col(k) for k in keys]).alias("n_groups"))


def explore(bars: DataFrame, key: str = "ISIN", group_keys: Sequence[str] = ("ISIN", "Date"),
            approximate: bool = False, groups_with_missing: bool = False) -> DataFrame:
    """Row count, column count, distinct securities (missing counted) and groups.

    Exact form: one grouped count by the security and group keys (a hash
    aggregate with map-side combine, so a hot security is reduced in every
    scan task), then every figure from that table of distinct combinations.
    ``approximate=True`` uses HyperLogLog++ sketches in a single aggregate.
    ``groups_with_missing`` as in :func:`group_count`.
    """
    keys = list(dict.fromkeys([key, *group_keys]))
    if approximate:
        full = F.struct(*[F.col(k) for k in group_keys])
        if not groups_with_missing:
            full = F.when(F.greatest(*[F.col(k).isNull() for k in group_keys]) == F.lit(False), full)
        out = bars.agg(F.count(F.lit(1)).alias("n_rows"),
                       distinct_with_missing(key, True).alias("n_securities"),
                       F.approx_count_distinct(full).alias("n_groups"))
    else:
        combos = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("_bq_c"))
        all_keys = F.greatest(*[F.col(k).isNull() for k in group_keys]) == F.lit(False)
        if set(group_keys) == set(keys):
            groups = F.count(F.lit(1)) if groups_with_missing else \
                F.sum(F.when(all_keys, F.lit(1)).otherwise(F.lit(0)))
        elif groups_with_missing:
            groups = F.count_distinct(F.struct(*[F.col(k) for k in group_keys]))
        else:
            groups = F.count_distinct(*[F.col(k) for k in group_keys])
        out = combos.agg(F.sum("_bq_c").cast("bigint").alias("n_rows"),
                         distinct_with_missing(key).alias("n_securities"),
                         groups.cast("bigint").alias("n_groups"))
    return out.select(F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
                      F.lit(len(bars.columns)).alias("n_columns"), "n_securities",
                      F.coalesce("n_groups", F.lit(0)).cast("bigint").alias("n_groups"))


def global_max(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """Column maximum as one row (A3)."""
    return df.agg(F.max(c).alias(name or f"max_{c}"))
