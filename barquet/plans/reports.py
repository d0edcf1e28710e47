"""The two reports, composed from the operators.

Daily report plan (D1): scan -> drop missing -> partial/final aggregate on
(ISIN, Date) -> ``lag`` window on ISIN -> round -> optional dense index ->
filter on the run date -> order. The big exchange is the aggregate's, and it
moves map-side-combined rows; the window's exchange moves one row per
security and day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquet.functions.columns import (EUR_TO_MXN, MORNING_CLOSE, MORNING_OPEN, convert_currency,
                                       pct_change, round_numeric_columns, row_stddev)
from barquet.operators.bars import _ALL, daily_ohlcv, drop_missing, morning_ohlcv
from barquet.operators.ordering import index_ordered_partitions
from barquet.session import materialize

CHANGE = "change_prev_closing_%"


def previous_close(report: DataFrame, close: str = "closing_price_eur", name: str = "prev_closing_price",
                   key: str = "ISIN", order: str = "Date") -> DataFrame:
    """Close of the security's previous report row (W3): previous row, not calendar day.

    The window partition is one security's report rows (one per day), so
    it is bounded by the number of days however many bars the day had.
    """
    w = Window.partitionBy(key).orderBy(order)
    return report.withColumn(name, F.lag(close, 1).over(w))


def daily_report(bars: DataFrame, arg_date: str | None = None, close_col: str = "EndPrice",
                 with_index: bool = True, subset: Sequence[str] | None | object = _ALL,
                 tiebreak: str | None = None, decimals: int = 2, sort: bool = True) -> DataFrame:
    """Daily report per (ISIN, Date).

    Columns: ``index`` (optional), ISIN, Date, opening/closing/minimum/maximum
    price, daily volume and ``change_prev_closing_%`` (NULL on a security's
    first day or after a zero close). Prices and the change are rounded half
    to even. ``index`` numbers the whole report in (ISIN, Date) order before
    the ``Date >= arg_date`` filter, so the day before the run date (read
    only for its close) is dropped but still counted.
    """
    clean = drop_missing(bars, subset)
    day = daily_ohlcv(clean, close_col=close_col, tiebreak=tiebreak)
    if with_index:
        # One exchange for both the lag window and the index: a range split on
        # ISIN keeps each security (one row per day) in one partition, which
        # the window needs, and sorted by (ISIN, Date) inside partitions it is
        # already in index order.
        day = day.repartitionByRange("ISIN").sortWithinPartitions("ISIN", "Date")
    withprev = previous_close(day)
    rep = withprev.withColumn(CHANGE, pct_change("closing_price_eur", "prev_closing_price")) \
                  .drop("prev_closing_price")
    rep = round_numeric_columns(rep, decimals)
    if with_index:
        rep = index_ordered_partitions(materialize(rep), "index")
        rep = rep.select("index", *[F.col(f"`{c}`") for c in rep.columns if c != "index"])
    if arg_date is not None:
        rep = rep.filter(F.col("Date") >= F.lit(arg_date))
    if sort and with_index:
        # already range-partitioned on (ISIN, Date) and sorted inside each
        # partition by the index step (filter and broadcast join keep that),
        # so partition order is key order: no second range shuffle
        rep = rep.sortWithinPartitions("ISIN", "Date")
    elif sort:
        rep = rep.orderBy("ISIN", "Date")
    return rep


#: What a run keeps of a security for the next one.
LAST_CLOSE = ["ISIN", "Date", "closing_price_eur"]


def daily_report_step(bars: DataFrame, last_closes: DataFrame | None = None, close_col: str = "EndPrice",
                      subset: Sequence[str] | None | object = _ALL, tiebreak: str | None = None, decimals: int = 2) -> tuple[DataFrame, DataFrame]:
    """The daily report of some new days (D1 without ``index``), and the last closes to hand to the next step.

    ``bars`` are the new days' alone; ``last_closes`` (ISIN, Date,
    closing_price_eur) is what the step before returned: the previous close
    (W3) of a security's first new row is its last stored one, however many
    days lie between. No earlier bar and no earlier report row is read. A
    stored row on or after a new row's day is not before it and is not used
    for it.
    """
    day = daily_ohlcv(drop_missing(bars, subset), close_col=close_col, tiebreak=tiebreak).withColumn("_bq_new", F.lit(True))
    rows = day
    if last_closes is not None:
        kept = last_closes.select(*LAST_CLOSE).join(day.select("ISIN", "Date"), ["ISIN", "Date"], "left_anti")  # a day that is run again
        rows = day.unionByName(kept.withColumn("_bq_new", F.lit(False)), allowMissingColumns=True)
    rep = previous_close(rows).filter("_bq_new").drop("_bq_new").withColumn(CHANGE, pct_change("closing_price_eur", "prev_closing_price")).drop("prev_closing_price")
    last = rows.groupBy("ISIN").agg(F.max_by(F.struct("Date", "closing_price_eur"), "Date").alias("_bq_l")).select("ISIN", "_bq_l.Date", "_bq_l.closing_price_eur")
    return round_numeric_columns(rep, decimals), last


def morning_report(bars: DataFrame, lo: str = MORNING_OPEN, hi: str = MORNING_CLOSE,
                   rate: float = EUR_TO_MXN, subset: Sequence[str] | None | object = _ALL,
                   tiebreak: str | None = None, sort: bool = False) -> DataFrame:
    """Morning report per (ISIN, Date).

    Open/close of the whole day, low/high/volume of the bars strictly
    between ``lo`` and ``hi``, the close converted at ``rate``, and the
    sample standard deviation of (open, close). One aggregate, one shuffle
    With ``sort`` the rows come in (ISIN, Date) order, as the reference's
    grouping produces them; it costs a range shuffle of the (small) report,
    which Spark keeps even below order-sensitive aggregates, so it is off
    unless the report itself is the output.
    """
    clean = drop_missing(bars, subset)
    m = morning_ohlcv(clean, lo, hi, tiebreak)
    out = m.select(
        "ISIN", "Date", "start_price", "end_price", "minimum_price", "maximum_price",
        "daily_traded_volume",
        convert_currency("end_price", rate).alias("end_price_mx"),
        row_stddev("start_price", "end_price").alias("standard_deviation"))
    return out.orderBy("ISIN", "Date") if sort else out
