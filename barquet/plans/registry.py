"""Named queries over the driver's tables, each with its DuckDB oracle.

Every query reads the given parquet tables through the fixture views, so
its work grows with the tables. ``ORACLES`` holds, per query name, DuckDB
SQL computing the same rows from the same tables (fixture views inlined as
CTEs); a query with no SQL form has no entry there.

Model outputs that are sums of floating products are rounded half to even on
both sides (coefficients to 6 decimals, prices to 2), so that summation order
cannot flip a comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barquet.sources import fixtures as fx
from barquet.plans import reports

QueryFn = Callable[[SparkSession, str], DataFrame]

RUN_DATE = "2024-01-10"

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _w(*views: str) -> str:
    """WITH clause for the fixture views, ready for more CTEs after a comma."""
    return fx.duckdb_with(*views)


_NOT_NULL_BARS = ("ISIN is not null and Date is not null and Time is not null and StartPrice is not null "
                  "and EndPrice is not null and MinPrice is not null and MaxPrice is not null "
                  "and TradedVolume is not null")


def _r2(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


def _daily_sql(view: str, close: str = "EndPrice", index: bool = True, arg_date: str | None = RUN_DATE,
               since: str | None = None) -> str:
    idx = 'row_number() over (order by ISIN, Date) - 1 as "index", ' if index else ""
    where = f"where Date >= '{arg_date}'" if arg_date else ""
    extracted = f" and Date >= '{since}'" if since else ""
    return _w(view) + f""", c as (select * from {view} where {_NOT_NULL_BARS}{extracted}),
d as (select ISIN, Date, arg_min(StartPrice, Time) as o, arg_max({close}, Time) as cl,
      min(MinPrice) as mn, max(MaxPrice) as mx, cast(sum(TradedVolume) as bigint) as vol
      from c group by ISIN, Date),
l as (select *, lag(cl) over (partition by ISIN order by Date) as prev from d),
r as (select {idx}ISIN, Date, {_r2('o')} as opening_price_eur, {_r2('cl')} as closing_price_eur,
      {_r2('mn')} as minimum_price_eur, {_r2('mx')} as maximum_price_eur, vol as daily_traded_volume,
      {_r2('(cl - prev) / nullif(prev, 0) * 100')} as "change_prev_closing_%" from l)
select * from r {where}"""


@register("d1_daily_report", _daily_sql("trades"))
def d1_daily_report(spark: SparkSession, sf: str) -> DataFrame:
    """Daily report of the run date and later on the five-security bars, with the row index."""
    return reports.daily_report(fx.trades(spark, sf), arg_date=RUN_DATE)


@register("d1_daily_report_wide", _daily_sql("trades_wide"))
def d1_daily_report_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Daily report over many securities with few bars each."""
    return reports.daily_report(fx.trades_wide(spark, sf), arg_date=RUN_DATE)


@register("d1_daily_report_dirty", _daily_sql("trades_dirty"))
def d1_daily_report_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Daily report on bars with missing keys and closes: those rows are dropped first."""
    return reports.daily_report(fx.trades_dirty(spark, sf), arg_date=RUN_DATE)


@register("w2b_daily_report_start_close", _daily_sql("trades", close="StartPrice", index=False, arg_date=None))
def w2b_daily_report_start_close(spark: SparkSession, sf: str) -> DataFrame:
    """The early variant: close = last StartPrice of the day, no index, no date filter."""
    return reports.daily_report(fx.trades(spark, sf), arg_date=None, close_col="StartPrice", with_index=False)


def _morning_sql(view: str, extra_where: str = "") -> str:
    m = "(start_price + end_price) / 2"
    return _w(view) + f""", c as (select * from {view} where {_NOT_NULL_BARS}),
oc as (select ISIN, Date, arg_min(StartPrice, Time) as start_price, arg_max(EndPrice, Time) as end_price
       from c group by ISIN, Date),
w as (select ISIN, Date, min(MinPrice) as minimum_price, max(MaxPrice) as maximum_price,
      cast(sum(TradedVolume) as bigint) as daily_traded_volume
      from c where Time > '08:00' and Time < '12:00' group by ISIN, Date),
morning as (select w.ISIN, w.Date, start_price, end_price, minimum_price, maximum_price, daily_traded_volume,
      end_price * 19.08 as end_price_mx,
      sqrt(((start_price - {m}) * (start_price - {m}) + (end_price - {m}) * (end_price - {m})) / 1)
        as standard_deviation
      from w join oc on w.ISIN = oc.ISIN and w.Date = oc.Date)"""


@register("d2_morning_report", _morning_sql("trades") + " select * from morning")
def d2_morning_report(spark: SparkSession, sf: str) -> DataFrame:
    """Morning report in key order."""
    return reports.morning_report(fx.trades(spark, sf), sort=True)


@register("d2_morning_report_wide", _morning_sql("trades_wide") + " select * from morning")
def d2_morning_report_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Morning report over many securities; days without a morning bar vanish."""
    return reports.morning_report(fx.trades_wide(spark, sf), sort=True)


@register("d2_morning_report_dirty", _morning_sql("trades_dirty") + " select * from morning")
def d2_morning_report_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Morning report on bars with missing values."""
    return reports.morning_report(fx.trades_dirty(spark, sf), sort=True)


@register("a3_max_end_price", _morning_sql("trades") + " select max(end_price) as max_end_price from morning")
def a3_max_end_price(spark: SparkSession, sf: str) -> DataFrame:
    """Largest morning close (A3)."""
    from barquet.operators.bars import global_max
    return global_max(reports.morning_report(fx.trades(spark, sf)), "end_price", "max_end_price")


_EXPLORE_SQL = """ select count(*) as n_rows, 8 as n_columns,
  cast(count(distinct ISIN) + coalesce(max(cast(ISIN is null as int)), 0) as bigint) as n_securities,
  (select count(*) from (select distinct ISIN, Date from {v} where ISIN is not null and Date is not null))
    as n_groups
  from {v}"""


@register("d8_explore", _w("trades") + _EXPLORE_SQL.format(v="trades"))
def d8_explore(spark: SparkSession, sf: str) -> DataFrame:
    """Row, column, security and group counts of the bars."""
    from barquet.operators.bars import explore
    return explore(fx.trades(spark, sf))


@register("d8_explore_dirty", _w("trades_dirty") + _EXPLORE_SQL.format(v="trades_dirty"))
def d8_explore_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Counts with missing keys: a missing ISIN is one more distinct value, but no group."""
    from barquet.operators.bars import explore
    return explore(fx.trades_dirty(spark, sf))


@register("d8_explore_groups_with_missing", _w("trades_dirty") + """ select count(*) as n_rows, 8 as n_columns,
  cast(count(distinct ISIN) + coalesce(max(cast(ISIN is null as int)), 0) as bigint) as n_securities,
  (select count(*) from (select distinct ISIN, Date from trades_dirty)) as n_groups
  from trades_dirty""")
def d8_explore_groups_with_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Counts with key combinations that have a missing value counted as groups, as pandas' len(groupby) does."""
    from barquet.operators.bars import explore
    return explore(fx.trades_dirty(spark, sf), groups_with_missing=True)


@register("d8_explore_approx")
def d8_explore_approx(spark: SparkSession, sf: str) -> DataFrame:
    """Exploration counts with HyperLogLog++ sketches for the distinct figures (A5, A6 at scale)."""
    from barquet.operators.bars import explore
    return explore(fx.trades_dirty(spark, sf), approximate=True)


@register("w1_w2_attach_open_close", _w("trades") + """ select *,
  first_value(StartPrice) over (partition by ISIN, Date order by Time
    rows between unbounded preceding and unbounded following) as opening_price,
  last_value(EndPrice) over (partition by ISIN, Date order by Time
    rows between unbounded preceding and unbounded following) as closing_price
  from trades""")
def w1_w2_attach_open_close(spark: SparkSession, sf: str) -> DataFrame:
    """Every bar with its day's first open and last close."""
    from barquet.operators.bars import attach_open_close
    return attach_open_close(fx.trades(spark, sf))


@register("w3_prev_close", _w("trades") + """ select ISIN, Date, arg_max(EndPrice, Time) as closing_price_eur,
  lag(arg_max(EndPrice, Time)) over (partition by ISIN order by Date) as prev_closing_price
  from trades group by ISIN, Date""")
def w3_prev_close(spark: SparkSession, sf: str) -> DataFrame:
    """Each day's close with the security's previous close."""
    from barquet.operators.bars import daily_ohlcv
    day = daily_ohlcv(fx.trades(spark, sf)).select("ISIN", "Date", "closing_price_eur")
    return reports.previous_close(day)


@register("p1_p2_clean_bars", _w("trades_dirty") + f""" select ISIN, Date, Time, EndPrice from trades_dirty
  where {_NOT_NULL_BARS}""")
def p1_p2_clean_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Projection and missing-value cleaning of the dirty bars."""
    from barquet.operators.bars import drop_missing, select_columns
    return select_columns(drop_missing(fx.trades_dirty(spark, sf)), ["ISIN", "Date", "Time", "EndPrice"])


@register("p3_key_equals", _w("trades") + " select * from trades where ISIN = 'click'")
def p3_key_equals(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of one security."""
    from pyspark.sql import functions as F
    return fx.trades(spark, sf).filter(F.col("ISIN") == "click")


@register("p4_key_in_list", _w("trades") + " select * from trades where ISIN in ('click', 'view', 'error')")
def p4_key_in_list(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of a list of securities."""
    from pyspark.sql import functions as F
    return fx.trades(spark, sf).filter(F.col("ISIN").isin("click", "view", "error"))


@register("p5_morning_bars", _w("trades") + " select * from trades where Time > '08:00' and Time < '12:00'")
def p5_morning_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars strictly between 08:00 and 12:00 (P5)."""
    from barquet.functions.columns import time_between_exclusive
    return fx.trades(spark, sf).filter(time_between_exclusive("Time"))


@register("p6_after_open", _w("trades") + " select * from trades where Time > '08:00'")
def p6_after_open(spark: SparkSession, sf: str) -> DataFrame:
    """Bars after 08:00."""
    from barquet.functions.columns import time_after
    return fx.trades(spark, sf).filter(time_after("Time"))


@register("p8_report_of_previous_day", _morning_sql("trades")
          + f" select * from morning where Date = strftime(date '{RUN_DATE}' - interval 1 day, '%Y-%m-%d')")
def p8_report_of_previous_day(spark: SparkSession, sf: str) -> DataFrame:
    """Morning report rows of the run date minus one day."""
    from pyspark.sql import functions as F
    from barquet.functions.columns import previous_day
    day = F.date_format(previous_day(F.lit(RUN_DATE)), "yyyy-MM-dd")
    return reports.morning_report(fx.trades(spark, sf, "2024-01-09", "2024-01-09")).filter(F.col("Date") == day)


@register("p9_report_date_range", _morning_sql("trades")
          + " select * from morning where Date >= '2024-01-05' and Date <= '2024-01-12'")
def p9_report_date_range(spark: SparkSession, sf: str) -> DataFrame:
    """Morning report rows in a closed date range."""
    from pyspark.sql import functions as F
    return reports.morning_report(fx.trades(spark, sf, "2024-01-05", "2024-01-12")).filter(F.col("Date").between("2024-01-05", "2024-01-12"))


@register("f6_next_days", _w("trades") + """, f as (select ISIN, min(Date) as d0 from trades group by ISIN),
  g as (select ISIN, unnest(generate_series(cast(d0 as date), cast(d0 as date) + interval 2 day,
    interval 1 day)) as d from f)
  select ISIN, strftime(cast(d as date), '%Y-%m-%d') as Date from g""")
def f6_next_days(spark: SparkSession, sf: str) -> DataFrame:
    """Three consecutive dates from each security's first trading day."""
    from pyspark.sql import functions as F
    from barquet.functions.columns import date_sequence
    # min of a parsed date (fixed-width buffer, hash aggregate) rather than of the text
    first = fx.trades(spark, sf).groupBy("ISIN").agg(F.min(F.to_date("Date")).alias("d0"))
    days = first.select("ISIN", F.explode(date_sequence("d0", 3)).alias("d"))
    return days.select("ISIN", F.date_format("d", "yyyy-MM-dd").alias("Date"))


@register("f7_price_labels", _morning_sql("trades")
          + " select ISIN, Date, printf('%.2f', round_even(end_price * 100, 0) / 100) as label from morning")
def f7_price_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Two-decimal labels of the morning closes."""
    from barquet.functions.columns import two_decimal_label
    return reports.morning_report(fx.trades(spark, sf)).select("ISIN", "Date", two_decimal_label("end_price").alias("label"))


@register("o4_first_ten_bars", _w("trades") + " select * from trades order by ISIN, Date, Time limit 10")
def o4_first_ten_bars(spark: SparkSession, sf: str) -> DataFrame:
    """First ten bars in key order."""
    from barquet.operators.ordering import head
    return head(fx.trades(spark, sf), ["ISIN", "Date", "Time"], 10)


# --- series and models -------------------------------------------------------

def _round(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    from barquet.functions.columns import round_half_even
    from pyspark.sql import functions as F
    return df.select(*[round_half_even(F.col(c), digits[c]).alias(c) if c in digits else F.col(c)
                       for c in df.columns])


def _re(x: str, d: int) -> str:
    scale = repr(float(10.0 ** d))
    return f"round_even(({x}) * {scale}, 0) / {scale}"


@register("w5_lead7_pairs", _morning_sql("trades") + """ select ISIN, Date, end_price,
  lead(end_price, 7) over (partition by ISIN order by Date) as target from morning qualify target is not null""")
def w5_lead7_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each morning close with the close seven report rows later."""
    from barquet.operators.series import lead_pairs
    m = reports.morning_report(fx.trades(spark, sf)).select("ISIN", "Date", "end_price")
    return lead_pairs(m, "ISIN", "Date", "end_price", 7)


@register("w7_chrono_split", _w("closes") + """, n as (select series_id, count(*) as n,
  cast(floor(count(*) * 0.8) as bigint) as cut from closes group by series_id)
  select c.series_id, c.idx, c.Close, case when idx < cut then 'train' else 'test' end as split,
    case when idx < cut then 0 else cut end as split_start,
    case when idx < cut then cut else n - cut end as split_len
  from closes c join n on c.series_id = n.series_id""")
def w7_chrono_split(spark: SparkSession, sf: str) -> DataFrame:
    """80/20 chronological split of each close series."""
    from barquet.operators.series import chrono_split
    return chrono_split(fx.closes(spark, sf), "series_id", "idx", 0.8)


_SCALED = """, mm as (select series_id, min(Close) as scale_min,
  coalesce(nullif(max(Close) - min(Close), 0), 1.0) as scale_range from closes group by series_id),
  sc as (select c.series_id, c.idx, c.Close, (c.Close - scale_min) / scale_range as v, scale_min, scale_range
  from closes c join mm on c.series_id = mm.series_id)"""


@register("m2_minmax_scale", _w("closes") + _SCALED + """ select series_id, idx, Close, v as Close_scaled,
  v * scale_range + scale_min as Close_restored from sc""")
def m2_minmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Per-series min-max scaling and its inverse (M2)."""
    from barquet.operators.series import minmax_inverse, minmax_scale
    s = minmax_scale(fx.closes(spark, sf), "series_id", "Close", name="Close_scaled")
    return s.select("series_id", "idx", "Close", "Close_scaled", minmax_inverse("Close_scaled").alias("Close_restored"))


_LAGS = ", ".join(f"lag(v, {k}) over w as f{10 - k}" for k in range(10, 0, -1))


@register("w6_lag_windows", _w("closes") + _SCALED + f""", n as (select series_id, count(*) as n,
  cast(floor(count(*) * 0.8) as bigint) as cut from closes group by series_id),
  p as (select sc.*, case when idx < cut then 'train' else 'test' end as split,
    case when idx < cut then 0 else cut end as st, case when idx < cut then cut else n - cut end as len
    from sc join n on sc.series_id = n.series_id),
  l as (select series_id, idx, split, st, len, v, {_LAGS} from p
    window w as (partition by series_id, split order by idx))
  select series_id, idx, split, {", ".join(f"f{i}" for i in range(10))}, v as target from l
  where idx - st >= 10 and idx - st <= len - 2""")
def w6_lag_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Ten-step lag windows inside each chronological part of the scaled series."""
    from pyspark.sql import functions as F
    from barquet.operators.series import lag_windows, minmax_scale
    s = minmax_scale(fx.closes(spark, sf), "series_id", "Close", name="v")
    w = lag_windows(s, "series_id", "idx", "v", time_step=10, frac=0.8)
    return w.select("series_id", "idx", "split", *[F.col("features")[i].alias(f"f{i}") for i in range(10)], "target")


@register("w8_last_ten", _w("closes") + """ select series_id, idx, Close from closes
  qualify row_number() over (partition by series_id order by idx desc) <= 10""")
def w8_last_ten(spark: SparkSession, sf: str) -> DataFrame:
    """Last ten positions of each series."""
    from barquet.operators.ordering import last_k_per_key
    return last_k_per_key(fx.closes(spark, sf), ["series_id"], "idx", 10)


def _ols_sql(src: str, by: str | None) -> str:
    g = f"{by}, " if by else ""
    gb = f"group by {by}" if by else ""
    return f""" select {g}
  {_re("case when var_pop(start_price) = 0 then 0.0 else regr_slope(end_price, start_price) end", 6)} as slope,
  {_re("case when var_pop(start_price) = 0 then avg(end_price) else regr_intercept(end_price, start_price) end", 6)}
    as intercept,
  {_re('''case when count(*) < 2 then null when var_pop(start_price) = 0 then
      (case when var_pop(end_price) = 0 then 1.0 else 0.0 end) else regr_r2(end_price, start_price) end''', 6)} as r2,
  cast(regr_count(end_price, start_price) as bigint) as n from {src} {gb}"""


_M6 = {"slope": 6, "intercept": 6, "r2": 6}


@register("m1_open_close_ols", _morning_sql("trades_wide") + _ols_sql("morning", "Date"))
def m1_open_close_ols(spark: SparkSession, sf: str) -> DataFrame:
    """OLS of morning close on open across securities, one model per day (M1)."""
    from barquet.operators.regression import ols_fit
    m = reports.morning_report(fx.trades_wide(spark, sf))
    return _round(ols_fit(m, "end_price", "start_price", by="Date"), _M6)


@register("m1_fitted_values", _morning_sql("trades_wide") + """, f as (select Date,
  case when var_pop(start_price) = 0 then 0.0 else regr_slope(end_price, start_price) end as s,
  case when var_pop(start_price) = 0 then avg(end_price) else regr_intercept(end_price, start_price) end as i
  from morning group by Date)
  select m.ISIN, m.Date, m.start_price, m.end_price, """ + _re("s * m.start_price + i", 6) + """ as prediction
  from morning m join f on m.Date = f.Date""")
def m1_fitted_values(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted closes from each day's model (M1)."""
    from barquet.operators.regression import ols_fit, ols_predict
    m = reports.morning_report(fx.trades_wide(spark, sf)).select("ISIN", "Date", "start_price", "end_price")
    fit = ols_fit(m, "end_price", "start_price", by="Date")
    return _round(ols_predict(m, fit, "start_price", by="Date"), {"prediction": 6})


@register("d5_fit_open_close_day", _morning_sql("trades_wide")
          + ", one as (select * from morning where Date = '2024-01-09')" + _ols_sql("one", None))
def d5_fit_open_close_day(spark: SparkSession, sf: str) -> DataFrame:
    """One-day open-to-close regression."""
    from barquet.plans.models import fit_open_close
    return _round(fit_open_close(reports.morning_report(fx.trades_wide(spark, sf, "2024-01-09", "2024-01-09")), "2024-01-09"), _M6)


@register("d5_fit_open_close_range", _morning_sql("trades_wide")
          + ", rng as (select * from morning where Date >= '2024-01-08' and Date <= '2024-01-10')"
          + _ols_sql("rng", None))
def d5_fit_open_close_range(spark: SparkSession, sf: str) -> DataFrame:
    """Open-to-close regression over a date range."""
    from barquet.plans.models import fit_open_close
    return _round(fit_open_close(reports.morning_report(fx.trades_wide(spark, sf, "2024-01-08", "2024-01-10")), "2024-01-08", "2024-01-10"), _M6)


_LINREG_SQL = _w("trades") + """, tw as (select * from trades where Date >= '{a}' and Date <= '{b}'),
  g as (select ISIN, regr_slope(EndPrice, StartPrice) as slope, regr_intercept(EndPrice, StartPrice) as intercept,
    least(greatest(corr(StartPrice, EndPrice), -1.0), 1.0) as r,
    cast(regr_count(EndPrice, StartPrice) as bigint) as n,
    var_pop(StartPrice) as vx, var_pop(EndPrice) as vy, avg(StartPrice) as mx from tw group by ISIN),
  lr as (select ISIN, slope, intercept, r, sqrt((1 - r * r) * vy / (vx * (n - 2))) as stderr,
    sqrt((1 - r * r) * vy / (vx * (n - 2))) * sqrt(vx + mx * mx) as intercept_stderr, n from g)"""

_LR_DIG = {"slope": 6, "intercept": 4, "r": 6, "stderr": 6, "intercept_stderr": 4}

_LINREG_GLOBAL_SQL = _w("trades") + """, tw as (select * from trades where Date >= '{a}' and Date <= '{b}'),
  lr as (select regr_slope(EndPrice, StartPrice) as slope, regr_intercept(EndPrice, StartPrice) as intercept
    from tw)"""


@register("m1b_linregress", _LINREG_SQL.format(a="2024-01-08", b="2024-01-10") + " select ISIN, "
          + ", ".join(f"{_re(c, d)} as {c}" for c, d in _LR_DIG.items()) + ", n from lr")
def m1b_linregress(spark: SparkSession, sf: str) -> DataFrame:
    """Slope, intercept, r and standard errors of close on open per security."""
    from pyspark.sql import functions as F
    from barquet.operators.regression import linregress
    t = fx.trades(spark, sf, "2024-01-08", "2024-01-10").filter(F.col("Date").between("2024-01-08", "2024-01-10"))
    return _round(linregress(t, "EndPrice", "StartPrice", by="ISIN", p_value=False), _LR_DIG)


@register("m1b_p_value")
def m1b_p_value(spark: SparkSession, sf: str) -> DataFrame:
    """Same fits with the two-sided p value of the slope (no SQL form for Student's t)."""
    from pyspark.sql import functions as F
    from barquet.operators.regression import linregress
    t = fx.trades(spark, sf, "2024-01-08", "2024-01-10").filter(F.col("Date").between("2024-01-08", "2024-01-10"))
    return linregress(t, "EndPrice", "StartPrice", by="ISIN", p_value=True)


@register("m1c_next_days_forecast", _LINREG_SQL.format(a="2024-01-29", b="2024-01-31") + """,
  days as (select ISIN, strftime(cast(unnest(generate_series(date '2024-01-29', date '2024-01-31',
    interval 1 day)) as date), '%Y-%m-%d') as Date from lr),
  firsts as (select ISIN, Date, arg_min(StartPrice, Time) as first_StartPrice from trades
    where StartPrice is not null and Date >= '2024-01-29' and Date <= '2024-01-31' group by ISIN, Date)
  select d.ISIN, d.Date, f.first_StartPrice,
    """ + _re("lr.slope * f.first_StartPrice + lr.intercept", 6) + """ as predicted_EndPrice
  from days d left join firsts f on d.ISIN = f.ISIN and d.Date = f.Date join lr on d.ISIN = lr.ISIN""")
def m1c_next_days_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Per security, three dates scored from each day's first open; no data gives NULL."""
    from pyspark.sql import functions as F
    from barquet.operators.regression import linregress, predict_days_ahead
    t = fx.trades(spark, sf, "2024-01-29", "2024-01-31")
    win = t.filter(F.col("Date").between("2024-01-29", "2024-01-31"))
    model = linregress(win, "EndPrice", "StartPrice", by="ISIN", p_value=False)
    out = predict_days_ahead(t, model, "2024-01-29", 3, by="ISIN")
    return _round(out.select("ISIN", "Date", "first_StartPrice", "predicted_EndPrice"), {"predicted_EndPrice": 6})


_AR1 = """, l as (select series_id, idx, Close, lag(Close) over (partition by series_id order by idx) as y1
  from closes),
  f as (select series_id, regr_slope(Close, y1) as phi, regr_intercept(Close, y1) as c,
    arg_max(Close, idx) as yn, cast(max(idx) as bigint) as last_idx from l group by series_id)"""


@register("m6b_ar1_forecast", _w("closes") + _AR1 + """, s as (select f.*, unnest(generate_series(1, 100)) as step
  from f)
  select series_id, cast(step as bigint) as step, last_idx + step as idx,
    case when abs(phi) < 1 then """ + _re("c / (1 - phi) + pow(phi, step) * (yn - c / (1 - phi))", 2)
          + """ end as forecast from s""")
def m6b_ar1_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """100-step AR(1) forecasts per close series."""
    from barquet.operators.forecast import ar1_forecast
    return _round(ar1_forecast(fx.closes(spark, sf), "series_id", "idx", "Close", steps=100), {"forecast": 2})


_LISTED = ("click", "purchase", "view")


@register("m6b_ar1_of_listed_securities", "with rep as (" + _daily_sql("trades", index=False, arg_date=None) + "), closes as (select ISIN as series_id, "
          "row_number() over (partition by ISIN order by Date) - 1 as idx, closing_price_eur as Close from rep where ISIN in " + str(_LISTED) + ")"
          + _AR1 + """, s as (select f.*, unnest(generate_series(1, 100)) as step from f)
  select series_id as ISIN, cast(step as bigint) as step, last_idx + step as idx,
    case when abs(phi) < 1 then """ + _re("c / (1 - phi) + pow(phi, step) * (yn - c / (1 - phi))", 4) + " end as forecast from s")
def m6b_ar1_of_listed_securities(spark: SparkSession, sf: str) -> DataFrame:
    """100-step AR(1) forecasts of the report closes of the securities in a list."""
    from pyspark.sql import functions as F
    from barquet.operators.forecast import ar1_forecast
    from barquet.operators.mlmodels import series_positions
    bars = fx.trades(spark, sf).filter(F.col("ISIN").isin(*_LISTED))
    report = reports.daily_report(bars, with_index=False, sort=False)
    series = series_positions(report.select("ISIN", "Date", "closing_price_eur"), "ISIN", "Date")
    return _round(ar1_forecast(series, "ISIN", "idx", "closing_price_eur", steps=100), {"forecast": 4})


@register("a7_a8_ar1_errors", _w("closes") + _AR1 + """, n as (select series_id, count(*) as n,
  cast(floor(count(*) * 0.8) as bigint) as cut from closes group by series_id),
  p as (select l.series_id, case when idx < cut then 'train' else 'test' end as split,
    (Close - (c + phi * y1)) as d from l join f on l.series_id = f.series_id join n on l.series_id = n.series_id
    where y1 is not null)
  select series_id, split, """ + _re("sqrt(avg(d * d))", 2) + " as rmse, " + _re("avg(d * d)", -2)
          + """ as mse from p group by series_id, split""")
def a7_a8_ar1_errors(spark: SparkSession, sf: str) -> DataFrame:
    """RMSE and MSE of one-step AR(1) predictions per series and part."""
    from barquet.operators.forecast import ar1_fitted
    from barquet.operators.metrics import errors_by
    from barquet.operators.series import chrono_split
    fitted = ar1_fitted(fx.closes(spark, sf), "series_id", "idx", "Close")
    parts = chrono_split(fitted, "series_id", "idx", 0.8)
    return _round(errors_by(parts, "Close", "prediction", ["series_id", "split"]), {"rmse": 2, "mse": -2})


@register("m8_actual_and_forecast", _w("closes") + _AR1 + """, s as (select f.*, unnest(generate_series(1, 7))
  as step from f),
  fc as (select series_id, last_idx + step as idx, 'forecast' as kind,
    case when abs(phi) < 1 then """ + _re("c / (1 - phi) + pow(phi, step) * (yn - c / (1 - phi))", 2)
          + """ end as value from s),
  u as (select series_id, cast(idx as bigint) as idx, 'actual' as kind, Close as value from closes
    union all select * from fc)
  select series_id, idx, kind, value, printf('%.2f', """ + _re("value", 2) + """) as label from u""")
def m8_actual_and_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Actual closes followed by AR(1) forecasts with labels."""
    from barquet.operators.charts import actual_and_forecast
    from barquet.operators.forecast import ar1_forecast
    c = fx.closes(spark, sf)
    fc = _round(ar1_forecast(c, "series_id", "idx", "Close", steps=7), {"forecast": 2})
    return actual_and_forecast(c, fc, "series_id", "idx", "Close", "forecast")


@register("m6_arma11_forecast")
def m6_arma11_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """ARMA(1,1) forecasts, days = 7 (8 steps) per series of the smooth closes."""
    from barquet.operators.forecast import arma11_forecast
    return arma11_forecast(fx.closes_smooth(spark, sf), "series_id", "idx", "Close", days=7)


@register("m6_arma11_forecast_css")
def m6_arma11_forecast_css(spark: SparkSession, sf: str) -> DataFrame:
    """ARMA(1,1) forecasts (days = 7) after 5 conditional-sum-of-squares Gauss-Newton steps."""
    from barquet.operators.forecast import arma11_forecast
    return arma11_forecast(fx.closes_smooth(spark, sf), "series_id", "idx", "Close", days=7, css_iterations=5)


@register("m7_one_class_flags")
def m7_one_class_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every close with its one-class score and anomaly flag (nu = 0.05)."""
    from barquet.operators.anomaly import one_class_flags
    return one_class_flags(fx.closes(spark, sf), "series_id", "Close", nu=0.05)


@register("m7_one_class_certificate", _w("closes") + """ select series_id, count(*) as n, true as share_ok, true as support_ok,
  true as weights_ok, true as bounds_ok from closes group by series_id""")
def m7_one_class_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """Optimality of the one-class fit per series (M7): at most nu * n rows are flagged, flagged and boundary rows
    reach nu * n, the weights sum to nu * n, and rows off the support do not score below 0 (an optimum is what meets them all)."""
    from pyspark.sql import functions as F
    from barquet.operators.anomaly import one_class_fit, one_class_score
    nu, c = 0.05, fx.closes(spark, sf)
    model = one_class_fit(c, "series_id", "Close", nu)
    rows = one_class_score(c, model, "series_id", "Close")
    tiny = F.lit(1e-5) * F.col("rho")
    r = rows.join(model.select("series_id", "rho", "support_values", "support_weights", "support_cells", "n"), "series_id")
    x = F.col("Close").cast("double")
    held = F.array_contains("support_values", x) | F.exists("support_cells", lambda c: x.between(c["lo"], c["hi"]))
    weights = F.concat("support_weights", F.transform("support_cells", lambda c: c["weight"]))
    per = r.groupBy("series_id").agg(
        F.max("n").alias("n"), F.sum(F.col("is_anomaly").cast("int")).alias("flagged"),
        F.sum((F.col("score") <= tiny).cast("int")).alias("low"),
        F.max(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)).alias("total"),
        F.min(F.when(~held, F.col("score") / F.col("rho"))).alias("off"))
    return per.select("series_id", "n", (F.col("flagged") <= nu * F.col("n")).alias("share_ok"), (F.col("low") >= nu * F.col("n")).alias("support_ok"),
                      (F.abs(F.col("total") - nu * F.col("n")) < 1e-4).alias("weights_ok"), (F.coalesce("off", F.lit(0.0)) > -1e-5).alias("bounds_ok"))


@register("d6_analyze_series_chart")
def d6_analyze_series_chart(spark: SparkSession, sf: str) -> DataFrame:
    """Actual closes followed by the ARMA(1,1) forecast of the series job."""
    from barquet.plans.analytics import analyze_series
    return analyze_series(fx.closes_smooth(spark, sf), days=5, nu=0.05)["chart"]


@register("d6_analyze_series_anomalies")
def d6_analyze_series_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Positions and prices the series job flags."""
    from barquet.plans.analytics import analyze_series
    return analyze_series(fx.closes_smooth(spark, sf), days=5, nu=0.05)["anomalies"]


@register("m3_multi_feature_ols")
def m3_multi_feature_ols(spark: SparkSession, sf: str) -> DataFrame:
    """end_price on start, minimum, maximum and volume of the morning report (MLlib, normal equations)."""
    from barquet.operators.mlmodels import multi_feature_regression
    m = reports.morning_report(fx.trades_wide(spark, sf))
    _, summary, _ = multi_feature_regression(
        m, "end_price", ["start_price", "minimum_price", "maximum_price", "daily_traded_volume"])
    return summary


def _lag_model_sql(series: str, step: int = 10) -> str:
    """CTEs of the lag-window model over rows (k, idx, v) of ``series``: st (per-key numbers), sc (scaled), win (windows), coef (intercept, then oldest to newest lag).

    The normal equations of all training windows are solved by Gauss-Jordan steps on a list of rows.
    """
    lags = ", ".join(f"lag(x, {step + 1 - i}) over o as l{i}" for i in range(1, step + 1))
    z = ["1.0", *[f"l{i}" for i in range(1, step + 1)], "t"]
    rows = ", ".join("[" + ", ".join(f"sum({z[i]} * {z[j]})" for j in range(step + 2)) + "]" for i in range(step + 1))
    return f"""ls as ({series}),
  st as (select k, count(*) as n, max(idx) as last, min(v) as lo, coalesce(nullif(max(v) - min(v), 0), 1.0) as rng, cast(floor(count(*) * 0.8) as bigint) as cut from ls group by k),
  sc as (select ls.k, ls.idx, (ls.v - st.lo) / st.rng as x, case when ls.idx < cut then 'train' else 'test' end as split, case when ls.idx < cut then 0 else cut end as s0,
    case when ls.idx < cut then cut else n - cut end as len from ls join st on ls.k = st.k),
  lw as (select k, split, x as t, {lags}, idx - s0 as rel, len from sc window o as (partition by k order by idx)),
  win as (select * from lw where rel >= {step} and rel <= len - 2),
  gj(p, m) as (select 1, [{rows}] from win where split = 'train'
    union all select p + 1, list_transform(m, lambda r, i: case when i = p then list_transform(r, lambda x: x / m[p][p])
      else list_transform(r, lambda x, j: x - r[p] / m[p][p] * m[p][j]) end) from gj where p <= {step + 1}),
  coef as (select list_transform(m, lambda r: r[{step + 2}]) as b from gj where p = {step + 2})"""


def _recursive(sql: str) -> str:
    return "with recursive " + sql.removeprefix("with ")


_LAG_FIT = " + ".join(["b[1]", *[f"b[{i + 1}] * l{i}" for i in range(1, 11)]])


@register("d7_lag_forecast", _recursive(_morning_sql("trades")) + ", " + _lag_model_sql("select ISIN as k, row_number() over (partition by ISIN order by Date) - 1 as idx, end_price as v from morning where end_price is not null") + """,
  f(k, step, l) as (select k, 0, list(x order by idx) from (select sc.*, st.last from sc join st on sc.k = st.k) where idx > last - 10 group by k
    union all select k, step + 1, list_append(l[2:], b[1] + list_sum(list_transform(list_zip(l, b[2:]), lambda z: z[1] * z[2]))) from f, coef where step < 7)
  select f.k as ISIN, cast(step as bigint) as step, last + step as idx, """ + _re("l[10] * rng + lo", 4) + " as forecast from f join st on f.k = st.k where step > 0")
def d7_lag_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """7-step lag-window forecast of every security's morning close (time_step 10)."""
    from barquet.plans.analytics import report_lag_forecast
    fc, _ = report_lag_forecast(reports.morning_report(fx.trades(spark, sf)), time_step=10, horizon=7)
    return _round(fc, {"forecast": 4})


@register("d7_lag_forecast_errors", _recursive(_w("closes_smooth")) + ", " + _lag_model_sql("select series_id as k, idx, Close as v from closes_smooth")
          + ", e as (select win.k, split, (" + _LAG_FIT + " - t) * rng as d from win join st on win.k = st.k, coef)\n"
          + "  select k as series_id, split, " + _re("sqrt(avg(d * d))", 2) + " as rmse, " + _re("avg(d * d)", -2) + " as mse from e group by k, split")
def d7_lag_forecast_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Train/test RMSE of the lag-window model on the smooth closes, per series."""
    from barquet.operators.mlmodels import lag_forecast
    _, err = lag_forecast(fx.closes_smooth(spark, sf), "series_id", "idx", "Close", 10, 7)
    return _round(err, {"rmse": 2, "mse": -2})


@register("m6_arma11_loglik", _w("closes_smooth") + """, l as (select series_id, count(*) as n,
    list(struct_pack(ay := Close, ao := 0.0::double, p := 0.0::double, yy := 0.0::double, yo := 0.0::double, oo := 0.0::double, lf := 0.0::double) order by idx) as l
    from closes_smooth group by series_id),
  e as (select series_id, n, list_reduce(list_concat([struct_pack(ay := 0.0::double, ao := 0.0::double, p := (0.7::double + 0.3) * (0.7::double + 0.3) / (1 - 0.7::double * 0.7), yy := 0.0::double,
      yo := 0.0::double, oo := 0.0::double, lf := 0.0::double)], l), lambda a, x: struct_pack(
      ay := 0.7::double * a.ay + (0.7::double * a.p + 1.0) / (1 + a.p) * (x.ay - a.ay), ao := 0.7::double * a.ao + (0.7::double * a.p + 1.0) / (1 + a.p) * (1 - a.ao),
      p := 0.09::double * a.p / (1 + a.p), yy := a.yy + (x.ay - a.ay) * (x.ay - a.ay) / (1 + a.p), yo := a.yo + (x.ay - a.ay) * (1 - a.ao) / (1 + a.p),
      oo := a.oo + (1 - a.ao) * (1 - a.ao) / (1 + a.p), lf := a.lf + ln(1 + a.p))) as e from l),
  f as (select series_id, n, e.yo / e.oo as m, (e.yy - e.yo / e.oo * e.yo) / n as s2, e.lf as lf, e.ay - e.yo / e.oo * e.ao as following from e)
  select series_id, cast(n as bigint) as n, """ + _re("m", 2) + " as mean, " + _re("sqrt(s2)", 2) + " as sigma, "
          + _re("-0.5 * (n * ln(2 * pi() * s2) + lf + n)", 4) + " as loglik, " + _re("following", 2) + " as next_centred from f")
def m6_arma11_loglik(spark: SparkSession, sf: str) -> DataFrame:
    """Exact ARMA(1,1) log likelihood of the smooth closes at phi = 0.7, theta = 0.3, with the best mean and variance, and the next value's prediction (M6)."""
    from pyspark.sql import functions as F
    from barquet.operators.arma import arma11_loglik
    fit = arma11_loglik(fx.closes_smooth(spark, sf), ["series_id"], "idx", "Close", 0.7, 0.3)
    return _round(fit.select("series_id", "n", "mean", F.sqrt("sigma2").alias("sigma"), "loglik", "next_centred"), {"mean": 2, "sigma": 2, "loglik": 4, "next_centred": 2})


@register("m6_arma11_forecast_likelihood")
def m6_arma11_forecast_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """ARMA(1,1) forecasts (days = 7) of the smooth closes from the exact maximum likelihood fit."""
    from barquet.operators.forecast import arma11_forecast
    return arma11_forecast(fx.closes_smooth(spark, sf), "series_id", "idx", "Close", days=7, method="likelihood")


@register("m5_sigmoid_unit", _recursive(_morning_sql("trades")) + """, p as (select ISIN, Date, end_price as x, lead(end_price, 7) over (partition by ISIN order by Date) as y from morning),
  q as (select * from p where y is not null),
  b as (select ISIN, min(x) as xl, coalesce(nullif(max(x) - min(x), 0), 1.0) as xr, min(y) as yl, coalesce(nullif(max(y) - min(y), 0), 1.0) as yr from q group by ISIN),
  d as (select list(struct_pack(x := (x - xl) / xr, y := (y - yl) / yr)) as d from q join b on q.ISIN = b.ISIN),
  newton(i, w) as (select 0, 0.0::double union all select i + 1,
    w + list_sum(list_transform(d, lambda p: (p.y - 1 / (1 + exp(-w * p.x))) * p.x)) / list_sum(list_transform(d, lambda p: p.x * p.x / (1 + exp(-w * p.x)) / (1 + exp(w * p.x))))
    from newton, d where i < 30)
  select r.ISIN, r.Date, r.x as end_price, """ + _re("1 / (1 + exp(-w * (r.x - xl) / xr)) * yr + yl", 2) + """ as predicted_later
  from (select *, row_number() over (partition by ISIN order by Date desc) as rn from p) r join b on r.ISIN = b.ISIN, newton where rn <= 7 and i = 30""")
def m5_sigmoid_unit(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled close 7 rows later from a one-unit logistic model, for each security's last 7 days."""
    from barquet.operators.mlmodels import sigmoid_unit
    m = reports.morning_report(fx.trades(spark, sf)).select("ISIN", "Date", "end_price")
    _, pred = sigmoid_unit(m, "ISIN", "Date", "end_price", 7)
    return _round(pred, {"predicted_later": 2})


# --- kept a day, merged over days ----------------------------------------------

def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written by day in the shared scratch folder and read back, as a run a day leaves it."""
    from barquet.session import work_dir
    path = work_dir(df.sparkSession, name)
    df.write.partitionBy("Date").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@register("d5_fit_from_day_moments", _morning_sql("trades_wide")
          + ", rng as (select * from morning where Date >= '2024-01-08' and Date <= '2024-01-19')"
          + _ols_sql("rng", None))
def d5_fit_from_day_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Open-to-close regression over a date range from moments stored a day: the fit reads one row a day, no bars."""
    from barquet.operators.daystats import day_moments, ols_between
    moments = _kept(day_moments(reports.morning_report(fx.trades_wide(spark, sf)), "end_price", "start_price"), "day_moments")
    return _round(ols_between(moments, "2024-01-08", "2024-01-19"), _M6)


@register("m1b_linregress_from_day_moments", _LINREG_SQL.format(a="2024-01-08", b="2024-01-19") + " select ISIN, "
          + ", ".join(f"{_re(c, d)} as {c}" for c, d in _LR_DIG.items()) + ", n from lr")
def m1b_linregress_from_day_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Close on open of the raw bars per security over a date range, from moments stored a day."""
    from barquet.operators.daystats import day_moments, linregress_between
    moments = _kept(day_moments(fx.trades(spark, sf), "EndPrice", "StartPrice", by="ISIN"), "day_moments")
    return _round(linregress_between(moments, "2024-01-08", "2024-01-19", by="ISIN"), _LR_DIG)


@register("d8_explore_from_day_sketches", _w("trades_wide") + """ select count(*) as n_rows, count(distinct ISIN) as n_securities, count(distinct row(ISIN, Date)) as n_groups,
  true as securities_ok, true as groups_ok from trades_wide where Date >= '2024-01-05' and Date <= '2024-01-20'""")
def d8_explore_from_day_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, securities and groups of a date range from sketches stored a day, held against the exact counts: within four standard errors."""
    from pyspark.sql import functions as F
    from barquet.operators.bars import explore
    from barquet.operators.daystats import day_sketches, explore_between
    t = fx.trades_wide(spark, sf)
    sketched = explore_between(_kept(day_sketches(t), "day_sketches"), "2024-01-05", "2024-01-20")
    exact = explore(t.filter(F.col("Date").between("2024-01-05", "2024-01-20")))
    near = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"e.{c}")) <= 0.033 * F.col(f"e.{c}") + 1
    both = exact.alias("e").join(F.broadcast(sketched).alias("a"), F.col("e.n_rows") == F.col("a.n_rows"))  # one row each; rows are counted exactly
    return both.select("e.n_rows", "e.n_securities", "e.n_groups", near("n_securities").alias("securities_ok"), near("n_groups").alias("groups_ok"))


@register("d1_daily_report_by_steps", _daily_sql("trades_wide", index=False))
def d1_daily_report_by_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The daily report run in three steps of days: each reads its own bars and one stored close a security."""
    from pyspark.sql import functions as F
    from barquet.session import materialize
    t = fx.trades_wide(spark, sf)
    middle = "2024-01-20"
    _, last = reports.daily_report_step(t.filter(F.col("Date") < RUN_DATE))
    one, last = reports.daily_report_step(t.filter((F.col("Date") >= RUN_DATE) & (F.col("Date") < middle)), materialize(last))
    two, _ = reports.daily_report_step(t.filter(F.col("Date") >= middle), materialize(last))
    return one.unionByName(two)


# --- files -------------------------------------------------------------------

def _landing(spark: SparkSession, sf: str) -> str:
    """The ``trades`` view written as a dated CSV tree in the shared scratch folder."""
    from barquet.session import work_dir
    from barquet.sources.files import write_dated_csv
    return write_dated_csv(fx.trades(spark, sf), work_dir(spark, "landing"))


_BAR_SELECT = ["ISIN", "Date", "Time", "StartPrice", "MaxPrice", "MinPrice", "EndPrice", "TradedVolume"]


@register("s1_s3_extract_dated_csv", _w("trades") + " select * from trades where Date >= '2024-01-09'")
def s1_s3_extract_dated_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Days from run date - 1 on, read back from the dated CSV tree by header name."""
    from barquet.sources.files import extract
    return extract(spark, _landing(spark, sf), RUN_DATE, lookback_days=1).select(*_BAR_SELECT)


@register("d3_d1_d4_daily_run", _daily_sql("trades", since="2024-01-09"))
def d3_d1_d4_daily_run(spark: SparkSession, sf: str) -> DataFrame:
    """Extract from the dated tree, build the daily report, store it, read the latest back."""
    from barquet.plans.etl import run_daily
    from barquet.session import work_dir
    _, latest = run_daily(spark, _landing(spark, sf), work_dir(spark, "reports"), RUN_DATE,
                          run_ts="20240110_180000")
    return latest


@register("s6_s8_latest_report", _daily_sql("trades"))
def s6_s8_latest_report(spark: SparkSession, sf: str) -> DataFrame:
    """Two stored daily reports (an older run and the run date's); the latest one read back."""
    from barquet.session import work_dir
    from barquet.sources.files import latest_report, write_report
    base = work_dir(spark, "reports")
    bars = fx.trades(spark, sf)
    write_report(reports.daily_report(bars, arg_date="2024-01-05"), base, "20240105_180000")
    write_report(reports.daily_report(bars, arg_date=RUN_DATE), base, "20240110_180000")
    return latest_report(spark, base)


@register("s9_list_reports",
          "select * from (values ('20240105_180000'), ('20240110_180000')) as t(report_ts)")
def s9_list_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Stamps of the stored reports (two runs of the daily report)."""
    from barquet.session import work_dir
    from barquet.sources.files import list_reports, write_report
    base = work_dir(spark, "reports")
    bars = fx.trades(spark, sf)
    write_report(reports.daily_report(bars, arg_date="2024-01-05"), base, "20240105_180000")
    write_report(reports.daily_report(bars, arg_date=RUN_DATE), base, "20240110_180000")
    return list_reports(spark, base)


@register("s10_csv_round_trip", _morning_sql("trades") + " select * from morning")
def s10_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The morning report written as CSV (header, no index) and read back with its schema."""
    from barquet.session import work_dir
    from barquet.sources.files import write_report_csv
    m = reports.morning_report(fx.trades(spark, sf))
    path = write_report_csv(m, work_dir(spark, "csv"))
    return spark.read.schema(m.schema).option("header", True).option("enforceSchema", False).csv(path)


# --- streaming ---------------------------------------------------------------

@register("st_incremental_daily_report", _daily_sql("trades", index=False, arg_date=None))
def st_incremental_daily_report(spark: SparkSession, sf: str) -> DataFrame:
    """Dated CSV tree -> incremental daily aggregation (file stream, available-now) -> report."""
    from barquet.session import work_dir
    from barquet.streaming.incremental import report_from_daily_table, start_daily_aggregation
    src = _landing(spark, sf)
    table, ckpt = work_dir(spark, "daily_table"), work_dir(spark, "stream_ckpt")
    # a file stream has one declared schema: the landing files' header
    start_daily_aggregation(spark, src, table, ckpt, schema=fx.trades(spark, sf).schema).awaitTermination()
    return report_from_daily_table(spark, table)


@register("st_incremental_morning_report", _morning_sql("trades") + " select * from morning")
def st_incremental_morning_report(spark: SparkSession, sf: str) -> DataFrame:
    """Dated CSV tree -> incremental morning aggregation -> morning report."""
    from barquet.session import work_dir
    from barquet.streaming.incremental import report_from_morning_table, start_morning_aggregation
    src = _landing(spark, sf)
    table, ckpt = work_dir(spark, "morning_table"), work_dir(spark, "stream_ckpt")
    start_morning_aggregation(spark, src, table, ckpt, schema=fx.trades(spark, sf).schema).awaitTermination()
    return report_from_morning_table(spark, table)


@register("m1c_next_days_forecast_global", _LINREG_GLOBAL_SQL.format(a="2024-01-29", b="2024-01-31") + """,
  days as (select strftime(cast(unnest(generate_series(date '2024-01-29', date '2024-01-31',
    interval 1 day)) as date), '%Y-%m-%d') as Date),
  firsts as (select Date, arg_min(StartPrice, row(Time, ISIN)) as first_StartPrice from trades
    where StartPrice is not null and Date >= '2024-01-29' and Date <= '2024-01-31' group by Date)
  select d.Date, f.first_StartPrice,
    """ + _re("lr.slope * f.first_StartPrice + lr.intercept", 6) + """ as predicted_EndPrice
  from days d left join firsts f on d.Date = f.Date, lr""")
def m1c_next_days_forecast_global(spark: SparkSession, sf: str) -> DataFrame:
    """The sketch's shape: one regression over every bar of the window, scored on each day's first bar."""
    from pyspark.sql import functions as F
    from barquet.operators.regression import linregress, predict_days_ahead
    t = fx.trades(spark, sf, "2024-01-29", "2024-01-31")
    model = linregress(t.filter(F.col("Date").between("2024-01-29", "2024-01-31")), "EndPrice", "StartPrice",
                       by=None, p_value=False)
    out = predict_days_ahead(t, model, "2024-01-29", 3, by=None, tiebreak="ISIN")
    return _round(out.select("Date", "first_StartPrice", "predicted_EndPrice"), {"predicted_EndPrice": 6})


# --- option variants ------------------------------------------------------------

@register("d1_daily_report_clustered", _daily_sql("trades"))
def d1_daily_report_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """The daily report read per security: rows as the index step lays them out, without a final sort."""
    return reports.daily_report(fx.trades(spark, sf), arg_date=RUN_DATE, sort=False)


@register("m2_minmax_scale_train_fit", _w("closes") + """, n as (select series_id,
  cast(floor(count(*) * 0.8) as bigint) as cut from closes group by series_id),
  mm as (select c.series_id, min(Close) as scale_min, coalesce(nullif(max(Close) - min(Close), 0), 1.0) as scale_range
    from closes c join n on c.series_id = n.series_id where c.idx < n.cut group by c.series_id)
  select c.series_id, c.idx, c.Close, (c.Close - scale_min) / scale_range as Close_scaled
  from closes c join mm on c.series_id = mm.series_id""")
def m2_minmax_scale_train_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Min-max scaling fitted on the training part only (no test rows in the bounds) (M2)."""
    from pyspark.sql import functions as F
    from barquet.operators.series import chrono_split, minmax_scale
    c = fx.closes(spark, sf)
    parts = chrono_split(c, "series_id", "idx", 0.8)
    s = minmax_scale(parts, "series_id", "Close", name="Close_scaled", where=F.col("split") == "train")
    return s.select("series_id", "idx", "Close", "Close_scaled")


@register("w8_series_tail", _w("closes") + """ select series_id, idx, Close from closes
  qualify row_number() over (partition by series_id order by idx desc) <= 10""")
def w8_series_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Last ten positions of each dense series from its length, without a sort."""
    from barquet.operators.series import series_tail
    return series_tail(fx.closes(spark, sf), "series_id", "idx", 10).select("series_id", "idx", "Close")


@register("s3_read_strict", _w("trades") + " select * from trades")
def s3_read_strict(spark: SparkSession, sf: str) -> DataFrame:
    """The dated CSV tree read in one scan with the declared header (enforceSchema off) (S3)."""
    from barquet.sources.files import day_paths_since, read_csv_strict
    base = _landing(spark, sf)
    return read_csv_strict(spark, day_paths_since(spark, base, "1970-01-01"), fx.trades(spark, sf).schema)


@register("m1b_linregress_global", _w("trades") + """, tw as (select * from trades
  where Date >= '2024-01-08' and Date <= '2024-01-10'),
  g as (select regr_slope(EndPrice, StartPrice) as slope, regr_intercept(EndPrice, StartPrice) as intercept,
    least(greatest(corr(StartPrice, EndPrice), -1.0), 1.0) as r,
    cast(regr_count(EndPrice, StartPrice) as bigint) as n, var_pop(StartPrice) as vx, var_pop(EndPrice) as vy,
    avg(StartPrice) as mx from tw),
  lr as (select slope, intercept, r, sqrt((1 - r * r) * vy / (vx * (n - 2))) as stderr,
    sqrt((1 - r * r) * vy / (vx * (n - 2))) * sqrt(vx + mx * mx) as intercept_stderr, n from g)
  select """ + ", ".join(f"{_re(c, d)} as {c}" for c, d in _LR_DIG.items()) + ", n from lr")
def m1b_linregress_global(spark: SparkSession, sf: str) -> DataFrame:
    """One regression over every bar of a date window, as the sketch has it."""
    from pyspark.sql import functions as F
    from barquet.operators.regression import linregress
    t = fx.trades(spark, sf, "2024-01-08", "2024-01-10").filter(F.col("Date").between("2024-01-08", "2024-01-10"))
    return _round(linregress(t, "EndPrice", "StartPrice", by=None, p_value=False), _LR_DIG)


@register("w6_lag_windows_whole_series", _w("closes") + _SCALED + f""", n as (select series_id, count(*) as n
  from closes group by series_id),
  l as (select sc.series_id, idx, n, v, {_LAGS} from sc join n on sc.series_id = n.series_id
    window w as (partition by sc.series_id order by idx))
  select series_id, idx, {", ".join(f"f{i}" for i in range(10))}, v as target from l
  where idx >= 10 and idx <= n - 2""")
def w6_lag_windows_whole_series(spark: SparkSession, sf: str) -> DataFrame:
    """Ten-step lag windows over each whole scaled series (no split)."""
    from pyspark.sql import functions as F
    from barquet.operators.series import lag_windows, minmax_scale
    s = minmax_scale(fx.closes(spark, sf), "series_id", "Close", name="v")
    w = lag_windows(s, "series_id", "idx", "v", time_step=10, frac=None)
    return w.select("series_id", "idx", *[F.col("features")[i].alias(f"f{i}") for i in range(10)], "target")


# --- operators not covered by the queries above -----------------------------------

@register("u1_s3_mixed_headers", _w("trades") + " select * from trades")
def u1_s3_mixed_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Files with reordered, extra and absent columns read into one table by header name."""
    from pyspark.sql import functions as F
    from barquet.session import work_dir
    from barquet.sources.files import read_csv_by_name
    base, t = work_dir(spark, "mixed"), fx.trades(spark, sf)
    even = F.day(F.to_date("Date")) % 2 == 0
    t.filter(even).select(*reversed(_BAR_SELECT)).write.option("header", True).csv(f"{base}/even")
    t.filter(~even).select(F.lit("x").alias("Extra"), *_BAR_SELECT[2:], *_BAR_SELECT[:2]).write.option("header", True).csv(f"{base}/odd")
    return read_csv_by_name(spark, [f"{base}/even", f"{base}/odd"]).select(*_BAR_SELECT)


@register("p2_every_source_column", _w("trades") + " select * from trades where Time not like '%:13' and Time not like '%:17'")
def p2_every_source_column(spark: SparkSession, sf: str) -> DataFrame:
    """Bars without a missing value in any column of the file, also one that no job uses (P2 before the projection)."""
    from pyspark.sql import functions as F
    from barquet.session import work_dir
    from barquet.sources.files import extract, write_dated_csv
    t = fx.trades(spark, sf)
    wide = t.withColumn("Currency", F.when(~F.col("Time").like("%:13"), F.lit("EUR"))) \
            .withColumn("Note", F.when(F.col("Time").like("%:17"), F.lit("NA")).otherwise(F.lit("ok")))
    base = write_dated_csv(wide, work_dir(spark, "landing"))
    return extract(spark, base, "1970-01-02", every_column=True).select(*_BAR_SELECT)


@register("s2_u2_named_days", _w("trades") + " select * from trades where Date in ('2024-01-03', '2024-01-05')")
def s2_u2_named_days(spark: SparkSession, sf: str) -> DataFrame:
    """Several days picked by name from the dated tree."""
    from barquet.sources.files import day_paths_for, read_csv_strict
    base = _landing(spark, sf)
    return read_csv_strict(spark, day_paths_for(base, ["2024-01-03", "2024-01-05"]), fx.trades(spark, sf).schema)


@register("s4_o6_sample_header", _w("trades") + " ".join(
    f"{'union all' if i else ''} select {i} as position, '{c}' as name, count({c}) as n_values from trades"
    for i, c in enumerate(_BAR_SELECT)))
def s4_o6_sample_header(spark: SparkSession, sf: str) -> DataFrame:
    """Columns named by the header of the second file of the sorted listing, with their filled cells over all files."""
    from pyspark.sql import functions as F
    from barquet.sources.files import check_header, day_paths_since, read_csv_by_name
    paths = day_paths_since(spark, _landing(spark, sf), "1970-01-01")
    names = check_header(spark, paths, fx.trades(spark, sf).schema, position=1)
    rows = read_csv_by_name(spark, paths, fx.trades(spark, sf).schema)
    one = rows.agg(*[F.count(c).alias(c) for c in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(c).alias("n_values")) for i, c in enumerate(names)])))


@register("s5_close_files", _w("closes") + " select series_id || '/close' as series_id, cast(idx as bigint) as idx, Close from closes")
def s5_close_files(spark: SparkSession, sf: str) -> DataFrame:
    """Close series read by column name from files of equal names in several folders."""
    from pyspark.sql import functions as F
    from barquet.session import work_dir
    from barquet.sources.files import _hadoop_fs, read_close_series
    base, c = work_dir(spark, "closes"), fx.closes(spark, sf)
    folders = [r[0] for r in c.select("series_id").distinct().collect()]  # one an order priority
    for f in folders:
        own = c.filter(F.col("series_id") == f).select(F.concat(F.lit("day "), "idx").alias("Date"), "Close", F.lit(1).alias("Volume"), "idx")
        own.coalesce(1).sortWithinPartitions("idx").drop("idx").write.option("header", True).csv(f"{base}/{f}")
        fs, root = _hadoop_fs(spark, f"{base}/{f}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for st in fs.listStatus(root):
            if st.getPath().getName().startswith("part-"):
                fs.rename(st.getPath(), path(root, "close.csv"))
    return read_close_series(spark, [f"{base}/{f}" for f in folders])


@register("s7_read_report", _daily_sql("trades"))
def s7_read_report(spark: SparkSession, sf: str) -> DataFrame:
    """One stored report read back by its path."""
    from barquet.session import work_dir
    from barquet.sources.files import read_report, write_report
    return read_report(spark, write_report(reports.daily_report(fx.trades(spark, sf), arg_date=RUN_DATE), work_dir(spark, "reports"), "20240110_180000"))


@register("f3_f4_f5_text_parts", """select event_id, regexp_full_match(strftime(ts, '%H:%M'), '([01][0-9]|2[0-3]):[0-5][0-9]') as is_time,
  regexp_full_match(event_type, '([01][0-9]|2[0-3]):[0-5][0-9]') as type_is_time, strftime(ts, '%Y%m%d_%H%M%S') as stamp,
  strftime(ts, '%Y-%m-%d') as key_day from events""")
def f3_f4_f5_text_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Time-of-day test, report stamp and first part of an object key for every event."""
    from pyspark.sql import functions as F
    from barquet.functions.columns import is_hhmm, key_first_part, report_stamp
    e = fx.table(spark, sf, "events")
    key = F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd"), F.col("event_type"), F.lit("file.csv"))
    return e.select("event_id", is_hhmm(F.date_format("ts", "HH:mm")).alias("is_time"), is_hhmm("event_type").alias("type_is_time"),
                    report_stamp("ts").alias("stamp"), key_first_part(key).alias("key_day"))


@register("f8_f10_unit_terms", _w("trades") + """ select ISIN, Date, Time, """ + _re("1.0 / (1.0 + exp(-(EndPrice / 100.0)))", 9) + """ as s,
  """ + _re("(1.0 / (1.0 + exp(-(EndPrice / 100.0)))) * (1.0 - 1.0 / (1.0 + exp(-(EndPrice / 100.0))))", 9) + """ as ds,
  cast(split_part(Time, ':', 1) as int) as hour, cast(split_part(Time, ':', 2) as double) as minute from trades""")
def f8_f10_unit_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic value and derivative of every close, and numbers parsed from the time's text."""
    from pyspark.sql import functions as F
    from barquet.functions.columns import parse_float, parse_int, sigmoid, sigmoid_derivative_from_output
    t = fx.trades(spark, sf).withColumn("s", sigmoid(F.col("EndPrice") / 100.0))
    out = t.select("ISIN", "Date", "Time", "s", sigmoid_derivative_from_output("s").alias("ds"),
                   parse_int(F.split_part("Time", F.lit(":"), F.lit(1))).alias("hour"), parse_float(F.split_part("Time", F.lit(":"), F.lit(2))).alias("minute"))
    return _round(out, {"s": 9, "ds": 9})


@register("o1_tiebreak", """with e as (select event_type as ISIN, strftime(ts, '%Y-%m-%d') as Date, strftime(ts, '%H:00') as Time, value, event_id from events)
  select ISIN, Date, arg_min(value, row(Time, event_id)) as opening_price_eur, arg_max(value, row(Time, event_id)) as closing_price_eur,
  min(value) as minimum_price_eur, max(value) as maximum_price_eur, cast(count(*) as bigint) as daily_traded_volume from e group by ISIN, Date""")
def o1_tiebreak(spark: SparkSession, sf: str) -> DataFrame:
    """First and last of a day whose bars share their times, decided by an id."""
    from pyspark.sql import functions as F
    from barquet.operators.bars import daily_ohlcv
    e = fx.table(spark, sf, "events")
    bars = e.select(F.col("event_type").alias("ISIN"), F.date_format("ts", "yyyy-MM-dd").alias("Date"), F.date_format("ts", "HH:00").alias("Time"),
                    *[F.col("value").alias(c) for c in ("StartPrice", "MaxPrice", "MinPrice", "EndPrice")], F.lit(1).alias("TradedVolume"), "event_id")
    return daily_ohlcv(bars, tiebreak="event_id")


def _partial_slope(rel: str, y: str, xs: list[str], last: str, tag: str) -> str:
    """CTEs after which ``{tag}`` has the coefficient of ``last`` in the regression of ``y`` on ``xs`` and a constant:
    everything is freed of the constant and of the other regressors one after the other."""
    cols, others = [y, *xs], [x for x in xs if x != last]
    out = [f"{tag}_0 as (select " + ", ".join(f"{c} - avg({c}) over () as {c}" for c in cols) + f" from {rel})"]
    for i, x in enumerate(others):
        out.append(f"{tag}_{i + 1} as (select " + ", ".join(f"{c} - {x} * sum({c} * {x}) over () / sum({x} * {x}) over () as {c}" if c not in others[:i + 1] else c for c in cols)
                   + f" from {tag}_{i})")
    out.append(f"{tag} as (select '{last}' as feature, sum({y} * {last}) / sum({last} * {last}) as coefficient from {tag}_{len(others)})")
    return ",\n".join(out)


_M3_X = ["start_price", "minimum_price", "maximum_price", "daily_traded_volume"]


@register("m3_coefficients", _morning_sql("trades_wide") + ", d as (select end_price, start_price, minimum_price, maximum_price, "
          "cast(daily_traded_volume as double) as daily_traded_volume from morning),\n"
          + ",\n".join(_partial_slope("d", "end_price", _M3_X, x, f"c{i}") for i, x in enumerate(_M3_X))
          + " select feature, " + _re("coefficient", 6) + " as coefficient from ("
          + " union all ".join(f"select * from c{i}" for i in range(len(_M3_X))) + ")")
def m3_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients of end_price on four columns of the morning report (M3)."""
    from pyspark.sql import functions as F
    from barquet.operators.mlmodels import multi_feature_regression
    _, summary, _ = multi_feature_regression(reports.morning_report(fx.trades_wide(spark, sf)), "end_price", _M3_X)
    rows = summary.select(F.posexplode("coefficients").alias("i", "coefficient"))
    return _round(rows.select(F.array(*[F.lit(x) for x in _M3_X])[F.col("i")].alias("feature"), "coefficient"), {"coefficient": 6})


@register("a5_a6_approx_within_bound", "select 1 as n_tables, true as rows_ok, true as securities_ok, true as groups_ok, count(*) as n_events from events")
def a5_a6_approx_within_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Sketched counts of the wide bars against the exact ones: within five relative errors."""
    from pyspark.sql import functions as F
    from barquet.operators.bars import explore
    t = fx.trades_wide(spark, sf)
    a, e = explore(t, approximate=True), explore(t)
    near = lambda c: (F.abs(F.col(f"a.{c}") - F.col(f"e.{c}")) <= 0.05 * F.col(f"e.{c}") + 1)
    n = fx.table(spark, sf, "events").agg(F.count(F.lit(1)).alias("n_events"))
    both = a.alias("a").join(e.alias("e"), F.col("a.n_rows") == F.col("e.n_rows"), "left")
    return both.select(F.lit(1).alias("n_tables"), F.col("e.n_rows").isNotNull().alias("rows_ok"), near("n_securities").alias("securities_ok"),
                       near("n_groups").alias("groups_ok")).join(n.hint("broadcast"))


@register("m1b_p_value_of_volume", _w("trades") + """, lr as (select ISIN, corr(EndPrice, TradedVolume) as r, count(*) as n from trades
    where Date >= '2024-01-08' and Date <= '2024-01-10' group by ISIN),
  t as (select ISIN, n - 2 as dof, atan(abs(r) * sqrt(n - 2) / sqrt(1 - r * r) / sqrt(n - 2)) as theta from lr),
  s as (select ISIN, dof, theta, case when k in (0, 4000) then 1 when k % 2 = 1 then 4 else 2 end * pow(cos(theta * k / 4000), dof - 1) as v
    from t, (select unnest(range(4001)) as k))
  select ISIN, """ + _re("1 - 2 / sqrt(pi()) * exp(lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0)) * sum(v) * theta / 12000", 6) + """ as p_value
  from s group by ISIN, dof, theta""")
def m1b_p_value_of_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Two-sided p value of the slope of volume on close per security, against the t density integrated by Simpson's rule."""
    from pyspark.sql import functions as F
    from barquet.operators.regression import linregress
    t = fx.trades(spark, sf, "2024-01-08", "2024-01-10").filter(F.col("Date").between("2024-01-08", "2024-01-10"))
    return _round(linregress(t, "TradedVolume", "EndPrice", by="ISIN").select("ISIN", "p_value"), {"p_value": 6})
