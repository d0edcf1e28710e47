"""Scalar building blocks as Spark ``Column`` expressions.

Everything here is a built-in expression, so it stays inside whole-stage
codegen; none of it needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

# Fixed values the reports must reproduce.
EUR_TO_MXN = 19.08          # currency rate applied to the morning close
MORNING_OPEN = "08:00"      # morning session bounds, both exclusive
MORNING_CLOSE = "12:00"
REPORT_TS_FORMAT = "yyyyMMdd_HHmmss"
DATE_FORMAT = "yyyy-MM-dd"
TIME_FORMAT = "HH:mm"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c: str | Column, decimals: int = 2) -> Column:
    """Round the way numpy does for floats: scale, round half to even, unscale.

    Spark's ``round`` works on the exact decimal value and rounds half up,
    so 0.125 gives 0.13 there and 0.12 here; 2.675 (stored as 2.67499..)
    gives 2.68 here because the scaled value lands on 267.5.
    """
    scale = float(10 ** decimals)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


def round_numeric_columns(df: DataFrame, decimals: int = 2,
                          exclude: Sequence[str] = ()) -> DataFrame:
    """Apply :func:`round_half_even` to every floating column (integers are unchanged)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)) and f.name not in exclude:
            out.append(round_half_even(F.col(f"`{f.name}`"), decimals).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def pct_change(current: str | Column, previous: str | Column) -> Column:
    """``(current - previous) / previous * 100``; NULL when previous is NULL or 0."""
    cur, prev = _c(current), _c(previous)
    return F.try_divide(cur - prev, prev) * F.lit(100.0)


def convert_currency(c: str | Column, rate: float = EUR_TO_MXN) -> Column:
    """Price times a fixed rate."""
    return _c(c) * F.lit(float(rate))


def row_stddev(*cols: str | Column) -> Column:
    """Sample standard deviation across columns of one row (n - 1).

    Missing values are skipped; fewer than two present values give NULL.
    Built from ``filter``/``aggregate`` on an array, so it is one projection.
    """
    vals = F.filter(F.array(*[_c(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    n = F.size(vals)
    mean = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x) / n
    ss = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(n >= 2, F.sqrt(ss / (n - 1)))


def time_between_exclusive(c: str | Column, lo: str = MORNING_OPEN, hi: str = MORNING_CLOSE) -> Column:
    """``lo < time < hi`` on ``HH:mm`` strings (both bounds excluded, unlike ``between``)."""
    t = _c(c)
    return (t > F.lit(lo)) & (t < F.lit(hi))


def time_after(c: str | Column, lo: str = MORNING_OPEN) -> Column:
    """``time > lo`` on ``HH:mm`` strings (the one-bound form of the morning filter)."""
    return _c(c) > F.lit(lo)


def is_hhmm(c: str | Column) -> Column:
    """True when the text is a valid ``HH:mm`` time of day."""
    return _c(c).rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]$")


def to_date(c: str | Column) -> Column:
    """``yyyy-MM-dd`` text to a date."""
    return F.to_date(_c(c), DATE_FORMAT)


def previous_day(c: str | Column) -> Column:
    """Date minus one day (accepts a date or ``yyyy-MM-dd`` text)."""
    return F.date_sub(F.to_date(_c(c)), 1)


def report_stamp(ts: str | Column) -> Column:
    """Timestamp to the ``yyyyMMdd_HHmmss`` text used to name reports."""
    return F.date_format(_c(ts), REPORT_TS_FORMAT)


def key_first_part(key: str | Column, sep: str = "/") -> Column:
    """First path component of an object key or file path."""
    return F.split_part(_c(key), F.lit(sep), F.lit(1))


def date_sequence(start: str | Column, periods: int) -> Column:
    """Array of ``periods`` consecutive dates starting at ``start``."""
    d = F.to_date(_c(start))
    return F.sequence(d, F.date_add(d, periods - 1))


def two_decimal_label(c: str | Column) -> Column:
    """``f'{x:.2f}'`` text; rounds half to even first so 0.125 reads 0.12 as in Python."""
    return F.format_string("%.2f", round_half_even(c, 2))


def sigmoid(c: str | Column) -> Column:
    """Logistic function ``1 / (1 + exp(-x))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def sigmoid_derivative_from_output(s: str | Column) -> Column:
    """Derivative of the logistic function written in terms of its output ``s``."""
    sc = _c(s)
    return sc * (F.lit(1.0) - sc)


def squared_error(y: str | Column, p: str | Column) -> Column:
    d = _c(y) - _c(p)
    return d * d


def parse_int(c: str | Column) -> Column:
    """Text to int; ANSI cast, so bad text raises as Python's ``int`` does."""
    return _c(c).cast("int")


def parse_float(c: str | Column) -> Column:
    """Text to double; ANSI cast, so bad text raises as Python's ``float`` does."""
    return _c(c).cast("double")
