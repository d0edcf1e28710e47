"""Column-level helpers (projections, predicates, scalar functions)."""

from barquet.functions.columns import (  # noqa: F401
    DATE_FORMAT, EUR_TO_MXN, MORNING_CLOSE, MORNING_OPEN, REPORT_TS_FORMAT, TIME_FORMAT,
    convert_currency, date_sequence, is_hhmm, key_first_part, parse_float, parse_int,
    pct_change, previous_day, report_stamp, round_half_even, round_numeric_columns,
    row_stddev, sigmoid, sigmoid_derivative_from_output, squared_error, time_after,
    time_between_exclusive, to_date, two_decimal_label,
)
