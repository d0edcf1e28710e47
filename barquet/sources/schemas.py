"""Declared schemas. Nothing is inferred: ``inferSchema`` would turn an
``HH:mm`` time into a timestamp of today, and a declared schema lets the CSV
reader turn a bad number into NULL instead of failing the whole file."""

from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

# Minute bars as they arrive in the dated CSV files.
BAR_SCHEMA = StructType([
    StructField("ISIN", StringType()),
    StructField("Mnemonic", StringType()),
    StructField("Date", StringType()),
    StructField("Time", StringType()),
    StructField("StartPrice", DoubleType()),
    StructField("MaxPrice", DoubleType()),
    StructField("MinPrice", DoubleType()),
    StructField("EndPrice", DoubleType()),
    StructField("TradedVolume", LongType()),
])

# Columns the reports use (and the default subset for dropping missing rows).
BAR_COLUMNS = ["ISIN", "Date", "Time", "StartPrice", "EndPrice", "MinPrice", "MaxPrice", "TradedVolume"]

DAILY_REPORT_COLUMNS = [
    "index", "ISIN", "Date", "opening_price_eur", "closing_price_eur", "minimum_price_eur",
    "maximum_price_eur", "daily_traded_volume", "change_prev_closing_%",
]

MORNING_REPORT_COLUMNS = [
    "ISIN", "Date", "start_price", "end_price", "minimum_price", "maximum_price",
    "daily_traded_volume", "end_price_mx", "standard_deviation",
]

# A close series: explicit position, since file order is not a Spark notion.
SERIES_SCHEMA = StructType([
    StructField("series_id", StringType()),
    StructField("idx", IntegerType()),
    StructField("Close", DoubleType()),
])

CLOSE_FILE_SCHEMA = StructType([StructField("Close", DoubleType())])

# The text pandas' CSV reader takes as a missing value by
# default (pandas 2.x), in every column. The readers map it to NULL so that a
# later drop of missing rows removes the same rows.
PANDAS_NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
