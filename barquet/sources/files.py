"""Dated CSV trees in, Parquet reports out.

Input layout: one directory per day named ``YYYY-MM-DD`` (not Hive
``key=value``), CSV files with a header inside. Output layout: one report
per run under ``<base>/report_ts=<yyyyMMdd_HHmmss>/`` so the run stamp is a
partition column and picking the latest report is a partition filter.

Day and report selection lists only the first level of the tree (one
Hadoop ``FileSystem.listStatus`` call, so the cost follows the number of
days or reports, not files); the files inside the chosen directories are
then listed by Spark's own file index when the read is planned. Only names
reach the driver, never rows.
"""

from __future__ import annotations

import datetime as dt
import os
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from barquet.operators.ordering import with_dense_index
from barquet.sources.schemas import BAR_SCHEMA, CLOSE_FILE_SCHEMA, PANDAS_NA_VALUES

_DAY = re.compile(r"^\d{4}-\d{2}-\d{2}$")
_PY_TS = "%Y%m%d_%H%M%S"  # the yyyyMMdd_HHmmss report stamp, in Python's notation


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


# --- dated trees ---------------------------------------------------------------

def write_dated_csv(bars: DataFrame, base: str, date_col: str = "Date") -> str:
    """Write bars as ``base/YYYY-MM-DD/part-*.csv`` with a header (one parallel write).

    The files keep their ``Date`` column, as the exchange's files do. The
    write is partitioned on a copy of the date, and the ``_day=X``
    directories are then renamed to ``X`` (a metadata operation).
    """
    bars.withColumn("_day", F.col(date_col)).write.partitionBy("_day").option("header", True) \
        .mode("errorifexists").csv(base)
    fs, root = _hadoop_fs(bars.sparkSession, base)
    jvm = bars.sparkSession.sparkContext._jvm
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("_day="):
            fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(root, name[len("_day="):]))
    return base


def _list_dirs(spark: SparkSession, base: str) -> list[str]:
    """Names of the first-level directories under ``base`` (hidden ``_``/``.`` names skipped).

    One listing call of the base directory: metadata only, and only as many
    entries as there are days (or reports), not files.
    """
    fs, root = _hadoop_fs(spark, base)
    if not fs.exists(root):
        return []
    names = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and not name.startswith(("_", ".")):
            names.append(name)
    return names


def list_day_dirs(spark: SparkSession, base: str) -> list[tuple[dt.date, str]]:
    """Day directories under ``base`` with their dates, sorted by date.

    A first-level directory whose name is not a ``yyyy-MM-dd`` date raises,
    as the reference's key parsing does.
    """
    days = []
    for name in _list_dirs(spark, base):
        if not _DAY.match(name):
            raise ValueError(f"object key does not start with a yyyy-MM-dd day: {name!r}")
        days.append((dt.datetime.strptime(name, "%Y-%m-%d").date(), f"{base.rstrip('/')}/{name}"))
    return sorted(days, key=lambda t: t[0])


def day_paths_since(spark: SparkSession, base: str, cutoff: dt.date | str) -> list[str]:
    """Day directories dated on or after ``cutoff``."""
    if isinstance(cutoff, str):
        cutoff = dt.datetime.strptime(cutoff, "%Y-%m-%d").date()
    return [p for d, p in list_day_dirs(spark, base) if d >= cutoff]


def day_paths_for(base: str, days: Sequence[str]) -> list[str]:
    """Paths of the named days (S2: prefix selection of one or several days)."""
    return [f"{base.rstrip('/')}/{d}" for d in days]


# --- CSV reads -----------------------------------------------------------------

def missing_tokens_to_null(df: DataFrame, na_values: Sequence[str] | None = PANDAS_NA_VALUES) -> DataFrame:
    """Text columns holding a missing-value token become NULL (numbers that fail to parse already are)."""
    if not na_values:
        return df
    tokens = [t for t in na_values if t != ""]
    return df.select(*[F.when(F.col(f"`{f.name}`").isin(tokens), F.lit(None)).otherwise(F.col(f"`{f.name}`"))
                       .alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def read_csv_strict(spark: SparkSession, paths: Sequence[str] | str, schema: StructType = BAR_SCHEMA,
                    na_values: Sequence[str] | None = PANDAS_NA_VALUES) -> DataFrame:
    """Read CSV files whose header must equal ``schema`` (S3 fast path).

    Spark matches a declared schema to columns by position; with
    ``enforceSchema=false`` a file whose header differs raises instead of
    yielding shifted values. A field that does not parse (``NA`` in a number
    column) reads as NULL, and so does a text field holding one of
    ``na_values`` (by default the tokens pandas reads as missing).
    """
    df = (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
          .option("mode", "PERMISSIVE").csv(list(paths) if not isinstance(paths, str) else paths))
    return missing_tokens_to_null(df, na_values)


def _decoded(uri: str) -> str:
    """A listed (URL-encoded) file URI as a path string Spark's readers accept."""
    from urllib.parse import unquote
    return unquote(uri)


#: Layouts (distinct header lines) are few; more than this many is taken as a sign of files that are not tables.
MAX_LAYOUTS = 10_000


#: Files whose first lines are fetched at once.
HEADER_THREADS = 32


def _header_lines(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """First line of every file that has one, by the file's (URL-encoded) URI.

    The listing is Spark's own; each file is opened by the Hadoop file system
    that Spark reads with, one line is taken, and it is closed: a buffer's
    worth of bytes a file, whatever its length, and no Spark job.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = spark.read.text(paths).inputFiles()

    def first(uri: str) -> str | None:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
            opened = codec.createInputStream(stream) if codec else stream
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(opened, "UTF-8")).readLine()
        finally:
            stream.close()
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        return {f: line for f, line in zip(files, pool.map(first, files)) if line is not None}


def _layout_paths(headers: dict[str, str], given: list[str]) -> dict[str, list[str]]:
    """The paths to read for each header line: folders where all files of one have it, else the files.

    Folders stand for their files only where the caller gave folders.
    """
    known = {_plain(p) for p in given}
    by_folder: dict[str, dict[str, list[str]]] = {}
    for uri, header in headers.items():
        by_folder.setdefault(uri.rsplit("/", 1)[0], {}).setdefault(header, []).append(uri)
    out: dict[str, list[str]] = {}
    for folder, lines in sorted(by_folder.items()):
        for header, files in lines.items():
            whole = len(lines) == 1 and _plain(_decoded(folder)) in known
            out.setdefault(header, []).extend([_decoded(folder)] if whole else [_decoded(f) for f in sorted(files)])
    return out


def _plain(path: str) -> str:
    """A path without scheme differences and a slash at its end."""
    return re.sub(r"^file:/+", "/", path).rstrip("/")


def _cells(header: str) -> list[str]:
    import csv
    row = next(csv.reader([header.lstrip("\ufeff").rstrip("\r")]), [])
    return [c.strip() for c in row]


def read_csv_by_name(spark: SparkSession, paths: Sequence[str] | str, schema: StructType = BAR_SCHEMA,
                     na_values: Sequence[str] | None = PANDAS_NA_VALUES, required: Sequence[str] | None = None,
                     position_cols: bool = False, every_column: bool = False) -> DataFrame:
    """Read CSV files matching columns by header name, per file.

    Files are grouped by their header line; each group is read by Spark's CSV
    source with exactly that header's columns, however many, and the groups
    are put together by name. Columns a file lacks are NULL, extra columns
    are ignored, text that does not convert to the target type is NULL, and
    so is a field holding one of ``na_values`` (by default the tokens pandas
    reads as missing). A file whose header has none of the names, or lacks
    one of ``required``, raises and is named: no file is left out silently.

    ``every_column`` drops the rows with a missing value in any column that
    their own file has (P2 over the whole source) before the columns are
    chosen. ``position_cols`` adds the file's path, the split's offset and the
    row's number in it. The header step reads one row a file; the data is
    scanned once. When every file is known to carry the declared header,
    :func:`read_csv_strict` does the same without the header step.
    """
    path_list = list(paths) if not isinstance(paths, str) else [paths]
    names = [f.name for f in schema.fields]
    tokens = [t for t in (na_values or ()) if t != ""]
    headers = _header_lines(spark, path_list)
    held = _layout_paths(headers, path_list)
    if len(held) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} different header lines under {path_list[:3]}")
    parts = []
    for header, own in sorted(held.items()):
        cells = _cells(header)
        lowered = [c.lower() for c in cells]
        at = {n: lowered.index(n.lower()) for n in names if n.lower() in lowered}
        lacking = [n for n in (required or ()) if n not in at]
        if not at or lacking:
            raise ValueError(f"{own[:3]}{' ...' * (len(own) > 3)}: " + (f"no column {lacking}" if lacking else f"header {cells[:8]} has none of {names}"))
        raw_schema = StructType([StructField(f"_c{i}", StringType()) for i in range(len(cells))])
        raw = spark.read.schema(raw_schema).option("header", True).option("mode", "PERMISSIVE").csv(own)
        if position_cols:
            raw = raw.select("*", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("_bq_path"), F.col("_metadata.file_block_start").alias("_bq_start"),
                             F.monotonically_increasing_id().alias("_bq_pos"))
        text = {i: F.when(F.col(f"_c{i}").isin(tokens), F.lit(None)).otherwise(F.col(f"_c{i}")) if tokens else F.col(f"_c{i}") for i in range(len(cells))}
        typed = {}
        for f in schema.fields:
            if f.name not in at:
                typed[f.name] = F.lit(None).cast(f.dataType)
            else:
                typed[f.name] = text[at[f.name]] if isinstance(f.dataType, StringType) else text[at[f.name]].try_cast(f.dataType)
        if every_column:
            whole = F.lit(True)
            for i in range(len(cells)):
                whole = whole & text[i].isNotNull()
            for n in at:
                whole = whole & typed[n].isNotNull()
            raw = raw.filter(whole)
        extra = ["_bq_path", "_bq_start", "_bq_pos"] if position_cols else []
        parts.append(raw.select(*extra, *[typed[n].alias(n) for n in names]))
    if not parts:
        raise FileNotFoundError(f"no files under {path_list}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def list_files(spark: SparkSession, paths: Sequence[str] | str) -> list[str]:
    """Data files under the given paths, sorted (hidden and marker files excluded)."""
    reader = spark.read.format("text").option("recursiveFileLookup", True)
    return sorted(reader.load(list(paths) if not isinstance(paths, str) else paths).inputFiles())


def sample_header(spark: SparkSession, paths: Sequence[str] | str, position: int = 0) -> list[str]:
    """Column names of the file at ``position`` of the sorted listing."""
    files = list_files(spark, paths)
    if not files:
        raise FileNotFoundError(f"no files under {paths}")
    return spark.read.option("header", True).csv(files[position]).columns


def check_header(spark: SparkSession, paths: Sequence[str] | str, schema: StructType = BAR_SCHEMA,
                 position: int = 0) -> list[str]:
    """Sample one file's header and fail if a declared column is missing from it."""
    cols = sample_header(spark, paths, position)
    missing = [f.name for f in schema.fields if f.name not in cols]
    if missing:
        raise ValueError(f"columns {missing} missing from the header {cols}")
    return cols


def read_close_series(spark: SparkSession, paths: Sequence[str] | str, value: str = "Close",
                      series_col: str = "series_id") -> DataFrame:
    """The ``value`` column of CSV files as ``(series_id, idx, value)``, found by its header name.

    One series a file. ``series_id`` is the file name without extension or,
    where files of different folders share a name, the path from their common
    folder on. ``idx`` is the row's position in its file, made explicit at
    ingest: file splits are ordered by their offset and rows inside a split by
    ``monotonically_increasing_id``, then numbered per file by the
    distributed dense index. A file without the column raises.
    """
    schema = StructType([StructField(value, CLOSE_FILE_SCHEMA.fields[0].dataType)])
    path_list = list(paths) if not isinstance(paths, str) else [paths]
    raw = read_csv_by_name(spark, path_list, schema, required=[value], position_cols=True)
    files = sorted({_decoded(f) for f in spark.read.format("text").load(path_list).inputFiles()})
    stems = [re.sub(r"\.[^./]*$", "", f) for f in files]
    if len({x.rsplit("/", 1)[-1] for x in stems}) == len(stems):
        name = F.regexp_extract("_bq_path", r"([^/]*?)(\.[^./]*)?$", 1)
    else:
        common = os.path.commonpath([x.rsplit("/", 1)[0] for x in stems])
        # the listed form of the path: scheme and slashes before it may be written differently
        tail = F.element_at(F.split("_bq_path", re.escape(re.sub(r"^file:/+", "/", common)) + "/", 2), -1)
        name = F.regexp_replace(tail, r"\.[^./]*$", "")
    named = raw.withColumn(series_col, name).drop("_bq_path")
    indexed = with_dense_index(named, ["_bq_start", "_bq_pos"], name="idx", partition_cols=[series_col])
    return indexed.select(series_col, F.col("idx").cast("long").alias("idx"), value)


def extract(spark: SparkSession, base: str, arg_date: str, lookback_days: int = 1,
            schema: StructType = BAR_SCHEMA, by_name: bool = True, every_column: bool = False) -> DataFrame:
    """Bars of every day from ``arg_date - lookback_days`` on (D3).

    The lookback day feeds the previous close of the first reported day; a
    lookback of one calendar day misses it after a weekend, hence the
    argument. Raises when no day qualifies. ``by_name=False`` switches to the
    strict reader (no header step) for trees whose files all carry
    ``schema``'s header. ``every_column`` drops bars with a missing value in
    any column of their file, used or not (P2 before the projection).
    """
    if every_column and not by_name:
        raise ValueError("every_column needs by_name")
    run = dt.datetime.strptime(arg_date, "%Y-%m-%d").date()
    cutoff = run - dt.timedelta(days=lookback_days)
    paths = day_paths_since(spark, base, cutoff)
    if not paths:
        raise FileNotFoundError(f"no day directories under {base} on or after {cutoff.isoformat()}")
    return read_csv_by_name(spark, paths, schema, every_column=every_column) if by_name else read_csv_strict(spark, paths, schema)


# --- reports -------------------------------------------------------------------

def report_stamp(run_ts: dt.datetime | None = None) -> str:
    """``yyyyMMdd_HHmmss`` text of the run time (F4); pass it in to make runs repeatable."""
    return (run_ts or dt.datetime.now()).strftime(_PY_TS)


def write_report(report: DataFrame, base: str, run_ts: dt.datetime | str | None = None,
                 layout: str = "partition", prefix: str = "daily_report_") -> str:
    """Write a report as Parquet (S6); returns the path.

    ``layout="partition"`` (default) writes ``base/report_ts=<stamp>``, so the
    stamp is a partition column and the latest report is a partition filter.
    ``layout="named"`` writes ``base/<prefix><stamp>.parquet``, one dataset per
    run named like the object keys of a bucket. Never overwrites: a second run
    with the same stamp fails.
    """
    stamp = run_ts if isinstance(run_ts, str) else report_stamp(run_ts)
    if layout == "partition":
        path = f"{base.rstrip('/')}/report_ts={stamp}"
    elif layout == "named":
        path = f"{base.rstrip('/')}/{prefix}{stamp}.parquet"
    else:
        raise ValueError(f"unknown layout {layout!r}")
    report.write.mode("errorifexists").parquet(path)
    return path


def write_report_csv(report: DataFrame, path: str) -> str:
    """Write a report as CSV with a header and no index column."""
    report.write.mode("errorifexists").option("header", True).csv(path)
    return path


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Read one report."""
    return spark.read.parquet(path)


def report_stamps(spark: SparkSession, base: str, layout: str = "partition",
                  prefix: str = "daily_report_") -> list[str]:
    """Stamps of the stored reports, from one listing of the report folder."""
    names = _list_dirs(spark, base)
    if layout == "named":
        pat = re.compile("^" + re.escape(prefix) + r"(\d{8}_\d{6})\.parquet$")
        return sorted(m.group(1) for n in names for m in [pat.match(n)] if m)
    return sorted(n[len("report_ts="):] for n in names if n.startswith("report_ts="))


def list_reports(spark: SparkSession, base: str) -> DataFrame:
    """Distinct report stamps as a DataFrame (S9), from the listing: no file is opened."""
    return spark.createDataFrame([(t,) for t in report_stamps(spark, base)], "report_ts string")


def latest_report(spark: SparkSession, base: str, keep_stamp: bool = False, layout: str = "partition",
                  prefix: str = "daily_report_") -> DataFrame:
    """The report with the greatest stamp.

    Stamps sort as text in time order; the newest one's folder is read
    directly, so no other report's files are listed.
    """
    stamps = report_stamps(spark, base, layout, prefix)
    if not stamps:
        raise FileNotFoundError(f"no reports under {base}")
    if layout == "named":
        df = spark.read.parquet(f"{base.rstrip('/')}/{prefix}{stamps[-1]}.parquet")
        return df.withColumn("report_ts", F.lit(stamps[-1])) if keep_stamp else df
    df = spark.read.parquet(f"{base.rstrip('/')}/report_ts={stamps[-1]}")  # only that report's files are listed
    return df.withColumn("report_ts", F.lit(stamps[-1])) if keep_stamp else df
