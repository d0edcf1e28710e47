"""Command-line runs of the jobs, as the reference's scripts run them.

    python -m barquet daily   --source DIR --reports DIR --date YYYY-MM-DD [--run-ts yyyyMMdd_HHmmss]
    python -m barquet morning --source DIR --reports DIR --date YYYY-MM-DD [--run-ts ...]
    python -m barquet series  --closes DIR --out DIR --days N --nu X
    python -m barquet models  --report DIR --csv DIR --out DIR
    python -m barquet stream-daily|stream-morning --source DIR --table DIR --checkpoint DIR [--late-days N]

Paths may be any Hadoop-compatible URI. The session comes from
``spark-submit`` (or ``--master`` for a local run).
"""

from __future__ import annotations

import argparse
import os
import sys

if __package__ in (None, ""):  # run as a script path (as spark-submit does): make the package importable
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barquet.session import get_spark  # noqa: E402


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m barquet")
    p.add_argument("--master", default=None, help="Spark master for a local run, e.g. local[8]")
    sub = p.add_subparsers(dest="job", required=True)
    for name in ("daily", "morning"):
        s = sub.add_parser(name, help=f"{name} report from a dated CSV tree, stored as Parquet")
        s.add_argument("--source", required=True)
        s.add_argument("--reports", required=True)
        s.add_argument("--date", required=True, help="run date; the day before is read for the previous close")
        s.add_argument("--run-ts", default=None, help="report stamp yyyyMMdd_HHmmss (default: now)")
        s.add_argument("--lookback-days", type=int, default=1)
        s.add_argument("--missing-in", choices=["any", "used"], default="any" if name == "morning" else "used",
                       help="drop bars with a missing value in any column of their file, or in the used ones only")
    s = sub.add_parser("series", help="ARMA(1,1) forecast and one-class anomalies of close files")
    s.add_argument("--closes", required=True, help="folder of one-column Close CSV files")
    s.add_argument("--out", required=True, help="output folder (forecast/, chart/, anomalies/ as Parquet)")
    s.add_argument("--days", type=int, required=True)
    s.add_argument("--nu", type=float, required=True)
    s = sub.add_parser("models", help="lag forecast, regression and sigmoid unit on a stored morning report, over its CSV form")
    s.add_argument("--report", required=True, help="path of one stored morning report")
    s.add_argument("--csv", required=True, help="where the report is written as CSV")
    s.add_argument("--out", required=True)
    for name in ("daily", "morning"):
        s = sub.add_parser(f"stream-{name}", help=f"incremental bars -> {name} aggregate table (available-now)")
        s.add_argument("--source", required=True)
        s.add_argument("--table", required=True)
        s.add_argument("--checkpoint", required=True)
        s.add_argument("--late-days", type=int, default=31, help="days behind the newest for which late bars count; -1 for no bound")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = get_spark(args.master)
    if args.job in ("daily", "morning"):
        from barquet.plans.etl import run_daily, run_morning_with_model
        if args.job == "daily":
            path, latest = run_daily(spark, args.source, args.reports, args.date, args.run_ts, args.lookback_days, args.missing_in == "any")
        else:
            path, latest, model = run_morning_with_model(spark, args.source, args.reports, args.date,
                                                         args.run_ts, args.lookback_days, args.missing_in == "any")
            model.show(truncate=False)
        print(f"written {path}")
        latest.show(20, truncate=False)
    elif args.job == "series":
        from barquet.plans.analytics import analyze_series
        from barquet.sources.files import read_close_series
        out = analyze_series(read_close_series(spark, args.closes), days=args.days, nu=args.nu)
        for name in ("forecast", "chart", "anomalies"):
            out[name].write.mode("errorifexists").parquet(f"{args.out.rstrip('/')}/{name}")
        out["forecast"].orderBy("series_id", "idx").show(50, truncate=False)
    elif args.job == "models":
        from barquet.plans.etl import run_report_models
        from barquet.sources.files import read_report
        for name, df in run_report_models(spark, read_report(spark, args.report), args.csv).items():
            df.write.mode("errorifexists").parquet(f"{args.out.rstrip('/')}/{name}")
    else:
        from barquet.streaming.incremental import start_daily_aggregation, start_morning_aggregation
        start = start_daily_aggregation if args.job == "stream-daily" else start_morning_aggregation
        start(spark, args.source, args.table, args.checkpoint, late_days=None if args.late_days < 0 else args.late_days).awaitTermination()
        print(f"table {args.table} up to date")
    return 0


if __name__ == "__main__":
    sys.exit(main())
