"""barquet: market-bar reports and series analytics as Spark jobs.

Every public function takes and returns a Spark ``DataFrame`` (or a
``Column`` for the scalar helpers in :mod:`barquet.functions`). The main
entry points are re-exported here.
"""

from barquet.session import get_spark, materialize, sizing_conf, work_dir

__all__ = ["get_spark", "materialize", "sizing_conf", "work_dir",
           "daily_report", "morning_report", "extract", "latest_report", "write_report",
           "read_close_series", "analyze_series"]


def __getattr__(name):  # lazy, so importing the package does not import every module
    if name in ("daily_report", "morning_report"):
        from barquet.plans import reports
        return getattr(reports, name)
    if name in ("extract", "latest_report", "write_report", "read_close_series"):
        from barquet.sources import files
        return getattr(files, name)
    if name == "analyze_series":
        from barquet.plans.analytics import analyze_series
        return analyze_series
    raise AttributeError(name)
