"""Time the headline queries; print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8). Each query is forced with the no-op sink, which runs the
whole plan (every column, every row) without collecting to the driver.
A warm-up pass on the smallest tables pays JVM start-up and code
generation before timing.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barquet import get_spark  # noqa: E402
from barquet.plans import registry  # noqa: E402

HEADLINE = [
    "d1_daily_report",
    "d1_daily_report_wide",
    "d2_morning_report",
    "d2_morning_report_wide",
    "w1_w2_attach_open_close",
    "d8_explore_dirty",
    "m1_open_close_ols",
    "m1b_linregress",
    "w6_lag_windows",
    "m2_minmax_scale",
    "m6b_ar1_forecast",
    "m6_arma11_forecast",
    "m6_arma11_forecast_css",
    "m6_arma11_forecast_likelihood",
    "m7_one_class_flags",
    "d6_analyze_series_chart",
    "d7_lag_forecast",
]


def run(spark, name: str, sf: str) -> float:
    t0 = time.perf_counter()
    registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                      extra={"spark.driver.memory": "16g"})
    names = [n for n in HEADLINE if n in registry.QUERIES]
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for n in names if os.path.isdir(warm) else []:
        try:
            run(spark, n, warm)
        except Exception as e:  # noqa: BLE001 - reported below with the timed run
            print(f"warm-up of {n} failed: {e}", file=sys.stderr)
    times: dict[str, float | None] = {}
    for n in names:
        try:
            times[n] = round(run(spark, n, sf), 3)
        except Exception as e:  # noqa: BLE001 - a failed query is reported as null, never hidden
            print(f"{n} failed: {e}", file=sys.stderr)
            times[n] = None
    m = re.search(r"sf([0-9.]+)", sf)
    done = [t for t in times.values() if t is not None]
    print(json.dumps({"metric": "headline_total", "value": round(sum(done), 3), "unit": "sec",
                      "queries": times, "failed": [n for n, t in times.items() if t is None],
                      "sf": float(m.group(1)) if m else sf}))


if __name__ == "__main__":
    main()
