"""Summarise a Spark event log per job group: jobs, stages, tasks, task time, shuffle bytes.

Usage: python tools/eventlog_summary.py <event log dir or file>

Run the queries with ``spark.eventLog.enabled=true`` and
``spark.eventLog.dir`` set to a fresh scratch folder, and call
``sparkContext.setJobGroup(name, name)`` before each query.
"""

from __future__ import annotations

import collections
import glob
import io
import json
import os
import sys


def _lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "**", "events_*"), recursive=True)) if os.path.isdir(path) else [path]
    for f in files:
        raw = open(f, "rb")
        if f.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(raw)
        yield from io.TextIOWrapper(raw, encoding="utf-8")


def summarise(path: str) -> dict[str, dict]:
    stage_group: dict[int, str] = {}
    job_start: dict[int, tuple[str, int]] = {}
    out: dict[str, dict] = collections.defaultdict(
        lambda: {"jobs": 0, "stages": set(), "tasks": 0, "task_ms": 0, "max_task_ms": 0, "job_ms": 0,
                 "shuffle_write_bytes": 0})
    for line in _lines(path):
        e = json.loads(line)
        ev = e.get("Event")
        if ev == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            if g:
                job_start[e["Job ID"]] = (g, e["Submission Time"])
                out[g]["jobs"] += 1
                for s in e.get("Stage IDs", []):
                    stage_group[s] = g
        elif ev == "SparkListenerJobEnd" and e["Job ID"] in job_start:
            g, t0 = job_start[e["Job ID"]]
            out[g]["job_ms"] += e["Completion Time"] - t0
        elif ev == "SparkListenerTaskEnd" and e["Stage ID"] in stage_group:
            g = stage_group[e["Stage ID"]]
            m = e.get("Task Metrics") or {}
            rt = m.get("Executor Run Time", 0)
            rec = out[g]
            rec["stages"].add(e["Stage ID"])
            rec["tasks"] += 1
            rec["task_ms"] += rt
            rec["max_task_ms"] = max(rec["max_task_ms"], rt)
            rec["shuffle_write_bytes"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
    return out


def main() -> None:
    for g, r in summarise(sys.argv[1]).items():
        print(f"{g:28s} jobs={r['jobs']:3d} stages={len(r['stages']):3d} tasks={r['tasks']:5d} "
              f"task_ms={r['task_ms']:7d} max_task_ms={r['max_task_ms']:6d} job_ms={r['job_ms']:7d} "
              f"shuffle_write_kb={r['shuffle_write_bytes'] // 1024}")


if __name__ == "__main__":
    main()
