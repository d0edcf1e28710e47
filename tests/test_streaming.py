"""Incremental daily aggregation over a dated file tree (late files included)."""

import os
import tempfile

from barquet.plans.reports import daily_report, morning_report
from barquet.streaming.incremental import (report_from_daily_table, report_from_morning_table,
                                            start_daily_aggregation, start_morning_aggregation)

HDR = "ISIN,Mnemonic,Date,Time,StartPrice,MaxPrice,MinPrice,EndPrice,TradedVolume\n"


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(HDR + "".join(lines))


def test_incremental_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="bq-stream-")
    src, table, ckpt = f"{root}/src", f"{root}/daily", f"{root}/ckpt"
    _write(f"{src}/2024-01-01/a.csv", ["A,X,2024-01-01,09:00,10,11,9,10.5,5\n", "B,Y,2024-01-01,09:00,20,21,19,20,1\n"])
    _write(f"{src}/2024-01-02/a.csv", ["A,X,2024-01-02,09:30,10.5,12,10,11,7\n"])
    q = start_daily_aggregation(spark, src, table, ckpt)
    q.awaitTermination()
    first = {(r.ISIN, r.Date): r for r in report_from_daily_table(spark, table).collect()}
    assert first[("A", "2024-01-02")]["change_prev_closing_%"] == round((11 - 10.5) / 10.5 * 100, 2)

    # a new day and a late file for 2024-01-02 (earlier open, later close)
    _write(f"{src}/2024-01-03/a.csv", ["A,X,2024-01-03,10:00,11,11,11,11,1\n"])
    _write(f"{src}/2024-01-02/b.csv", ["A,X,2024-01-02,08:00,9,13,8,9.5,2\n", "A,X,2024-01-02,17:00,12,12,12,12.5,1\n"])
    q = start_daily_aggregation(spark, src, table, ckpt)
    q.awaitTermination()
    got = sorted(tuple(r) for r in report_from_daily_table(spark, table).collect())

    bars = spark.read.option("header", True).schema(
        "ISIN string, Mnemonic string, Date string, Time string, StartPrice double, MaxPrice double, "
        "MinPrice double, EndPrice double, TradedVolume bigint").csv(f"{src}/*")
    want = sorted(tuple(r) for r in daily_report(bars, with_index=False).collect())
    assert got == want
    row = [r for r in got if r[0] == "A" and r[1] == "2024-01-02"][0]
    assert row[2:7] == (9.0, 12.5, 8.0, 13.0, 10)


def test_watermarked_run(spark):
    root = tempfile.mkdtemp(prefix="bq-stream-wm-")
    src, table, ckpt = f"{root}/src", f"{root}/daily", f"{root}/ckpt"
    _write(f"{src}/2024-01-01/a.csv", ["A,X,2024-01-01,09:00,10,11,9,10.5,5\n"])
    _write(f"{src}/2024-01-05/a.csv", ["A,X,2024-01-05,09:00,11,12,10,11.5,5\n"])
    q = start_daily_aggregation(spark, src, table, ckpt, late_days=2)
    q.awaitTermination()
    rows = report_from_daily_table(spark, table).collect()
    assert [(r.Date, r.closing_price_eur) for r in rows] == [("2024-01-01", 10.5), ("2024-01-05", 11.5)]


def test_incremental_morning_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="bq-stream-m-")
    src, table, ckpt = f"{root}/src", f"{root}/morning", f"{root}/ckpt"
    _write(f"{src}/2024-01-01/a.csv", ["A,X,2024-01-01,07:59,10,11,9,10.5,5\n", "A,X,2024-01-01,13:00,10,11,9,9.5,5\n"])
    start_morning_aggregation(spark, src, table, ckpt).awaitTermination()
    assert not os.path.exists(table) or report_from_morning_table(spark, table).count() == 0
    _write(f"{src}/2024-01-01/b.csv", ["A,X,2024-01-01,09:00,10,12,8,11,3\n"])
    _write(f"{src}/2024-01-02/a.csv", ["B,Y,2024-01-02,10:00,20,21,19,20,1\n"])
    start_morning_aggregation(spark, src, table, ckpt).awaitTermination()
    got = sorted(tuple(r) for r in report_from_morning_table(spark, table).collect())
    bars = spark.read.option("header", True).schema(
        "ISIN string, Mnemonic string, Date string, Time string, StartPrice double, MaxPrice double, "
        "MinPrice double, EndPrice double, TradedVolume bigint").csv(f"{src}/*")
    want = sorted(tuple(r) for r in morning_report(bars).collect())
    assert got == want and len(got) == 2


def test_watermark_drops_bars_older_than_the_allowed_lateness(spark):
    root = tempfile.mkdtemp(prefix="bq-stream-late-")
    src, table, ckpt = f"{root}/src", f"{root}/daily", f"{root}/ckpt"
    _write(f"{src}/2024-01-01/a.csv", ["A,X,2024-01-01,09:00,10,11,9,10.5,5\n"])
    _write(f"{src}/2024-01-05/a.csv", ["A,X,2024-01-05,09:00,11,12,10,11.5,5\n"])
    start_daily_aggregation(spark, src, table, ckpt, late_days=1).awaitTermination()
    # a bar for 2024-01-01 arrives after the watermark (2024-01-04) has passed it, and one within lateness
    _write(f"{src}/2024-01-01/late.csv", ["A,X,2024-01-01,17:00,99,99,99,99,1\n"])
    _write(f"{src}/2024-01-05/late.csv", ["A,X,2024-01-05,17:00,12,13,12,12.5,1\n"])
    start_daily_aggregation(spark, src, table, ckpt, late_days=1).awaitTermination()
    rows = {r.Date: r for r in report_from_daily_table(spark, table).collect()}
    assert rows["2024-01-01"].closing_price_eur == 10.5 and rows["2024-01-01"].daily_traded_volume == 5
    assert rows["2024-01-05"].closing_price_eur == 12.5 and rows["2024-01-05"].daily_traded_volume == 6


def test_upsert_without_success_markers_keeps_other_securities(spark):
    import tempfile

    from barquet.streaming.incremental import DAILY_TABLE_DDL, upsert_days
    path = tempfile.mkdtemp(prefix="bq-up-") + "/daily"
    row = lambda isin, day, close: (isin, 1.0, close, 0.5, 2.0, 10, day)
    spark._jsc.hadoopConfiguration().set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        upsert_days(spark.createDataFrame([row("A", "2024-01-01", 1.0), row("B", "2024-01-01", 2.0), row("A", "2024-01-02", 5.0)], DAILY_TABLE_DDL), path)
        upsert_days(spark.createDataFrame([row("A", "2024-01-01", 3.0)], DAILY_TABLE_DDL), path)
    finally:
        spark._jsc.hadoopConfiguration().unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    got = sorted((r.ISIN, r.Date, r.closing_price_eur) for r in spark.read.schema(DAILY_TABLE_DDL).parquet(path).collect())
    assert got == [("A", "2024-01-01", 3.0), ("A", "2024-01-02", 5.0), ("B", "2024-01-01", 2.0)]


def test_a_run_that_dies_while_days_change_places_loses_nothing(spark, monkeypatch):
    from barquet.streaming import incremental
    from barquet.streaming.incremental import DAILY_TABLE_DDL, recover, upsert_days
    row = lambda isin, day, close: (isin, 1.0, close, 0.5, 2.0, 10, day)
    first = [row("A", "2024-01-01", 1.0), row("B", "2024-01-01", 2.0), row("A", "2024-01-02", 5.0), row("C", "2024-01-03", 9.0)]
    second = [row("A", "2024-01-01", 3.0), row("A", "2024-01-02", 6.0)]
    want = [("A", "2024-01-01", 3.0), ("A", "2024-01-02", 6.0), ("B", "2024-01-01", 2.0), ("C", "2024-01-03", 9.0)]
    old = [("A", "2024-01-01", 1.0), ("A", "2024-01-02", 5.0), ("B", "2024-01-01", 2.0), ("C", "2024-01-03", 9.0)]
    read = lambda path: sorted((r.ISIN, r.Date, r.closing_price_eur) for r in spark.read.schema(DAILY_TABLE_DDL).parquet(path).collect())
    for dies_at in range(5):  # at the journal entry; and before or after a day's removal or move
        path = tempfile.mkdtemp(prefix="bq-die-") + "/daily"
        upsert_days(spark.createDataFrame(first, DAILY_TABLE_DDL), path)
        left = [dies_at]

        class Dying(incremental._Folders):
            def _count(self):
                if left[0] == 0:
                    left[0] = -1
                    raise KeyboardInterrupt
                left[0] -= 1

            def drop(self, *parts):
                if parts[0].startswith("Date="):
                    super().drop(*parts)
                    self._count()
                else:
                    super().drop(*parts)

            def move(self, source, target):
                self._count()
                super().move(source, target)
        with monkeypatch.context() as m:
            m.setattr(incremental, "_Folders", Dying)
            try:
                upsert_days(spark.createDataFrame(second, DAILY_TABLE_DDL), path)
            except KeyboardInterrupt:
                pass
        journalled = recover(spark, path)
        assert (left[0] == -1) and len(journalled) == (dies_at > 0)
        assert read(path) == (want if journalled else old)
        upsert_days(spark.createDataFrame(second, DAILY_TABLE_DDL), path)  # the replayed batch
        assert read(path) == want and not any(os.path.exists(f"{path}/{d}") and os.listdir(f"{path}/{d}") for d in ("_aside", "_journal"))


def test_late_bars_are_counted(spark):
    from barquet.streaming.incremental import late_bars
    root = tempfile.mkdtemp(prefix="bq-stream-count-")
    src, table, ckpt = f"{root}/src", f"{root}/daily", f"{root}/ckpt"
    _write(f"{src}/2024-01-01/a.csv", ["A,X,2024-01-01,09:00,10,11,9,10.5,5\n"])
    _write(f"{src}/2024-01-09/a.csv", ["A,X,2024-01-09,09:00,11,12,10,11.5,5\n"])
    q = start_daily_aggregation(spark, src, table, ckpt, late_days=1)
    q.awaitTermination()
    assert late_bars(q) == 0
    _write(f"{src}/2024-01-01/late.csv", ["A,X,2024-01-01,17:00,99,99,99,99,1\n", "B,X,2024-01-01,17:00,99,99,99,99,1\n"])
    q = start_daily_aggregation(spark, src, table, ckpt, late_days=1)
    q.awaitTermination()
    assert late_bars(q) >= 1
