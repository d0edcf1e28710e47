"""Dated CSV trees, by-name reads and the report store."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from barquet.plans.etl import run_daily
from barquet.sources.files import (day_paths_since, extract, latest_report, list_reports, read_csv_by_name,
                                   read_csv_strict, report_stamps, write_dated_csv, write_report)
from barquet.sources.schemas import BAR_SCHEMA


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


HDR = "ISIN,Mnemonic,Date,Time,StartPrice,MaxPrice,MinPrice,EndPrice,TradedVolume\n"


def test_files_by_date_and_lookback(spark):
    base = tempfile.mkdtemp(prefix="bq-days-")
    for d in ("2022-12-29", "2022-12-30", "2022-12-31"):
        _write(f"{base}/{d}/f.csv", HDR + f"A,X,{d},09:00,1,2,0.5,1.5,10\n")
    assert [p.rsplit("/", 1)[1] for p in day_paths_since(spark, base, "2022-12-30")] == ["2022-12-30", "2022-12-31"]
    got = sorted(r.Date for r in extract(spark, base, "2022-12-31", lookback_days=1).collect())
    assert got == ["2022-12-30", "2022-12-31"]
    with pytest.raises(FileNotFoundError):
        extract(spark, base, "2023-02-01")


def test_non_date_key_raises(spark):
    base = tempfile.mkdtemp(prefix="bq-bad-")
    _write(f"{base}/misc/f.csv", HDR)
    with pytest.raises(ValueError):
        day_paths_since(spark, base, "2022-01-01")


def test_reordered_header_by_name_and_strict(spark):
    base = tempfile.mkdtemp(prefix="bq-hdr-")
    _write(f"{base}/2024-01-01/a.csv", HDR + "A,X,2024-01-01,09:00,1,2,0.5,1.5,10\n")
    _write(f"{base}/2024-01-01/b.csv", "Time,ISIN,Date,EndPrice\n10:00,B,2024-01-01,NA\n11:00,B,2024-01-01,7.5\n")
    rows = {(r.ISIN, r.Time): r for r in read_csv_by_name(spark, [f"{base}/2024-01-01"]).collect()}
    assert rows[("A", "09:00")].EndPrice == 1.5 and rows[("A", "09:00")].TradedVolume == 10
    assert rows[("B", "10:00")].EndPrice is None  # bad number reads as NULL
    assert rows[("B", "11:00")].EndPrice == 7.5 and rows[("B", "11:00")].StartPrice is None
    with pytest.raises(Exception):
        read_csv_strict(spark, [f"{base}/2024-01-01/b.csv"], BAR_SCHEMA).collect()


def test_dated_tree_round_trip_and_latest_report(spark):
    root = tempfile.mkdtemp(prefix="bq-rt-")
    bars = spark.createDataFrame(
        [("A", "2024-01-0%d" % d, "09:00", 1.0 * d, 2.0 * d, 0.5, 1.5 * d, d) for d in (1, 2, 3)],
        "ISIN string, Date string, Time string, StartPrice double, MaxPrice double, MinPrice double, "
        "EndPrice double, TradedVolume bigint")
    src = write_dated_csv(bars, f"{root}/landing")
    assert sorted(n for n in os.listdir(src) if not n.startswith(("_", "."))) == \
        ["2024-01-01", "2024-01-02", "2024-01-03"]
    path, latest = run_daily(spark, src, f"{root}/reports", "2024-01-03", run_ts="20230217_232455")
    assert path.endswith("report_ts=20230217_232455")
    rows = latest.collect()
    assert [(r["index"], r.Date, r["change_prev_closing_%"]) for r in rows] == [(1, "2024-01-03", 50.0)]
    write_report(latest.withColumn("ISIN", F.lit("Z")), f"{root}/reports", "20230328_000509")
    assert report_stamps(spark, f"{root}/reports") == ["20230217_232455", "20230328_000509"]
    assert [r.ISIN for r in latest_report(spark, f"{root}/reports").collect()] == ["Z"]
    assert list_reports(spark, f"{root}/reports").count() == 2
    plan = latest_report(spark, f"{root}/reports")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "20230328_000509" in plan


def test_close_series_file_order_and_bom(spark):
    base = tempfile.mkdtemp(prefix="bq-close-")
    vals_a = [11.6, 12.0, 11.9, 13.25, 12.5]
    with open(f"{base}/Some Stock.csv", "w", encoding="utf-8-sig") as f:
        f.write("Close\n" + "\n".join(str(v) for v in vals_a) + "\n")
    with open(f"{base}/Other.csv", "w", encoding="utf-8-sig") as f:
        f.write("Close\n3.0\nNA\n1.0\n")
    from barquet.sources.files import read_close_series, sample_header
    rows = read_close_series(spark, base).collect()
    got = {}
    for r in rows:
        got.setdefault(r.series_id, {})[r.idx] = r.Close
    assert got["Some Stock"] == dict(enumerate(vals_a))
    assert got["Other"] == {0: 3.0, 1: None, 2: 1.0}
    assert sample_header(spark, base) == ["Close"]


def test_dense_index_per_key(spark):
    from barquet.operators.ordering import with_dense_index
    df = spark.range(0, 500).selectExpr("id % 3 as k", "id")
    out = with_dense_index(df, ["id"], name="i", partition_cols=["k"], partitions=7).collect()
    for k in range(3):
        ids = sorted((r.i, r.id) for r in out if r.k == k)
        assert [i for i, _ in ids] == list(range(len(ids)))
        assert [x for _, x in ids] == sorted(x for _, x in ids)


def test_check_header_and_day_paths(spark):
    from barquet.sources.files import check_header, day_paths_for
    base = tempfile.mkdtemp(prefix="bq-chk-")
    _write(f"{base}/2024-01-01/a.csv", "Time,ISIN\n09:00,A\n")
    with pytest.raises(ValueError):
        check_header(spark, base)
    assert day_paths_for("s3a://b/", ["2024-01-01", "2024-01-02"]) == ["s3a://b/2024-01-01", "s3a://b/2024-01-02"]


def test_by_name_read_with_bom_header(spark):
    base = tempfile.mkdtemp(prefix="bq-bom-")
    os.makedirs(f"{base}/2024-01-01")
    with open(f"{base}/2024-01-01/a.csv", "w", encoding="utf-8-sig") as f:
        f.write("ISIN,Date,Time,EndPrice\nA,2024-01-01,09:00,1.5\n")
    r = read_csv_by_name(spark, [f"{base}/2024-01-01"]).collect()[0]
    assert (r.ISIN, r.Time, r.EndPrice) == ("A", "09:00", 1.5)


def test_by_name_files_of_several_layouts(spark):
    base = tempfile.mkdtemp(prefix="bq-lay-")
    _write(f"{base}/2024-01-01/a.csv", HDR + "A,X,2024-01-01,09:00,1,2,0.5,1.5,10\n")
    _write(f"{base}/2024-01-01/b.csv", "Time,ISIN,Date,EndPrice\n10:00,B,2024-01-01,NA\n11:00,B,2024-01-01,7.5\n")
    _write(f"{base}/2024-01-02/c.csv", "Time,ISIN,Date,EndPrice\n10:30,C,2024-01-02,3.25\n")
    src = [f"{base}/2024-01-01", f"{base}/2024-01-02"]
    got = sorted((r.ISIN, r.Time, r.EndPrice) for r in read_csv_by_name(spark, src).collect())
    assert got == [("A", "09:00", 1.5), ("B", "10:00", None), ("B", "11:00", 7.5), ("C", "10:30", 3.25)]


def test_run_morning_with_model(spark):
    from barquet.plans.etl import run_morning_with_model
    root = tempfile.mkdtemp(prefix="bq-rmm-")
    lines = []
    for i, isin in enumerate(["A", "B", "C"]):
        for d in ("2022-12-30", "2022-12-31"):
            lines.append(f"{isin},X,{d},09:00,{10 + i},{12 + i},{9 + i},{11 + 2 * i},5\n")
    _write(f"{root}/src/2022-12-30/a.csv", HDR + "".join(l for l in lines if "12-30" in l))
    _write(f"{root}/src/2022-12-31/a.csv", HDR + "".join(l for l in lines if "12-31" in l))
    path, stored, model = run_morning_with_model(spark, f"{root}/src", f"{root}/rep", "2022-12-31",
                                                 run_ts="20230328_000509")
    assert path.endswith("report_ts=20230328_000509") and stored.count() == 6
    m = model.collect()[0]
    assert (m.n, round(m.slope, 9), round(m.intercept, 9), round(m.r2, 9)) == (3, 2.0, -9.0, 1.0)


def test_run_morning_and_read_report(spark):
    from barquet.plans.etl import run_morning
    from barquet.sources.files import read_report
    root = tempfile.mkdtemp(prefix="bq-rm-")
    _write(f"{root}/src/2024-01-02/a.csv", HDR + "A,X,2024-01-02,09:00,1,2,0.5,1.5,10\nA,X,2024-01-02,13:00,2,3,1,2.5,4\n")
    path, latest = run_morning(spark, f"{root}/src", f"{root}/rep", "2024-01-02", run_ts="20240102_120000")
    r = latest.collect()[0]
    assert (r.start_price, r.end_price, r.daily_traded_volume) == (1.0, 2.5, 10)
    back = read_report(spark, path).collect()[0]
    assert back.end_price_mx == 2.5 * 19.08


def test_by_name_paths_with_spaces_and_files_without_header(spark):
    base = tempfile.mkdtemp(prefix="bq sp ")
    _write(f"{base}/2024-01-01/a file.csv", HDR + "A,X,2024-01-01,09:00,1,2,0.5,1.5,10\n")
    _write(f"{base}/2024-01-01/b.csv", "Time,ISIN,Date,EndPrice\n10:00,B,2024-01-01,NA\n11:00,B,2024-01-01,7.5\n")
    _write(f"{base}/2024-01-02/c.csv", "Time,ISIN,Date,EndPrice\n10:30,C,2024-01-02,3.25\n")
    src = [f"{base}/2024-01-01", f"{base}/2024-01-02"]
    got = sorted((r.ISIN, r.Time, r.EndPrice) for r in read_csv_by_name(spark, src).collect())
    assert got == [("A", "09:00", 1.5), ("B", "10:00", None), ("B", "11:00", 7.5), ("C", "10:30", 3.25)]
    _write(f"{base}/2024-01-02/junk.csv", "no header here\n1,2,3\n")
    with pytest.raises(ValueError, match="junk.csv"):
        read_csv_by_name(spark, src)


def test_wide_files_long_headers_and_cells_equal_to_names(spark):
    base = tempfile.mkdtemp(prefix="bq-wide-")
    extra = [f"a_rather_long_name_of_an_extra_column_{i}" for i in range(3000)]
    assert len(",".join(extra)) > 65536
    _write(f"{base}/2024-01-01/a.csv", ",".join([*extra, "ISIN", "Date", "Time", "EndPrice"]) + "\n" + "x," * 3000 + "A,2024-01-01,09:00,1.5\n")
    _write(f"{base}/2024-01-01/b.csv", "ISIN,Date,Time,Mnemonic,EndPrice\nISIN,2024-01-01,Time,Date,2.5\n")
    _write(f"{base}/2024-01-01/c.csv", "EndPrice,other\n3.5,9\n")
    got = sorted((r.EndPrice, r.ISIN, r.Mnemonic) for r in read_csv_by_name(spark, [f"{base}/2024-01-01"]).collect())
    assert got == [(1.5, "A", None), (2.5, "ISIN", "Date"), (3.5, None, None)]


def test_every_source_column_can_be_asked_for(spark):
    from barquet.sources.files import extract
    base = tempfile.mkdtemp(prefix="bq-every-")
    _write(f"{base}/2024-01-02/a.csv", "ISIN,Date,Time,EndPrice,Unused\nA,2024-01-02,09:00,1,x\nB,2024-01-02,09:00,1,\nC,2024-01-02,09:00,NA,x\n")
    _write(f"{base}/2024-01-02/b.csv", "ISIN,Date,Time,EndPrice\nD,2024-01-02,09:00,1\n")
    assert sorted(r.ISIN for r in extract(spark, base, "2024-01-02", every_column=True).collect()) == ["A", "D"]
    assert extract(spark, base, "2024-01-02").count() == 4


def test_close_column_by_name_and_equal_file_names(spark):
    from barquet.sources.files import read_close_series
    base = tempfile.mkdtemp(prefix="bq-close-")
    _write(f"{base}/x/A.csv", "Date,Close\n2024-01-01,1.5\n2024-01-02,2.5\n")
    _write(f"{base}/y/A.csv", "Close,Volume\n7,1\n")
    _write(f"{base}/y/B.csv", "Close\n9\n")
    got = sorted(tuple(r) for r in read_close_series(spark, [f"{base}/x", f"{base}/y"]).collect())
    assert got == [("x/A", 0, 1.5), ("x/A", 1, 2.5), ("y/A", 0, 7.0), ("y/B", 0, 9.0)]
    assert sorted({r.series_id for r in read_close_series(spark, f"{base}/y").collect()}) == ["A", "B"]
    _write(f"{base}/z/C.csv", "Date,Open\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="Close"):
        read_close_series(spark, f"{base}/z")


def test_command_line_daily_and_series(spark, capsys):
    from barquet.__main__ import main
    root = tempfile.mkdtemp(prefix="bq-cli-")
    for d in ("2022-12-30", "2022-12-31"):
        _write(f"{root}/src/{d}/a.csv", HDR + f"A,X,{d},09:00,10,11,9,10.5,5\n")
    assert main(["daily", "--source", f"{root}/src", "--reports", f"{root}/rep", "--date", "2022-12-31",
                 "--run-ts", "20230101_000000"]) == 0
    assert "report_ts=20230101_000000" in capsys.readouterr().out
    os.makedirs(f"{root}/closes")
    with open(f"{root}/closes/S.csv", "w") as f:
        f.write("Close\n" + "\n".join(str(50 + (i % 7) * 0.3 + (i % 3) * 0.1) for i in range(80)) + "\n")
    assert main(["series", "--closes", f"{root}/closes", "--out", f"{root}/out", "--days", "2", "--nu", "0.1"]) == 0
    assert spark.read.parquet(f"{root}/out/forecast").count() == 3


def test_by_name_read_of_gzip_files(spark):
    import gzip
    base = tempfile.mkdtemp(prefix="bq-gz-")
    os.makedirs(f"{base}/2024-01-01")
    with gzip.open(f"{base}/2024-01-01/a.csv.gz", "wt") as f:
        f.write("Time,ISIN,Date,EndPrice\n10:00,G,2024-01-01,2.5\n")
    rows = read_csv_by_name(spark, [f"{base}/2024-01-01"]).collect()
    assert [(r.ISIN, r.Time, r.EndPrice) for r in rows] == [("G", "10:00", 2.5)]


def test_named_report_layout(spark):
    from barquet.sources.files import latest_report, report_stamps, write_report
    root = tempfile.mkdtemp(prefix="bq-named-")
    a = spark.createDataFrame([("A", 1.0)], "ISIN string, v double")
    b = spark.createDataFrame([("B", 2.0)], "ISIN string, v double")
    p1 = write_report(a, root, "20230217_232455", layout="named", prefix="xr_")
    write_report(b, root, "20230328_000509", layout="named", prefix="xr_")
    assert p1.endswith("/xr_20230217_232455.parquet")
    assert report_stamps(spark, root, layout="named", prefix="xr_") == ["20230217_232455", "20230328_000509"]
    got = latest_report(spark, root, keep_stamp=True, layout="named", prefix="xr_").collect()
    assert [(r.ISIN, r.report_ts) for r in got] == [("B", "20230328_000509")]
    with pytest.raises(Exception):
        write_report(b, root, "20230328_000509", layout="named", prefix="xr_")


def test_command_line_morning_and_stream(spark, capsys):
    from barquet.__main__ import main
    root = tempfile.mkdtemp(prefix="bq-cli2-")
    for i, d in enumerate(("2022-12-30", "2022-12-31")):
        _write(f"{root}/src/{d}/a.csv", HDR + f"A,X,{d},09:00,{10 + i},12,9,{11 + i},5\n"
               + f"B,Y,{d},09:30,{20 + i},22,19,{23 + i},2\n")
    assert main(["morning", "--source", f"{root}/src", "--reports", f"{root}/rep", "--date", "2022-12-31",
                 "--run-ts", "20230101_000000"]) == 0
    out = capsys.readouterr().out
    assert "report_ts=20230101_000000" in out and "slope" in out
    assert main(["stream-daily", "--source", f"{root}/src", "--table", f"{root}/daily",
                 "--checkpoint", f"{root}/ckpt"]) == 0
    from barquet.streaming.incremental import report_from_daily_table, report_from_morning_table
    assert report_from_daily_table(spark, f"{root}/daily").count() == 4
    assert main(["stream-morning", "--source", f"{root}/src", "--table", f"{root}/morning",
                 "--checkpoint", f"{root}/ckpt2", "--late-days", "-1"]) == 0
    assert report_from_morning_table(spark, f"{root}/morning").count() == 4


def test_command_line_models_on_the_stored_report(spark):
    from barquet.__main__ import main
    from barquet.plans.reports import morning_report
    from barquet.sources import fixtures as fx
    from barquet.sources.files import write_report
    root = tempfile.mkdtemp(prefix="bq-models-")
    path = write_report(morning_report(fx.trades(spark, "/root/testdata/sf0.001")), f"{root}/rep", "20240110_180000")
    assert main(["models", "--report", path, "--csv", f"{root}/csv", "--out", f"{root}/out"]) == 0
    assert spark.read.parquet(f"{root}/out/later").count() > 0 and spark.read.parquet(f"{root}/out/regression").count() == 1


def test_missing_tokens_like_pandas(spark):
    import pandas as pd
    base = tempfile.mkdtemp(prefix="bq-na-")
    text = ("ISIN,Date,Time,StartPrice,MaxPrice,MinPrice,EndPrice,TradedVolume\n"
            "NA,2024-01-01,09:00,1,2,0.5,1.5,10\nA,2024-01-01,null,1,2,0.5,1.5,10\n"
            "B,2024-01-01,09:05,1,2,0.5,N/A,10\nC,2024-01-01,09:07,1,2,0.5,1.5,10\n")
    _write(f"{base}/2024-01-01/a.csv", text)
    from barquet.operators.bars import drop_missing
    want = pd.read_csv(f"{base}/2024-01-01/a.csv").dropna()
    for reader in (lambda: read_csv_by_name(spark, [f"{base}/2024-01-01"]),
                   lambda: read_csv_strict(spark, [f"{base}/2024-01-01"], _schema8())):
        got = drop_missing(reader()).select("ISIN").collect()
        assert [r.ISIN for r in got] == list(want["ISIN"]) == ["C"]


def _schema8():
    from pyspark.sql.types import StructType
    return StructType([f for f in BAR_SCHEMA.fields if f.name != "Mnemonic"])


def _records_read(spark, since):
    """Input records of the stages that started after the given one."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()) if stages.apply(i).stageId() > since)


def _last_stage(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return max([stages.apply(i).stageId() for i in range(stages.size())], default=-1)


def test_header_step_takes_one_line_of_each_file(spark, tmp_path):
    from barquet.sources.files import _header_lines, _layout_paths, read_csv_by_name
    n = 200_000
    for day, names in (("2024-01-01", ["a", "b"]), ("2024-01-02", ["c"]), ("2024-01-03", ["d"])):
        (tmp_path / day).mkdir()
        for name in names:
            head = "Time,EndPrice\n" if name in "ac" else "EndPrice,Time,More\n"
            row = "09:00,{}\n" if name in "ac" else "{},09:00,x\n"
            with open(tmp_path / day / f"{name}.csv", "w") as f:
                f.write(head + "".join(row.format(i) for i in range(n)))
    (tmp_path / "2024-01-02" / "empty.csv").write_text("")
    paths = [str(p) for p in sorted(tmp_path.iterdir())]
    since = _last_stage(spark)
    headers = _header_lines(spark, paths)
    rows = {f.rsplit("/", 1)[1]: line for f, line in headers.items()}
    assert rows == {"a.csv": "Time,EndPrice", "b.csv": "EndPrice,Time,More", "c.csv": "Time,EndPrice", "d.csv": "EndPrice,Time,More"}
    assert _records_read(spark, since) == 0  # no job: a line of each file, through its file system
    held = _layout_paths(headers, paths)
    ends = {k: sorted(p.rsplit("/", 1)[1] for p in v) for k, v in held.items()}
    assert ends == {"Time,EndPrice": ["2024-01-02", "a.csv"], "EndPrice,Time,More": ["2024-01-03", "b.csv"]}  # whole folders, and files of the mixed one
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    schema = StructType([StructField("Time", StringType()), StructField("EndPrice", DoubleType())])
    got = read_csv_by_name(spark, paths, schema).groupBy().agg({"EndPrice": "sum", "Time": "count"}).collect()[0]
    assert sorted(got) == sorted([4 * n, 4 * n * (n - 1) / 2])
    assert _records_read(spark, since) == 4 * n  # the data once, whatever the number of layouts
