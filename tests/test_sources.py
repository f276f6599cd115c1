import json
import struct
import xml.etree.ElementTree as ET

import numpy as np

from tapeloom.render import chart
from tapeloom.sources import sinks
from tapeloom.sources.daybars import RECORD, DayBars, close_series, last_dates, read_day_bars
from tapeloom.sources.sync import sync_files
from tapeloom.sources.small_files import read_dbase, read_industries, read_names, read_snapshot


def day_file(path, rows):
    path.write_bytes(np.array(rows, RECORD).tobytes())


def test_day_files_both_ways(spark, tmp_path):
    day_file(tmp_path / "sh600000.day", [(20240102, 1000, 1110, 990, 1100, 5e6, 700, 0), (20240103, 1100, 1200, 1050, 1150, 6e6, 800, 0)])
    (tmp_path / "sz000001.day").write_bytes(b"")
    (tmp_path / "bj920001.day").write_bytes(np.array([(20240102, 1, 2, 1, 2, 1.5, 3, 0)], RECORD).tobytes() + b"rest")
    spark.dataSource.register(DayBars)
    one = spark.read.format("daybars").option("filesPerTask", 1).load(str(tmp_path / "*.day"))
    two = read_day_bars(spark, str(tmp_path / "*.day"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    got = {(r.stem, str(r.date)): r for r in one.collect()}
    assert len(got) == 3 and got[("sh600000", "2024-01-02")].close == 11.0 and got[("sh600000", "2024-01-03")].amount == 6e6
    assert {r.stem: str(r.last_date) for r in last_dates(spark, str(tmp_path / "*.day")).collect()} == {"sh600000": "2024-01-03", "bj920001": "None"}


def test_series_and_sync(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, close in (("sh000001", 300), ("sz399006", 200)):
        day_file(tmp_path / "a" / f"{name}.day", [(20240103, 1, 2, 1, close + 1, 1.0, 1, 0), (20240102, 1, 2, 1, close, 1.0, 1, 0)])
    bars = read_day_bars(spark, str(tmp_path / "a" / "*.day"))
    assert [(str(r.date), r.close) for r in close_series(bars, "sz399006").collect()] == [("2024-01-02", 2.0), ("2024-01-03", 2.01)]
    copy = lambda: {r.path[-12:]: r.copied for r in sync_files(spark, str(tmp_path / "a" / "*.day"), str(tmp_path / "b"), 1).collect()}
    assert copy() == {"sh000001.day": True, "sz399006.day": True} and copy() == {"sh000001.day": False, "sz399006.day": False}
    day_file(tmp_path / "a" / "sh000001.day", [(20240104, 1, 2, 1, 9, 1.0, 1, 0)])
    assert copy() == {"sh000001.day": True, "sz399006.day": False}
    assert (tmp_path / "b" / "sh000001.day").read_bytes() == (tmp_path / "a" / "sh000001.day").read_bytes() and len(list((tmp_path / "b").iterdir())) == 2


def test_dbase_names_and_industries(spark, tmp_path):
    fields = [(b"SC", 1), (b"GPDM", 6), (b"ZGB", 8)]
    head = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, 3, 32 + 32 * len(fields) + 1, 1 + 15)
    head += b"".join(n.ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([k]) + b"\0" * 15 for n, k in fields) + b"\r"
    (tmp_path / "base.dbf").write_bytes(head + b" 1600000 123.450" + b"*0000001   9.000" + b" 0000002        ")
    assert [tuple(r) for r in read_dbase(spark, str(tmp_path / "base.dbf")).collect()] == [("1", "600000", "123.450"), ("0", "000002", "")]
    (tmp_path / "names.txt").write_bytes("600000|浦发银行\n600000|second\nshort|no\n000001|平安银行\n".encode("gbk"))
    assert {tuple(r) for r in read_names(spark, str(tmp_path / "names.txt")).collect()} == {("600000", "浦发银行"), ("000001", "平安银行")}
    (tmp_path / "ind.cfg").write_text("1|600000|T10|||X5\n0|000001|T2\n0|000002||||X1\n")
    assert {tuple(r) for r in read_industries(spark, str(tmp_path / "ind.cfg")).collect()} == {("1", "600000", "T10", "X5"), ("0", "000002", None, "X1")}
    assert read_snapshot(spark, None, "ts_code string, industry string").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("B", "2024-01-02", 1.23456), ("A", "2024-01-03", None)], "ts_code string, date string, x double")
    sinks.write_bars(df, str(tmp_path / "p"), 2)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_csv(df, str(tmp_path / "c"), 2)
    text = "".join(p.read_text("utf-8") for p in sorted((tmp_path / "c").glob("*.csv")))
    assert "﻿ts_code" in text and "1.23" in text and "1.234" not in text
    assert sinks.write_summary(df.selectExpr("count(*) n"), str(tmp_path / "s.json")) == {"n": 2} == json.loads((tmp_path / "s.json").read_text())
    assert sinks.markdown(df.orderBy("ts_code")).splitlines()[2] == "| A | 2024-01-03 | — |"
    assert sinks.markdown(df.orderBy("ts_code"), 1).splitlines()[3:] == ["", "The first 1 rows; there are more."]


def test_chart_is_xml():
    bars = [{"date": f"2024-01-{d:02}", "open": 10, "high": 11 + d % 3, "low": 9, "close": 10 + d % 2, "vol": d, "ma5": 10.0} for d in range(1, 20)]
    root = ET.fromstring(chart(bars, "A & <B>", marks={"2024-01-05": "T+1"}))
    assert root.tag.endswith("svg") and any("T+1" == (e.text or "") for e in root)
