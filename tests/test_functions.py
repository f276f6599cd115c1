import datetime as dt

from pyspark.sql import functions as F

from tapeloom.functions import boards, regimes, rounding
from tapeloom.functions.codes import code_from_file_stem
from tapeloom.operators import audit, bars as B, master
from tapeloom.operators.small import checked_broadcast, is_broadcast


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


def test_rounding(spark):
    assert values(spark, rounding.cents_half_up(F.col("x")), [10.005, 1.0049999, 11.0], "x double") == [1001.0, 100.0, 1100.0]
    assert values(spark, rounding.cents(F.col("x")), [0.125, 0.135, None], "x double") == [12.0, 14.0, None]
    assert values(spark, rounding.decimals(F.col("x"), 2), [1.005, 2.675], "x double") == [1.0, 2.68]


def test_boards(spark):
    codes = ["600000.SH", "000001.SZ", "300001.SZ", "688001.SH", "920001.BJ", "430001.BJ", None]
    assert values(spark, boards.board_of(F.col("c")), codes, "c string") == ["main", "main", "chinext", "star", "bse", "other", "other"]
    assert values(spark, boards.board_strict(F.col("c")), codes, "c string") == ["main", "main", "chinext", "star", "bse", None, None]
    assert values(spark, boards.board_name(F.col("c")), [" 主板", "ChiNext", "科創板", "Star Market", "BSE", "x", None], "c string") == ["main", "chinext", "star", "star", "bse", None, None]
    share = boards.limit_share(F.col("b"), F.col("d"))
    assert values(spark, share, [("chinext", dt.date(2020, 8, 23)), ("chinext", dt.date(2020, 8, 24)), ("star", dt.date(2019, 8, 1)), ("bse", dt.date(2024, 1, 1)), ("other", dt.date(2024, 1, 1))], "b string, d date") == [0.1, 0.2, 0.2, 0.3, None]
    assert values(spark, boards.exchange_of_symbol(F.col("s")), ["600000", "000001", "830001", "x"], "s string") == ["SH", "SZ", "BJ", None]
    stems = ["sh600000", "sh510300", "sz300001", "bj920001", "sz399001"]
    assert values(spark, boards.in_universe(F.col("s")), stems, "s string") == [True, False, True, True, False]
    assert values(spark, code_from_file_stem(F.col("s")), ["sh600000"], "s string") == ["600000.SH"]


def test_regimes(spark):
    days = [dt.date(2019, 1, 31), dt.date(2019, 2, 1), dt.date(2021, 11, 29), dt.date(2021, 11, 30), dt.date(2024, 9, 22), dt.date(2024, 9, 23), dt.date(2026, 6, 30), dt.date(2026, 7, 1), None]
    assert values(spark, regimes.regime(F.col("d")), days, "d date") == ["bear", "bull", "bull", "bear", "bear", "bull", "bull", "bear", None]
    spans = [(days[1], days[2]), (days[0], days[1]), (days[1], days[5]), (None, days[1])]
    assert values(spark, regimes.regime_of_span(F.col("a"), F.col("b")), spans, "a date, b date") == ["bull", "cross", "cross", None]


def test_master(spark):
    assert values(spark, master.day(F.col("t")), ["20240131", "", "  ", "2024", "20241341", None], "t string") == [dt.date(2024, 1, 31), None, None, None, None, None]
    df = spark.createDataFrame([("A", "D", 1), ("A", "L", 2), ("A", "L", 3), ("B", "X", 4)], "k string, s string, n int")
    assert {(r.k, r.n) for r in master.first_by_priority(df, "k", "s", ("L", "P", "D"), ("n",)).collect()} == {("A", 2), ("B", 4)}
    m = spark.createDataFrame([("600000.SH", " Alpha "), ("000600.SZ", "Alphabet"), ("000002.SZ", None)], "ts_code string, name string")
    for text, want in (("600000.sh", {"600000.SH"}), ("600", {"000600.SZ"}), ("Alpha", {"600000.SH"}), ("lph", {"600000.SH", "000600.SZ"}), ("zzz", set())):
        assert {r.ts_code for r in master.resolve(m, text).collect()} == want


def test_small_sides(spark):
    df = spark.range(10)
    for most, small in ((240, True), (239, False)):  # 10 rows of 16 bytes and a number
        side = checked_broadcast(df, most)
        assert side.count() == 10 and is_broadcast(side) is small
        assert ("BroadcastHashJoin" in df.join(side.hint("merge") if not small else side, "id")._jdf.queryExecution().executedPlan().toString()) is small
    text = spark.createDataFrame([("a" * 1000, [1.0] * 50), (None, None)], "t string, x array<double>")
    assert is_broadcast(checked_broadcast(text, 1500)) and not is_broadcast(checked_broadcast(text, 1400))
    assert checked_broadcast(df.limit(0)).count() == 0 and is_broadcast(checked_broadcast(df.limit(0), 0))


def test_windows_around_and_overlaps(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "ts_code string, date date, close double")
    at = spark.createDataFrame([("A", dt.date(2024, 1, 2)), ("A", dt.date(2025, 1, 1))], "ts_code string, date date")
    assert sorted((r.offset, r.close) for r in B.around(df, at, 2, 2).collect()) == [(-1, 0.0), (0, 1.0), (1, 2.0), (2, 3.0)]
    weeks = spark.createDataFrame([("A", dt.date(2024, 1, 5)), ("A", dt.date(2024, 1, 12))], "ts_code string, date date")
    assert [r.date.day for r in B.overlapping(weeks, "2024-01-06", "2024-01-06", "W").collect()] == [12]


def test_inventories(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in ("xxy", "yz"))
    assert {(r.k, r.left_rows, r.right_rows, r["where"]) for r in audit.inventory(a, b, "k").collect()} == {("x", 2, None, "left_only"), ("y", 1, 1, "both"), ("z", None, 1, "right_only")}
    assert {(r.k, r.side) for r in audit.same_calendar(a, b, "k").collect()} == {("x", "left"), ("z", "right")}
