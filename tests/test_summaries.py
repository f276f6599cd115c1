"""Master, labels, entries and audits on small tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tapeloom.operators import adjust, audit, bars as B, events as E, limits, master, stats
from tapeloom.screener.session import _rolled

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def bars(spark, rows, code="600000.SH"):
    schema = "ts_code string, date date, open double, high double, low double, close double, vol bigint, amount double, adj_factor double"
    return spark.createDataFrame([(code, day(i), *map(float, r), 100, 100.0, 1.0) for i, r in enumerate(rows)], schema)


def test_daily_labels_in_order(spark):
    rows = [(10, 10, 10, 10), (11, 11, 11, 11), (12.1, 12.1, 11.5, 12.1), (12.8, 13.31, 12.7, 13.31), (13.4, 14.64, 13.3, 14.64), (13.18, 13.18, 13.18, 13.18), (13, 13, 11.86, 11.86), (12, 12, 11.9, 12)]
    got = [r.board_type for r in limits.daily_labels(bars(spark, rows)).orderBy("date").collect()]
    assert got == ["", "one_word_up", "t_board_up", "gap_limit_up", "limit_up", "one_word_down", "limit_down", ""]


def test_one_price_pullback_with_the_published_parameters(spark):
    rows = [(10, 10.1, 9.9, 10 + 0.01 * (i % 3)) for i in range(80)]
    last = rows[-1][3]
    up = round(last * 1.1 + 1e-9, 2)
    rows += [(up,) * 4, (up, up * 1.01, up * 0.96, round(up * 0.97, 2)), (up, up, up * 0.9, up * 0.95)]
    got = E.one_price_pullbacks(bars(spark, rows), "2024-01-01").collect()
    assert [(r.board_date, r.signal_date, r.gap_bars, r.st_like) for r in got] == [(day(80), day(81), 1, False)]


def test_halvings_look_at_the_high_before_their_peak(spark):
    calm = [(50, 50, 50, 50)] * 70
    rows = calm + [(60, 61, 59, 60)] + [(60 - 4 * k, 60 - 4 * k, 58 - 4 * k, 58 - 4 * k) for k in range(1, 9)] + [(28, 40, 27, 30)] * 30
    got = E.halvings(bars(spark, rows), 63, 25, 63).collect()
    assert len(got) == 1 and got[0].peak_date == day(70) and got[0].peak_is_long_high and got[0].status == "complete"
    assert not E.halvings(bars(spark, rows), 63, 25, 504).first().peak_is_long_high


def test_entries_leave_out_blocked_opens(spark):
    forward = spark.createDataFrame([("A", day(i), 1, i == 0, 0.1 * i, 0.0, 0.2, 0.1) for i in range(3)], "ts_code string, date date, horizon int, entry_blocked boolean, ret_close double, ex_close double, ret_open double, ex_open double")
    signals = spark.createDataFrame([("A", day(i), i % 2) for i in range(3)], "ts_code string, date date, kind int")
    got = {(r.group_by, r.group, r.entry): r.n for r in stats.entry_summary(signals, forward, [(), ("kind",)]).collect()}
    assert got == {("all", "", "close"): 3, ("all", "", "open"): 2, ("kind", "0", "close"): 2, ("kind", "0", "open"): 1, ("kind", "1", "close"): 1, ("kind", "1", "open"): 1}


def test_counter_examples(spark):
    df = spark.createDataFrame([(i, r, x) for i, (r, x) in enumerate([("bull", -0.1), ("bull", 0.0), ("bull", 0.2), ("bear", 0.3), ("bear", -0.1), ("cross", -0.5), ("bear", 0.3)])], "id int, regime string, ret double")
    got = [(r.kind, r.place, r.id) for r in stats.counter_examples(df, "ret", "regime", ("id",), 2).orderBy("kind", "place").collect()]
    assert got == [("bear_positive", 1, 3), ("bear_positive", 2, 6), ("bull_not_positive", 1, 0), ("bull_not_positive", 2, 1)]


def test_bars_around_targets(spark):
    b = bars(spark, [(1, 1, 1, 1 + i) for i in range(9)])
    targets = spark.createDataFrame([("600000.SH", day(1)), ("600000.SH", day(8)), ("600000.SH", day(8)), ("600000.SH", day(40)), ("x", day(1))], "ts_code string, date date")
    got = sorted((r.target_date, r.offset, (r.date - D0).days) for r in B.around(b, targets, 2, 2).collect())
    assert got == [(day(1), -1, 0), (day(1), 0, 1), (day(1), 1, 2), (day(1), 2, 3), (day(8), -2, 6), (day(8), -1, 7), (day(8), 0, 8)]


def test_reconciled_rows(spark):
    a = bars(spark, [(1, 2, 1, 2), (1, 2, 1, 2), (1, 2, 1, 2)])
    other = a.withColumns({"close": F.when(F.col("date") == day(1), F.col("close") + 1e-6).otherwise(F.col("close")), "vol": F.when(F.col("date") == day(2), None).otherwise(F.col("vol"))})
    assert audit.reconcile_rows(a, other).first()[:] == (True, 0, 1, 1)
    assert audit.reconcile_rows(a, other.filter(F.col("date") > day(0))).first()[:] == (False, 1, 1, 1)
    assert audit.reconcile_rows(a, a.limit(0)).first()[:] == (False, 3, 0, 0)


def test_master_lookups(spark):
    actions = spark.createDataFrame([(1, "600000", 1, day(3), 1.0), (0, "1", 1, day(1), 2.0), (1, "600000", 5, day(2), 3.0), (7, "9", 1, day(1), 4.0)], "market int, code string, category int, date date, cash double")
    assert [(r.ts_code, r.ex_date, r.cash) for r in adjust.distributions(actions).collect()] == [("000001.SZ", day(1), 2.0), ("600000.SH", day(3), 1.0)]
    lists = {s: spark.createDataFrame([(c, s.lower()) for c in codes], "ts_code string, name string") for s, codes in (("D", "ab"), ("L", "bc"), ("X", "cd"))}
    assert {(r.ts_code, r.list_status) for r in master.union_statuses(lists).collect()} == {("a", "D"), ("b", "L"), ("c", "L"), ("d", "X")}
    named = spark.createDataFrame([("600000.SH", "north bank"), ("000001.SZ", "south bank")], "ts_code string, name string")
    assert master.resolve_one(named, "1") == "000001.SZ" and master.resolve_one(named, "north") == "600000.SH"
    for text in ("bank", "none"):
        with pytest.raises(ValueError):
            master.resolve_one(named, text)
    rows = spark.createDataFrame([("600000.SH", 1)], "ts_code string, x int")
    assert master.required(rows, named, ("ts_code",)).first().name == "north bank"
    with pytest.raises(PySparkException):
        master.required(rows.unionByName(rows.withColumn("ts_code", F.lit("no"))), named, ("ts_code",)).collect()


@pytest.mark.parametrize("n", [0, 1, 3, 50])
def test_rolled_windows_against_plain_loops(n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(20) < 0.2, np.nan, rng.integers(0, 3, 20).astype(float))
    frames = [x[max(0, i + 1 - n) if n else 0 : i + 1] for i in range(20)]
    some = lambda f: [f(w[~np.isnan(w)]) if (~np.isnan(w)).any() else np.nan for w in frames]
    yes = [int(((w != 0) & ~np.isnan(w)).sum()) for w in frames]
    want = {"COUNT": yes, "EXIST": [y > 0 for y in yes], "EVERY": [y == len(w) for y, w in zip(yes, frames, strict=True)], "SUM": some(np.sum), "HHV": some(np.max), "LLV": some(np.min), "MA": [w.mean() if len(w) == n and n else np.nan for w in frames], "STD": [w.std(ddof=1) if len(w) == n and n > 1 else np.nan for w in frames]}
    for name, values in want.items():
        assert np.allclose(_rolled(name, x, n), np.asarray(values, float), equal_nan=True), name
