"""Bars, limits, actions, paths, events, statistics and audits on small literals."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import adjust, audit, bars as B, events as E, limits, ranking, returns, stats

D0 = dt.date(2024, 1, 1)
BARS = "ts_code string, date date, open double, high double, low double, close double, vol bigint, amount double, adj_factor double"


def frame(spark, code, closes, lows=None, opens=None, start=D0, factors=None, highs=None):
    rows = []
    for i, c in enumerate(closes):
        lo = (lows or closes)[i]
        o = (opens or closes)[i]
        h = (highs or [max(c, o)] * len(closes))[i] if highs else max(c, o)
        rows.append((code, start + dt.timedelta(days=i), float(o), float(h), float(lo), float(c), 100, 100.0 * c, float((factors or [1] * len(closes))[i])))
    return spark.createDataFrame(rows, BARS)


def labels(df):
    return [r.board_type for r in limits.board_labels(df).orderBy("date").collect()]


def test_limit_labels(spark):
    same = lambda xs: dict(closes=xs, lows=xs)
    rows = frame(spark, "000001.SZ", **same([10, 11, 9.9, 10, 9.9]), opens=[10, 10.5, 9.9, 9.9, 10])
    assert labels(rows) == ["", "limit_up", "one_word_down", "", ""]
    switch = frame(spark, "300001.SZ", [10, 11, 4.4, 5.28], opens=[10, 11, 4.4, 5.0], factors=[1, 1, 2, 2], start=dt.date(2020, 8, 21))
    assert labels(switch)[1:] == ["one_word_up", "one_word_down", "limit_up"] or labels(frame(spark, "300001.SZ", [10, 11], opens=[10, 11], start=dt.date(2020, 8, 22)))[1] == "one_word_up"


def test_actions_chain_and_are_placed(spark):
    bars = frame(spark, "A", [10, 10, 10, 10])
    acts = [("A", D0, 1.0, 0.0, 0.0, 0.0), ("A", D0 + dt.timedelta(2), 10.0, 0.0, 0.0, 0.0), ("A", D0 + dt.timedelta(2), 10.0, 0.0, 0.0, 0.0), ("A", D0 + dt.timedelta(9), 1.0, 0.0, 0.0, 0.0), ("B", D0, 1.0, 0.0, 0.0, 0.0), ("A", D0 + dt.timedelta(3), 0.0, 4.0, 10.0, 5.0)]
    schema = "ts_code string, ex_date date, cash_per10 double, rights_price double, bonus_per10 double, rights_per10 double"
    placed = adjust.place_actions(spark.createDataFrame(acts, schema), bars)
    got = {(r.ts_code, (r.ex_date - D0).days): r for r in placed.collect()}
    assert {k: r.status for k, r in got.items()} == {("A", 0): "before_listing", ("A", 2): "applied", ("A", 3): "applied", ("A", 9): "after_data_end", ("B", 0): "before_listing"}
    assert got[("A", 2)].ref_price == pytest.approx(9.0) and got[("A", 3)].ref_price == pytest.approx((10 + 4 * 0.5) / 2.5)
    sparse = bars.filter(F.col("date") != F.lit(D0 + dt.timedelta(2)))
    both = {(r.ex_date - D0).days: r for r in adjust.place_actions(spark.createDataFrame(acts[1:2] + acts[5:], schema), sparse).collect()}
    assert both[3].prev_close == pytest.approx(9.0) and both[2].trade_date == both[3].trade_date
    factor = [r.built_factor for r in adjust.factors(sparse, adjust.place_actions(spark.createDataFrame(acts[1:2] + acts[5:], schema), sparse)).orderBy("date").collect()]
    assert factor == pytest.approx([1, 1, 10 / ((9 + 2) / 2.5)])


def path(spark, closes, lows, gap, horizon, d0=0):
    df = B.backward_adjusted(frame(spark, "A", closes, lows)).withColumn("gap", F.when(F.col("date") == F.lit(D0 + dt.timedelta(d0)), gap))
    return returns.lowest_bar_path(df, "gap", horizon).collect()


def test_paths(spark):
    (r,) = path(spark, [10, 9, 8, 7, 6, 5, 12, 11, 10], [10, 8, 4, 6, 5, 4, 11, 10, 9], 1, 4)
    assert (r.entry, r.entry_close, (r.exit_date - D0).days, r.path_return) == (2, 8.0, 6, pytest.approx(0.5))
    (r,) = path(spark, [10, 15, 9, 8, 7, 6, 5], [10, 5, 8, 7, 6, 5, 4], 1, 3)
    assert r.entry == 1 and r.path_return == pytest.approx(9 / 15 - 1)
    assert path(spark, [10, 9, 8, 7, 9, 9, 9, 9], [10, 5, 7, 6, 8, 8, 8, 8], 2, 3) == []
    assert path(spark, [10, 9, 8, 7], [10, 8, 7, 6], 1, 4) == []


def test_halvings(spark):
    closes = [100, 100, 90, 80, 60, 49, 45, 48, 51, 55, 60, 65]
    (r,) = E.halvings(frame(spark, "A", closes), 4, 3, 4).collect()
    assert (r.signal_date - D0).days == 5 and r.best_return == pytest.approx(51 / 49 - 1) and r.terminal_return == pytest.approx(51 / 49 - 1)
    (r,) = E.halvings(frame(spark, "A", [100, 100, 100, 50, 49, 48, 47]), 3, 3, 3).collect()
    assert (r.signal_date - D0).days == 4 and r.status == "no_complete_window" and r.best_return is None


def test_spacing_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(n)) for k in "ab" for n in np.unique(rng.integers(0, 200, 60))]
    want, last = set(), {}
    for k, n in rows:
        if n - last.get(k, -99) >= 9:
            want.add((k, n))
            last[k] = n
    got = E.spaced(spark.createDataFrame(rows, "k string, n bigint"), "k", "n", 9)
    assert {tuple(r) for r in got.collect()} == want


def test_one_price_pullback(spark):
    n = 70
    closes = [10 + 0.01 * (i % 3) for i in range(n)]
    board = float(np.floor(closes[-1] * 1.1 * 100 + 0.5) / 100)
    c = [*closes, board, board + 0.1, board - 0.2]
    o = [x - 0.01 for x in closes] + [board, board, board]
    lows = [x - 0.02 for x in closes] + [board, board - 0.1, board - 0.3]
    df = frame(spark, "600001.SH", c, lows, o, start=dt.date(2023, 11, 1))
    (r,) = E.one_price_pullbacks(df, "2020-01-01", month_cap=5.0).collect()
    assert r.gap_bars == 2 and r.drop_pct == pytest.approx((board - 0.2) / board - 1) and r.d1_direction == "up" and not r.st_like


def test_summary_matches_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], None if i % 7 == 0 else float(rng.normal()), None if i % 5 == 0 else float(rng.normal())) for i in range(90)] + [("c", None, 1.0), ("d", 2.0, None)]
    df = spark.createDataFrame(rows, "g string, r double, x double")
    got = {r.group: r for r in stats.summarize(df, "r", "x", [(), ("g",)]).collect()}
    for g in ("", "a", "b"):
        r = np.array([v for k, v, _ in rows if v is not None and g in ("", k)])
        x = np.array([v for k, _, v in rows if v is not None and g in ("", k)])
        assert got[g].n == len(r) and got[g].ex_mean == pytest.approx(x.mean())
        assert (got[g].mean, got[g].median, got[g].std, got[g].p10, got[g].win) == pytest.approx((r.mean(), np.median(r), r.std(ddof=1), np.quantile(r, 0.1), (r > 0).mean()))
    assert got["c"].n == 0 and got["c"].mean is None and got["d"].t is None
    assert {r.group: r.ex_mean for r in stats.summarize(df, "r", "x", [("g",)], aligned=True).collect()}["c"] is None


def test_histogram_and_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (-0.4, -0.3, 0.0, 0.049, 2.0, None, float("nan"))], "r double")
    got = [r.n for r in stats.histogram(df, "r").orderBy("bin").collect()]
    assert got == [1, 1, 0, 0, 0, 2, 0, 0, 0, 0, 0, 1] and stats.histogram(df.limit(0), "r").count() == 12
    label = [r.b for r in df.select(stats.bucket(F.col("r"), (-0.3, 0.0), ("x", "y", "z")).alias("b")).collect()]
    assert label == ["x", "x", "y", "z", "z", None, None]


def test_picks_and_samples(spark):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(9)] + [("g", 9, None)], "g string, id int, v double")
    got = stats.spread_pick(df, ("g",), "v", ("id",), 2).collect()
    assert {(r.kind, r.id) for r in got} == {("high", 8), ("high", 7), ("low", 0), ("low", 1), ("middle", 4), ("middle", 3)}
    a, b = (sorted(r.id for r in stats.seeded_sample(x, ("id",), 4, 7).collect()) for x in (df, df.repartition(5)))
    assert a == b and len(a) == 4


def test_rankings(spark):
    df = B.backward_adjusted(frame(spark, "A", [10, 5, 8, 20, 4], [9, 4, 7, 19, 3]).unionByName(frame(spark, "B", [1, 1, 1, 1, 1])))
    got = {r.ts_code: r for r in ranking.run_ups(df, "2024-01-01", "2024-12-31").collect()}
    assert got["A"].run_up == pytest.approx(20 / 4 - 1) and (got["A"].low_date - D0).days == 1 and (got["A"].high_date - D0).days == 3
    top = ranking.amount_leaders(df, "2024-01-01", "2024-01-05", 5, 1).collect()
    assert [(r.ts_code, r["rank"], r.coverage) for r in top] == [("A", 1, 1.0)]
    for bad in (("2024-02-01", "2024-01-01", 1, 1), ("2024-01-01", "2024-02-01", 0, 1), ("2024-01-01", "2024-02-01", 1, 0)):
        with pytest.raises(ValueError):
            ranking.amount_leaders(df, *bad)


def test_audits(spark):
    calendar = spark.createDataFrame([(D0 + dt.timedelta(i), i % 7 < 5, True, False) for i in range(20)], "cal_date date, sh_open boolean, sz_open boolean, bj_open boolean")
    df = frame(spark, "600000.SH", range(10, 30)).filter("date not in ('2024-01-03', '2024-01-04', '2024-01-10')")
    (r,) = audit.coverage(df, calendar).collect()
    assert (r.bars, r.sessions, r.missing, r.gap_runs, r.longest_gap, r.off_calendar) == (12, 15, 3, 2, 2, 5)
    assert sorted(g.sessions for g in audit.gaps(df, calendar).collect()) == [1, 2]
    rows = [("a", D0, float("nan"), 2.0, 1.0, 1.5, 1, 1.0, 1.0), ("a", D0, 1.0, 1.0, 2.0, 1.5, -1, 1.0, 0.0), ("a", D0, 3.0, 2.0, 1.0, 0.0, 1, None, 1.0)]
    (r,) = audit.invalid_rows(spark.createDataFrame(rows, BARS)).collect()
    assert (r["rows"], r.nonfinite_price, r.nonpositive_price, r.low_above_high, r.open_outside, r.close_outside, r.bad_factor, r.negative_flow, r.repeated_keys) == (3, 1, 1, 1, 2, 2, 1, 1, 2)


def test_resample_labels_weeks_by_friday(spark):
    df = frame(spark, "A", range(1, 11), start=dt.date(2024, 1, 4))  # a Thursday
    got = {(str(r.date), r.open, r.close, r.bars) for r in B.resample(df, "W").collect()}
    assert got == {("2024-01-05", 1.0, 2.0, 2), ("2024-01-12", 3.0, 9.0, 7), ("2024-01-19", 10.0, 10.0, 1)}
