"""Findings of the first review: each of these tests fails where an operator does less than the whole job."""

import datetime as dt
import math

from tests.test_quality import BARS, D0, found, walk

from tapeloom.operators.spikes import SpikeRules, implausible_readings
from tapeloom.plans import screens, similar, studies


def test_factors_wrong_for_several_bars_are_found(spark):
    rows, want = walk("300002.SZ", seed=4), set()
    for start, values in ((0, (5.0, 5.0)), (40, (10.0, 10.0)), (80, (0.4, 0.4, 0.4)), (120, (3.0, 7.0)), (160, (10.0,)), (162, (10.0, 10.0)), (250, (0.2, 0.2, 0.2)), (398, (9.0, 9.0))):
        for i, f in enumerate(values, start):
            rows[i][8] = f
            want.add(("300002.SZ", i, "adj_factor"))
    rows[41][5] = None
    for r in rows[300:305]:  # a step and its return that the prices follow
        r[2:6] = [x / 2 for x in r[2:6]]
        r[7], r[8] = r[7] / 2, 4.0
    assert found(spark, rows) == want


def test_blocks_do_not_cut_wrong_factors(spark):
    rows = walk("600003.SH", n=500, seed=9)
    for i in range(40, 470, 45):
        for r in rows[i : i + 3]:
            r[8] *= 3
    df = spark.createDataFrame(rows, BARS)
    whole, split = ({(r.date, r.field) for r in implausible_readings(df, SpikeRules(block_days=b, margin_days=60)).collect()} for b in (5000, 7))
    assert whole == split and len(whole) == 30


EVENTS = "ts_code string, signal_date date, loaded_at timestamp, board string, year int, drop_bucket string, d1_direction string, drop_pct double, signal_day_pct double, ret_close_to_best_close_25 double, d1_return double, return_start_date date, return_end_date date"


def event_table(spark, folder, returns):
    """A folder with an event of 600000.SH a day, of the given returns."""
    rows = [("600000.SH", D0 + dt.timedelta(i), dt.datetime(2024, 1, 1), "main", 2024, "a", "up", -0.05, 0.0, r, r, D0, D0) for i, r in enumerate(returns)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{folder}/yizi_events.parquet")
    return str(folder)


def test_large_returns_are_kept(spark, tmp_path):
    sf_dir = event_table(spark, tmp_path, [0.5, 9.0, 14.0, 57.5, -0.4, math.inf, -math.inf, math.nan, None])
    assert [r.ret for r in studies.threshold_events(spark, sf_dir).collect()] == [57.5, 14.0, 9.0, 0.5]
    whole = studies.event_summary(spark, sf_dir).filter("grouping = 'all'").first()
    assert (whole.n, whole["mean"], whole.ex_mean) == (5, 16.12, 16.12)
    assert {r.sign: (r.n, r.mean) for r in studies.regime_summary(spark, sf_dir).filter("regime = 'total'").collect()} == {"total": (5, 16.12)}


def test_instruments_with_late_bars_are_not_missing(spark, tmp_path):
    late = [(dt.date(y, 3, 2), c, 1.0, 1.0, 1.0, 1.0, 100, 100.0, 1.0, dt.datetime(2026, 1, 1)) for y, c in ((2019, "600000.SH"), (2020, "600831.SH"), (2026, "bj920001"))]
    late.append((dt.date(2021, 3, 2), "600002.SH", math.nan, 1.0, 1.0, 1.0, 100, 100.0, 1.0, dt.datetime(2026, 1, 1)))
    spark.createDataFrame(late, "date date, ts_code string, open double, high double, low double, close double, vol bigint, amount double, adj_factor double, synced_at timestamp").write.parquet(f"{tmp_path}/stock_daily.parquet")
    named = [("600000.SH", "a"), ("600831.SH", "b"), ("920001.BJ", "c"), ("300573.SZ", " d "), ("600001.SH", "e"), ("600002.SH", "f")]
    spark.createDataFrame(named, "ts_code string, name string").write.parquet(f"{tmp_path}/stock_basic_tdx.parquet")
    got = {tuple(r) for r in studies.missing_instruments(spark, str(tmp_path)).collect()}
    assert got == {("300573.SZ", "d", True), ("600001.SH", "e", False), ("600002.SH", "f", False)}


def test_middle_returns_are_picked(spark, tmp_path):
    sf_dir = event_table(spark, tmp_path, [-1.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.2, 3.4, None])
    got = {(r.kind, r.place): ((r.signal_date - D0).days, r.ret) for r in studies.representative_events(spark, sf_dir).collect()}
    assert [got["middle", k] for k in range(1, 6)] == [(5, 0.5), (6, 0.6), (4, 0.4), (7, 0.7), (3, 0.3)]
    assert [got["high", k][0] for k in range(1, 6)] == [9, 7, 6, 5, 4] and [got["low", k][0] for k in range(1, 6)] == [0, 1, 2, 8, 3] and len(got) == 15


def test_elastic_search_sees_every_start(spark, tmp_path):
    source = walk("605999.SH", n=480, seed=11, factor_at=900)
    shifted = [[*r[:1], dt.date(2023, 1, 2) + dt.timedelta(i), *r[2:]] for i, r in enumerate(source)]
    first = next(i for i, r in enumerate(shifted) if str(r[1]) == similar.FIRST)
    length = sum(similar.FIRST <= str(r[1]) <= similar.LAST for r in shifted)
    other = [["600009.SH", shifted[i][1], *r[2:]] for i, r in enumerate(walk("600009.SH", n=480, seed=12, factor_at=900))]
    at = 8 * 20 + 4
    for i in range(-1, length):
        other[at + i][2:] = shifted[first + i][2:]
    rows = [(*r, dt.datetime(2026, 1, 1)) for r in shifted + other]
    spark.createDataFrame(rows, BARS + ", synced_at timestamp").write.parquet(f"{tmp_path}/stock_daily.parquet")
    best = similar.similar_elastic(spark, str(tmp_path)).orderBy("rank").first()
    assert (best.ts_code, best.start_date, best.length, best.mass) == ("600009.SH", other[at][1], length, 0.0)


def test_screens_see_the_whole_span(spark, tmp_path):
    rows = []
    for code, start in (("600004.SH", dt.date(2018, 1, 2)), ("600005.SH", dt.date(2026, 5, 1))):
        rows += [(code, start + dt.timedelta(i), *r[2:], dt.datetime(2026, 10, 1)) for i, r in enumerate(walk(code, n=150, seed=21, factor_at=900))]
    spark.createDataFrame(rows, BARS + ", synced_at timestamp").write.parquet(f"{tmp_path}/stock_daily.parquet")
    for query in (screens.screen_cross, screens.screen_pullback, screens.screen_returns):
        hits = query(spark, str(tmp_path)).select("ts_code", "date").collect()
        days = [{(r.date - start).days for r in hits if r.ts_code == code} for code, start in (("600004.SH", dt.date(2018, 1, 2)), ("600005.SH", dt.date(2026, 5, 1)))]
        assert days[0] == days[1] and max(days[0]) > 61
        if query is screens.screen_returns:
            assert screens.screen_summary(spark, str(tmp_path)).filter("horizon = 1").first().samples == len(hits)
