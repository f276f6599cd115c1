"""Differences, implausible readings and regular grids."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.codes import canonical_code
from tapeloom.operators.current import current_bars, current_rows
from tapeloom.operators.diff import Tolerance, diff_copies
from tapeloom.operators.grid import Imputation, bucketed, chosen_pair, regular_grid, singular_spectrum_fill
from tapeloom.operators.spikes import SpikeRules, implausible_readings

NAN = float("nan")
D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def test_codes(spark):
    said = ["600000.SH", "sh600000", "SH600000", "600000SH", "600000.sh", " 600000.SH", "600000.SH ", "000001.SZ", "bj920001", "", "odd", None]
    got = [r.c for r in spark.createDataFrame([(s,) for s in said], "s string").select(canonical_code(F.col("s")).alias("c")).collect()]
    assert got == ["600000.SH"] * 7 + ["000001.SZ", "920001.BJ", "", "ODD", None]


def test_current_rows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", 1, t, 1.0), ("a", 1, t + dt.timedelta(1), None), ("a", 1, t, 3.0), ("b", 1, None, 4.0), ("b", 1, t, 5.0), ("c", 1, None, 6.0), ("d", 1, t, 7.0), ("d", 1, t, 7.0)]
    df = spark.createDataFrame(rows, "k string, n int, at timestamp, x double")
    assert {(r.k, r.x) for r in current_rows(df, ("k", "n"), "at", ("x",)).collect()} == {("a", None), ("b", 5.0), ("c", 6.0), ("d", 7.0)}


def brute_diff(left, right, tol):
    out = set()
    known = lambda x: x is not None and x == x
    lk, rk = {r[:2] for r in left}, {r[:2] for r in right}
    for k in (lk ^ rk):
        if None not in k:
            out.add((*k, "missing_in_right" if k in lk else "missing_in_left"))
    for k in lk & rk:
        if None in k:
            continue
        for j, f in ((2, "x"), (3, "n")):
            a, b = [r[j] for r in left if r[:2] == k and known(r[j])], [r[j] for r in right if r[:2] == k and known(r[j])]
            if not a or not b:
                if bool(a) != bool(b):
                    out.add((*k, f))
            elif any(p != q and (math.inf in (p, q) or not abs(p - q) <= tol[f].absolute + tol[f].relative * max(map(abs, a))) for p in a for q in b):
                out.add((*k, f))
    return out


def test_diff_against_brute_force(spark):
    rng = random.Random(3)
    tol = {"x": Tolerance(absolute=0.01), "n": Tolerance(relative=0.1)}
    values = [1.0, 1.005, 1.02, -2.0, None, NAN, math.inf]

    def side():
        keys = [(rng.choice(["hot", "hot", "a", None]), rng.randint(0, 60)) for _ in range(150)]
        rows = [(*k, rng.choice(values), rng.choice([10, 10, 11, 13, None])) for k in keys]
        return rows + rows[:20]

    left, right = side(), side()
    schema = "k string, d int, x double, n bigint"
    a = spark.createDataFrame([(*r, "extra", 1) for r in left], schema + ", field string, sign int")
    got = diff_copies(a, spark.createDataFrame(right, schema), ("k", "d"), tol)
    assert {(r.k, r.d, r.diff_kind) for r in got.collect()} == brute_diff(left, right, tol)


def test_diff_of_empty_copies(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "k string, d int, x double")
    assert [r.diff_kind for r in diff_copies(df, df.limit(0), ("k", "d"), {"x": Tolerance()}).collect()] == ["missing_in_right"]
    assert diff_copies(df.limit(0), df.limit(0), ("k", "d"), {"x": Tolerance()}).count() == 0


def walk(code="600000.SH", n=400, seed=1, factor_at=200):
    rng = np.random.default_rng(seed)
    rows, c = [], 50.0
    for i in range(n):
        o = c * math.exp(rng.normal(0, 0.004))
        if i == factor_at:
            c, o = c / 2, o / 2
        new = c * math.exp(rng.normal(0, 0.015))
        h, lo = max(o, new) * math.exp(abs(rng.normal(0, 0.006))), min(o, new) * math.exp(-abs(rng.normal(0, 0.006)))
        vol = int(rng.integers(1000, 9000)) * 100
        rows.append([code, day(i), round(o, 2), round(h, 2), round(lo, 2), round(new, 2), vol, vol * (o + h + lo + new) / 4, 2.0 if i >= factor_at else 1.0])
        c = new
    return rows


BARS = "ts_code string, date date, open double, high double, low double, close double, vol bigint, amount double, adj_factor double"


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], BARS + ", field string, block int")
    return {(r.ts_code, (r.date - D0).days, r.field) for r in implausible_readings(df).collect()}


def test_ordinary_moves_are_no_faults(spark):
    rows = walk()
    for i in range(300, 306):  # no trading: yesterday's close everywhere
        rows[i][2:8] = [rows[299][5]] * 4 + [0, 0.0]
    rows[100][2:6] = [rows[99][5] * 1.1] * 4  # a one-price board
    for r in rows[101:200]:
        r[2:6] = [round(x * 1.1, 2) for x in r[2:6]]
    rows[50][5] = None
    rows[60][2] = NAN
    rows[70][3] = None
    assert found(spark, rows) == set()


def test_planted_faults_are_found(spark):
    rows, want = walk("300001.SZ", seed=2), set()
    plant = [(20, 2, lambda r: r[2] * 100), (40, 3, lambda r: r[3] * 1.25), (60, 4, lambda r: r[4] * 0.8), (80, 2, lambda r: -r[2]), (90, 4, lambda r: 0.0), (110, 8, lambda r: 0.1), (130, 8, lambda r: -1.0), (150, 3, lambda r: r[4] * 0.9), (399, 8, lambda r: 20.0), (0, 8, lambda r: 0.1)]
    names = {2: "open", 3: "high", 4: "low", 8: "adj_factor"}
    for i, j, f in plant:
        rows[i][j] = f(rows[i])
        want.add(("300001.SZ", i, names[j]))
    for i in range(251, 260):
        rows[i][4] = rows[250][4]
        want.add(("300001.SZ", i, "low"))
    rows[320][3], rows[320][4] = rows[320][4], rows[320][3]
    want |= {("300001.SZ", 320, "high"), ("300001.SZ", 320, "low")}
    assert found(spark, rows + walk("600001.SH", seed=5)) == want


def test_readings_of_small_and_empty_tables(spark):
    assert found(spark, []) == set()
    assert found(spark, walk(n=3)) == set()
    assert found(spark, [["a", day(0), None, None, NAN, None, None, None, None]]) == set()


def test_blocks_do_not_change_results(spark):
    rows = walk("600002.SH", n=500, seed=8)
    rows[250][3] *= 1.3
    for i in range(361, 372):
        rows[i][2] = rows[360][2]
    df = spark.createDataFrame(rows, BARS)
    whole, split = ({(r.date, r.field) for r in implausible_readings(df, SpikeRules(block_days=b, margin_days=60)).collect()} for b in (5000, 120))
    assert whole == split and len(whole) == 12


def grid(spark, rows, days=30, rules=Imputation()):
    df = spark.createDataFrame([(s, c, p, v, 1) for s, c, p, v in rows], "source string, calendar string, period date, value double, slot int")
    slots = spark.createDataFrame([("X", day(i)) for i in range(days) if i % 7 < 5] * 2 + [("Y", day(i)) for i in range(days)] + [("X", None)], "calendar string, period date")
    return {(r.source, (r.period - D0).days): r for r in regular_grid(df, slots, rules).collect()}


def test_grid_marks_what_is_missing(spark):
    rows = [("a", "X", day(0), 1.0), ("a", "X", day(3), 2.0), ("a", "X", day(5), 9.0), ("a", "X", day(9), None), ("a", "X", day(10), NAN), ("a", "X", day(14), 4.0), ("b", "Y", day(4), 5.0), ("c", "X", day(6), 1.0), ("d", "Z", day(1), 1.0), (None, "X", None, 1.0)]
    got = grid(spark, rows)
    assert sorted(k for k in got if k[0] == "a") == [("a", i) for i in (0, 1, 2, 3, 4, 7, 8, 9, 10, 11, 14)]
    assert {k[1] for k, r in got.items() if k[0] == "a" and r.is_filled} == {1, 2, 4, 7, 8, 9, 10, 11}
    assert all((r.value is None) == r.is_filled and r.filled_value > 0 for r in got.values())
    assert [k for k in got if k[0] != "a"] == [("b", 4)]
    assert grid(spark, []) == {}


def test_grid_blocks_mark_the_same(spark):
    rng = random.Random(6)
    rows = [("a", "Y", day(i), 10 + math.sin(i / 9)) for i in range(400) if rng.random() < 0.6 and not 120 < i < 300]
    one, many = (grid(spark, rows, 400, Imputation(block=b, margin=16)) for b in (1024, 32))
    assert {k for k, r in one.items() if r.is_filled} == {k for k, r in many.items() if r.is_filled}
    assert len(one) == (rows[-1][2] - rows[0][2]).days + 1


def wave(n=300):
    t = np.arange(float(n))
    truth = 5 + np.sin(t / 6) + 0.5 * np.cos(t / 11)
    lost = np.random.default_rng(2).random(n) < 0.2
    lost[[0, -1]] = False
    return t, truth, lost, np.where(lost, np.interp(t, t[~lost], truth[~lost]), truth)


def test_imputation_recovers_a_periodic_series_with_the_defaults():
    _, truth, lost, guess = wave()
    pair = chosen_pair(guess, lost, Imputation())
    got, rounds, converged = singular_spectrum_fill(guess.copy(), lost, *pair)
    assert pair == (24, 5) and converged and rounds > 1 and np.allclose(got[~lost], truth[~lost])
    assert np.abs(got - truth)[lost].max() < 0.3 * np.abs(guess - truth)[lost].max()


def test_imputation_equals_plain_iteration():
    _, _, lost, guess = wave(80)
    y = guess - guess[~lost].mean()
    for _ in range(20_000):
        path = np.lib.stride_tricks.sliding_window_view(y, 6).T
        u, s, vt = np.linalg.svd(path, full_matrices=False)
        low = (u[:, :3] * s[:3]) @ vt[:3]
        total, count = np.zeros(80), np.zeros(80)
        for j in range(6):
            total[j : j + 75] += low[j]
            count[j : j + 75] += 1
        fresh = (total / count)[lost]
        done = np.abs(fresh - y[lost]).max() < 1e-12
        y[lost] = fresh
        if done:
            break
    got, _, converged = singular_spectrum_fill(guess.copy(), lost, 6, 3, 1e-10, 500)
    assert converged and np.allclose(got, y + guess[~lost].mean(), atol=1e-5)
    assert not singular_spectrum_fill(guess.copy(), lost, 6, 3, 1e-10, 1)[2]


def test_irregular_times_are_put_into_their_slots(spark):
    at = dt.datetime
    rows = [("a", at(2024, 1, 1, 9), 1.0), ("a", at(2024, 1, 1, 17, 30), 2.0), ("a", at(2024, 1, 1, 23, 59), None), ("a", at(2024, 1, 4, 0, 1), 4.0), ("a", at(2024, 1, 5, 3), NAN), ("b", at(2024, 1, 2, 5), 7.0), (None, None, 1.0)]
    readings = bucketed(spark.createDataFrame([(s, "Y", t, v, 9) for s, t, v in rows], "source string, calendar string, time timestamp, value double, period int"), F.to_date("time"))
    slots = spark.createDataFrame([("Y", day(i)) for i in range(10)], "calendar string, period date")
    got = {(r.source, (r.period - D0).days): r for r in regular_grid(readings, slots).collect()}
    assert {k: r.value for k, r in got.items()} == {("a", 0): 2.0, ("a", 1): None, ("a", 2): None, ("a", 3): 4.0, ("b", 1): 7.0}
    assert got["a", 1].converged and got["a", 1].line_value == pytest.approx(2 * 2 ** (1 / 3))


def test_gaps_wider_than_blocks(spark):
    rows = [("a", "Y", day(i), 1.0 + i) for i in (0, 1, 390, 399)]
    got = grid(spark, rows, 400, Imputation(block=16, margin=4))
    assert len(got) == 400 and sum(r.is_filled for r in got.values()) == 396
    assert all(1 < got["a", i].filled_value < 400 for i in range(2, 390))


def test_current_bars_normalise(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("sh600000", D0, 1.0, t), ("600000.SH", D0, NAN, t + dt.timedelta(1)), (None, D0, 1.0, t), ("600000.SH", None, 1.0, t)]
    df = spark.createDataFrame(rows, "ts_code string, date date, close double, synced_at timestamp")
    assert [tuple(r) for r in current_bars(df, ("close",)).collect()] == [("600000.SH", D0, None)]


@pytest.mark.parametrize("shift", [0, 1])
def test_p1_tolerance_edges(spark, shift):
    left = spark.createDataFrame([("a", 1, 10.0)], "k string, d int, x double")
    right = spark.createDataFrame([("a", 1, 10.0 + 0.25 + shift * 0.01)], "k string, d int, x double")
    assert diff_copies(left, right, ("k", "d"), {"x": Tolerance(absolute=0.25)}).count() == shift
