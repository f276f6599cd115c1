import datetime as dt
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation

from tapeloom.plans import similar
from tapeloom.similarity import kernels as K
from tapeloom.similarity import measures as M
from tapeloom.similarity import search as S
from tapeloom.similarity.search import SearchRules, _framed, bounded, candidate_lengths, query_of, scanned, search, stride, suppressed

SCHEMA = "ts_code string, date date, open double, high double, low double, close double, vol bigint"


def ripples(code, lag, n=180, seed=0):
    """Prices on three waves of unlike lengths, ``lag`` days late, with a little noise of the code's own."""
    rng = np.random.default_rng(seed)
    t = np.arange(n) - lag
    close = 24 * np.exp(0.06 * np.cos(t / 7.3) + 0.03 * np.sin(t / 2.9) - 0.02 * np.cos(t / 19.0) + 0.0004 * t + 0.0005 * rng.normal(size=n))
    open_ = close * np.exp(0.004 * np.sin(t / 3.7))
    high, low = np.maximum(open_, close) * (1.006 + 0.002 * np.cos(t / 5)), np.minimum(open_, close) * (0.993 - 0.002 * np.sin(t / 4))
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    return [(code, d, *map(float, x), int(5000 + 900 * np.sin(i / 3.1))) for i, (d, *x) in enumerate(zip(days, open_, high, low, close, strict=True))]


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(ripples("600001.SH", 0) + ripples("600002.SH", 0.05, seed=1) + ripples("600003.SH", 12.0, seed=2), SCHEMA).cache()


def w(*rows):
    return [np.array([x], float) for x in zip(*rows, strict=True)]


def test_search_finds_the_near_copy(bars):
    got = search(bars, "600001.SH", "2020-04-01", "2020-04-30").collect()
    assert got[0].ts_code != "600001.SH" and all(r.length == 30 for r in got)
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    for mode in ("fixed", "elastic"):
        past = search(bars, "600001.SH", "2020-04-01", "2020-04-30", SearchRules(mode=mode, step=4), history_only=True).collect()
        assert past and all(r.end_date < dt.date(2020, 4, 1) for r in past)


def test_counters(bars):
    seen = Observation("recall")
    assert search(bars, "600001.SH", "2020-04-01", "2020-04-30", counters=seen).count() > 0
    assert seen.get["candidates"] >= max(seen.get["mass_path"], seen.get["structure_path"]) > 0 and seen.get["state_path"] == 0


def test_no_look_ahead(spark, bars):
    early = search(bars, "600001.SH", "2020-04-01", "2020-04-30", history_only=True).select("ts_code", "start_idx", "score").collect()
    changed = bars.selectExpr("ts_code", "date", *[f"if(date > '2020-04-30', {c} * 20, {c}) as {c}" for c in ("open", "high", "low", "close")], "vol")
    assert search(changed, "600001.SH", "2020-04-01", "2020-04-30", history_only=True).select("ts_code", "start_idx", "score").collect() == early


def test_latest_leaves_out_stale_series(bars):
    got = search(bars.filter("ts_code <> '600003.SH' or date < '2020-06-08'"), "600001.SH", "2020-04-01", "2020-04-30", latest=True).collect()
    assert [r.ts_code for r in got] == ["600002.SH"]


def test_bad_requests(bars):
    for args, kw in ((("600001.SH", "2020-04-01", "2020-04-02"), {}), (("nobody", "2020-04-01", "2020-04-30"), {}), (("600001.SH", "2020-04-01", "2020-04-30", SearchRules(mode="x")), {}), (("600001.SH", "2020-04-01", "2020-04-30"), {"timeframe": "Q"})):
        with pytest.raises(ValueError):
            search(bars, *args, **kw)


def test_lengths():
    assert candidate_lengths(30, SearchRules()) == [30]
    assert candidate_lengths(5, SearchRules(mode="elastic")) == [8]
    assert 63 in candidate_lengths(63, SearchRules(mode="elastic")) and len(candidate_lengths(63, SearchRules(mode="elastic"))) == 3


def test_warping():
    q = np.arange(30.0)[:, None]
    assert M.warped_distance(q, (q + 0.5)[None], 2)[0] == pytest.approx(0.5 * np.sqrt(30 / 60))
    d, steps, over_q, over_c = M.elastic_distance(np.arange(10.0)[:, None], np.arange(11.0)[None, :, None], np.zeros(10), np.zeros((1, 11)), band=0.25, gap=0.1)
    assert (steps[0], over_q[0], over_c[0]) == (11, 0, 1) and d[0] == pytest.approx(np.sqrt(0.1 / 11))
    assert np.isinf(M.elastic_distance(np.zeros((3, 1)), np.zeros((1, 12, 1)), np.zeros(3), np.zeros((1, 12)))[0][0])


def test_warping_equals_plain_recursion():
    rng = np.random.default_rng(57)
    q, x = rng.normal(size=(9, 3)), rng.normal(size=(4, 9, 3))
    for k in range(4):
        d = np.full((10, 10), np.inf)
        d[0, 0] = 0
        for i in range(1, 10):
            for j in range(max(1, i - 2), min(9, i + 2) + 1):
                d[i, j] = ((q[i - 1] - x[k, j - 1]) ** 2).sum() + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
        assert M.warped_distance(q, x, 2)[k] == pytest.approx(np.sqrt(d[9, 9] / 18))


def test_board_events():
    e = M.board_events(*w((10, 10, 10, 10), (11, 11, 11, 11), (12, 12, 12, 11.99), (10.8, 13, 10.8, 13.8)), np.array([10.0]), 0.1)[0]
    assert e[1].tolist() == [1, 0, 1, 0, 1, 0] and e[2, 0] == 0 and e[3, 0] == 0
    tee = M.board_events(*w((10, 10, 10, 10), (11, 11, 10.5, 11)), np.array([10.0]), 0.1)[0]
    assert tee[1].tolist() == [1, 0, 0, 0, 1, 1]


def test_event_measures():
    q = np.zeros((14, 6))
    q[[2, 6, 9], 5] = 1
    c = q.copy()
    c[9, 5] = 0
    assert [x[0] for x in M.event_coverage(q, c[None])] == [pytest.approx(2 / 3), 1]
    a, b = np.zeros((11, 6)), np.zeros((21, 6))
    a[[2, 6], 0], a[8, 3], b[[4, 12], 0], b[16, 3] = 1, 1, 1, 1
    assert M.event_sequences(a, np.stack([b, np.zeros((21, 6))])) == pytest.approx([0, 1])
    assert M.event_sequences(np.zeros((11, 6)), np.stack([b, np.zeros((21, 6))])) == pytest.approx([1, 0])


def test_event_sequences_against_single_windows():
    rng = np.random.default_rng(5)
    query, events = (rng.random((17, 6)) < 0.15).astype(float), (rng.random((40, 23, 6)) < 0.12).astype(float)
    want = []
    for e in events:
        number = place = total = 0.0
        for k in range(6):
            a, b = [i / 16 for i in range(17) if query[i, k]], [i / 22 for i in range(23) if e[i, k]]
            if not a and not b:
                continue
            most, w = max(len(a), len(b)), M.EVENT_WEIGHTS[k]
            total += w
            number += w * (most - min(len(a), len(b))) / most
            if not a or not b:
                place += w
                continue
            spread = [[np.interp(j * (len(x) - 1) / max(most - 1, 1), range(len(x)), x) for j in range(most)] for x in (a, b)]
            place += w * np.mean(np.abs(np.subtract(*spread)))
        want.append((0.65 * number + 0.35 * place) / total if total else 0.0)
    assert M.event_sequences(query, events) == pytest.approx(want)


def test_series_scan_equals_the_measures_of_each_window():
    rng = np.random.default_rng(17)
    n = 160
    close = 20 * np.exp(np.cumsum(rng.choice([0.0, 0.01, -0.012, 0.0953, -0.1054], n, p=[0.1, 0.4, 0.3, 0.1, 0.1])))
    open_ = np.where(rng.random(n) < 0.2, close, close * np.exp(rng.normal(0, 0.02, n)))
    bars = np.stack([open_, np.maximum(open_, close) * 1.01, np.minimum(open_, close) * 0.99, close, rng.integers(0, 5, n) * 100.0], axis=1).round(2)
    for volume in (True, False):
        series = M.Series(bars, 0.1, volume)
        q = bars[30:55]
        qf, qe = M.bar_features(*(q[None, :, k] for k in range(5)), volume)[0], M.board_events(*(q[None, :, k] for k in range(4)), bars[29:30, 3], 0.1)[0]
        assert qe.any()
        for m in (25, 31):
            view = np.lib.stride_tricks.sliding_window_view(bars, m, axis=0)
            o, h, lo, c, v = (view[:, k] for k in range(5))
            starts = np.arange(n - m + 1)
            before = np.where(starts > 0, bars[np.maximum(starts - 1, 0), 3], bars[starts, 3])
            events = M.board_events(o, h, lo, c, before, 0.1)
            if m == 25:
                assert series.shape(q[:, 3]) == pytest.approx(M.shape_distance(q[:, 3], c), abs=1e-6)
                assert series.structure(qf) == pytest.approx(M.structure_distance(qf, M.bar_features(o, h, lo, c, v, volume)), abs=1e-6)
                assert series.event(qe) == pytest.approx(M.event_distance(qe, events), abs=1e-9)
            assert np.allclose(series.coverage(qe, m), M.event_coverage(qe, events))
            small, some = series.coarse_windows(m, 12, starts)
            for got, want in zip(small, M.coarse(o, h, lo, c, v, 12), strict=True):
                assert np.allclose(got, want)
            assert np.array_equal(some, np.maximum.reduceat(events, M.bucket_starts(m, 12), axis=1) > 0)
            state, _ = M.states(M.bar_features(o, h, lo, c, v), events)
            assert np.array_equal(series.modes(m, 12, starts), M.bucket_modes(state, 12))
            x = M.bar_features(o, h, lo, c, v)
            assert np.allclose(M.resampled_windows(x, 20), [M.resampled(w_, 20) for w_ in x])


def test_weekly_parts_see_nothing_behind_the_window():
    days = np.array([(np.datetime64("2020-01-06") + k).astype(int) for k in range(280) if (np.datetime64("2020-01-06") + k).astype(dt.date).weekday() < 5])
    bars = np.abs(np.random.default_rng(79).normal(10, 1, (len(days), 5)))
    weeks = (days + 5) // 7
    early = M.weekly_parts(weeks, bars, 100, 117, 8)
    assert (len(early[0]), len(early[1])) == (8, 4)
    bars[118:] *= 20
    for a, b in zip(early, M.weekly_parts(weeks, bars, 100, 117, 8), strict=True):
        assert np.array_equal(a, b)


def test_quotas_and_suppression(spark):
    rows = [("A", i, 10, float(i), 0.0, 0.0, 0.0, 1.0, 1, "mass") for i in range(20)] + [("B", i, 10, 50.0 + i, 0.0, 0.0, 0.0, 1.0, 1, "structure") for i in range(8)]
    schema = "ts_code string, start_idx int, length int, mass double, structure double, event double, state double, coverage double, missing int, paths string"
    kept = bounded(spark.createDataFrame(rows, schema), 9, False)
    assert len(kept) == 9 and (kept.paths == "structure").sum() == 3
    rows = [("A", i, 10, float(i), 0.0, 0.0, 0.0, 0.5, 1, "mass") for i in range(20)] + [("B", i, 10, 50.0, 0.0, 0.0, 0.0, 1.0, 0, "mass") for i in range(4)]
    kept = bounded(spark.createDataFrame(rows, schema), 8, True)
    assert len(kept) == 8 and (kept.ts_code == "B").sum() == 4
    scored = spark.createDataFrame([("A", 0, 10, 0.9, "2020-01-01"), ("A", 4, 10, 0.8, "2020-01-05"), ("A", 8, 10, 0.7, "2020-01-09"), ("B", 4, 10, 0.8, "2020-01-05")], "ts_code string, start_idx int, length int, score double, start_date string")
    assert {(r.ts_code, r.start_idx) for r in suppressed(scored, 0.25).collect()} == {("A", 0), ("A", 8), ("B", 4)}
    assert {(r.ts_code, r.start_idx) for r in suppressed(scored, 0.25, 1).collect()} == {("A", 0), ("B", 4)}


def test_exact_search_finds_what_the_bounded_one_finds(bars):
    key = ("ts_code", "start_idx", "length")
    rules = {"mode": "elastic", "top_k": 8}
    near, whole = (search(bars, "600001.SH", "2020-04-01", "2020-04-30", r).select(*key, "score").collect() for r in (SearchRules(**rules), SearchRules(**rules, exact=True)))
    assert len(whole) == 8 and near[0][:3] == whole[0][:3]
    assert sorted(r.score for r in whole)[-3:] >= sorted(r.score for r in near)[-3:]
    assert sum(any(r.ts_code == x.ts_code and abs(r.start_idx - x.start_idx) <= 6 for x in near) for r in whole) >= 6


def test_refined_search_equals_the_exact_one(bars):
    key = ("ts_code", "start_idx", "length", "score")
    exact, refined = ([tuple(r) for r in search(bars, "600001.SH", "2020-04-01", "2020-04-30", SearchRules(mode="elastic", top_k=4, **more)).select(*key).collect()] for more in ({"exact": True}, {"refine": 40, "local_top": 30}))
    assert [r[:3] for r in exact] == [r[:3] for r in refined] and np.allclose([r[3] for r in exact], [r[3] for r in refined])


def test_exact_search_equals_scoring_every_window_and_warps_few(bars, monkeypatch):
    got = [tuple(r) for r in search(bars, "600001.SH", "2020-04-01", "2020-04-30", SearchRules(mode="elastic", top_k=6, exact=True)).select("ts_code", "start_idx", "length", "score").collect()]
    rules = SearchRules(mode="elastic", exact=True)
    frame = _framed(bars, "D")
    query = query_of(frame, "600001.SH", "2020-04-01", "2020-04-30", rules)
    lengths = candidate_lengths(len(query.days), rules)
    tables = [pa.Table.from_pandas(x.sort_values("date"), preserve_index=False) for _, x in frame.toPandas().groupby("ts_code")]
    every = [K._exact_kernel(K._recall_kernel(query, rules, False, True, False, lengths, True), query, rules)(t).to_pandas() for t in tables]
    scored = []
    for x in every:
        total = 0.30 * x.dtw + 0.25 * x.state_edit + 0.20 * x.anchor + 0.05 * x.ret.clip(upper=2.0) + 0.05 * x.vol.clip(upper=2.0) + 0.20 * x.event_seq + 0.05 * np.abs(np.log(x.length / len(query.days)))
        score = K._scores(total.to_numpy(), (x.weekly_share / (1 + x.weekly)).to_numpy(), x.event_seq.to_numpy(), x.coverage.to_numpy(), x.missing.to_numpy(), query, rules)
        scored.append(K.kept_windows(rules.overlap, 6)(pa.Table.from_pandas(x.assign(score=score), preserve_index=False)).to_pandas())
    want = sorted((tuple(r) for x in scored for r in x[["ts_code", "start_idx", "length", "score"]].itertuples(index=False)), key=lambda r: -r[3])[:6]
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])

    warped, warp = [], M.elastic_distance
    monkeypatch.setattr(M, "elastic_distance", lambda q, x, *loud: warped.append(len(x)) or warp(q, x, *loud))
    kernel = K._best_kernel(query, rules, False, True, False, lengths, 6)
    for t in tables * 3:
        kernel(t)
    assert sum(warped) < 2 * sum(len(x) for x in every)


def test_bounds_and_weeks_of_a_series_agree_with_single_windows():
    rng = np.random.default_rng(23)
    n = 150
    close = 20 * np.exp(np.cumsum(rng.choice([0.0, 0.01, -0.012, 0.0953, -0.1054], n, p=[0.1, 0.4, 0.3, 0.1, 0.1])))
    open_ = np.where(rng.random(n) < 0.2, close, close * np.exp(rng.normal(0, 0.02, n)))
    bars = np.stack([open_, np.maximum(open_, close) * 1.01, np.minimum(open_, close) * 0.99, close, rng.integers(0, 5, n) * 100.0], axis=1).round(2)
    days = np.sort(rng.choice(np.arange(18000, 18260), n, replace=False))
    weeks = (days + 5) // 7
    for volume in (True, False):
        rules, weekly = SearchRules(mode="elastic", use_volume=volume), M.weekly_parts(weeks, bars, 70, 94, 8)
        query = K.Query("600001.SH", days[70:95], bars[70:95], bars[69, 3], weekly)
        qf, qe, qs, ql = query.parts(rules)
        for m in (21, 25, 31):
            starts = np.arange(n - m + 1)
            q, x, _, state, loud, _ = K._elastic("600001.SH", bars, starts, m, query, rules)
            beside = M.Beside(M.Series(bars, 0.1, volume), q, qs, ql, *K._elastic_weights(qf, rules))
            assert (beside.elastic_bound(m) <= M.elastic_distance(q, x, ql, loud)[0] + 1e-6).all()
            assert np.allclose(beside.edit(m, starts), M.edit_distance(qs, state, ql, loud))
            want = [M.weekly_distance(weekly, M.weekly_parts(weeks, bars, int(k), int(k + m - 1), 8), volume) for k in starts]
            assert np.allclose(np.column_stack(M.weekly_distances(weekly, weeks, bars, starts, m, 8, volume)), want)


def test_long_queries_and_bad_weights(bars):
    assert search(bars, "600001.SH", "2020-01-10", "2020-06-20", SearchRules(max_length=30)).count() > 0
    for bad in ({"mode": "elastic", "max_length": 30}, {"weekly_weight": 1.5}, {"overlap": -0.1}, {"recall_n": 0}, {"exact": True}, {"score_weights": {"mass": 2.0}}):
        with pytest.raises(ValueError):
            search(bars, "600001.SH", "2020-01-10", "2020-06-20", SearchRules(**bad))
    assert [stride(x) for x in (3, 8, 20, 42, 250)] == [1, 2, 5, 8, 8]
    assert scanned(bars, [100, 170, 200], 4).first()[:] == (3, 3 * (21 + 3))


def test_coarse_and_states():
    x = np.arange(10.0)[None]
    o, h, lo, c, v = M.coarse(x, x, x, x, x, 4)
    assert o[0].tolist() == [0, 3, 6, 8] and c[0].tolist() == [2, 5, 7, 9] and v[0].tolist() == [3, 12, 13, 17]
    assert M.bucket_modes(np.array([[[2], [0], [2], [1], [0], [0]]]), 2)[0].tolist() == [[2], [0]]
    s = np.array([[0, 1, 1, 1, 1], [2, 1, 1, 1, 1]])
    assert M.edit_distance(s, s[None], np.zeros(2), np.zeros((1, 2)))[0] == 0
    assert M.local_minima(np.array([3.0, 1, 2, 5, 0, np.inf]), 3, 1) == [4, 1]


def test_searches_of_one_scan_equal_those_by_themselves(bars, monkeypatch):
    shared = {"mode": "elastic", "top_k": 6}
    several = {"exact": SearchRules(**shared, exact=True), "bounded": SearchRules(**shared, recall_n=12), "strided": SearchRules(**shared, step=4), "refined": SearchRules(**shared, refine=30, local_top=30), "few": SearchRules(**shared, refine=2, refine_bars=0)}
    args, shown = ("600001.SH", "2020-04-01", "2020-04-30"), ("rank", "ts_code", "start_idx", "length", "start_date")
    rows = lambda df: (df.select(*shown).collect(), [r.score for r in df.select("score").collect()])
    want = {name: rows(search(bars, *args, r)) for name, r in several.items()}
    alone = []
    monkeypatch.setattr(S, "search", lambda *a, **k: alone.append(a[4]) or search(*a, **k))
    got = S.searches(bars, *args, several)
    for name in several:
        found = rows(got[name])
        assert found[0] == want[name][0] and np.allclose(found[1], want[name][1])
    # Two windows re-ranked don't make six; no other search is run by itself.
    assert alone == [several["few"]]
    with pytest.raises(ValueError):
        S.searches(bars, *args, {"a": SearchRules(**shared), "b": SearchRules(**shared, overlap=0.5)})


def test_recall_scans_the_series_once(bars, monkeypatch):
    framed, made = S._framed, []
    monkeypatch.setattr(S, "_framed", lambda *args: made.append(1) or framed(*args))
    for name, value in {"SYMBOL": "600001.SH", "FIRST": "2020-04-01", "LAST": "2020-04-30", "bars": lambda *_: bars}.items():
        monkeypatch.setattr(similar, name, value)
    for name in [x for x in ("ELASTIC", "STRIDED", "EXACT", "REFINED") if hasattr(similar, x)]:
        monkeypatch.setattr(similar, name, replace(getattr(similar, name), top_k=4))
    got = {r.search: r for r in similar.similar_recall(bars.sparkSession, "").collect()}
    assert len(made) == 1 and set(got) == {"bounded", "strided", "refined"}
    assert all(r.best == 4 for r in got.values()) and (got["refined"].recall, got["refined"].code_recall) == (1.0, 1.0)


def test_a_task_keeps_what_can_be_in_a_shortlist_and_bounds_hold():
    rng = np.random.default_rng(31)
    n = 220
    close = 20 * np.exp(np.cumsum(rng.choice([0.0, 0.01, -0.012, 0.0953, -0.1054], n, p=[0.1, 0.4, 0.3, 0.1, 0.1])))
    open_ = np.where(rng.random(n) < 0.2, close, close * np.exp(rng.normal(0, 0.02, n)))
    x = np.stack([open_, np.maximum(open_, close) * 1.01, np.minimum(open_, close) * 0.99, close, rng.integers(0, 5, n) * 100.0], axis=1).round(2)
    days = np.arange(18000, 18000 + n)
    for volume in (True, False):
        rules = SearchRules(mode="elastic", use_volume=volume)
        query = K.Query("600001.SH", days[70:95], x[70:95], x[69, 3], None)
        qf, qe, qs, ql = query.parts(rules)
        series = M.Series(x, 0.1, volume)
        for m in (21, 25, 31):
            starts = np.arange(n - m + 1)
            q, w_, _, state, loud, _ = K._elastic("600001.SH", x, starts, m, query, rules)
            beside = M.Beside(series, q, qs, ql, *K._elastic_weights(qf, rules))
            edits = M.edit_distance(qs, state, ql, loud)
            assert (beside.edit_bound(m) <= edits + 1e-9).all() and beside.edit_bound(m).max() > 0.5 * edits.min()
            assert np.allclose(beside.elastic_bound(m)[3::7], beside.elastic_bound(m, starts[3::7]))
            # Coarse distances from the bars of the series equal those of each window.
            small, some = series.coarse_windows(m, 12, starts[5:])
            own, modes = M.coarse(*(x[None, 70:95, k] for k in range(5)), 12), M.bucket_modes(qs[None], 12)[0]
            features, events = M.bar_features(*own, volume)[0], np.maximum.reduceat(qe, M.bucket_starts(25, 12), axis=0)
            want = M.shape_distance(own[3], small[3]), M.structure_distance(features, M.bar_features(*small, volume)), M.event_distance(events, some), np.mean(series.modes(m, 12, starts[5:]) != modes, axis=(1, 2))
            for a, b in zip(series.coarse_distances(m, starts[5:], own[3][0], features, events, modes), want, strict=True):
                assert np.allclose(a, b, atol=1e-9)
    heads, kept, keys = K._Heads(5, True), [], []
    for _ in range(30):
        found = {"mass": rng.random(8), "event": np.zeros(8), "coverage": np.ones(8), "missing": rng.integers(0, 2, 8)}
        paths = {k: ["structure"] if k % 3 == 0 else ["mass"] for k in range(8)}
        here = heads(found, paths)
        kept += [found["mass"][k] for k in here]
        keys += [(found["mass"][k], k % 3 == 0, found["missing"][k] == 0) for k in range(8)]
    for own in (keys, [k for k in keys if k[1]], [k for k in keys if k[2]]):
        assert {k[0] for k in sorted(own)[:5]} <= set(kept)
    assert len(kept) < len(keys) / 2
