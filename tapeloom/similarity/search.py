"""The search: recall per series, a global bound, re-ranking of the shortlist, and suppression of overlaps.

Series are scanned where they lie (one shuffle by instrument, the query in the kernel's closure); only
window metadata leaves the scan. The shortlist is bounded by ``recall_n``, so what follows is small. With ``exact``
nothing is bounded: every legal window is scored where its series lies, as far as its parts leave it a chance.
"""

import time
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.operators.bars import PRICES, resample, valid_bars
from tapeloom.operators.lineage import cut
from tapeloom.similarity import measures as M
from tapeloom.similarity.kernels import _BAR, _CANDIDATE, _FOUND, _KEPT, _METRIC, _ROOM, LAG_DAYS, Query, SearchRules, _best_kernel, _exact_kernel, _feature_kernel, _recall_kernel, _rerank_kernel, _several_kernel, _weeks, candidate_lengths, kept_windows, stride


def _key() -> Column:
    return F.col("mass") + 0.75 * F.col("event") + 2.0 * (1.0 - F.col("coverage"))


def bounded(candidates: DataFrame, limit: int, events: bool) -> pd.DataFrame:
    """At most ``limit`` candidates: with query events first the complete ones (half of the limit at most), then the
    structure path's (a third of the rest at most), then the best of the rest; ties go to later windows.

    Each of the three needs the head of its own order only, so one job brings at most ``3 * limit`` rows to the
    driver, which puts them together."""
    order = [F.col("key"), F.col("ts_code").desc(), F.col("start_idx").desc(), F.col("length").desc()]
    keyed = candidates.withColumn("key", _key())
    heads = [keyed.filter("missing = 0")] if events else []
    heads += [keyed.filter(F.col("paths").contains("structure")), keyed]
    union = heads[0].orderBy(*order).limit(limit)
    for h in heads[1:]:
        union = union.unionByName(h.orderBy(*order).limit(limit))
    ident = ["ts_code", "start_idx", "length"]
    rest = union.toPandas().drop_duplicates(ident).sort_values(["key", *ident], ascending=[True, False, False, False], ignore_index=True)
    kept = np.zeros(len(rest), bool)
    if events:
        kept[np.flatnonzero(rest["missing"] == 0)[: max(1, limit // 2)]] = True
    room = limit - kept.sum()
    if room > 0:
        kept[np.flatnonzero(~kept & rest["paths"].str.contains("structure").to_numpy(bool))[: max(1, room // 3)]] = True
        kept[np.flatnonzero(~kept)[: limit - kept.sum()]] = True
    return rest[kept]


def fused_score(weights: dict) -> Column:
    """One minus the weighted ranks, as shares of the candidates, of the fixed mode's distances."""
    ranked = {"mass": "mass", "dtw": "dtw", "aligned": "aligned", "ret": "ret", "vol": "vol", "event": "event_seq"}
    return 1.0 - sum((F.percent_rank().over(W.orderBy(F.col(c))) * weights[k] for k, c in ranked.items()), F.lit(0.0))


def banded_score(score: Column | str = "score") -> Column:
    """A score in the band of its events: complete and in place above 0.5, complete above 0.25, others below."""
    base = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    quality = F.col("coverage") * F.least(F.greatest(1.0 - F.col("event_seq"), F.lit(0.0)), F.lit(1.0))
    return F.when((F.col("missing") == 0) & (F.col("event_seq") <= 1e-9), 0.5 + 0.5 * base).when(F.col("missing") == 0, 0.25 + 0.25 * base * quality).otherwise(0.25 * (0.5 * base + 0.5 * quality))


def _scored(df: DataFrame, query: Query, rules: SearchRules) -> DataFrame:
    """Adds daily_score, of the distances, and score, with the weekly background and the events' bands."""
    if rules.mode == "fixed":
        df = df.withColumn("score", fused_score(rules.score_weights))
    else:
        path = 0.5 * F.least("ret", F.lit(2.0)) + 0.5 * F.least("vol", F.lit(2.0))
        total = 0.30 * F.col("dtw") + 0.25 * F.col("state_edit") + 0.20 * F.col("anchor") + 0.10 * path + 0.20 * F.col("event_seq") + 0.05 * F.abs(F.ln(F.col("length") / F.lit(float(len(query.days)))))
        df = df.withColumn("score", 1.0 / (1.0 + F.greatest(total, F.lit(0.0))))
    df = df.withColumn("daily_score", F.col("score"))
    if query.weekly is not None:
        week = F.col("weekly_share") / (1.0 + F.col("weekly"))
        weight = rules.weekly_weight * min(1.0, len(query.weekly[1]) / 3.0)
        df = df.withColumn("score", (1.0 - weight) * F.col("score") + weight * week)
    if rules.event_bands and query.parts(rules)[1].any():
        df = df.withColumn("score", banded_score())
    return df


def best_frame(frame: DataFrame, only: dict[str, np.ndarray]) -> DataFrame:
    """``only`` as a table: a row per series, at most ``refine`` of them."""
    return frame.sparkSession.createDataFrame([(code, x.tolist()) for code, x in only.items()], "ts_code string, inside array<int>")


def scanned(bars: DataFrame, lengths: list[int], step: int = 1) -> DataFrame:
    """How many series are long enough for one of the lengths, and how many windows a scan of them has."""
    per = bars.groupBy("ts_code").agg(F.count("*").alias("n"))
    windows = sum((F.when(F.col("n") >= m, F.floor((F.col("n") - m) / step) + 1).otherwise(0) for m in lengths), F.lit(0).cast("long"))
    return per.select(windows.alias("w")).agg(F.count_if(F.col("w") > 0).alias("symbols"), F.sum("w").alias("windows_total"))


def _framed(bars: DataFrame, timeframe: str) -> DataFrame:
    """Finite, positive bars of a timeframe, cut and kept by instrument: the scan, the scale and the re-ranking read them."""
    if timeframe not in LAG_DAYS:
        raise ValueError("unknown timeframe")
    daily = valid_bars(bars, PRICES).select("ts_code", "date", *PRICES, F.coalesce("vol", F.lit(0)).cast("double").alias("vol"))
    if timeframe != "D":
        daily = resample(daily.withColumn("amount", F.lit(0.0)), timeframe).select("ts_code", "date", *PRICES, F.col("vol").cast("double").alias("vol"))
    return cut(daily.repartition("ts_code"))


def query_of(frame: DataFrame, symbol: str, start: str, end: str, rules: SearchRules, timeframe: str = "D") -> Query:
    """The query window with its weekly background. Its bars, and a bounded number before them, come to the driver: those of
    twice the calendar days that the background spans, or where trading stopped the last bars before, however old."""
    own = frame.filter((F.col("ts_code") == symbol) & (F.col("date") <= F.lit(end).cast("date")))
    weeks = rules.weekly_prior + 2
    first_day = F.lit(start).cast("date")
    got = own.filter(F.col("date") >= F.date_sub(first_day, 14 * weeks)).toPandas()
    if (pd.to_datetime(got["date"]) < pd.Timestamp(start)).sum() < 5 * weeks:
        got = pd.concat([got, own.filter(F.col("date") < first_day).orderBy(F.col("date").desc()).limit(5 * weeks).toPandas()]).drop_duplicates("date")
    got = got.sort_values("date")
    inside = (pd.to_datetime(got["date"]) >= pd.Timestamp(start)).to_numpy()
    if inside.sum() < 3 or (rules.mode == "elastic" and inside.sum() > rules.max_length):
        raise ValueError("the query needs 3 bars at least, and max_length at most in elastic mode")
    values, days = got[list(_BAR)].to_numpy(float), (pd.to_datetime(got["date"]) - pd.Timestamp(0)).dt.days.to_numpy()
    first = int(np.flatnonzero(inside)[0])
    weekly = M.weekly_parts(_weeks(days), values, first, len(days) - 1, rules.weekly_prior) if timeframe == "D" and rules.weekly_weight > 0 else None
    if weekly is not None and len(weekly[1]) < 3:
        weekly = None
    return Query(symbol, days[first:], values[first:], values[first - 1, 3] if first else values[first, 3], weekly)


def window_distances(bars: DataFrame, symbol: str, start: str, end: str, rules: SearchRules = SearchRules()) -> DataFrame:
    """Every window of the query's lengths with its distances in the recall: mass, structure, event, state, coverage, missing."""
    rules.check()
    frame = _framed(bars, "D")
    query = query_of(frame, symbol, start, end, rules)
    kernel = _recall_kernel(query, rules, False, False, False, candidate_lengths(len(query.days), rules), everything=True)
    return frame.groupBy("ts_code").applyInArrow(kernel, _CANDIDATE).drop("paths")


def search(bars: DataFrame, symbol: str, start: str, end: str, rules: SearchRules = SearchRules(), timeframe: str = "D", history_only: bool = False, exclude_query: bool = True, latest: bool = False, counters: Observation | None = None, seconds: dict | None = None) -> DataFrame:
    """The best ``top_k`` windows like the query's: rank, ts_code, dates, length, score and all distances.

    ``bars``: ts_code, date, open, high, low, close, vol, unique by key; bars that are not finite and positive are
    left out. ``timeframe`` W or M merges them first. ``history_only`` keeps windows that end before the query
    starts; ``exclude_query`` those of its own series that overlap it; ``latest`` looks only at the last window of
    every other series that is not out of date. ``counters`` gets the number of candidates and of each path's (see :func:`scanned`
    for series and windows), ``seconds`` the time of each phase that runs here. ValueError for modes, weights and
    timeframes out of range, and for less than three bars or, in elastic mode, more than ``max_length``.
    """
    rules.check()
    clock, spent = time.perf_counter, seconds if seconds is not None else {}

    def mark(phase: str, began: float) -> float:
        spent[phase] = clock() - began
        return clock()

    began = clock()
    frame = _framed(bars, timeframe)
    query = query_of(frame, symbol, start, end, rules, timeframe)
    _, qe, _, _ = query.parts(rules)
    began = mark("load", began)
    lengths = candidate_lengths(len(query.days), rules)
    scanned_ = frame
    if latest:
        newest = frame.agg(F.max("date").alias("newest")).first()["newest"]
        fresh = frame.groupBy("ts_code").agg(F.max("date").alias("own_last")).filter(F.col("own_last") >= F.date_sub(F.lit(newest), LAG_DAYS[timeframe])).select("ts_code")
        scanned_ = frame.filter(F.col("ts_code") != symbol).join(fresh, "ts_code", "left_semi")
    count = 10 if latest else rules.top_k
    recall = _recall_kernel(query, rules, history_only, exclude_query, latest, lengths)
    schema = f"{_CANDIDATE}, {', '.join(_METRIC.split(', ')[3:])}"
    if rules.exact:
        kept = scanned_.groupBy("ts_code").applyInArrow(_best_kernel(query, rules, history_only, exclude_query, latest, lengths, count), _KEPT)
        best = kept.orderBy(F.col("score").desc(), "ts_code", "start_date").limit(count).select("ts_code", "start_idx", "length").toPandas()
        began = mark("scan", began)
        only = _by_length(best)
        whole = _recall_kernel(query, rules, history_only, exclude_query, latest, lengths, True, only)
        df = scanned_.filter(F.col("ts_code").isin(list(only))).groupBy("ts_code").applyInArrow(_exact_kernel(whole, query, rules), schema)
        wanted = [F.struct(F.lit(code).alias("ts_code"), F.lit(int(k)).alias("start_idx"), F.lit(int(m)).alias("length")) for code, k, m in best.itertuples(index=False)]
        df = df.filter(F.struct("ts_code", "start_idx", "length").isin(*wanted) if wanted else F.lit(False))
    elif rules.refine:
        df = scanned_.groupBy("ts_code").applyInArrow(_exact_kernel(recall, query, rules), schema)
        df = cut(df)
        best = _scored(df, query, rules).orderBy(F.col("score").desc(), "ts_code", "start_date").limit(rules.refine).select("ts_code", "start_idx").toPandas()
        only = _around(best, rules)
        whole = _recall_kernel(query, rules, history_only, exclude_query, latest, lengths, True, {code: dict.fromkeys(lengths, x) for code, x in only.items()})
        near = scanned_.filter(F.col("ts_code").isin(list(only))).groupBy("ts_code").applyInArrow(_exact_kernel(whole, query, rules), schema)
        df = near.unionByName(df.join(F.broadcast(best_frame(scanned_, only)), "ts_code", "left").filter("inside is null or not array_contains(inside, start_idx)").drop("inside"))
        began = mark("refinement", began)
    else:
        recalled = scanned_.groupBy("ts_code").applyInArrow(recall, _CANDIDATE)
        if counters is not None:
            recalled = recalled.observe(counters, F.count("*").alias("candidates"), *[F.count_if(F.col("paths").contains(p)).alias(f"{p}_path") for p in ("mass", "structure", "event", "state")])
        recalled = cut(recalled)
        began = mark("recall", began)
        kept = bounded(recalled, rules.recall_n, bool(qe.any()))
        windows = _by_length(kept)
        shortlist = bars.sparkSession.createDataFrame(kept[[x.split()[0] for x in _CANDIDATE.split(", ")]], _CANDIDATE) if len(kept) else recalled.limit(0)
        near = frame.filter(F.col("ts_code").isin(list(windows))).groupBy("ts_code")
        began = mark("selection", began)
        middle, spread = np.zeros(7), np.ones(7)
        if rules.mode == "fixed":
            # recall_n windows of the query's length at most.
            got = near.applyInArrow(_feature_kernel(rules, windows), ", ".join(f"f{k} double" for k in range(7))).toArrow()
            whole = np.concatenate([np.stack([got[f"f{k}"].to_numpy() for k in range(7)], axis=1), query.parts(rules)[0]])
            low, middle, high = np.quantile(whole, (0.25, 0.5, 0.75), axis=0)
            spread = np.maximum(high - low, 1e-6)
            began = mark("scale", began)
        metrics = near.applyInArrow(_rerank_kernel(query, rules, middle, spread, windows), _METRIC)
        df = metrics.join(F.broadcast(shortlist), ["ts_code", "start_idx", "length"])
    return _ranked(df, query, rules, count)


def _ranked(df: DataFrame, query: Query, rules: SearchRules, count: int) -> DataFrame:
    best = suppressed(_scored(df, query, rules), rules.overlap, count)
    top = best.orderBy(F.col("score").desc(), "ts_code", "start_date").limit(count)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "ts_code", "start_date")))


def _by_length(windows: pd.DataFrame) -> dict[str, dict[int, np.ndarray]]:
    """Starts of windows by code and length."""
    return {code: {int(m): x["start_idx"].to_numpy(np.int64) for m, x in g.groupby("length")} for code, g in windows.groupby("ts_code")}


def _around(best: pd.DataFrame, rules: SearchRules) -> dict[str, np.ndarray]:
    """Starts within ``refine_bars`` bars of those of ``best``, by code."""
    around = np.arange(-rules.refine_bars, rules.refine_bars + 1)
    return {code: np.unique((g["start_idx"].to_numpy()[:, None] + around).ravel()) for code, g in best.groupby("ts_code")}


def searches(bars: DataFrame, symbol: str, start: str, end: str, several: dict[str, SearchRules], history_only: bool = False, exclude_query: bool = True) -> dict[str, DataFrame]:
    """What :func:`search` gives for each of the rules, by name (without ``paths``), from one scan of the series and one re-ranking.

    The rules are of the elastic mode and may differ in ``step``, ``local_top``, ``recall_n``, ``top_k``, ``exact``, ``refine`` and
    ``refine_bars``. A refined search's candidates below the best ``refine`` ones aren't re-ranked: they matter only where
    fewer than ``top_k`` windows above them stay, and where that is so, the search is run by itself."""
    free = dict.fromkeys(("step", "local_top", "recall_n", "top_k", "exact", "refine", "refine_bars"))
    for rules in several.values():
        rules.check()
    if any(r.mode != "elastic" for r in several.values()) or len({str(replace(r, **dict.fromkeys(free, 0))) for r in several.values()}) != 1:
        raise ValueError("the searches must be elastic, with equal rules but for steps, counts, exact and refine")
    rules = next(iter(several.values()))
    frame = _framed(bars, "D")
    query = query_of(frame, symbol, start, end, rules)
    lengths = candidate_lengths(len(query.days), rules)
    found = cut(frame.groupBy("ts_code").applyInArrow(_several_kernel(query, several, history_only, exclude_query, lengths), _FOUND))
    key = ["ts_code", "start_idx", "length"]
    chosen, lowest = {}, {}
    for name, r in several.items():
        own = found.filter(F.col("search") == name).drop("search")
        if r.exact or r.refine:
            best = own.orderBy(F.col("score").desc(), "ts_code", "start_date").limit(r.refine or r.top_k).select(*key, "score").toPandas()
            lowest[name] = best["score"].min() if len(best) == r.refine else -np.inf
        else:
            best = bounded(own.drop("score"), r.recall_n, bool(query.parts(r)[1].any()))
        chosen[name] = _around(best, r) if r.refine else best[key]
    only: dict[str, dict[int, np.ndarray]] = {}
    for x in chosen.values():
        for code, own in ({code: dict.fromkeys(lengths, at) for code, at in x.items()} if isinstance(x, dict) else _by_length(x)).items():
            for m, at in own.items():
                only.setdefault(code, {})[m] = np.union1d(only.get(code, {}).get(m, at), at)
    whole = _recall_kernel(query, replace(rules, step=1), history_only, exclude_query, False, lengths, True, only)
    every = cut(frame.filter(F.col("ts_code").isin(list(only))).groupBy("ts_code").applyInArrow(_exact_kernel(whole, query, rules), f"{_CANDIDATE}, {', '.join(_METRIC.split(', ')[3:])}").drop("paths"))
    out = {}
    for name, r in several.items():
        if r.refine:
            df = every.join(F.broadcast(best_frame(frame, chosen[name])), "ts_code").filter("array_contains(inside, start_idx)").drop("inside") if chosen[name] else every.limit(0)
        else:
            df = every.join(F.broadcast(frame.sparkSession.createDataFrame(chosen[name], "ts_code string, start_idx int, length int")), key) if len(chosen[name]) else every.limit(0)
        out[name] = cut(_ranked(df, query, r, r.top_k))
        if name in lowest and lowest[name] > -np.inf:
            scores = [x["score"] for x in out[name].select("score").collect()]
            if len(scores) < r.top_k or min(scores) < lowest[name] + _ROOM:
                out[name] = search(bars, symbol, start, end, r, history_only=history_only, exclude_query=exclude_query).drop("paths")
    return out


def suppressed(scored: DataFrame, overlap: float, most: int | None = None) -> DataFrame:
    """The windows that stay: from the best score down, none that shares more than ``overlap`` of the shorter one's bars
    with a better one of its series; at most ``most`` of a series."""
    return scored.groupBy("ts_code").applyInArrow(kept_windows(overlap, most), scored.schema)
