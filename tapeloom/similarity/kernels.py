"""What runs in Python workers for the search: NumPy and Arrow only, so that a worker starts quickly."""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from tapeloom.similarity import measures as M


@dataclass(frozen=True)
class SearchRules:
    """Fixed values of the search. ``step`` is the stride of the elastic scan (see :func:`stride`); 1 looks at every
    window. ``min_length`` and ``max_length`` bound the windows of the elastic mode. ``exact`` compares every window, in
    elastic mode, whose score doesn't depend on the other candidates. With ``refine`` all candidates of a series are re-ranked
    where it lies, without the bound ``recall_n``, and so are all windows within ``refine_bars`` bars of the best
    ``refine`` ones. Weights lie between 0 and 1."""

    mode: str = "fixed"
    min_length: int = 8
    max_length: int = 250
    lengths: int = 3
    step: int = 1
    local_top: int = 20
    recall_n: int = 1000
    top_k: int = 20
    exclusion: float = 0.25
    warp: float = 0.08
    clip: float = 5.0
    overlap: float = 0.25
    self_overlap: float = 0.2
    use_volume: bool = True
    weekly_weight: float = 0.25
    weekly_prior: int = 8
    event_bands: bool = True
    exact: bool = False
    refine: int = 0
    refine_bars: int = 10
    score_weights: dict = field(default_factory=lambda: {"mass": 0.15, "dtw": 0.30, "aligned": 0.20, "ret": 0.10, "vol": 0.05, "event": 0.20})

    def check(self) -> None:
        """ValueError for a mode, bound or weight out of range."""
        if self.mode not in ("fixed", "elastic"):
            raise ValueError("unknown mode")
        if (self.exact or self.refine) and self.mode != "elastic":
            raise ValueError("scores of the fixed mode are ranks among the candidates: exact and refine need the elastic mode")
        if min(self.lengths, self.step, self.local_top, self.recall_n, self.top_k) < 1 or self.weekly_prior < 0:
            raise ValueError("counts must be 1 at least")
        shares = (self.exclusion, self.warp, self.overlap, self.self_overlap, self.weekly_weight, *self.score_weights.values())
        if not all(np.isfinite(x) and 0 <= x <= 1 for x in shares) or not sum(self.score_weights.values()) > 0 or not self.clip > 0:
            raise ValueError("weights and shares must lie between 0 and 1")


def stride(length: int, most: int = 8) -> int:
    """The stride for a quick scan of windows of a length: a quarter of it, from 1 to ``most``."""
    return min(most, max(1, length // 4))


LAG_DAYS = {"D": 7, "W": 14, "M": 45}
_BAR = ("open", "high", "low", "close", "vol")
_CANDIDATE = "ts_code string, start_idx int, length int, mass double, structure double, event double, state double, coverage double, missing int, paths string, start_date date, end_date date"


def limit_of(code: str) -> float:
    return 0.2 if code[:3] in ("300", "301", "688", "689") else 0.3 if code[:1] in ("4", "8") else 0.1


def candidate_lengths(length: int, rules: SearchRules) -> list[int]:
    """Window lengths to look at: the query's own, and in elastic mode the allowed ones nearest to it, of which the
    search keeps the own and those closest to four and six fifths of it."""
    if rules.mode == "fixed":
        return [length]
    if length < 8:
        near = {length - 1, length, length + 1}
    else:
        delta = min(max(2, round(0.2 * length)), 20)
        near = {length - delta, length, length + delta} | {round(length * r / 100) for r in range(75, 136, 10)}
    low, high = max(rules.min_length, 3), rules.max_length
    if low > high:
        raise ValueError("min_length above max_length")
    fit = [x for x in sorted(near, key=lambda x: (abs(x - length), x)) if low <= x <= high][:9] or [min(max(length, low), high)]
    if len(fit) <= rules.lengths:
        return sorted(fit)
    aims = [length, 0.8 * length, 1.2 * length][: rules.lengths]
    return sorted({min(fit, key=lambda x: (abs(x - aim), x)) for aim in aims})


@dataclass
class Query:
    """The query window with all that the kernels need of it."""

    symbol: str
    days: np.ndarray
    bars: np.ndarray
    previous: float
    weekly: tuple | None
    known: dict = field(default_factory=dict, repr=False, compare=False)

    def parts(self, rules: SearchRules):
        """Features, events, states and salience of the query's bars."""
        if rules.use_volume not in self.known:
            self.known[rules.use_volume] = self._parts(rules)
        return self.known[rules.use_volume]

    def _parts(self, rules: SearchRules):
        o, h, lo, c, v = (self.bars[None, :, k] for k in range(5))
        features = M.bar_features(o, h, lo, c, v, rules.use_volume)[0]
        events = M.board_events(o, h, lo, c, np.array([self.previous]), limit_of(self.symbol))[0]
        state, loud = M.states(M.bar_features(o, h, lo, c, v)[0], events)
        return features, events, state, loud


def _windows(bars: np.ndarray, starts: np.ndarray, m: int) -> list[np.ndarray]:
    views = np.lib.stride_tricks.sliding_window_view(bars, m, axis=0)[starts]
    return [views[:, k] for k in range(5)]


def _previous(bars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    close = bars[:, 3]
    return np.where(starts > 0, close[np.maximum(starts - 1, 0)], close[starts])


def _scan(series: M.Series, m: int, starts: np.ndarray, query: Query, rules: SearchRules) -> dict[str, np.ndarray]:
    """Distances of the windows of length ``m`` at ``starts``."""
    qf, qe, qs, _ = query.parts(rules)
    coverage, missing = (x[starts] for x in series.coverage(qe, m))
    if rules.mode == "fixed":
        return {"mass": series.shape(query.bars[:, 3])[starts], "structure": series.structure(qf)[starts], "event": series.event(qe)[starts], "state": np.zeros(len(starts)), "coverage": coverage, "missing": missing}
    n = len(query.days)
    buckets = min(n, m, int(np.clip(round(n / 2), 8, 32)))
    own = M.coarse(*(query.bars[None, :, k] for k in range(5)), buckets)
    own_features, own_modes = M.bar_features(*own, rules.use_volume)[0], M.bucket_modes(qs[None], buckets)[0]
    own_events = np.maximum.reduceat(qe, M.bucket_starts(n, buckets), axis=0)
    found = series.coarse_distances(m, starts, own[3][0], own_features, own_events, own_modes)
    return dict(zip(("mass", "structure", "event", "state"), found, strict=True)) | {"coverage": coverage, "missing": missing}


def _bars_of(table: pa.Table) -> tuple[str, np.ndarray, np.ndarray]:
    """Code, days and bars (open, high, low, close, vol) of one series, in date order."""
    table = table.sort_by("date")
    bars = np.stack([table[c].to_numpy(zero_copy_only=False).astype(float) for c in _BAR], axis=1)
    bars[:, 4] = np.nan_to_num(bars[:, 4])
    return table["ts_code"][0].as_py(), table["date"].cast(pa.int32()).to_numpy(), bars


def _legal(code: str, first: np.ndarray, last: np.ndarray, query: Query, rules: SearchRules, history_only: bool, exclude: bool) -> np.ndarray:
    legal = np.ones(len(first), bool)
    if history_only:
        legal &= last < query.days[0]
    if exclude and code == query.symbol:
        span = np.minimum(last, query.days[-1]) - np.maximum(first, query.days[0])
        legal &= np.maximum(span, 0) / (query.days[-1] - query.days[0] + 1) <= rules.self_overlap
    return legal


def _recall_kernel(query: Query, rules: SearchRules, history_only: bool, exclude: bool, latest: bool, lengths: list[int], everything: bool = False, only: dict[str, dict[int, np.ndarray]] | None = None):
    """The best windows of each path of a series, or with ``everything`` all legal ones, or those of ``only`` (starts by code and length)."""
    has_events = bool(query.parts(rules)[1].any())

    def recall(table: pa.Table) -> pa.Table:
        code, days, bars = _bars_of(table)
        series = M.Series(bars, limit_of(code), rules.use_volume)
        out = []
        for m in lengths:
            if len(days) < m:
                continue
            step = rules.step if rules.mode == "elastic" and not latest else 1
            starts = np.array([len(days) - m]) if latest else np.arange(0, len(days) - m + 1, step)
            if only is not None:
                starts = np.intersect1d(only.get(code, {}).get(m, starts[:0]), starts)
                if not len(starts):
                    continue
            found = _scan(series, m, starts, query, rules)
            legal = _legal(code, days[starts], days[starts + m - 1], query, rules, history_only and not latest, exclude)
            paths = {int(k): ["all"] for k in np.flatnonzero(legal)} if everything else _paths(_minima(found, legal, m, rules, step, has_events, rules.local_top), rules.local_top)
            out.append(_candidates(code, days, starts, m, found, paths))
        return pa.concat_tables(out) if out else _table(_CANDIDATE, [[]] * 12)

    return recall


_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "date": pa.date32()}


def _table(schema: str, columns: list) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    arrays = [pa.array(x, pa.int32()).cast(pa.date32()) if t == "date" else pa.array(x, _KINDS[t]) for x, (_, t) in zip(columns, fields, strict=True)]
    return pa.table(arrays, names=[n for n, _ in fields])


def _minima(found: dict[str, np.ndarray], legal: np.ndarray, m: int, rules: SearchRules, step: int, has_events: bool, count: int) -> dict[str, list[int]]:
    """The ``count`` best legal windows of each path, the best first, by their place in ``found``."""
    elastic = rules.mode == "elastic"
    miss = 2.0 * (1.0 - found["coverage"])
    total = found["mass"] + 0.75 * found["event"] + miss
    if elastic:
        total = total + 0.35 * found["structure"] + 0.25 * found["state"]
    ways = {"mass": total, "structure": found["structure"]} | ({"state": found["state"]} if elastic else {}) | ({"event": found["event"] + miss} if has_events else {})
    radius = max(1, round(max(3, m * rules.exclusion) / step)) if elastic else max(5, int(m * rules.exclusion))
    return {name: M.local_minima(np.where(legal, x, np.inf), count, radius) for name, x in ways.items()}


def _paths(minima: dict[str, list[int]], count: int) -> dict[int, list[str]]:
    """The paths that lead to a window: it is among the path's ``count`` best."""
    paths: dict[int, list[str]] = {}
    for name, places in minima.items():
        for k in places[:count]:
            paths.setdefault(k, []).append(name)
    return paths


def _candidates(code: str, days: np.ndarray, starts: np.ndarray, m: int, found: dict[str, np.ndarray], paths: dict[int, list[str]]) -> pa.Table:
    at = np.fromiter(paths, np.int64, len(paths))
    first = starts[at]
    return _table(_CANDIDATE, [[code] * len(at), first, np.full(len(at), m), *[found[x][at] for x in ("mass", "structure", "event", "state", "coverage")], found["missing"][at], ["+".join(sorted(p)) for p in paths.values()], days[first], days[first + m - 1]])


_METRIC = "ts_code string, start_idx int, length int, dtw double, aligned double, ret double, vol double, event_seq double, state_edit double, anchor double, steps int, skipped_query int, skipped_window int, weekly double, weekly_share double, weekly_weeks int"


def _weeks(days: np.ndarray) -> np.ndarray:
    return (days + 5) // 7  # weeks end on Friday: day 0 is a Thursday


def _weekly(days: np.ndarray, bars: np.ndarray, start: np.ndarray, m: int, query: Query, rules: SearchRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not query.weekly:
        return np.full(len(start), np.nan), np.full(len(start), np.nan), np.zeros(len(start), int)
    return M.weekly_distances(query.weekly, _weeks(days), bars, start, m, rules.weekly_prior, rules.use_volume)


def _path(c: np.ndarray, query: Query) -> tuple[np.ndarray, np.ndarray]:
    """How far returns and volatilities of windows of closes are from the query's."""
    qret, qvol = np.log(query.bars[-1, 3] / query.bars[0, 3]), np.diff(np.log(query.bars[:, 3])).std()
    return np.abs(np.log(c[:, -1] / c[:, 0]) - qret), np.abs(np.log((np.diff(np.log(c), axis=1).std(axis=1) + 1e-9) / (qvol + 1e-9)))


def _elastic_weights(qf: np.ndarray, rules: SearchRules) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features, in units of the query's spread, and of the event flags."""
    return np.sqrt(M.FEATURE_WEIGHTS) * np.where(np.arange(7) < 6, 1.0, float(rules.use_volume)) / np.maximum(qf.std(axis=0), 1e-3), np.sqrt(0.2 * M.EVENT_WEIGHTS)


def _elastic(code: str, bars: np.ndarray, start: np.ndarray, m: int, query: Query, rules: SearchRules) -> tuple:
    """What the elastic mode compares: the query, the windows, and the windows' events, states, salience and closes."""
    qf, qe, _, _ = query.parts(rules)
    weights, flags = _elastic_weights(qf, rules)
    o, h, lo, c, v = _windows(bars, start, m)
    events = M.board_events(o, h, lo, c, _previous(bars, start), limit_of(code))
    features = M.bar_features(o, h, lo, c, v)
    state, loud = M.states(features, events)
    used = features if rules.use_volume else M.bar_features(o, h, lo, c, v, False)
    return np.concatenate([qf * weights, qe * flags], axis=1), np.concatenate([used * weights, events * flags], axis=2), events, state, loud, c


def _rerank(code: str, days: np.ndarray, bars: np.ndarray, start: np.ndarray, m: int, query: Query, rules: SearchRules, middle: np.ndarray, spread: np.ndarray) -> list:
    """Columns of ``_METRIC`` for the windows of ``m`` bars at ``start``."""
    qf, qe, qs, ql = query.parts(rules)
    zero = np.zeros(len(start))
    if rules.mode == "elastic":
        q, x, events, state, loud, c = _elastic(code, bars, start, m, query, rules)
        dtw, steps, over_q, over_c = M.elastic_distance(q, x, ql, loud)
        edit, anchor = M.edit_distance(qs, state, ql, loud), M.anchor_distance(query.bars[:, 3], c)
        aligned = np.sqrt(np.mean((M.resampled_windows(x, len(q)) - q) ** 2, axis=(1, 2)))
    else:
        weights, flags = np.sqrt(M.FEATURE_WEIGHTS) * np.where(np.arange(7) < 6, 1.0, float(rules.use_volume)), np.sqrt(0.2 * M.EVENT_WEIGHTS)
        scaled = lambda x: np.clip((x - middle) / spread, -rules.clip, rules.clip) * weights
        q = np.concatenate([scaled(qf), qe * flags], axis=1)
        o, h, lo, c, v = _windows(bars, start, m)
        events = M.board_events(o, h, lo, c, _previous(bars, start), limit_of(code))
        x = np.concatenate([scaled(M.bar_features(o, h, lo, c, v, rules.use_volume)), events * flags], axis=2)
        dtw, steps, over_q, over_c, edit, anchor = M.warped_distance(q, x, max(1, round(m * rules.warp))), zero, zero, zero, zero, zero
        aligned = np.sqrt(np.mean(((x - q) ** 2).sum(axis=2), axis=1))
    ret, vol = _path(c, query)
    weekly = _weekly(days, bars, start, m, query, rules)
    return [[code] * len(start), start, [m] * len(start), dtw, aligned, ret, vol, M.event_sequences(qe, events), edit, anchor, steps, over_q, over_c, *weekly]


def _rerank_kernel(query: Query, rules: SearchRules, middle: np.ndarray, spread: np.ndarray, windows: dict[str, dict[int, np.ndarray]], block: int = 512):
    """Metrics of a series' shortlisted ``windows`` (by code and length)."""
    fields = [x.split() for x in _METRIC.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}

    def rerank(table: pa.Table) -> pa.Table:
        code, days, bars = _bars_of(table)
        out = [pa.table([pa.array([], kinds[t]) for _, t in fields], names=[n for n, _ in fields])]
        for m, start in windows.get(code, {}).items():
            for k in range(0, len(start), block):
                columns = _rerank(code, days, bars, start[k : k + block], m, query, rules, middle, spread)
                out.append(pa.table([pa.array(np.asarray(x).tolist(), kinds[t]) for x, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]))
        return pa.concat_tables(out)

    return rerank


def _scores(total: np.ndarray, week: np.ndarray, event_seq: np.ndarray, coverage: np.ndarray, missing: np.ndarray, query: Query, rules: SearchRules) -> np.ndarray:
    """The elastic mode's score; it falls with ``total`` and ``event_seq``, so with parts of them it is an upper bound."""
    score = 1.0 / (1.0 + np.maximum(total, 0.0))
    if query.weekly is not None:
        weight = rules.weekly_weight * min(1.0, len(query.weekly[1]) / 3.0)
        score = (1.0 - weight) * score + weight * week
    if rules.event_bands and query.parts(rules)[1].any():
        quality = coverage * np.clip(1.0 - event_seq, 0.0, 1.0)
        score = np.where((missing == 0) & (event_seq <= 1e-9), 0.5 + 0.5 * score, np.where(missing == 0, 0.25 + 0.25 * score * quality, 0.25 * (0.5 * score + 0.5 * quality)))
    return score


_KEPT = "ts_code string, start_idx int, length int, score double, start_date date"
#: Bounds are compared with this much room for rounding.
_ROOM = 1e-6


class _Scorer:
    """Scores of the windows of a series that can reach a floor. A window is scored part by part, the cheap ones first, and
    left out as soon as an upper bound of its score lies below its floor."""

    def __init__(self, query: Query, rules: SearchRules):
        self.query, self.rules, self.parts = query, rules, query.parts(rules)
        self.weights = _elastic_weights(self.parts[0], rules)

    def beside(self, series: M.Series) -> M.Beside:
        qf, qe, qs, ql = self.parts
        return M.Beside(series, np.concatenate([qf * self.weights[0], qe * self.weights[1]], axis=1), qs, ql, *self.weights)

    def __call__(self, code: str, days: np.ndarray, bars: np.ndarray, series: M.Series, beside: M.Beside, m: int, start: np.ndarray, floor: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``start`` of the windows that reach their ``floor``, and their scores."""
        query, rules, (_, qe, _, ql) = self.query, self.rules, self.parts
        coverage, missing = (x[start] for x in series.coverage(qe, m))
        week, zero = np.ones(len(start)), np.zeros(len(start))
        rest = 0.05 * abs(np.log(m / len(query.days))) + zero
        places, scores = [], []

        def some(at: np.ndarray, total: np.ndarray, events: np.ndarray | float = 0.0) -> np.ndarray:
            return _scores(total, week[at], zero[at] + events, coverage[at], missing[at], query, rules) >= floor[at]

        for k in range(0, len(start), block):
            at = np.arange(k, min(k + block, len(start)))
            c = _windows(bars, start[at], m)[3]
            ret, vol = _path(c, query)
            rest[at] += 0.20 * M.anchor_distance(query.bars[:, 3], c) + 0.10 * (0.5 * np.minimum(ret, 2.0) + 0.5 * np.minimum(vol, 2.0))
        left = np.flatnonzero(some(np.arange(len(start)), rest))
        if len(left):
            edit = 0.25 * beside.edit_bound(m)[start]
            left = left[some(left, rest[left] + edit[left])]
        if query.weekly is not None and len(left):
            distance, share, _ = _weekly(days, bars, start[left], m, query, rules)
            week[left] = share / (1.0 + distance)
            left = left[some(left, rest[left] + edit[left])]
        if len(left):
            least = np.zeros(len(start))
            for k in range(0, len(left), block):
                least[left[k : k + block]] = 0.30 * beside.elastic_bound(m, start[left[k : k + block]])
            left = left[some(left, rest[left] + edit[left] + least[left])]
        for k in range(0, len(left), block):
            at = left[k : k + block]
            rest[at] += 0.25 * beside.edit(m, start[at])
            at = at[some(at, rest[at] + least[at])]
            if not len(at):
                continue
            q, x, events, _, loud, _ = _elastic(code, bars, start[at], m, query, rules)
            sequence = M.event_sequences(qe, events)
            total = rest[at] + 0.20 * sequence
            stay = some(at, total + least[at], sequence)
            at, sequence = at[stay], sequence[stay]
            total = total[stay] + 0.30 * M.elastic_distance(q, x[stay], ql, loud[stay])[0]
            places.append(at)
            scores.append(_scores(total, week[at], sequence, coverage[at], missing[at], query, rules))
        return (np.concatenate(places), np.concatenate(scores)) if places else (np.zeros(0, np.int64), zero[:0])


class _Best:
    """The best ``count`` values of a task so far; ``floor`` is the least of them, with room for rounding."""

    def __init__(self, count: int):
        self.count, self.values = count, np.zeros(0)

    @property
    def floor(self) -> float:
        return self.values[0] - _ROOM if len(self.values) == self.count else -np.inf

    def add(self, values: np.ndarray) -> None:
        self.values = np.sort(np.concatenate([self.values, values]))[-self.count :]


def _best_kernel(query: Query, rules: SearchRules, history_only: bool, exclude: bool, latest: bool, lengths: list[int], count: int):
    """The windows of a series that can be among the best ``count`` of all, overlaps suppressed: every legal window has its
    score, or an upper bound of it that lies below the score of ``count`` windows that stay in the series seen before.

    Windows of one series don't suppress those of another, and better ones are never suppressed by worse ones, so what is
    below that score can't change the result. A task's first series are scored whole."""
    scorer, best, keep = _Scorer(query, rules), _Best(count), kept_windows(rules.overlap, count)

    def whole(table: pa.Table) -> pa.Table:
        if len(table) < min(lengths):
            return _table(_KEPT, [[]] * 5)
        code, days, bars = _bars_of(table)
        series = M.Series(bars, limit_of(code), rules.use_volume)
        beside, found = scorer.beside(series), []
        for m in lengths:
            if len(days) >= m:
                start = np.array([len(days) - m]) if latest else np.arange(0, len(days) - m + 1, rules.step)
                start = start[_legal(code, days[start], days[start + m - 1], query, rules, history_only and not latest, exclude)]
                at, score = scorer(code, days, bars, series, beside, m, start, np.full(len(start), best.floor))
                found.append((start[at], np.full(len(at), m), score))
        start, length, score = (np.concatenate(x) for x in zip(*found, strict=True))
        near = score >= best.floor
        stays = keep(_table(_KEPT, [[code] * int(near.sum()), start[near], length[near], score[near], days[start[near]]]))
        best.add(stays["score"].to_numpy())
        return stays

    return whole


class _Heads:
    """Which candidates of a search can be among the first ``limit`` of a head of :func:`search.bounded`, as far as a task knows."""

    def __init__(self, limit: int, events: bool):
        self.heads = {x: _Best(limit) for x in ("all", "structure", *["complete"] * events)}

    def __call__(self, found: dict[str, np.ndarray], paths: dict[int, list[str]]) -> dict[int, list[str]]:
        at = np.fromiter(paths, np.int64, len(paths))
        key = found["mass"][at] + 0.75 * found["event"][at] + 2.0 * (1.0 - found["coverage"][at])
        in_heads = {"all": np.ones(len(at), bool), "structure": np.array(["structure" in p for p in paths.values()], bool), "complete": found["missing"][at] == 0}
        stays = np.zeros(len(at), bool)
        for name, best in self.heads.items():
            best.add(-key[in_heads[name]])
            stays |= in_heads[name] & (-key >= best.floor)
        return {k: p for (k, p), kept in zip(paths.items(), stays, strict=True) if kept}


_FOUND = f"search string, {_CANDIDATE}, score double"


def _several_kernel(query: Query, searches: dict[str, SearchRules], history_only: bool, exclude: bool, lengths: list[int]):
    """What the scans of several elastic searches take from a series, by the search's name, each series being looked at once. The
    searches may differ in ``step``, ``local_top``, ``recall_n``, ``exact`` and ``refine``.

    Of a bounded search: the candidates that can be in its shortlist. Of a refined one: the candidates that can be among
    the best ``refine``, with their scores. Of an exact one: what :func:`_best_kernel` gives. What a task has seen decides."""
    any_ = next(iter(searches.values()))
    scorer, has_events = _Scorer(query, any_), bool(query.parts(any_)[1].any())
    heads = {n: _Heads(r.recall_n, has_events) for n, r in searches.items() if not r.exact and not r.refine}
    best = {n: _Best(r.refine or r.top_k) for n, r in searches.items() if r.exact or r.refine}
    keep = {n: kept_windows(r.overlap, r.top_k) for n, r in searches.items() if r.exact}

    def named(name: str, candidates: pa.Table, score: np.ndarray) -> pa.Table:
        return pa.table([pa.array([name] * len(candidates), pa.string()), *candidates.columns, pa.array(score, pa.float64())], names=[x.split()[0] for x in _FOUND.split(", ")])

    def several(table: pa.Table) -> pa.Table:
        out, scored = [named("", _table(_CANDIDATE, [[]] * 12), [])], {n: [] for n in best}
        if len(table) < min(lengths):
            return out[0]
        code, days, bars = _bars_of(table)
        series = M.Series(bars, limit_of(code), any_.use_volume)
        beside = scorer.beside(series)
        for m in lengths:
            if len(days) < m:
                continue
            starts = np.arange(len(days) - m + 1)
            whole = _scan(series, m, starts, query, any_)
            legal = _legal(code, days[starts], days[starts + m - 1], query, any_, history_only, exclude)
            floor, wanted, minima = np.full(len(starts), np.inf), {}, {}
            for name, rules in searches.items():
                if rules.exact:
                    at, paths = np.flatnonzero(legal[:: rules.step]), None
                else:
                    found = {k: x[:: rules.step] for k, x in whole.items()}
                    if rules.step not in minima:
                        minima[rules.step] = _minima(found, legal[:: rules.step], m, rules, rules.step, has_events, max(r.local_top for r in searches.values() if r.step == rules.step))
                    paths = _paths(minima[rules.step], rules.local_top)
                    if name in heads:
                        if paths := heads[name](found, paths):
                            kept = _candidates(code, days, starts[:: rules.step], m, found, paths)
                            out.append(named(name, kept, np.full(len(kept), np.nan)))
                        continue
                    at = np.fromiter(paths, np.int64, len(paths))
                wanted[name] = at, paths
                floor[at * rules.step] = np.minimum(floor[at * rules.step], best[name].floor)
            own = np.flatnonzero(floor < np.inf)
            at, some = scorer(code, days, bars, series, beside, m, own, floor[own])
            score = np.full(len(starts), -np.inf)
            score[own[at]] = some
            for name, (at, paths) in wanted.items():
                step = searches[name].step
                near = at[(score[at * step] > -np.inf) & (score[at * step] >= best[name].floor)]
                if len(near):
                    kept = _candidates(code, days, starts[::step], m, {k: x[::step] for k, x in whole.items()}, {k: paths[k] if paths else ["all"] for k in near.tolist()})
                    scored[name].append(named(name, kept, score[near * step]))
        for name, tables in scored.items():
            if tables:
                kept = pa.concat_tables(tables)
                kept = keep[name](kept) if name in keep else kept
                best[name].add(kept["score"].to_numpy())
                out.append(kept)
        return pa.concat_tables(out)

    return several


def _exact_kernel(recall, query: Query, rules: SearchRules, block: int = 512):
    """Every legal window of a series with its metrics: recall and re-ranking in one."""
    fields = [x.split() for x in _METRIC.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}

    def whole(table: pa.Table) -> pa.Table:
        candidates = recall(table)
        code, days, bars = _bars_of(table)
        start, length = candidates["start_idx"].to_numpy(), candidates["length"].to_numpy()
        more: dict[str, list] = {n: [] for n, _ in fields[3:]}
        # Candidates stand by length and start, as the kernel gives them.
        for m in dict.fromkeys(length.tolist()):
            own = start[length == m]
            for k in range(0, len(own), block):
                for (n, _), x in zip(fields[3:], _rerank(code, days, bars, own[k : k + block], m, query, rules, np.zeros(7), np.ones(7))[3:], strict=True):
                    more[n] += np.asarray(x).tolist()
        for n, t in fields[3:]:
            candidates = candidates.append_column(n, pa.array(more[n], kinds[t]))
        return candidates

    return whole


def _feature_kernel(rules: SearchRules, windows: dict[str, dict[int, np.ndarray]]):
    """Bar features of shortlisted windows, for the robust scale."""

    def rows(table: pa.Table) -> pa.Table:
        code, _, bars = _bars_of(table)
        x = [M.bar_features(*_windows(bars, start, m), rules.use_volume).reshape(-1, 7) for m, start in windows.get(code, {}).items()]
        x = np.concatenate(x) if x else np.zeros((0, 7))
        return pa.table([x[:, k] for k in range(7)], names=[f"f{k}" for k in range(7)])

    return rows


def kept_windows(overlap: float, most: int | None):
    """Greedy choice among the scored windows of one series."""

    def keep(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([("score", "descending"), ("start_date", "ascending")])
        start, length = (batch[c].to_numpy().astype(np.int64) for c in ("start_idx", "length"))
        free, stays = np.ones(len(start), bool), []
        for k in range(len(start)):
            if free[k]:
                stays.append(k)
                if len(stays) == most:
                    break
                shared = np.minimum(start + length, start[k] + length[k]) - np.maximum(start, start[k])
                free &= shared <= overlap * np.minimum(length, length[k])
        return batch.take(pa.array(stays, pa.int64()))

    return keep
