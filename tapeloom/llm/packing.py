"""Packing of items of varying length into containers of fixed capacity.

Items are routed to context-size tiers by length. Each tier packs its items into windows of its own size, from
the longest tier to the shortest; the gaps of its windows are filled from the shorter tiers, the largest item that
fits first. Windows then share containers, the longest first, by the room they really use. Packing works
on the histogram of lengths, which has at most ``capacity`` rows whatever the number of items: it gives patterns
(windows that share a container) with multiplicities. Items find their container by their rank within
their length. Containers are numbered by falling cost and dealt to step groups back and forth, which balances the groups.
"""

from collections import Counter, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.operators.lineage import cut
from tapeloom.operators.small import checked_broadcast


@dataclass(frozen=True)
class Packing:
    """``tiers`` are the context sizes below ``capacity`` in ascending order; ``step`` is the number of
    containers of a step group; ``ranked_rows`` is how many items of one length one task ranks."""

    capacity: int = 2048
    tiers: tuple[int, ...] = (256, 512, 1024)
    step: int = 64
    ranked_rows: int = 200_000


@dataclass(frozen=True)
class Window:
    """Lengths that share a window of a tier, the longest first."""

    tier: int
    sizes: tuple[int, ...]

    @property
    def used(self) -> int:
        return sum(self.sizes)


@dataclass(frozen=True)
class Pattern:
    """Windows that share a container, and how many containers do so."""

    windows: tuple[Window, ...]
    times: int

    @property
    def cost(self) -> int:
        return sum(s * s for w in self.windows for s in w.sizes)

    @property
    def sizes(self) -> list[int]:
        return [s for w in self.windows for s in w.sizes]


def _filled(left: np.ndarray, capacity: int, first: int) -> tuple[Counter, int]:
    """The lengths of one bin that begins with ``first`` and takes the largest that fits until none does, and how many
    such bins ``left`` (a count per length) has; they are taken from it."""
    used, room, take = Counter(), capacity, first
    while take:
        used[take] += 1
        room -= take
        fits = np.flatnonzero(left[1 : room + 1]) + 1
        take = next((int(s) for s in fits[::-1] if left[s] > used[int(s)]), 0)
    times = min(int(left[s]) // k for s, k in used.items())
    for s, k in used.items():
        left[s] -= k * times
    return used, times


def plan_windows(histogram: dict[int, int], rules: Packing) -> list[tuple[Window, int]]:
    """Windows with multiplicities that use every item of the histogram (length: number) exactly once.

    What the shortest tier cannot pack into full windows stays single, in windows as long as the item, to fill the gaps
    that the other windows leave in their containers."""
    left = np.zeros(rules.capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    edges = [*[t for t in rules.tiers if t < rules.capacity], rules.capacity]
    out = []
    for low, high in reversed(list(zip([0, *edges[:-1]], edges, strict=True))):
        while (own := np.flatnonzero(left[low + 1 : high + 1])).size:
            used, times = _filled(left, high, low + 1 + int(own[-1]))
            if low == 0 and sum(s * k for s, k in used.items()) < high < rules.capacity:
                out += [(Window(size, (size,)), k * times) for size, k in used.items()]
            else:
                out.append((Window(high, tuple(sorted(used.elements(), reverse=True))), times))
    total: dict[Window, int] = {}
    for window, times in out:
        total[window] = total.get(window, 0) + times
    return list(total.items())


def plan_patterns(histogram: dict[int, int], rules: Packing) -> list[Pattern]:
    """Containers with multiplicities for all windows of the histogram, of falling cost."""
    waiting: dict[int, deque] = {}
    left = np.zeros(rules.capacity + 1, np.int64)
    for window, times in plan_windows(histogram, rules):
        waiting.setdefault(window.used, deque()).append([window, times])
        left[window.used] += times
    out = []
    while (there := np.flatnonzero(left)).size:
        used, times = _filled(left, rules.capacity, int(there[-1]))
        slots = sorted(used.elements(), reverse=True)
        while times:
            # The windows of one length differ: a run of containers lasts as long as each slot's next window does.
            runs, ask = [], Counter(slots)
            for u in ask:
                have, need = [], ask[u]
                for window, n in waiting[u]:
                    have += [window] * min(need - len(have), n)
                    if len(have) == need:
                        break
                runs += have
            share = Counter(runs)
            span = min(times, *(next(n for w, n in waiting[window.used] if w == window) // k for window, k in share.items()))
            for window, k in share.items():
                entry = next(e for e in waiting[window.used] if e[0] == window)
                entry[1] -= k * span
            for u in ask:
                while waiting[u] and not waiting[u][0][1]:
                    waiting[u].popleft()
            out.append(Pattern(tuple(sorted(runs, key=lambda w: (-w.tier, -w.used, w.sizes))), span))
            times -= span
    return sorted(out, key=lambda p: (-p.cost, [w.sizes for w in p.windows]))


def _segments(patterns: Sequence[Pattern]) -> np.ndarray:
    """Columns size, first rank, first container, containers, offset of the first slot, window's number and tier,
    container's tier, ordered by size and first rank."""
    out, taken, base = [], Counter(), 0
    for p in patterns:
        offset = 0
        for k, w in enumerate(p.windows):
            for size, slots in sorted(Counter(w.sizes).items(), reverse=True):
                out.append((size, taken[size], base, p.times, offset, k, w.tier, max(x.tier for x in p.windows)))
                taken[size] += slots * p.times
                offset += size * slots
        base += p.times
    return np.array(sorted(out), np.int64).reshape(-1, 8).T


_PLACED = "doc_id bigint, part bigint, n_tokens int, container_id bigint, container_tier int, window int, window_tier int, start int, step_group bigint"
_RANKS = 47  # bits of a rank within a length


def _placing(segments, groups: int):
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in _PLACED.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, base, times, offset, window, window_tier, tier = segments.value
        keys = (size << _RANKS) + first
        for b in batches:
            mine, rank = (b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "rank"))
            at = np.searchsorted(keys, (mine << _RANKS) + rank, side="right") - 1
            over = rank - first[at]
            container = base[at] + over % times[at]
            lap, place_ = container // groups, container % groups
            columns = {"n_tokens": mine, "container_id": container, "container_tier": tier[at], "window": window[at], "window_tier": window_tier[at], "start": offset[at] + over // times[at] * mine, "step_group": np.where(lap % 2 == 0, place_, groups - 1 - place_)}
            arrays = [b[n] if n in ("doc_id", "part") else pa.array(columns[n], pa.int64()).cast(kinds[k]) for n, k in fields]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

    return place


def pack_items(items: DataFrame, rules: Packing = Packing()) -> DataFrame:
    """doc_id, part, from_token, n_tokens, tier, container_id, container_tier, window, window_tier, start and step_group.

    ``items`` has doc_id and n_tokens. An item longer than the capacity is split into full containers and a
    remainder, no other is; ``part`` counts from 0 and ``from_token`` is the part's place in the item. Parts
    of one container are laid end to end from ``start`` 0, those of one of its windows side by side. Items of
    length 0, null or less have no part to place: one row with null container. Repeated rows are items of their own, of which
    any takes any of their places; apart from that the result doesn't depend on how the rows lie. An empty table gives none.

    The driver gets the histogram of lengths, ``capacity`` rows at most, and sends out the plan, whose patterns are
    not more than that many windows. No task ranks all items of a length: each length is hashed into as many
    buckets as it needs, ranked within them, and the buckets' counts give the offsets.
    """
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    cap = F.lit(rules.capacity).cast("long")
    size_of = F.when(F.col("part") < F.floor(F.col("n") / cap), cap).otherwise(F.col("n") % cap)
    last = F.greatest(F.ceil(F.col("n") / cap) - 1, F.lit(0))
    parts = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(n, F.lit(0)).alias("n")).select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    parts = cut(parts.select("doc_id", "part", size_of.cast("int").alias("size")))
    histogram = {r["size"]: r["n"] for r in parts.filter("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}
    patterns = plan_patterns(histogram, rules)
    spark = items.sparkSession
    groups = max(1, -(-sum(p.times for p in patterns) // rules.step))
    segments = spark.sparkContext.broadcast(_segments(patterns))
    fine = spark.createDataFrame([(s, 1 + c // rules.ranked_rows) for s, c in histogram.items()], "size int, buckets long")

    placed = parts.filter("size > 0").join(F.broadcast(fine), "size").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), F.col("buckets"))).drop("buckets")
    counts = placed.groupBy("size", "bucket").agg(F.count("*").alias("here"))
    before = W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("size", "bucket", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("skip"))
    within = W.partitionBy("size", "bucket").orderBy("doc_id", "part")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1).join(checked_broadcast(offsets), ["size", "bucket"]).select("doc_id", "part", "size", (F.col("rank") + F.col("skip")).alias("rank"))
    full = ranked.mapInArrow(_placing(segments, groups), _PLACED)
    tier = F.lit(rules.capacity)
    for t in reversed([t for t in rules.tiers if t < rules.capacity]):
        tier = F.when(F.col("n_tokens") <= t, F.lit(t)).otherwise(tier)
    full = full.withColumns({"from_token": F.col("part") * cap, "tier": tier})
    none = parts.filter("size = 0").select("doc_id", "part", F.col("size").alias("n_tokens"), F.lit(0).cast("long").alias("from_token"))
    return full.unionByName(none, allowMissingColumns=True).select("doc_id", "part", "from_token", "n_tokens", "tier", "container_id", "container_tier", "window", "window_tier", "start", "step_group")
