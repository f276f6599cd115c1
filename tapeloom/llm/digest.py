"""Percentiles of large numeric columns by merging centroid digests, certified by a counting pass.

A digest holds the centroids (mean, weight) of sorted values, clustered so that a centroid at quantile q
spans at most one unit of ``delta / (2 pi) * asin(2 q - 1)``: narrow at the tails, widest at the median.
Digests of parts merge by clustering their centroids again.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.lineage import cut
from tapeloom.operators.small import BROADCAST_BYTES, checked_broadcast, is_broadcast

DELTA = 1000.0
#: Parts into which a group is split when there are too many groups to broadcast their estimates.
SALTS = 32


def rank_bound(delta: float = DELTA) -> float:
    """Bound on the rank error of a quantile, as a share of the group: twice the widest centroid. It is what the counting
    pass certifies; deeper merging may exceed it, and is then refined."""
    return 2.0 * np.pi / delta


def cluster(means: np.ndarray, weights: np.ndarray, delta: float = DELTA) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of ``means`` with ``weights``, in any order, clustered anew. A mean lies between the least and the
    greatest value of its cluster, also after rounding, so equal values keep their value."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    total = weights.sum()
    middle = (np.cumsum(weights) - 0.5 * weights) / total
    bucket = np.floor(delta / (2.0 * np.pi) * np.arcsin(2.0 * middle - 1.0))
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    weight = np.add.reduceat(weights, starts)
    shares = weights / np.repeat(weight, np.diff(np.append(starts, len(means))))
    ends = np.append(starts[1:], len(means)) - 1
    return np.clip(np.add.reduceat(means * shares, starts), means[starts], means[ends]), weight


def quantiles(means: np.ndarray, weights: np.ndarray, least: float, most: float, at: Sequence[float]) -> np.ndarray:
    """Values at the quantiles ``at``: linear between the centroids' middle ranks, ending in the extremes, and never outside
    the two values around it: the refinement relies on that to take away a value in every round."""
    total = weights.sum()
    middle = np.cumsum(weights) - 0.5 * weights
    ranks = np.concatenate([[0.5], middle, [max(total - 0.5, 0.5)]])
    values = np.concatenate([[least], means, [most]])
    keep = np.concatenate([[True], np.diff(np.maximum.accumulate(ranks)) > 0])
    ranks, values = np.maximum.accumulate(ranks)[keep], np.clip(np.maximum.accumulate(values)[keep], least, most)
    wanted = np.clip(np.asarray(at) * (total - 1) + 0.5, ranks[0], ranks[-1])
    low = np.clip(np.searchsorted(ranks, wanted, "right") - 1, 0, max(len(ranks) - 2, 0))
    high = np.minimum(low + 1, len(ranks) - 1)
    share = (wanted - ranks[low]) / np.maximum(ranks[high] - ranks[low], 1e-300)
    return np.clip((1.0 - share) * values[low] + share * values[high], values[low], values[high])


_DIGEST = "means array<double>, weights array<double>, least double, most double"
#: Digests merged at once, within a partition and between partitions, and centroids that a task holds open.
FAN, BETWEEN, HELD = 32, 512, 4_000_000


def _digest_table(keys: list[tuple], names: Sequence[str], digests: list[tuple], types: dict, part: int | None = None) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in keys], types[c]) for i, c in enumerate(names)]
    columns += [pa.array([d[0] for d in digests], pa.list_(pa.float64())), pa.array([d[1] for d in digests], pa.list_(pa.float64()))]
    columns += [pa.array([float(d[j]) for d in digests], pa.float64()) for j in (2, 3)]
    extra = [] if part is None else ["_part"]
    columns += [pa.array([part] * len(keys), pa.int32()) for _ in extra]
    return pa.RecordBatch.from_arrays(columns, names=[*names, "means", "weights", "least", "most", *extra])


def _merged(sets: list[tuple], delta: float) -> tuple:
    m, w = cluster(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), delta)
    return m, w, min(s[2] for s in sets), max(s[3] for s in sets)


def _numbers(df: DataFrame, group: Sequence[str], value: str, extra: Sequence[str] = ()) -> DataFrame:
    number = F.col(value).cast("double")
    rows = df.select(*group, *extra, number.alias("_value"))
    return rows.filter(F.col("_value").isNotNull() & ~F.isnan("_value") & (F.abs(F.col("_value")) != float("inf")))


def digests(df: DataFrame, group: Sequence[str], value: str, delta: float = DELTA) -> DataFrame:
    """One digest per group: ``group``, means, weights, least, most. Digests of other tables with the same
    ``delta`` can be united with these and given to :func:`merge_digests`.

    Null, NaN and infinite values don't count; null group values form groups of their own. Every input
    partition reduces its rows to one digest a group before anything is shuffled; it merges them by levels, so
    that no value is clustered more often than the logarithm of its batches says, and hands its digests on early
    where its groups together have too many centroids to be held.
    """
    rows, names = _numbers(df, group, value), list(group)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        open_: dict[tuple, list[list[tuple]]] = {}
        types, held = {}, 0

        def close() -> pa.RecordBatch:
            return _digest_table(list(open_), names, [_merged([s for level in levels for s in level], delta) for levels in open_.values()], types, here)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            types.update({c: table.schema.field(c).type for c in names})
            grouped = table.group_by(names).aggregate([("_value", "list")])
            keys = list(zip(*[grouped[c].to_pylist() for c in names], strict=True)) if names else [()] * grouped.num_rows
            lists = grouped["_value_list"].combine_chunks()
            for i, key in enumerate(keys):
                values = lists[i].values.to_numpy(zero_copy_only=False)
                m, w = cluster(values, np.ones(len(values)), delta)
                fresh, at, levels = (m, w, values.min(), values.max()), 0, open_.setdefault(key, [[]])
                held += len(m)
                levels[0].append(fresh)
                while len(levels[at]) >= FAN:
                    one = _merged(levels[at], delta)
                    held += len(one[0]) - sum(len(s[0]) for s in levels[at])
                    levels[at] = []
                    at += 1
                    if at == len(levels):
                        levels.append([])
                    levels[at].append(one)
            if held > HELD:
                yield close()
                open_.clear()
                held = 0
        if open_:
            yield close()

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], _DIGEST, "_part int"])
    return merge_digests(rows.mapInArrow(part, schema), group, delta)


def merge_digests(parts: DataFrame, group: Sequence[str], delta: float = DELTA) -> DataFrame:
    """One digest per group from any number of partial ones, merged in two steps: first those of up to 512
    neighbouring partitions (of one hash, for digests that don't say where they are from), then the rest."""
    names = list(group)
    kinds = dict(parts.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], _DIGEST])

    def merge(table: pa.Table) -> pa.Table:
        flat = [np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in table[c].combine_chunks()]) for c in ("means", "weights")]
        m, w = cluster(flat[0], flat[1], delta)
        key = [tuple(table[c][0].as_py() for c in names)]
        types = {c: table.schema.field(c).type for c in names}
        return pa.Table.from_batches([_digest_table(key, names, [(m, w, min(table["least"].to_pylist()), max(table["most"].to_pylist()))], types)])

    salt = F.floor(F.col("_part") / F.lit(BETWEEN)) if "_part" in parts.columns else F.pmod(F.xxhash64("least", "most", F.size("means")), F.lit(BETWEEN))
    some = parts.withColumn("_salt", salt).groupBy(*names, "_salt").applyInArrow(merge, schema)
    return some.groupBy(*names).applyInArrow(merge, schema)


def digest_quantiles(merged: DataFrame, group: Sequence[str], at: Sequence[float] | str) -> DataFrame:
    """``group``, n and an array ``estimates`` of the values at the quantiles ``at``, or at the one in the column ``at``."""
    names = list(group)
    kinds = dict(merged.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "n long, estimates array<double>"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights = [x.values.to_numpy(zero_copy_only=False) for x in b["weights"]]
            means = [x.values.to_numpy(zero_copy_only=False) for x in b["means"]]
            asked = [[q] for q in b[at].to_pylist()] if isinstance(at, str) else [at] * b.num_rows
            got = [quantiles(m, w, lo, hi, q).tolist() for m, w, lo, hi, q in zip(means, weights, b["least"].to_pylist(), b["most"].to_pylist(), asked, strict=True)]
            columns = [b[c] for c in names] + [pa.array([int(round(w.sum())) for w in weights], pa.int64()), pa.array(got, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n", "estimates"])

    return merged.mapInArrow(read, schema)


def _same(names: Sequence[str], prefix: str):
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(prefix + c))
    return same


def _judged(found: DataFrame, bound: float) -> DataFrame:
    """Adds rank_error, rank_bound and certified to rows with quantile, n, n_below and n_upto."""
    wanted = F.col("quantile") * (F.col("n") - 1) + F.lit(0.5)
    error = F.greatest(F.col("n_below") - wanted, wanted - F.col("n_upto"), F.lit(0.0)) / F.col("n")
    out = found.withColumn("rank_error", error).withColumn("rank_bound", F.lit(float(bound)) + F.lit(1.0) / F.col("n"))
    return out.withColumn("certified", F.col("rank_error") <= F.col("rank_bound"))


_COUNTED = ("quantile", "estimate", "n", "n_below", "n_upto")


def _refined(rows: DataFrame, names: Sequence[str], found: DataFrame, bound: float, delta: float) -> DataFrame:
    """``found`` with every estimate outside the bound narrowed down until it is within: the values between the bounds
    that the counts so far give are digested and counted again, which takes away one value at least a round, and all but
    a small share as a rule. No round runs where all are certified."""
    keys, done = [*names, "quantile"], []
    low = F.col("n_below") > F.col("quantile") * (F.col("n") - 1) + F.lit(0.5)
    ends = {"_low": F.when(low, F.coalesce("_low", F.lit(-float("inf")))).otherwise(F.col("estimate")), "_high": F.when(low, F.col("estimate")).otherwise(F.coalesce("_high", F.lit(float("inf")))), "_under": F.when(low, F.coalesce("_under", F.lit(0))).otherwise(F.col("n_upto"))}
    null = F.lit(None)
    left = cut(found.withColumns({"_low": null.cast("double"), "_high": null.cast("double"), "_under": null.cast("long")}))
    while True:
        done.append(left.filter("certified").drop("_low", "_high", "_under"))
        asked = left.filter("not certified")
        if asked.isEmpty():
            break
        asked = cut(asked.withColumns(ends).select(*[F.col(c).alias(f"_g_{c}") for c in names], F.col("quantile"), F.col("n"), "_low", "_high", "_under"))
        inside = rows.join(checked_broadcast(asked), _same(names, "_g_")).filter((F.col("_value") > F.col("_low")) & (F.col("_value") < F.col("_high")))
        own = digests(inside.select(*keys, "_value"), keys, "_value", delta)
        size = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
        side = asked.withColumnsRenamed({f"_g_{c}": f"_d_{c}" for c in names}).withColumnRenamed("quantile", "_d_quantile")
        at = F.least(F.greatest((F.col("quantile") * (F.col("n") - 1) - F.col("_under")) / F.greatest(size - 1, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
        placed = own.join(side, _same(keys, "_d_")).select(*keys, "means", "weights", "least", "most", at.alias("_at"))
        fresh = checked_broadcast(digest_quantiles(placed, keys, "_at").select(*[F.col(c).alias(f"_e_{c}") for c in keys], F.col("estimates")[0].alias("estimate")))
        counted = inside.join(fresh, _same(keys, "_e_")).groupBy(*keys, "estimate").agg(F.count_if(F.col("_value") < F.col("estimate")).alias("below"), F.count_if(F.col("_value") <= F.col("estimate")).alias("upto"))
        whole = counted.join(side, _same(keys, "_d_")).select(*keys, "estimate", "n", (F.col("below") + F.col("_under")).alias("n_below"), (F.col("upto") + F.col("_under")).alias("n_upto"), "_low", "_high", "_under")
        left = cut(_judged(whole, bound))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def certified_percentiles(df: DataFrame, group: Sequence[str], value: str, at: Sequence[float], delta: float = DELTA, bound: float | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``group``, quantile, estimate, n, n_below, n_upto, rank_error, rank_bound, certified.

    The digests give the estimates; a second pass counts, for every group and estimate, the values below
    and not above it. ``rank_error`` is the distance of the wanted rank from that interval as a share of
    the group; ``certified`` says that it is within the stated bound (:func:`rank_bound` and one row, or
    ``bound``). An estimate outside it is narrowed down by further passes over the values around it, so every row is
    certified in the end. Ties count in favour: any rank that equal values take is theirs. Values and groups count as
    in :func:`digests`; an empty table gives none.
    """
    names, bound = list(group), rank_bound(delta) if bound is None else bound
    estimates = digest_quantiles(digests(df, group, value, delta), group, at)
    rows = _numbers(df, names, value)
    # The estimates, a row per group, are broadcast if they are small, so that no group's rows are brought together; every
    # partition reduces them to 2 * len(at) sums a group. More groups than that are joined by shuffling, but
    # after equal values of a group have been counted, and salted by value: a group is spread over its values.
    each = [F.col("estimates")[i].alias(f"e{i}") for i in range(len(at))]
    held = checked_broadcast(estimates.select(*[F.col(c).alias(f"_g_{c}") for c in names], F.col("n"), *each), broadcast_bytes)
    marks = [f(F.col("_value"), F.col(f"e{i}")) for i in range(len(at)) for f in (lambda v, e: v < e, lambda v, e: v <= e)]
    if is_broadcast(held):
        joined, times = rows.join(held, _same(names, "_g_")), F.lit(1)
    else:
        salt = F.pmod(F.xxhash64("_value"), F.lit(SALTS)).cast("int").alias("_salt")
        counts = rows.groupBy(*names, "_value").agg(F.count("*").alias("_times")).withColumn("_salt", salt)
        copies = held.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined, times = counts.join(copies, _same(names, "_g_") & (F.col("_salt") == F.col("_s"))), F.col("_times")
    counted = joined.groupBy(*names).agg(*[F.sum(F.when(m, times).otherwise(0)).cast("long").alias(f"c{i}") for i, m in enumerate(marks)])
    whole = counted.join(held, _same(names, "_g_"))
    long = F.inline(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.col(f"e{i}").alias("estimate"), F.col(f"c{2 * i}").alias("n_below"), F.col(f"c{2 * i + 1}").alias("n_upto")) for i, q in enumerate(at)]))
    found = _judged(whole.select(*names, "n", long), bound)
    return _refined(rows, names, found, bound, delta).select(*names, *_COUNTED, "rank_error", "rank_bound", "certified")
