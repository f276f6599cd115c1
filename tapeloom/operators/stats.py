"""Statistics of events: descriptions, long summaries, histograms, buckets, pivots and samples."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.operators.small import checked_broadcast

# Edges of the return histograms, open at both ends.
RETURN_EDGES = (-0.3, -0.2, -0.1, -0.05, 0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0)


def description(ret: str, excess: str | None = None, aligned: bool = False) -> list[Column]:
    """Aggregates of a return: n, mean, median, win, std, p10..p90, t, and of an excess one its mean and win.

    Missing values are left out of each column by itself, or with ``aligned`` the excess where the return is
    missing. ``t`` has no value for one row or no spread. Percentiles are exact and linear, which keeps a
    group's distinct values in memory; for groups of billions there are digests.
    """
    r = F.col(ret)
    std, n = F.stddev_samp(r), F.count(r)
    t = F.when((n > 1) & (std > 0), F.avg(r) / (std / F.sqrt(n)))
    out = [n.alias("n"), F.avg(r).alias("mean"), F.median(r).alias("median"), F.avg((r > 0).cast("double")).alias("win"), F.when(n > 1, std).alias("std")]
    out += [F.percentile(r, F.lit(q / 100)).alias(f"p{q}") for q in (10, 25, 75, 90)] + [t.alias("t")]
    if excess:
        x = F.when(r.isNotNull(), F.col(excess)) if aligned else F.col(excess)
        out += [F.avg(x).alias("ex_mean"), F.avg((x > 0).cast("double")).alias("ex_win")]
    return out


def summarize(events: DataFrame, ret: str, excess: str | None, groupings: Sequence[Sequence[str]], aligned: bool = False) -> DataFrame:
    """One long table of descriptions, a row per grouping and group: grouping, group, then the statistics.

    All groupings are grouping sets of one aggregation, so the events are read and shuffled once.
    """
    columns = list(dict.fromkeys(c for g in groupings for c in g))
    sets = [[F.col(c) for c in g] for g in groupings]
    name = F.lit("other")
    for g in groupings:
        same = F.lit(True)
        for c in columns:
            same = same & (F.grouping(c) == (0 if c in g else 1))
        name = F.when(same, F.lit("+".join(g) or "all")).otherwise(name)
    df = events.groupingSets(sets, *[F.col(c) for c in columns]).agg(name.alias("grouping"), *description(ret, excess, aligned))
    label = F.concat_ws("|", *[F.when(F.col(c).isNotNull(), F.col(c).cast("string")) for c in columns])
    return df.select("grouping", label.alias("group"), *[c for c in df.columns if c not in ("grouping", *columns)])


def histogram(events: DataFrame, value: str, edges: Sequence[float] = RETURN_EDGES) -> DataFrame:
    """bin, low, high, n, share and cum_share of every bin ``[low, high)``, empty ones included."""
    v = F.col(value)
    number = sum((F.when(v >= e, 1).otherwise(0) for e in edges), F.lit(0))
    counted = events.filter(v.isNotNull() & ~F.isnan(v)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    bounds = [None, *[float(e) for e in edges], None]
    bins = events.sparkSession.createDataFrame([(i, bounds[i], bounds[i + 1]) for i in range(len(edges) + 1)], "bin int, low double, high double")
    df = bins.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    every, upto = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    total = F.nullif(F.sum("n").over(every), F.lit(0))
    return df.select("bin", "low", "high", "n", (F.col("n") / total).alias("share"), (F.sum("n").over(upto) / total).alias("cum_share"))


def bucket(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bucket ``(a, b]`` that has the value; null for null."""
    out = F.lit(labels[-1])
    for e, name in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(value <= e, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull() & ~F.isnan(value), out)


def value_counts(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, n for every column, from one pass over the rows."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return events.select(pairs).groupBy("column", "value").agg(F.count("*").alias("n"))


def spread_pick(events: DataFrame, group: Sequence[str], value: str, ties: Sequence[str], n: int) -> DataFrame:
    """The n highest, the n lowest and the n nearest to the mean of each group, with ``kind`` and ``place``.

    Means come from an aggregation (a window would bring a whole group into one task); the ranks are cut to
    n before their shuffles."""
    known = events.filter(F.col(value).isNotNull() & ~F.isnan(value))
    means = known.groupBy(*group).agg(F.avg(value).alias("_mean"))
    df = known.join(checked_broadcast(means), list(group))
    picked = []
    for kind, order in (("high", F.col(value).desc()), ("low", F.col(value).asc()), ("middle", F.abs(F.col(value) - F.col("_mean")).asc())):
        by = W.partitionBy(*group).orderBy(order, *[F.col(t) for t in ties])
        picked.append(df.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= n).withColumn("kind", F.lit(kind)))
    return picked[0].unionByName(picked[1]).unionByName(picked[2]).drop("_mean")


def seeded_sample(events: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows by the order of a seeded hash (MD5) of their keys: the same rows whatever the partitioning, and in any system."""
    mark = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return events.orderBy(mark, *keys).limit(n)


def entry_summary(signals: DataFrame, forward: DataFrame, groupings: Sequence[Sequence[str]], entries: Sequence[str] = ("close", "open"), aligned: bool = False) -> DataFrame:
    """One long table: group_by, group, entry, horizon and the statistics of return and excess.

    ``signals``: ts_code, date and the grouping columns, joined to ``forward`` (a row per bar and horizon with
    ret_ and ex_ of each entry). Open entries leave out the blocked ones. Groupings are grouping sets of one aggregation.
    """
    cell = [F.struct(F.lit(e).alias("entry"), F.col(f"ret_{e}").alias("ret"), F.col(f"ex_{e}").alias("ex"), (F.col("entry_blocked") if e == "open" else F.lit(False)).alias("blocked")) for e in entries]
    columns = list(dict.fromkeys(c for g in groupings for c in g))
    rows = forward.join(signals.select("ts_code", "date", *columns), ["ts_code", "date"]).select(*columns, "horizon", F.inline(F.array(*cell))).filter("not blocked")
    sets = [[*[F.col(c) for c in g], F.col("entry"), F.col("horizon")] for g in groupings]
    name = F.lit("all")
    for g in groupings:
        if g:
            own = [F.grouping(c) == (0 if c in g else 1) for c in columns]
            name = F.when(F.forall(F.array(*own), lambda x: x), F.lit("+".join(g))).otherwise(name)
    label = F.concat_ws("|", *[F.when(F.col(c).isNotNull(), F.col(c).cast("string")) for c in columns]) if columns else F.lit("")
    out = rows.groupingSets(sets, *[F.col(c) for c in columns], F.col("entry"), F.col("horizon")).agg(name.alias("group_by"), *description("ret", "ex", aligned))
    return out.select("group_by", label.alias("group"), "entry", "horizon", *[c for c in out.columns if c not in ("group_by", "entry", "horizon", *columns)])


def counter_examples(events: DataFrame, ret: str, regime: str, ties: Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` lowest returns of bull markets that are not above 0, and the ``n`` highest of bear markets that are, with
    ``kind`` and ``place``."""
    picked = []
    for kind, keep, order in (("bull_not_positive", (F.col(regime) == "bull") & (F.col(ret) <= 0), F.col(ret).asc()), ("bear_positive", (F.col(regime) == "bear") & (F.col(ret) > 0), F.col(ret).desc())):
        by = [order, *[F.col(t) for t in ties]]
        head = events.filter(keep).orderBy(*by).limit(n)
        picked.append(head.withColumns({"kind": F.lit(kind), "place": F.row_number().over(W.orderBy(*by))}))
    return picked[0].unionByName(picked[1])
