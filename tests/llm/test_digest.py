import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm.digest import certified_percentiles, cluster, digest_quantiles, digests, merge_digests, quantiles, rank_bound

AT = (0.1, 0.5, 0.9, 0.99)


def test_error_is_within_the_bound(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(size=60_000), np.full(20_000, 1.0), [np.nan, np.inf, -np.inf]])
    rows = [("hot" if i % 3 else f"g{i % 5}", float(v), 1) for i, v in enumerate(values)] + [("hot", None, 1), (None, 4.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(7)
    for r in certified_percentiles(df, ("g",), "v", AT).collect():
        mine = np.sort([v for g, v, _ in rows if g == r.g and v is not None and np.isfinite(v)])
        assert r.n == len(mine) and r.certified and r.rank_error <= rank_bound() + 1 / r.n
        low, high = np.searchsorted(mine, r.estimate, "left"), np.searchsorted(mine, r.estimate, "right")
        wanted = r["quantile"] * (len(mine) - 1) + 0.5
        assert abs(max(low - wanted, wanted - high, 0) / len(mine) - r.rank_error) < 1e-9


def test_parts_combine(spark):
    df = spark.range(50_000).select((F.col("id") % 2).alias("g"), F.rand(4).alias("v"))
    halves = [digests(part, ("g",), "v") for part in df.randomSplit([1.0, 1.0], 1)]
    got = digest_quantiles(merge_digests(halves[0].unionByName(halves[1]), ("g",)), ("g",), AT).collect()
    assert sum(r.n for r in got) == 50_000
    for r in got:
        assert np.allclose(r.estimates, AT, atol=0.02)


def test_single_values_and_empty(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    got = {(r.g, r["quantile"]): r.estimate for r in certified_percentiles(df, ("g",), "v", (0.5,)).collect()}
    assert got == {("a", 0.5): 2.0, ("b", 0.5): 2.0}
    assert certified_percentiles(df.limit(0), ("g",), "v", (0.5,)).count() == 0


def skewed(spark):
    rng = np.random.default_rng(11)
    values = np.concatenate([rng.lognormal(0, 3, size=30_000), np.full(9_000, 0.25)])
    rows = [("hot" if i % 3 else None, float(v)) for i, v in enumerate(values)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(6)


def test_estimates_outside_the_bound_are_refined(spark):
    rows, df = skewed(spark)
    bound = 0.0002
    got = certified_percentiles(df, ("g",), "v", AT, delta=100.0, bound=bound).collect()
    assert len(got) == 2 * len(AT)
    for r in got:
        mine = np.sort([v for g, v in rows if g == r.g])
        wanted, slack = r["quantile"] * (len(mine) - 1), bound * len(mine) + 1.5
        assert r.certified and r.n == len(mine)
        assert (r.n_below, r.n_upto) == (np.searchsorted(mine, r.estimate, "left"), np.searchsorted(mine, r.estimate, "right"))
        assert mine[max(int(np.floor(wanted - slack)), 0)] <= r.estimate <= mine[min(int(np.ceil(wanted + slack)), len(mine) - 1)]


def test_many_groups_are_counted_without_a_broadcast(spark):
    rows, df = skewed(spark)
    one, other = (sorted((str(r.g), r["quantile"], r.estimate, r.n_below, r.n_upto, r.certified) for r in certified_percentiles(df, ("g",), "v", AT, broadcast_bytes=b).collect()) for b in (1 << 20, 0))
    assert one == other and len(one) == 2 * len(AT)


def test_equal_values_keep_their_value():
    for value in (0.1, -0.42, 0.05, 1e308):
        means, weights = cluster(np.full(3000, value), np.ones(3000))
        assert (means == value).all() and weights.sum() == 3000
        assert (quantiles(means, weights, value, value, AT) == value).all()
    means, weights = cluster(np.array([-1e308, 1e308] * 50), np.ones(100))
    got = quantiles(means, weights, -1e308, 1e308, AT)
    assert np.isfinite(got).all() and (np.diff(got) >= 0).all()


def test_refinement_ends_on_equal_values(spark):
    rows = [(g, v) for g, n in (("a", 3000), ("b", 700)) for v in [0.1] * n + [-0.42] * (n // 3) + [0.05] * (n // 2) + [i / n for i in range(n // 10)]]
    got = certified_percentiles(spark.createDataFrame(rows, "g string, v double").repartition(3), ("g",), "v", AT).collect()
    assert len(got) == 2 * len(AT) and all(r.certified for r in got)


def test_plan_has_no_sorting_of_rows(spark):
    _, df = skewed(spark)
    plan = digests(df, ("g",), "v")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
