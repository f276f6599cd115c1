import random

from tapeloom.llm.topn import top_n


def test_against_brute_force_with_ties_and_a_hot_group(spark):
    rng = random.Random(5)
    bad = [None, float("nan"), float("inf"), -float("inf")]
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([1.0, 2.0, 2.0, 3.5, *bad]), "x") for i in range(4000)]
    got = top_n(spark.createDataFrame(rows, "g string, id int, score double, _other string"), ("g",), "score", ("id",), 7)
    want = set()
    for g in {r[0] for r in rows}:
        good = [r for r in rows if r[0] == g and r[2] is not None and r[2] == r[2] and abs(r[2]) != float("inf")]
        for k, r in enumerate(sorted(good, key=lambda r: (-r[2], r[1]))[:7]):
            want.add((g, r[1], k + 1))
    assert {(r.g, r.id, r["rank"]) for r in got.collect()} == want


def test_small_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, None)], "g string, id int, score double")
    assert [(r.g, r["rank"]) for r in top_n(df, ("g",), "score", ("id",), 3).collect()] == [("a", 1)]
    assert top_n(df.limit(0), ("g",), "score", ("id",), 3).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 7, "x"), ("a", 2, 2.0, 8, "y")], "g string, id int, score double, rank int, _sub string")
    got = top_n(df, ("g",), "score", ("id",), 1).collect()
    assert [(r.id, r["rank"], r._sub) for r in got] == [(2, 1, "y")]
