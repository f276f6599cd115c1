import random
from collections import defaultdict

from pyspark.sql import functions as F

from tapeloom.llm.packing import Packing, pack_items, plan_patterns, plan_windows


def check(spark, rows, rules):
    df = spark.createDataFrame([(d, n, -1) for d, n in rows], "doc_id long, n_tokens int, part int")
    got = pack_items(df, rules).collect()
    parts, bins = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
        if r.container_id is not None:
            bins[r.container_id].append(r)
    for d, n in rows:
        mine = sorted(parts[d], key=lambda r: r.part)
        n = max(n or 0, 0)
        assert sum(r.n_tokens for r in mine) == n
        assert [r.from_token for r in mine] == [rules.capacity * r.part for r in mine]
        assert len(mine) == max(1, -(-n // rules.capacity))
        assert all((r.container_id is None) == (n == 0) for r in mine)
    for b in bins.values():
        end = 0
        for r in sorted(b, key=lambda r: r.start):
            assert r.start == end
            end += r.n_tokens
        assert end <= rules.capacity and len({r.step_group for r in b}) == 1
        windows = defaultdict(list)
        for r in sorted(b, key=lambda r: r.start):
            windows[r.window].append(r)
        assert [r.window for r in sorted(b, key=lambda r: r.start)] == sorted(r.window for r in b)
        for w in windows.values():
            assert sum(r.n_tokens for r in w) <= w[0].window_tier and len({r.window_tier for r in w}) == 1 and all(r.tier <= max(r.window_tier, r.tier * (len(w) == 1)) for r in w)
        assert b[0].container_tier == max(w[0].window_tier for w in windows.values())
    assert sorted(bins) == list(range(len(bins)))
    return bins


def test_every_item_is_placed_once_and_whole(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([rng.randint(1, 60), rng.randint(1, 2500), 100, 100])) for i in range(3000)] + [(90001, 0), (90002, None), (90003, 2048), (90004, 4096), (90005, 10_000), (90006, -4)]
    bins = check(spark, rows, Packing(ranked_rows=37))
    assert len(bins) <= 1.02 * sum(max(n or 0, 0) for _, n in rows) / 2048 + 1


def test_step_groups_are_balanced(spark):
    rng = random.Random(2)
    bins = check(spark, [(i, rng.randint(1, 900)) for i in range(4000)], Packing(step=32))
    cost, size = defaultdict(int), defaultdict(int)
    for b in bins.values():
        cost[b[0].step_group] += sum(r.n_tokens**2 for r in b)
        size[b[0].step_group] += 1
    assert max(size.values()) - min(size.values()) <= 1
    mean = [cost[g] / size[g] for g in cost]
    assert max(mean) < 1.04 * min(mean)


def test_long_windows_are_filled_from_shorter_tiers():
    patterns = plan_patterns({1500: 4, 548: 2, 300: 2, 248: 2}, Packing())
    assert sorted(map(tuple, (p.sizes for p in patterns))) == [(1500, 300, 248), (1500, 548)]
    assert {w.tier for p in patterns for w in p.windows} == {2048}


def histogram(seed, n=20_000):
    rng = random.Random(seed)
    out = defaultdict(int)
    for _ in range(n):
        out[min(2048, int(rng.lognormvariate(5.5, 1)) + 1)] += 1
    return dict(out)


def unused(histogram, rules):
    patterns = plan_patterns(histogram, rules)
    placed = defaultdict(int)
    for p in patterns:
        for s in p.sizes:
            placed[s] += p.times
    assert placed == histogram
    return 1 - sum(s * n for s, n in histogram.items()) / (rules.capacity * sum(p.times for p in patterns))


def test_tiers_pack_windows_of_their_own_size_without_losing_room():
    for seed in range(3):
        h = histogram(seed)
        tiers = {t: [(w, n) for w, n in plan_windows(h, Packing()) if w.tier == t] for t in (256, 512, 1024, 2048)}
        for low, t in ((0, 256), (256, 512), (512, 1024), (1024, 2048)):
            assert tiers[t] and all(low < w.sizes[0] <= t and w.used <= t for w, _ in tiers[t])
        assert any(len(w.sizes) > 1 and w.sizes[1] <= 256 for w, _ in tiers[1024])
        tiered, plain = plan_patterns(h, Packing()), plan_patterns(h, Packing(tiers=()))
        assert sorted((sorted(p.sizes), p.times) for p in tiered) != sorted((sorted(p.sizes), p.times) for p in plain)
        assert unused(h, Packing()) <= unused(h, Packing(tiers=())) + 1e-4


def test_the_result_does_not_depend_on_how_the_rows_lie(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(1, 900)) for i in range(3000)] + [(None, 40), (None, 41)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    first, second = (sorted(map(tuple, pack_items(x, Packing(ranked_rows=50)).collect()), key=str) for x in (df, df.orderBy(F.rand(3)).repartition(7)))
    assert first == second


def test_empty(spark):
    assert check(spark, [], Packing()) == {}
