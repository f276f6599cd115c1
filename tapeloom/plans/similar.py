"""Queries of the similarity search, and window measures that SQL can state."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.bars import full_when, rows_between
from tapeloom.plans.base import BARS_SQL, bars, q6, r6
from tapeloom.similarity.search import SearchRules, candidate_lengths, scanned, search, searches, stride, window_distances

SYMBOL, FIRST, LAST = "605999.SH", "2024-03-01", "2024-04-30"
QUERY_BARS = 42
_SHOWN = ("rank", "ts_code", "start_date", "end_date", "length", "paths")
ELASTIC, STRIDED, EXACT = SearchRules(mode="elastic"), SearchRules(mode="elastic", step=stride(42)), SearchRules(mode="elastic", exact=True)
REFINED = SearchRules(mode="elastic", local_top=50, refine=300)


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*_SHOWN, *[r6(c) for c in ("score", "mass", "dtw", "aligned", "event_seq")])


def r4(c: str):
    """To four decimals; the running sums of the scan are good to about seven."""
    return (F.floor(F.col(c) * F.lit(1e4) + F.lit(0.5)).cast("double") / F.lit(1e4)).alias(c)


def similar_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 windows most like 605999.SH in March and April 2024, of the same length."""
    return _shown(search(bars(spark, sf_dir), SYMBOL, FIRST, LAST))


def similar_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search(bars(spark, sf_dir), SYMBOL, FIRST, LAST, history_only=True))


def similar_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instruments whose last window is most like the query's."""
    return _shown(search(bars(spark, sf_dir), SYMBOL, FIRST, LAST, latest=True))


def similar_elastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three lengths by elastic warping, every start scanned."""
    return _shown(search(bars(spark, sf_dir), SYMBOL, FIRST, LAST, ELASTIC))


def similar_elastic_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quick elastic search that scans every eighth start only; most of the best windows lie between."""
    return _shown(search(bars(spark, sf_dir), SYMBOL, FIRST, LAST, STRIDED))


def similar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elastic search with every window re-ranked."""
    return _shown(search(bars(spark, sf_dir), SYMBOL, FIRST, LAST, EXACT))


def similar_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elastic search without a global bound, with all windows near the best candidates re-ranked too."""
    return _shown(search(bars(spark, sf_dir), SYMBOL, FIRST, LAST, REFINED))


def similar_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact elastic search's best 20 the others find, and how many of its instruments."""
    every = searches(bars(spark, sf_dir), SYMBOL, FIRST, LAST, {"exact": EXACT, "bounded": ELASTIC, "strided": STRIDED, "refined": REFINED})
    exact = every["exact"].select("ts_code", "start_date", "length")
    out = None
    for name in ("bounded", "strided", "refined"):
        found = every[name].select("ts_code", "start_date", "length", F.lit(1).alias("hit"))
        joined = exact.join(found, ["ts_code", "start_date", "length"], "left")
        codes = exact.select("ts_code").distinct().join(found.select("ts_code", "hit").distinct(), "ts_code", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("code_recall"))
        row = joined.agg(F.lit(name).alias("search"), F.count("*").alias("best"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall")).join(F.broadcast(codes))
        out = row if out is None else out.unionByName(row)
    return out


def similar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape, structure and event distance to the query, and coverage of its events, of every window of its length."""
    df = window_distances(bars(spark, sf_dir), SYMBOL, FIRST, LAST)
    return df.select("ts_code", "start_idx", "start_date", "end_date", *[r4(c) for c in ("mass", "structure", "event", "coverage")], "missing")


def similar_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments and windows that the fixed and the elastic search scan."""
    b = bars(spark, sf_dir)
    both = [scanned(b, candidate_lengths(QUERY_BARS, rules)).select(F.lit(rules.mode).alias("mode"), "*") for rules in (SearchRules(), SearchRules(mode="elastic"))]
    return both[0].unionByName(both[1])


def similar_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search(bars(spark, sf_dir), SYMBOL, "2023-01-01", "2023-12-31", timeframe="W"))


def window_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of the logarithm of close over every full window of 20 bars: what z-scores are made of."""
    log = F.ln("close")
    df = bars(spark, sf_dir).select("ts_code", "date", full_when(20, F.avg(log), rows_between(-19, 0)).alias("mean"), full_when(20, F.stddev_pop(log), rows_between(-19, 0)).alias("spread"))
    return df.filter("mean is not null").select("ts_code", "date", r6("mean"), r6("spread"))


QUERIES = {f.__name__: f for f in (similar_fixed, similar_history, similar_latest, similar_elastic, similar_elastic_strided, similar_exact, similar_refined, similar_recall, similar_windows, similar_size, similar_weekly, window_moments)}

_LIMIT = "CASE WHEN left(ts_code, 3) IN ('300', '301', '688', '689') THEN 0.2::DOUBLE WHEN left(ts_code, 1) IN ('4', '8') THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END"
_HIT = lambda sign: f"(pc > 0 AND (abs(c - round_even(pc * (1 {sign} lim), 2)) <= 0.011::DOUBLE OR abs(c / pc - (1 {sign} lim)) <= 0.003::DOUBLE))::INT"
_NEAR = lambda x: f"abs({x} - c) / c <= 0.006::DOUBLE"
# Per bar: features beside the bar before (f) and beside itself (a), and the six events; then every window's bars beside the query's.
_WINDOWS = f"""k0 AS (SELECT ts_code, date, bar_no, open o, high h, low l, c, coalesce(vol, 0)::DOUBLE v, coalesce(pc, c) AS pc, coalesce(lag(vol) OVER (PARTITION BY ts_code ORDER BY date), CASE WHEN bar_no = 0 THEN coalesce(vol, 0) ELSE 0 END)::DOUBLE AS pv, {_LIMIT} AS lim FROM b),
k1 AS (SELECT *, {_HIT('+')} AS e0, {_HIT('-')} AS e1, (greatest(round_even(o, 2), round_even(h, 2), round_even(l, 2), round_even(c, 2)) = least(round_even(o, 2), round_even(h, 2), round_even(l, 2), round_even(c, 2)))::INT AS flat FROM k0),
k2 AS (SELECT *, e0 * flat AS e2, e1 * flat AS e3, e0 * (o / pc >= 1.02::DOUBLE)::INT AS e4 FROM k1),
k AS (SELECT *, e4 * ({_NEAR('o')} AND flat = 0 AND {_NEAR('h')} AND l < c * 0.994::DOUBLE)::INT AS e5, ln(c / pc) f0, ln(o / pc) f1, ln(c / o) f2, greatest(h - greatest(o, c), 0) / pc f3, greatest(least(o, c) - l, 0) / pc f4, (h - l) / pc f5, ln((v + 1e-12::DOUBLE) / (pv + 1e-12::DOUBLE)) f6,
 greatest(h - greatest(o, c), 0) / c a3, greatest(least(o, c) - l, 0) / c a4, (h - l) / c a5 FROM k2),
q AS (SELECT row_number() OVER (ORDER BY date) - 1 AS i, * FROM k WHERE ts_code = '__SYMBOL__' AND date BETWEEN DATE '__FIRST__' AND DATE '__LAST__'),
q2 AS (SELECT i, ln(c) x, CASE WHEN i = 0 THEN 0 ELSE f1 END f1, f2, CASE WHEN i = 0 THEN a3 ELSE f3 END f3, CASE WHEN i = 0 THEN a4 ELSE f4 END f4, CASE WHEN i = 0 THEN a5 ELSE f5 END f5, CASE WHEN i = 0 THEN 0 ELSE f6 END f6, e0, e1, e2, e3, e4, e5 FROM q),
qs AS (SELECT avg(x) m, stddev_pop(x) s, count(*) n, greatest(stddev_pop(f1), 1e-3::DOUBLE) s1, greatest(stddev_pop(f2), 1e-3::DOUBLE) s2, greatest(stddev_pop(f3), 1e-3::DOUBLE) s3, greatest(stddev_pop(f4), 1e-3::DOUBLE) s4, greatest(stddev_pop(f5), 1e-3::DOUBLE) s5, greatest(stddev_pop(f6), 1e-3::DOUBLE) s6,
 sum(e0) n0, sum(e1) n1, sum(e2) n2, sum(e3) n3, sum(e4) n4, sum(e5) n5 FROM q2),
w AS (SELECT ts_code, bar_no AS start_idx, date AS start_date, lead(date, (SELECT n FROM qs)::INT - 1) OVER (PARTITION BY ts_code ORDER BY date) AS end_date FROM k),
p AS (SELECT w.ts_code, w.start_idx, w.start_date, w.end_date, q2.i, ln(k.c) AS x, (q2.x - qs.m) / qs.s AS z,
 ((CASE WHEN q2.i = 0 THEN 0 ELSE k.f1 END - q2.f1) / s1) ** 2 + ((k.f2 - q2.f2) / s2) ** 2 + ((CASE WHEN q2.i = 0 THEN k.a3 ELSE k.f3 END - q2.f3) / s3) ** 2 + ((CASE WHEN q2.i = 0 THEN k.a4 ELSE k.f4 END - q2.f4) / s4) ** 2
  + ((CASE WHEN q2.i = 0 THEN k.a5 ELSE k.f5 END - q2.f5) / s5) ** 2 + ((CASE WHEN q2.i = 0 THEN 0 ELSE k.f6 END - q2.f6) / s6) ** 2 AS d,
 abs(k.e0 - q2.e0) + abs(k.e1 - q2.e1) + abs(k.e2 - q2.e2) + abs(k.e3 - q2.e3) + abs(k.e4 - q2.e4) + abs(k.e5 - q2.e5) AS e, k.e0, k.e1, k.e2, k.e3, k.e4, k.e5
 FROM w, q2, qs, k WHERE w.end_date IS NOT NULL AND k.ts_code = w.ts_code AND k.bar_no = w.start_idx + q2.i),
g AS (SELECT ts_code, start_idx, start_date, end_date, sqrt(greatest(avg(z * z) + 1 - 2 * (avg(x * z) - avg(x) * avg(z)) / greatest(stddev_pop(x), 1e-12::DOUBLE), 0)) AS mass, stddev_pop(x) AS sx, sqrt(avg(d) / 6) AS structure, sqrt(avg(e) / 6) AS event,
 greatest(max(n0) - sum(e0), 0) l0, greatest(max(n1) - sum(e1), 0) l1, greatest(max(n2) - sum(e2), 0) l2, greatest(max(n3) - sum(e3), 0) l3, greatest(max(n4) - sum(e4), 0) l4, greatest(max(n5) - sum(e5), 0) l5, max(n0) + max(n1) + 3 * max(n2) + 3 * max(n3) + max(n4) + 4 * max(n5) AS need FROM p, qs GROUP BY ALL)""".replace("__SYMBOL__", SYMBOL).replace("__FIRST__", FIRST).replace("__LAST__", LAST)
_Q4 = lambda x, name: f"floor(({x}) * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS {name}"
_COUNTED = lambda lengths: f"count_if(n >= {min(lengths)}) AS symbols, (" + " + ".join(f"sum(greatest(n - {m} + 1, 0))" for m in lengths) + ")::BIGINT AS windows_total"

ORACLE = {
    "similar_windows": f"""WITH {BARS_SQL}, {_WINDOWS}
SELECT ts_code, start_idx::INT AS start_idx, start_date, end_date, {_Q4('CASE WHEN sx > 1e-9::DOUBLE THEN mass ELSE 1 END', 'mass')}, {_Q4('structure', 'structure')}, {_Q4('event', 'event')},
 {_Q4('CASE WHEN need > 0 THEN 1 - (l0 + l1 + 3 * l2 + 3 * l3 + l4 + 4 * l5) / need ELSE 1 END', 'coverage')}, (l0 + l1 + l2 + l3 + l4 + l5)::INT AS missing FROM g""",
    "similar_size": f"""WITH {BARS_SQL}, n AS (SELECT ts_code, count(*) n FROM b GROUP BY 1)
SELECT 'fixed' AS mode, {_COUNTED(candidate_lengths(QUERY_BARS, SearchRules()))} FROM n UNION ALL SELECT 'elastic', {_COUNTED(candidate_lengths(QUERY_BARS, SearchRules(mode='elastic')))} FROM n""",
    "window_moments": f"""WITH {BARS_SQL}, z AS (SELECT ts_code, date, count(*) OVER w n, avg(ln(c)) OVER w m, stddev_pop(ln(c)) OVER w s FROM b WINDOW w AS (PARTITION BY ts_code ORDER BY date ROWS 19 PRECEDING))
SELECT ts_code, date, {q6('m', 'mean')}, {q6('s', 'spread')} FROM z WHERE n = 20""",
}
