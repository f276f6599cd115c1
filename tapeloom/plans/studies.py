"""Queries over events and tables: statistics, picks, audits and the security master."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.regimes import regime_of_span
from tapeloom.operators import audit, bars as B, master, stats
from tapeloom.operators.current import current_bars
from tapeloom.plans.base import BARS_SQL, EVENTS_SQL, bars, events, q6, r6
from tapeloom.plans.problems import _CODE, CURRENT_BARS_SQL
from tapeloom.functions.codes import canonical_code
from tapeloom.sources.tables import table

_STATS = ("mean", "median", "win", "std", "p10", "p25", "p75", "p90", "t", "ex_mean", "ex_win")
_DROP_EDGES, _DROP_LABELS = (-0.07, -0.03), ("steep", "medium", "mild")


def _round_stats(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(c) for c in df.columns if c in _STATS})


def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the path return overall, by board, by year, and by board and year."""
    return _round_stats(stats.summarize(events(spark, sf_dir), "ret", "ex", [(), ("board",), ("year",), ("board", "year")]))


def event_summary_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above by direction, with the excess only where there is a return."""
    return _round_stats(stats.summarize(events(spark, sf_dir), "ret", "ex", [(), ("d1_direction",)], aligned=True))


def event_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stats.histogram(events(spark, sf_dir), "ret")
    return df.select("bin", "n", r6("share"), r6("cum_share"))


def event_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(events(spark, sf_dir), ("board", "year", "drop_bucket", "d1_direction"))


def event_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by right-closed bucket of the drop."""
    df = events(spark, sf_dir).withColumn("bucket", stats.bucket(F.col("drop_pct"), _DROP_EDGES, _DROP_LABELS))
    return df.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg("ret"), "mean"))


def _by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).filter("ret is not null and return_start_date is not null and return_end_date is not null")
    sign = F.when(F.col("ret") > 0, "gain").when(F.col("ret") < 0, "loss").otherwise("flat")
    return df.select("ret", regime_of_span(F.col("return_start_date"), F.col("return_end_date")).alias("regime"), sign.alias("sign"))


def regime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime by sign with both totals (a rollup)."""
    df = _by_regime(spark, sf_dir).rollup("regime", "sign").agg(F.count("*").alias("n"), r6(F.avg("ret"), "mean"), r6(F.median("ret"), "median"))
    return df.select(F.coalesce("regime", F.lit("total")).alias("regime"), F.coalesce("sign", F.lit("total")).alias("sign"), "n", "mean", "median")


def regime_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_regime(spark, sf_dir).groupBy("regime").pivot("sign", ["gain", "loss", "flat"]).count().na.fill(0, ["gain", "loss", "flat"])


def representative_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest, lowest and middle returns of each board."""
    df = stats.spread_pick(events(spark, sf_dir), ("board",), "ret", ("ts_code", "signal_date"), 5)
    return df.select("board", "kind", "place", "ts_code", "signal_date", r6("ret"))


def threshold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a return above 30 per cent, the highest first."""
    df = events(spark, sf_dir).filter("ret > 0.3")
    return df.orderBy(F.col("ret").desc(), "ts_code", "signal_date").select("ts_code", "signal_date", r6("ret"))


def sampled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 14 events."""
    return stats.seeded_sample(events(spark, sf_dir), ("ts_code", "signal_date"), 14, 20261002).select("ts_code", "signal_date", r6("ret"))


def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 201 to 400 of the events in order of signal date, latest first, and code."""
    df = events(spark, sf_dir).orderBy(F.col("signal_date").desc(), "ts_code").offset(200).limit(200)
    return df.select("ts_code", "signal_date")


def invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.invalid_rows(table(spark, sf_dir, "stock_daily"))


def session_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage(bars(spark, sf_dir), table(spark, sf_dir, "trade_calendar"))


def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.gaps(bars(spark, sf_dir), table(spark, sf_dir, "trade_calendar"))


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.daily_counts(bars(spark, sf_dir))


def yearly_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.yearly_coverage(bars(spark, sf_dir))


def copy_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every code in the two systems."""
    both = [table(spark, sf_dir, t).select(canonical_code(F.col("ts_code")).alias("ts_code")).dropna() for t in ("stock_daily", "stock_daily_qfq")]
    return audit.inventory(both[0], both[1], "ts_code")


def missing_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    basic = table(spark, sf_dir, "stock_basic_tdx").select("ts_code", F.trim("name").alias("name"))
    lost = audit.missing_instruments(basic, bars(spark, sf_dir), {"300573.SZ": "600831.SH"})
    return lost.select("ts_code", "name", "successor_present")


def adjusted_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjusted copy against the prices built from the bars, to a hundredth."""
    copy = table(spark, sf_dir, "stock_daily_qfq").select(canonical_code(F.col("ts_code")).alias("ts_code"), "date", *B.PRICES).dropna().dropDuplicates(["ts_code", "date"])
    return audit.reconcile_adjusted(B.forward_adjusted_view(bars(spark, sf_dir)), copy, 0.01)


def calendar_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that only the bars or only the Shanghai calendar has."""
    days = table(spark, sf_dir, "trade_calendar").filter("sh_open").select(F.col("cal_date").alias("date"))
    return audit.same_calendar(bars(spark, sf_dir).filter("ts_code like '%.SH'"), days, "date")


def action_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One action per code, by status applied, then before_listing, then others, the latest first."""
    df = table(spark, sf_dir, "xdxr").withColumn("_age", -F.unix_date("ex_date"))
    return master.first_by_priority(df, "ts_code", "status", ("applied", "before_listing"), ("_age",)).select("ts_code", "ex_date", "status")


def security_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, bars' codes and industries joined in full, with the exchange of each symbol."""
    basic = table(spark, sf_dir, "stock_basic_tdx")
    names = basic.filter("name is not null").select("symbol", "name")
    base = bars(spark, sf_dir).groupBy(F.substring("ts_code", 1, 6).alias("symbol")).agg(F.min("date").alias("first_date"))
    return master.build_master(names, base, basic.filter("tdx_industry_code is not null").select("symbol", F.col("tdx_industry_code").alias("industry"))).select("symbol", "name", "first_date", "industry")


def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master.resolve(table(spark, sf_dir, "stock_basic_tdx"), "食品").select("ts_code", "how")


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over the whole bar table: rows, instruments, days, gaps and rows off the calendar."""
    c = session_coverage(spark, sf_dir)
    return c.agg(F.count("*").alias("instruments"), F.sum("bars").alias("bars"), F.sum("missing").alias("missing"), F.sum("gap_runs").alias("gap_runs"), F.max("longest_gap").cast("bigint").alias("longest_gap"), F.sum("off_calendar").alias("off_calendar"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.count_if(F.col("missing") == 0).alias("complete_instruments"))


QUERIES = {f.__name__: f for f in (
    audit_summary, event_summary, event_summary_aligned, event_histogram, event_value_counts, event_buckets, regime_summary, regime_pivot, representative_events, threshold_events, sampled_events, event_page,
    invalid_rows, session_coverage, session_gaps, daily_counts, yearly_coverage, copy_inventory, missing_instruments, adjusted_reconciliation, calendar_differences, action_priority, security_master, name_resolution,
)}

_DESCRIBE = ", ".join(["count(ret) AS n", q6("avg(ret)", "mean"), q6("median(ret)", "median"), q6("avg((ret > 0)::INT)", "win"), q6("stddev_samp(ret)", "std"), *[q6(f"quantile_cont(ret, {q / 100})", f"p{q}") for q in (10, 25, 75, 90)],
                       q6("CASE WHEN count(ret) > 1 AND stddev_samp(ret) > 0 THEN avg(ret)/(stddev_samp(ret)/sqrt(count(ret))) END", "t")])
_EX = ", " + q6("avg(ex)", "ex_mean") + ", " + q6("avg((ex > 0)::INT)", "ex_win")
_EXA = ", " + q6("avg(CASE WHEN ret IS NOT NULL THEN ex END)", "ex_mean") + ", " + q6("avg(CASE WHEN ret IS NOT NULL THEN (ex > 0)::INT END)", "ex_win")
_REG = "(x >= DATE '2019-02-01')::INT + (x >= DATE '2021-11-30')::INT + (x >= DATE '2024-09-23')::INT + (x >= DATE '2026-07-01')::INT"
_REGIME = f"""g0 AS (SELECT ret, {_REG.replace('x >=', 'return_start_date >=')} i, {_REG.replace('x >=', 'return_end_date >=')} j FROM e WHERE ret IS NOT NULL AND return_start_date IS NOT NULL AND return_end_date IS NOT NULL),
g AS (SELECT ret, CASE WHEN i <> j THEN 'cross' WHEN i % 2 = 1 THEN 'bull' ELSE 'bear' END AS regime, CASE WHEN ret > 0 THEN 'gain' WHEN ret < 0 THEN 'loss' ELSE 'flat' END AS sign FROM g0)"""
_SESSIONS = """s0 AS (SELECT DISTINCT cal_date, x FROM (SELECT cal_date, 'SH' x FROM trade_calendar WHERE sh_open UNION ALL SELECT cal_date, 'SZ' FROM trade_calendar WHERE sz_open UNION ALL SELECT cal_date, 'BJ' FROM trade_calendar WHERE bj_open)),
s AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY cal_date) k FROM s0),
on0 AS (SELECT b.ts_code, date, k, lag(date) OVER w pd, k - lag(k) OVER w - 1 AS gap FROM b JOIN s ON s.x = right(b.ts_code, 2) AND cal_date = date WINDOW w AS (PARTITION BY b.ts_code ORDER BY k))"""
_EDGES = ", ".join(f"{e}::DOUBLE" for e in stats.RETURN_EDGES)
_NUM = lambda c: f'(isfinite("{c}") IS TRUE)'
_EVERY = " AND ".join(_NUM(c) for c in B.PRICES)
_KEY = "grouping_id(board, year)"

ORACLE = {
    "event_summary": f"""WITH {EVENTS_SQL} SELECT 'all' AS "grouping", '' AS "group", {_DESCRIBE}{_EX} FROM e UNION ALL SELECT 'board', board, {_DESCRIBE}{_EX} FROM e GROUP BY board
UNION ALL SELECT 'year', year::VARCHAR, {_DESCRIBE}{_EX} FROM e GROUP BY year UNION ALL SELECT 'board+year', board || '|' || year::VARCHAR, {_DESCRIBE}{_EX} FROM e GROUP BY board, year""",
    "event_summary_aligned": f"""WITH {EVENTS_SQL} SELECT 'all' AS "grouping", '' AS "group", {_DESCRIBE}{_EXA} FROM e UNION ALL SELECT 'd1_direction', coalesce(d1_direction, ''), {_DESCRIBE}{_EXA} FROM e GROUP BY d1_direction""",
    "event_histogram": f"""WITH {EVENTS_SQL}, k AS (SELECT len(list_filter([{_EDGES}], lambda z: ret >= z)) AS bin, count(*) n FROM e WHERE ret IS NOT NULL GROUP BY 1), a AS (SELECT i AS bin, coalesce(n, 0) n FROM range({len(stats.RETURN_EDGES) + 1}) r(i) LEFT JOIN k ON bin = i)
SELECT bin::INT AS bin, n, {q6('n/sum(n) OVER ()', 'share')}, {q6('sum(n) OVER (ORDER BY bin)/sum(n) OVER ()', 'cum_share')} FROM a""",
    "event_value_counts": f"""WITH {EVENTS_SQL}, u AS (SELECT 'board' AS "column", board AS "value" FROM e UNION ALL SELECT 'year', year::VARCHAR FROM e UNION ALL SELECT 'drop_bucket', drop_bucket FROM e UNION ALL SELECT 'd1_direction', d1_direction FROM e)
SELECT "column", "value", count(*) AS n FROM u GROUP BY 1, 2""",
    "event_buckets": f"WITH {EVENTS_SQL} SELECT CASE WHEN drop_pct <= -0.07::DOUBLE THEN 'steep' WHEN drop_pct <= -0.03::DOUBLE THEN 'medium' WHEN drop_pct IS NOT NULL THEN 'mild' END AS bucket, count(*) AS n, {q6('avg(ret)', 'mean')} FROM e GROUP BY 1",
    "regime_summary": f"WITH {EVENTS_SQL}, {_REGIME} SELECT coalesce(regime, 'total') AS regime, coalesce(sign, 'total') AS sign, count(*) AS n, {q6('avg(ret)', 'mean')}, {q6('median(ret)', 'median')} FROM g GROUP BY ROLLUP (regime, sign)",
    "regime_pivot": f"WITH {EVENTS_SQL}, {_REGIME} SELECT regime, sum((sign='gain')::INT)::BIGINT AS gain, sum((sign='loss')::INT)::BIGINT AS loss, sum((sign='flat')::INT)::BIGINT AS flat FROM g GROUP BY 1",
    "representative_events": f"""WITH {EVENTS_SQL}, k AS (SELECT board, ts_code, signal_date, ret, avg(ret) OVER (PARTITION BY board) AS m FROM e WHERE ret IS NOT NULL), h AS (SELECT board, 'high' AS kind, row_number() OVER (PARTITION BY board ORDER BY ret DESC, ts_code, signal_date) AS place, ts_code, signal_date, ret FROM k
UNION ALL SELECT board, 'low', row_number() OVER (PARTITION BY board ORDER BY ret, ts_code, signal_date), ts_code, signal_date, ret FROM k
UNION ALL SELECT board, 'middle', row_number() OVER (PARTITION BY board ORDER BY abs(ret - m), ts_code, signal_date), ts_code, signal_date, ret FROM k) SELECT board, kind, place::INT AS place, ts_code, signal_date, {q6('ret')} FROM h WHERE place <= 5""",
    "threshold_events": f"WITH {EVENTS_SQL} SELECT ts_code, signal_date, {q6('ret')} FROM e WHERE ret > 0.3::DOUBLE",
    "sampled_events": f"WITH {EVENTS_SQL} SELECT ts_code, signal_date, {q6('ret')} FROM e ORDER BY md5(ts_code || '|' || strftime(signal_date, '%Y-%m-%d') || '|20261002'), ts_code, signal_date LIMIT 14",
    "event_page": f"WITH {EVENTS_SQL} SELECT ts_code, signal_date FROM e ORDER BY signal_date DESC, ts_code LIMIT 200 OFFSET 200",
    "invalid_rows": f"""SELECT count(*) AS rows, sum((NOT ({_EVERY}))::INT)::BIGINT AS nonfinite_price, sum((({' OR '.join(f'({_NUM(p)} AND "{p}" <= 0)' for p in B.PRICES)}))::INT)::BIGINT AS nonpositive_price,
 sum((({_EVERY}) AND low > high)::INT)::BIGINT AS low_above_high, sum((({_EVERY}) AND (open > high OR open < low))::INT)::BIGINT AS open_outside, sum((({_EVERY}) AND ("close" > high OR "close" < low))::INT)::BIGINT AS close_outside,
 sum((NOT ({_NUM('adj_factor')} AND adj_factor > 0))::INT)::BIGINT AS bad_factor, sum(coalesce(vol < 0 OR ({_NUM('amount')} AND amount < 0), false)::INT)::BIGINT AS negative_flow,
 (count(*) - (SELECT count(*) FROM (SELECT DISTINCT ts_code, date FROM stock_daily)))::BIGINT AS repeated_keys FROM stock_daily""",
    "session_coverage": f"""WITH {BARS_SQL}, {_SESSIONS}, p AS (SELECT ts_code, min(date) a, max(date) z, count(*) n, max(k) - min(k) + 1 AS ss, sum((gap > 0)::INT) gr, coalesce(max(gap), 0) lg FROM on0 GROUP BY 1),
f AS (SELECT ts_code, count(*) n FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.x = right(b.ts_code, 2) AND cal_date = date) GROUP BY 1)
SELECT p.ts_code, a AS first_date, z AS last_date, p.n AS bars, ss::INT AS sessions, coalesce(gr, 0)::BIGINT AS gap_runs, lg::INT AS longest_gap, coalesce(f.n, 0) AS off_calendar, ss - p.n AS missing FROM p LEFT JOIN f ON f.ts_code = p.ts_code""",
    "audit_summary": f"""WITH {BARS_SQL}, {_SESSIONS}, p AS (SELECT ts_code, min(date) a, max(date) z, count(*) n, max(k) - min(k) + 1 - count(*) AS ms, sum((gap > 0)::INT) gr, coalesce(max(gap), 0) lg FROM on0 GROUP BY 1),
f AS (SELECT count(*) n FROM b WHERE ts_code IN (SELECT ts_code FROM p) AND NOT EXISTS (SELECT 1 FROM s WHERE s.x = right(b.ts_code, 2) AND cal_date = date))
SELECT count(*) AS instruments, sum(p.n)::BIGINT AS bars, sum(ms)::BIGINT AS missing, coalesce(sum(gr), 0)::BIGINT AS gap_runs, max(lg)::BIGINT AS longest_gap, (SELECT n FROM f)::BIGINT AS off_calendar, min(a) AS first_date, max(z) AS last_date, sum((ms = 0)::INT)::BIGINT AS complete_instruments FROM p""",
    "session_gaps": f'WITH {BARS_SQL}, {_SESSIONS} SELECT ts_code, pd AS "after", date AS "before", gap::INT AS sessions FROM on0 WHERE gap > 0',
    "daily_counts": f"WITH {BARS_SQL} SELECT date, count(DISTINCT ts_code) AS instruments, sum((vol = 0)::INT)::BIGINT AS without_trading FROM b GROUP BY 1",
    "yearly_coverage": f"WITH {BARS_SQL}, d AS (SELECT date, count(*) n FROM b GROUP BY 1) SELECT date_part('year', date)::INT AS year, count(*) AS days, sum(n)::BIGINT AS bars, arg_min(n, date) AS first_day_instruments, arg_max(n, date) AS last_day_instruments FROM d GROUP BY 1",
    "copy_inventory": f"""WITH a AS (SELECT {_CODE} AS ts_code, count(*) n FROM stock_daily WHERE ts_code IS NOT NULL GROUP BY 1), z AS (SELECT {_CODE} AS ts_code, count(*) n FROM stock_daily_qfq WHERE ts_code IS NOT NULL GROUP BY 1)
SELECT coalesce(a.ts_code, z.ts_code) AS ts_code, a.n AS left_rows, z.n AS right_rows, CASE WHEN a.n IS NULL THEN 'right_only' WHEN z.n IS NULL THEN 'left_only' ELSE 'both' END AS "where" FROM a FULL JOIN z ON a.ts_code = z.ts_code""",
    "missing_instruments": f"""WITH {BARS_SQL}, k AS (SELECT DISTINCT ts_code FROM b) SELECT ts_code, trim(name) AS name, (ts_code = '300573.SZ' AND EXISTS (SELECT 1 FROM k WHERE ts_code = '600831.SH')) AS successor_present
FROM stock_basic_tdx WHERE ts_code NOT IN (SELECT ts_code FROM k)""",
    "adjusted_reconciliation": f"""WITH {BARS_SQL}, z AS (SELECT *, last_value(f) OVER (PARTITION BY ts_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) lf FROM b), r4 AS (SELECT ts_code, date, round_even(open*f/lf*1e4::DOUBLE,0)/1e4::DOUBLE o, round_even(high*f/lf*1e4::DOUBLE,0)/1e4::DOUBLE h,
 round_even(low*f/lf*1e4::DOUBLE,0)/1e4::DOUBLE lo, round_even(c*f/lf*1e4::DOUBLE,0)/1e4::DOUBLE cl FROM z),
q AS (SELECT DISTINCT {_CODE} AS ts_code, date, open, high, low, "close" FROM stock_daily_qfq WHERE ts_code IS NOT NULL AND date IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND "close" IS NOT NULL AND NOT isnan(open) AND NOT isnan(high) AND NOT isnan(low) AND NOT isnan("close"))
SELECT sum((r4.ts_code IS NOT NULL AND q.ts_code IS NOT NULL)::INT)::BIGINT AS matched, sum((q.ts_code IS NULL)::INT)::BIGINT AS left_only, sum((r4.ts_code IS NULL)::INT)::BIGINT AS right_only, sum((abs(o-open) > 0.01::DOUBLE)::INT)::BIGINT AS open_off,
 sum((abs(h-high) > 0.01::DOUBLE)::INT)::BIGINT AS high_off, sum((abs(lo-low) > 0.01::DOUBLE)::INT)::BIGINT AS low_off, sum((abs(cl-"close") > 0.01::DOUBLE)::INT)::BIGINT AS close_off FROM r4 FULL JOIN q ON r4.ts_code = q.ts_code AND r4.date = q.date""",
    "calendar_differences": f"""WITH {BARS_SQL}, x AS (SELECT DISTINCT date FROM b WHERE ts_code LIKE '%.SH'), y AS (SELECT DISTINCT cal_date AS date FROM trade_calendar WHERE sh_open)
SELECT date, 'left' AS side FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT date, 'right' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""",
    "action_priority": "SELECT ts_code, ex_date, status FROM xdxr QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY CASE status WHEN 'applied' THEN 1 WHEN 'before_listing' THEN 2 ELSE 3 END, ex_date DESC) = 1",
    "security_master": f"""WITH {BARS_SQL}, n AS (SELECT symbol, name FROM stock_basic_tdx WHERE name IS NOT NULL), k AS (SELECT left(ts_code, 6) AS symbol, min(date) d FROM b GROUP BY 1), i AS (SELECT symbol, tdx_industry_code FROM stock_basic_tdx WHERE tdx_industry_code IS NOT NULL)
SELECT coalesce(n.symbol, k.symbol) AS symbol, trim(n.name) AS name, k.d AS first_date, i.tdx_industry_code AS industry FROM n FULL JOIN k ON n.symbol = k.symbol LEFT JOIN i ON i.symbol = coalesce(n.symbol, k.symbol)""",
    "name_resolution": """WITH m AS (SELECT ts_code, CASE WHEN ts_code = '食品' THEN 1 WHEN left(ts_code, 6) = '' THEN 2 WHEN trim(name) = '食品' THEN 3 WHEN contains(trim(name), '食品') THEN 4 END AS how FROM stock_basic_tdx)
SELECT ts_code, how FROM m WHERE how = (SELECT min(how) FROM m)""",
}
