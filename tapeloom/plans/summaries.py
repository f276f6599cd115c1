"""Queries of longer summaries: entries by horizon, shares of winners, counter-examples, coverage records and the audit's master row."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.boards import board_strict
from tapeloom.functions.codes import canonical_code
from tapeloom.functions.regimes import regime_of_span
from tapeloom.operators import audit, bars as B, events as E, limits, ranking, returns, stats
from tapeloom.operators.current import as_number, current_bars
from tapeloom.operators.lineage import cut
from tapeloom.plans.base import BARS_SQL, EVENTS_SQL, LIMITS_SQL, bars, events, q6, r6
from tapeloom.plans.market import _FJ, _HALVES, _HALVINGS, _HOLD, _IDX, _RUN, _STRICT, _STRONG, END, START
from tapeloom.plans.problems import _CODE, CURRENT_BARS_SQL
from tapeloom.plans.similar import _WINDOWS
from tapeloom.plans.studies import _DESCRIBE, _EX, _EXA, _EVERY, _NUM, _REGIME, _SESSIONS, _STATS
from tapeloom.sources.tables import table

SINCE = "2020-01-01"
HALVING_EDGES = (-0.5, -0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.5, 1.0)  # fixed values
THRESHOLDS = {"over_500": 5.0, "over_200": 2.0 + 1e-8}


def daily_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart labels of the days that have one."""
    return limits.daily_labels(bars(spark, sf_dir)).filter("board_type <> ''").select("ts_code", "date", "board_type")


def _entries(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    b = B.backward_adjusted(limits.limit_features(bars(spark, sf_dir)))
    forward = returns.forward_returns(b, returns.market_index(b), (1, 5, 20))
    signals = E.strong_day_pullbacks(bars(spark, sf_dir), "2018-01-01").select("ts_code", F.col("signal_date").alias("date"), "year", F.col("t").alias("days_since"))
    df = stats.entry_summary(signals, forward, [(), ("year",), ("days_since",)], **how)
    return df.withColumns({c: r6(c) for c in df.columns if c in _STATS})


def entry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pullbacks after a strong day by entry and horizon, overall, by year and by days since; blocked opens are left out."""
    return _entries(spark, sf_dir)


def close_entry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for close entries only, with the excess only where there is a return."""
    return _entries(spark, sf_dir, entries=("close",), aligned=True)


def halving_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of best and terminal return of the complete halvings."""
    found = cut(E.halvings(bars(spark, sf_dir), 63, 25, 126).filter("status = 'complete'").select("best_return", "terminal_return"))
    both = [stats.histogram(found, m, HALVING_EDGES).select(F.lit(m).alias("metric"), "bin", "n", r6("share")) for m in ("best_return", "terminal_return")]
    return both[0].unionByName(both[1])


def counter_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten returns not above 0 in bull markets and ten above 0 in bear markets, the most extreme."""
    df = events(spark, sf_dir).filter("ret is not null and return_start_date is not null and return_end_date is not null")
    df = df.withColumn("regime", regime_of_span(F.col("return_start_date"), F.col("return_end_date")))
    return stats.counter_examples(df, "ret", "regime", ("ts_code", "signal_date")).select("kind", "place", "ts_code", "signal_date", r6("ret"))


def holding_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ranking.holding_status(ranking.holding_returns(B.backward_adjusted(bars(spark, sf_dir)), START, END), START)
    return df.select("ts_code", "first_date", "last_date", r6("total_return"), "full_period", "status")


def _run_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.run_ups(B.backward_adjusted(bars(spark, sf_dir)), "2024-09-23", "2026-06-30").select("ts_code", "run_up")


def _won(df: DataFrame, group: str) -> DataFrame:
    return df.select("threshold", group, "stocks", "over", *[r6(c) for c in ("share_of_winners", "share_of_group", "median_rise", "mean_rise", "highest_rise")])


def winner_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rises above five and two times by board, with their shares."""
    return _won(ranking.winners(_run_ups(spark, sf_dir).withColumn("board", board_strict(F.col("ts_code"))), "board", THRESHOLDS), "board")


def winner_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by industry; a null industry is a group of its own."""
    named = table(spark, sf_dir, "stock_basic_tdx").groupBy("ts_code").agg(F.min("tdx_industry_code").alias("industry"))
    return _won(ranking.winners(_run_ups(spark, sf_dir).join(named, "ts_code", "left"), "industry", THRESHOLDS), "industry")


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_bars(table(spark, sf_dir, "stock_daily").withColumn("delivered", F.col("synced_at")), ("vol", "amount", "close", "delivered"))


def _copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "stock_daily_qfq").filter("ts_code is not null and date is not null")
    known = [as_number(F.col(c)).alias(c) for c in (*B.PRICES, "amount")]
    return rows.select(canonical_code(F.col("ts_code")).alias("ts_code"), "date", "vol", *known).dropDuplicates(["ts_code", "date"])


def coverage_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit knows of every instrument."""
    return audit.coverage_record(_delivered(spark, sf_dir), _copy(spark, sf_dir), table(spark, sf_dir, "trade_calendar"), table(spark, sf_dir, "stock_basic_tdx"), SINCE)


def reconciled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjusted copy against the prices built from the bars, to 1e-8, with keys and flows."""
    return audit.reconcile_rows(B.forward_adjusted_view(bars(spark, sf_dir)), _copy(spark, sf_dir))


def audit_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric and value of the audit's whole summary: one pass each over deliveries, records, calendar and the copies."""
    daily, calendar = table(spark, sf_dir, "stock_daily"), table(spark, sf_dir, "trade_calendar")
    basic = table(spark, sf_dir, "stock_basic_tdx")
    record = cut(coverage_record(spark, sf_dir))
    gaps = audit.gaps(_delivered(spark, sf_dir).filter(F.col("date") >= F.lit(SINCE).cast("date")), calendar)
    days = _delivered(spark, sf_dir).select("date").distinct().withColumn("traded", F.lit(True))
    open_days = calendar.filter("sh_open or sz_open or bj_open").select(F.col("cal_date").alias("date"), F.lit(True).alias("listed")).distinct()
    span = days.join(open_days, "date", "full")
    newest = record.agg(F.max("last_date").alias("newest"))
    starts = record.groupBy("first_date").agg(F.count("*").alias("n"), F.count_if(F.col("list_date") == F.col("first_date")).alias("on_listing"))
    late = (F.col("bars_since") > 0) & (F.col("start_gap_days") > 45)
    one_rows = [
        audit.invalid_rows(daily),
        daily.agg(F.count_if(F.col("vol") == 0).alias("zero_volume_rows"), F.count_if(F.col("ts_code").isNull() | F.col("date").isNull()).alias("rows_without_key"), F.count_if(F.col("date") >= F.lit(SINCE).cast("date")).alias("rows_since")),
        record.agg(F.count("*").alias("stocks"), F.sum("bars").alias("bars"), F.sum("bars_since").alias("bars_since"), F.count_if(F.col("bars_since") > 0).alias("stocks_since"), F.count_if("copy_exists").alias("copied_stocks"), F.count_if("aligned").alias("aligned_stocks"), F.count_if("values_equal").alias("value_equal_stocks"),
                   F.count_if(~F.col("date_order_ok")).alias("unordered_stocks"), F.sum("missing_inside_span").alias("internal_gap_stock_sessions"), F.max("longest_internal_gap").alias("longest_internal_gap"), F.count_if(late).alias("late_start_candidates"), F.count_if(F.col("list_date").isNull()).alias("stocks_without_listing_date")),
        record.withColumn("_one", F.lit(1)).join(F.broadcast(newest.withColumn("_one", F.lit(1))), "_one").agg(F.count_if(F.col("last_date") == F.col("newest")).alias("stocks_ending_on_latest")),
        starts.agg(F.max("n").alias("most_starts_on_a_day"), F.max_by("on_listing", F.struct("n", "first_date")).alias("of_these_listed_that_day")),
        gaps.agg(F.count("*").alias("internal_gap_ranges")),
        span.agg(F.count_if(F.col("listed")).alias("calendar_sessions"), F.count_if(F.col("traded") & F.col("listed").isNull()).alias("off_calendar_dates"), F.count_if(F.col("listed") & F.col("traded").isNull()).alias("missing_market_dates")),
        calendar.agg(F.count_if(~F.col("sh_open").eqNullSafe(F.col("sz_open"))).alias("sessions_that_differ_between_sh_and_sz")),
        reconciled_rows(spark, sf_dir).select(F.col("row_count_match").cast("long").alias("copy_row_count_match"), *[F.col(c).alias(f"copy_{c}") for c in ("bad_key_rows", "bad_price_rows", "bad_flow_rows")]),
        basic.select("ts_code").distinct().join(record.select("ts_code"), "ts_code", "left_anti").agg(F.count("*").alias("metadata_only_stocks")),
        _copy(spark, sf_dir).select("ts_code").distinct().join(record.select("ts_code"), "ts_code", "left_anti").agg(F.count("*").alias("copy_only_stocks")),
    ]
    out = None
    for row in one_rows:
        cells = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias("value")) for c in row.columns])))
        out = cells if out is None else out.unionByName(cells)
    return out


QUERIES = {f.__name__: f for f in (daily_labels, entry_summary, close_entry_summary, halving_distribution, counter_examples, holding_status, winner_boards, winner_industries, coverage_record, reconciled_rows, audit_master)}

_LABEL = "CASE WHEN e2 = 1 THEN 'one_word_up' WHEN e5 = 1 THEN 't_board_up' WHEN e4 = 1 THEN 'gap_limit_up' WHEN e3 = 1 THEN 'one_word_down' WHEN e0 = 1 THEN 'limit_up' WHEN e1 = 1 THEN 'limit_down' END"
_SIGNALS = f"sg AS (SELECT ts_code, date, t AS days_since, date_part('year', date)::INT AS year FROM z4), sj AS (SELECT sg.days_since, sg.year, fj.* FROM sg JOIN fj USING (ts_code, date))"
_ENTRY = "xe AS (SELECT year, days_since, horizon, 'close' AS entry, xc/hc - 1 AS ret, xc/hc - 1 - (m1/m0 - 1) AS ex FROM sj UNION ALL SELECT year, days_since, horizon, 'open', xc/no - 1, xc/no - 1 - (m1/mo - 1) FROM sj WHERE NOT blocked)"
_BY = lambda ex, where="": " UNION ALL ".join(f"SELECT '{g}' AS group_by, {v} AS \"group\", entry, horizon, {_DESCRIBE}{ex} FROM xe {where} GROUP BY {'' if g == 'all' else g + ', '}entry, horizon" for g, v in (("all", "''"), ("year", "year::VARCHAR"), ("days_since", "days_since::INT::VARCHAR")))
_EDGES = ", ".join(f"{e}::DOUBLE" for e in HALVING_EDGES)
_BINS = lambda m: f"""SELECT '{m}' AS metric, i::INT AS bin, coalesce(n, 0) AS n, {q6('coalesce(n, 0)/sum(n) OVER ()', 'share')} FROM range({len(HALVING_EDGES) + 1}) r(i) LEFT JOIN (SELECT len(list_filter([{_EDGES}], lambda z: {m} >= z)) AS bin, count(*) n FROM hd GROUP BY 1) ON bin = i"""
_WON = lambda group, join="": f"""th AS (SELECT 'over_500' AS threshold, 5.0::DOUBLE AS x UNION ALL SELECT 'over_200', 2.0::DOUBLE + 1e-8::DOUBLE), rr AS (SELECT r.ts_code, up, {group} FROM r {join}),
ww AS (SELECT threshold, {group.split(' AS ')[-1]}, count(*) AS stocks, count(CASE WHEN up > x THEN 1 END) AS over, median(CASE WHEN up > x THEN up END) md, avg(CASE WHEN up > x THEN up END) av, max(CASE WHEN up > x THEN up END) mx FROM rr, th GROUP BY 1, 2)
SELECT threshold, {group.split(' AS ')[-1]}, stocks, over, {q6('CASE WHEN sum(over) OVER (PARTITION BY threshold) > 0 THEN over/sum(over) OVER (PARTITION BY threshold) END', 'share_of_winners')}, {q6('over/stocks', 'share_of_group')}, {q6('md', 'median_rise')}, {q6('av', 'mean_rise')}, {q6('mx', 'highest_rise')} FROM ww"""  # noqa: E731
_QFQ = f"""cp AS (SELECT DISTINCT {_CODE} AS ts_code, date, CASE WHEN NOT isnan(open) THEN open END o, CASE WHEN NOT isnan(high) THEN high END h, CASE WHEN NOT isnan(low) THEN low END l, CASE WHEN NOT isnan("close") THEN "close" END c, vol AS cv, CASE WHEN NOT isnan(amount) THEN amount END AS ca FROM stock_daily_qfq WHERE ts_code IS NOT NULL AND date IS NOT NULL)"""
_RECORD = f"""{_QFQ},
pp AS (SELECT coalesce(k.ts_code, cp.ts_code) AS ts_code, k.date AS d, cp.date AS cd, k.vol IS NOT DISTINCT FROM cv AND k.amount IS NOT DISTINCT FROM ca AS same FROM cur k FULL JOIN cp ON cp.ts_code = k.ts_code AND cp.date = k.date),
p1 AS (SELECT ts_code, count(d) bars, count(cd) copy_rows, min(d) first_date, max(d) last_date, count(CASE WHEN d >= DATE '{SINCE}' THEN 1 END) bars_since, count(CASE WHEN d IS NULL OR cd IS NULL THEN 1 END) unpaired, count(CASE WHEN d IS NOT NULL AND cd IS NOT NULL AND NOT same THEN 1 END) AS different FROM pp GROUP BY 1 HAVING count(d) > 0),
lt AS (SELECT ts_code, sum(back::INT) = 0 AS date_order_ok FROM (SELECT ts_code, coalesce(synced_at < lag(synced_at) OVER (PARTITION BY ts_code ORDER BY date), false) back FROM cur) GROUP BY 1),
b AS (SELECT ts_code, date FROM cur WHERE date >= DATE '{SINCE}'), {_SESSIONS},
gp AS (SELECT ts_code, max(k) - min(k) + 1 - count(*) AS missing, coalesce(max(gap), 0) AS longest FROM on0 GROUP BY 1),
rc AS (SELECT p1.ts_code, first_date, last_date, bars, bars_since, date_order_ok, copy_rows > 0 AS copy_exists, copy_rows, copy_rows > 0 AND unpaired = 0 AS aligned, copy_rows > 0 AND unpaired = 0 AND different = 0 AS values_equal, different,
 coalesce(missing, 0)::BIGINT AS missing_inside_span, coalesce(longest, 0)::INT AS longest_internal_gap, list_date, (first_date - list_date)::INT AS start_gap_days FROM p1 JOIN lt USING (ts_code) LEFT JOIN gp USING (ts_code) LEFT JOIN (SELECT ts_code, min(list_date) AS list_date FROM stock_basic_tdx GROUP BY 1) USING (ts_code))"""
_REC = f"""zz AS (SELECT *, last_value(f) OVER (PARTITION BY ts_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) lf FROM vb), r4 AS (SELECT ts_code, date, vol, amount, round_even(open*f/lf*1e4::DOUBLE,0)/1e4::DOUBLE o, round_even(high*f/lf*1e4::DOUBLE,0)/1e4::DOUBLE h, round_even(low*f/lf*1e4::DOUBLE,0)/1e4::DOUBLE l, round_even(c*f/lf*1e4::DOUBLE,0)/1e4::DOUBLE c FROM zz),
rk AS (SELECT r4.ts_code AS a, cp.ts_code AS z, coalesce(abs(r4.o - cp.o) > 1e-8::DOUBLE, r4.o IS DISTINCT FROM cp.o) OR coalesce(abs(r4.h - cp.h) > 1e-8::DOUBLE, r4.h IS DISTINCT FROM cp.h) OR coalesce(abs(r4.l - cp.l) > 1e-8::DOUBLE, r4.l IS DISTINCT FROM cp.l) OR coalesce(abs(r4.c - cp.c) > 1e-8::DOUBLE, r4.c IS DISTINCT FROM cp.c) AS price,
 r4.vol IS DISTINCT FROM cv OR r4.amount IS DISTINCT FROM ca AS flow FROM r4 FULL JOIN cp ON cp.ts_code = r4.ts_code AND cp.date = r4.date),
rr AS (SELECT count(a) = count(z) AS row_count_match, count(CASE WHEN a IS NULL OR z IS NULL THEN 1 END) AS bad_key_rows, count(CASE WHEN a IS NOT NULL AND z IS NOT NULL AND price THEN 1 END) AS bad_price_rows, count(CASE WHEN a IS NOT NULL AND z IS NOT NULL AND flow THEN 1 END) AS bad_flow_rows FROM rk)"""
_PRICES = ("open", "high", "low", "close")
_FINITE = " AND ".join(f'isfinite("{c}") AND "{c}" > 0' for c in (*_PRICES, "adj_factor"))
_VB = f'vb AS (SELECT ts_code, date, open, high, low, "close" AS c, vol, amount, adj_factor AS f FROM cur WHERE {_FINITE})'
_METRICS = {
    "rows": "SELECT count(*) FROM stock_daily", "nonfinite_price": f"SELECT sum((NOT ({_EVERY}))::INT) FROM stock_daily", "nonpositive_price": "SELECT sum((" + " OR ".join(f'({_NUM(p)} AND "{p}" <= 0)' for p in _PRICES) + ")::INT) FROM stock_daily",
    "low_above_high": f"SELECT sum((({_EVERY}) AND low > high)::INT) FROM stock_daily", "open_outside": f"SELECT sum((({_EVERY}) AND (open > high OR open < low))::INT) FROM stock_daily", "close_outside": f'SELECT sum((({_EVERY}) AND ("close" > high OR "close" < low))::INT) FROM stock_daily',
    "bad_factor": f"SELECT sum((NOT ({_NUM('adj_factor')} AND adj_factor > 0))::INT) FROM stock_daily", "negative_flow": f"SELECT sum(coalesce(vol < 0 OR ({_NUM('amount')} AND amount < 0), false)::INT) FROM stock_daily",
    "repeated_keys": "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT ts_code, date FROM stock_daily)) FROM stock_daily",
    "zero_volume_rows": "SELECT count_if(vol = 0) FROM stock_daily", "rows_without_key": "SELECT count_if(ts_code IS NULL OR date IS NULL) FROM stock_daily", "rows_since": f"SELECT count_if(date >= DATE '{SINCE}') FROM stock_daily",
    "stocks": "SELECT count(*) FROM rc", "bars": "SELECT sum(bars) FROM rc", "bars_since": "SELECT sum(bars_since) FROM rc", "stocks_since": "SELECT count_if(bars_since > 0) FROM rc", "copied_stocks": "SELECT count_if(copy_exists) FROM rc", "aligned_stocks": "SELECT count_if(aligned) FROM rc",
    "value_equal_stocks": "SELECT count_if(values_equal) FROM rc", "unordered_stocks": "SELECT count_if(NOT date_order_ok) FROM rc", "internal_gap_stock_sessions": "SELECT sum(missing_inside_span) FROM rc", "longest_internal_gap": "SELECT max(longest_internal_gap) FROM rc",
    "late_start_candidates": "SELECT count_if(bars_since > 0 AND start_gap_days > 45) FROM rc", "stocks_without_listing_date": "SELECT count_if(list_date IS NULL) FROM rc", "stocks_ending_on_latest": "SELECT count_if(last_date = (SELECT max(last_date) FROM rc)) FROM rc",
    "most_starts_on_a_day": "SELECT max(n) FROM st", "of_these_listed_that_day": "SELECT on_listing FROM st ORDER BY n DESC, first_date DESC LIMIT 1", "internal_gap_ranges": "SELECT count(*) FROM on0 WHERE gap > 0",
    "calendar_sessions": "SELECT count(*) FROM od", "off_calendar_dates": "SELECT count(*) FROM (SELECT DISTINCT date FROM cur EXCEPT SELECT date FROM od)", "missing_market_dates": "SELECT count(*) FROM (SELECT date FROM od EXCEPT SELECT DISTINCT date FROM cur)",
    "sessions_that_differ_between_sh_and_sz": "SELECT count_if(sh_open IS DISTINCT FROM sz_open) FROM trade_calendar", "copy_row_count_match": "SELECT row_count_match::INT FROM rr", "copy_bad_key_rows": "SELECT bad_key_rows FROM rr", "copy_bad_price_rows": "SELECT bad_price_rows FROM rr", "copy_bad_flow_rows": "SELECT bad_flow_rows FROM rr",
    "metadata_only_stocks": "SELECT count(DISTINCT ts_code) FROM stock_basic_tdx WHERE ts_code NOT IN (SELECT ts_code FROM rc)", "copy_only_stocks": "SELECT count(DISTINCT ts_code) FROM cp WHERE ts_code NOT IN (SELECT ts_code FROM rc)",
}

ORACLE = {
    "daily_labels": f"WITH {BARS_SQL}, {_WINDOWS.split('q AS (SELECT row_number()')[0].rstrip().rstrip(',')} SELECT ts_code, date, {_LABEL} AS board_type FROM k WHERE {_LABEL} IS NOT NULL",
    "entry_summary": f"WITH {LIMITS_SQL}, {_IDX}, {_FJ}, {_STRONG}, {_SIGNALS}, {_ENTRY} {_BY(_EX)}",
    "close_entry_summary": f"""WITH {LIMITS_SQL}, {_IDX}, {_FJ}, {_STRONG}, {_SIGNALS}, {_ENTRY} {_BY(_EXA, "WHERE entry = 'close'")}""",
    "halving_distribution": f"""WITH RECURSIVE {BARS_SQL},
{_HALVES.replace('__LONG__', '126')}, hv AS ({_HALVINGS}), hd AS (SELECT v2.bs.v/v2.hc - 1 AS best_return, v2.ec/v2.hc - 1 AS terminal_return FROM v2 JOIN th ON th.ts_code = v2.ts_code AND th.k = v2.bar_no WHERE v2.bs IS NOT NULL)
{_BINS('best_return')} UNION ALL {_BINS('terminal_return')}""",
    "counter_examples": f"""WITH {EVENTS_SQL}, {_REGIME.replace('SELECT ret, ', 'SELECT ts_code, signal_date, ret, ')},
x AS (SELECT 'bull_not_positive' AS kind, row_number() OVER (ORDER BY ret, ts_code, signal_date) AS place, ts_code, signal_date, ret FROM g WHERE regime = 'bull' AND ret <= 0
 UNION ALL SELECT 'bear_positive', row_number() OVER (ORDER BY ret DESC, ts_code, signal_date), ts_code, signal_date, ret FROM g WHERE regime = 'bear' AND ret > 0) SELECT kind, place::INT AS place, ts_code, signal_date, {q6('ret')} FROM x WHERE place <= 10""",
    "holding_status": f"""WITH {BARS_SQL}, {_HOLD}, e AS (SELECT max(z) AS e FROM h0) SELECT h0.ts_code, h0.a AS first_date, h0.z AS last_date, {q6('cz/ca - 1', 'total_return')}, h0.z = e AND h0.a <= DATE '{START}' + 10 AS full_period, CASE WHEN h0.z = e THEN 'trading' ELSE 'delisted_or_suspended' END AS status FROM h0, e""",
    "winner_boards": f"WITH {BARS_SQL}, {_RUN}, {_WON(_STRICT + ' AS board')}",
    "winner_industries": f"WITH {BARS_SQL}, {_RUN}, {_WON('industry AS industry', 'LEFT JOIN (SELECT ts_code, min(tdx_industry_code) AS industry FROM stock_basic_tdx GROUP BY 1) n ON n.ts_code = r.ts_code')}",
    "coverage_record": f"WITH {CURRENT_BARS_SQL}, {_RECORD} SELECT * FROM rc",
    "reconciled_rows": f"WITH {CURRENT_BARS_SQL}, {_VB}, {_QFQ}, {_REC} SELECT * FROM rr",
    "audit_master": f"WITH {CURRENT_BARS_SQL}, {_RECORD}, {_VB}, {_REC}, st AS (SELECT first_date, count(*) n, count_if(list_date = first_date) on_listing FROM rc GROUP BY 1), od AS (SELECT DISTINCT cal_date AS date FROM trade_calendar WHERE sh_open OR sz_open OR bj_open) " + " UNION ALL ".join(f"SELECT '{name}' AS metric, coalesce(({sql})::BIGINT, 0) AS value" for name, sql in _METRICS.items()),
}
