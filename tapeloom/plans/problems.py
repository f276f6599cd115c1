"""Queries over the core's operators for data quality: differences, spikes and regular grids."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.diff import bar_differences
from tapeloom.operators.grid import held_out_closes, session_closes, weekly_closes
from tapeloom.operators.spikes import faulty_bar_readings
from tapeloom.sources.tables import table


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias("trade_day")


def _cents(column: str):
    return (F.floor(F.col(column) * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)).alias(column)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bar_differences(table(spark, sf_dir, "stock_daily"), table(spark, sf_dir, "stock_daily_qfq"))
    return found.select("ts_code", _day("date"), "diff_kind")


def p1_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differing cells with both sides' values."""
    found = bar_differences(table(spark, sf_dir, "stock_daily"), table(spark, sf_dir, "stock_daily_qfq"))
    return found.select("ts_code", _day("date"), "diff_kind", _cents("left_value"), _cents("right_value"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = faulty_bar_readings(table(spark, sf_dir, "stock_daily"))
    return found.select("ts_code", _day("date"), F.col("field").alias("faulty_field")).distinct()


def p2_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason for which a reading is implausible, with its value and score."""
    return faulty_bar_readings(table(spark, sf_dir, "stock_daily")).select("ts_code", _day("date"), "field", "reason", "value", "score")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = session_closes(table(spark, sf_dir, "stock_daily"), table(spark, sf_dir, "trade_calendar"))
    return grid.filter("is_filled").select(F.col("source").alias("ts_code"), _day("period"))


def p5_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole regular series, with filled sessions marked."""
    grid = session_closes(table(spark, sf_dir, "stock_daily"), table(spark, sf_dir, "trade_calendar"))
    return grid.select(F.col("source").alias("ts_code"), _day("period"), F.col("value").alias("close"), "is_filled", "filled_value", "line_value", "rounds", "converged")


def p5_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular series with the sessions without a close marked."""
    return p5_series(spark, sf_dir).select("ts_code", "trade_day", "close", "is_filled")


def p5_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closes put into weeks, with the weeks without any marked."""
    grid = weekly_closes(table(spark, sf_dir, "stock_daily"))
    return grid.select(F.col("source").alias("ts_code"), _day("period"), F.col("value").alias("close"), "is_filled")


def p5_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, in logarithms, of the imputation and of the straight line on one close in twenty, hidden before."""
    hidden = held_out_closes(table(spark, sf_dir, "stock_daily"), table(spark, sf_dir, "trade_calendar"))
    off = {name: F.abs(F.ln(c) - F.ln("value")) for name, c in (("imputed", "filled_value"), ("line", "line_value"))}
    errors = [f(x).alias(f"{name}_{of}") for name, x in off.items() for of, f in (("median", F.median), ("mean", F.avg), ("rms", lambda e: F.sqrt(F.avg(e * e))))]
    return hidden.agg(F.count("*").alias("hidden"), *errors, F.count_if(~F.col("converged")).alias("not_converged"))


QUERIES = {f.__name__: f for f in (p1_found, p1_cells, p2_found, p2_readings, p5_found, p5_series, p5_marked, p5_weekly, p5_holdout)}

_CODE = """CASE WHEN regexp_matches(upper(trim(ts_code)), '^[0-9]{6}[.]?[A-Z]{2}$') THEN substr(upper(trim(ts_code)), 1, 6) || '.' || right(upper(trim(ts_code)), 2)
 ELSE right(upper(trim(ts_code)), 6) || '.' || left(upper(trim(ts_code)), 2) END"""

CURRENT_BARS_SQL = f"""cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, date ORDER BY synced_at DESC) rn FROM (
 SELECT {_CODE} AS ts_code, date, CASE WHEN NOT isnan(open) THEN open END open, CASE WHEN NOT isnan(high) THEN high END high, CASE WHEN NOT isnan(low) THEN low END low, CASE WHEN NOT isnan(close) THEN close END "close",
  vol, CASE WHEN NOT isnan(amount) THEN amount END amount, CASE WHEN NOT isnan(adj_factor) THEN adj_factor END adj_factor, synced_at
 FROM stock_daily WHERE ts_code IS NOT NULL AND date IS NOT NULL)) WHERE rn = 1)"""

CURRENT_EVENTS_SQL = f"""ev AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, signal_date ORDER BY loaded_at DESC) rn FROM (
 SELECT * REPLACE ({_CODE} AS ts_code, CASE WHEN NOT isnan(ret_close_to_best_close_25) THEN ret_close_to_best_close_25 END AS ret_close_to_best_close_25)
 FROM yizi_events WHERE ts_code IS NOT NULL AND signal_date IS NOT NULL)) WHERE rn = 1)"""

_DIFF = f"""WITH {CURRENT_BARS_SQL},
lf AS (SELECT ts_code, arg_max(struct_pack(f := adj_factor), date).f AS last_factor FROM cur GROUP BY 1),
l AS (SELECT ts_code, date, open*adj_factor/nullif(last_factor,0) open, high*adj_factor/nullif(last_factor,0) high, low*adj_factor/nullif(last_factor,0) low, "close"*adj_factor/nullif(last_factor,0) "close", vol, amount
 FROM cur JOIN lf USING (ts_code)),
r AS (SELECT DISTINCT {_CODE} AS ts_code, date, CASE WHEN NOT isnan(open) THEN open END open, CASE WHEN NOT isnan(high) THEN high END high, CASE WHEN NOT isnan(low) THEN low END low, CASE WHEN NOT isnan("close") THEN "close" END "close", vol, CASE WHEN NOT isnan(amount) THEN amount END amount
 FROM stock_daily_qfq WHERE ts_code IS NOT NULL AND date IS NOT NULL),
j AS (SELECT coalesce(l.ts_code, r.ts_code) ts_code, strftime(coalesce(l.date, r.date), '%Y-%m-%d') trade_day, l.ts_code IS NOT NULL inl, r.ts_code IS NOT NULL inr,
 l.open lo, r.open ro, l.high lh, r.high rh, l.low ll, r.low rl, l."close" lc, r."close" rc, l.vol::DOUBLE lv, r.vol::DOUBLE rv, l.amount la, r.amount ra FROM l FULL JOIN r ON l.ts_code = r.ts_code AND l.date = r.date),
d AS (SELECT ts_code, trade_day, 'missing_in_qfq' diff_kind, NULL::DOUBLE a, NULL::DOUBLE b FROM j WHERE NOT inr
 UNION ALL SELECT ts_code, trade_day, 'missing_in_daily', NULL, NULL FROM j WHERE NOT inl
 UNION ALL SELECT ts_code, trade_day, 'open', lo, ro FROM j WHERE inl AND inr AND ((lo IS NULL) <> (ro IS NULL) OR abs(lo-ro) > 0.0002)
 UNION ALL SELECT ts_code, trade_day, 'high', lh, rh FROM j WHERE inl AND inr AND ((lh IS NULL) <> (rh IS NULL) OR abs(lh-rh) > 0.0002)
 UNION ALL SELECT ts_code, trade_day, 'low', ll, rl FROM j WHERE inl AND inr AND ((ll IS NULL) <> (rl IS NULL) OR abs(ll-rl) > 0.0002)
 UNION ALL SELECT ts_code, trade_day, 'close', lc, rc FROM j WHERE inl AND inr AND ((lc IS NULL) <> (rc IS NULL) OR abs(lc-rc) > 0.0002)
 UNION ALL SELECT ts_code, trade_day, 'vol', lv, rv FROM j WHERE inl AND inr AND ((lv IS NULL) <> (rv IS NULL) OR lv <> rv)
 UNION ALL SELECT ts_code, trade_day, 'amount', la, ra FROM j WHERE inl AND inr AND ((la IS NULL) <> (ra IS NULL) OR abs(la-ra) > 1e-6*abs(la)))"""

_GRID = """s AS (SELECT cal_date, 'SH' x FROM trade_calendar WHERE sh_open UNION ALL SELECT cal_date, 'SZ' FROM trade_calendar WHERE sz_open UNION ALL SELECT cal_date, 'BJ' FROM trade_calendar WHERE bj_open),
b AS (SELECT ts_code, date, "close", right(ts_code, 2) x FROM cur JOIN s ON cal_date = date AND x = right(ts_code, 2) WHERE "close" IS NOT NULL),
f AS (SELECT ts_code, x, min(date) a, max(date) z FROM b GROUP BY ALL)"""

ORACLE = {
    "p1_found": f"{_DIFF} SELECT ts_code, trade_day, diff_kind FROM d",
    "p1_cells": f"{_DIFF} SELECT ts_code, trade_day, diff_kind, floor(a * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS left_value, floor(b * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS right_value FROM d",
    "p5_marked": f"""WITH {CURRENT_BARS_SQL}, {_GRID}
SELECT f.ts_code, strftime(cal_date, '%Y-%m-%d') AS trade_day, b."close" AS "close", b."close" IS NULL AS is_filled FROM f JOIN s ON s.x = f.x AND cal_date BETWEEN a AND z LEFT JOIN b ON b.ts_code = f.ts_code AND b.date = cal_date""",
    "p5_weekly": f"""WITH {CURRENT_BARS_SQL}, w AS (SELECT ts_code, date_trunc('week', date)::DATE AS k, arg_max("close", date) AS c FROM cur WHERE "close" IS NOT NULL GROUP BY 1, 2),
g AS (SELECT ts_code, unnest(generate_series(min(k), max(k), INTERVAL 7 DAYS))::DATE AS k FROM w GROUP BY 1)
SELECT g.ts_code, strftime(g.k, '%Y-%m-%d') AS trade_day, w.c AS "close", w.c IS NULL AS is_filled FROM g LEFT JOIN w ON w.ts_code = g.ts_code AND w.k = g.k""",
    "p5_found": f"""WITH {CURRENT_BARS_SQL}, {_GRID}
SELECT f.ts_code, strftime(cal_date, '%Y-%m-%d') AS trade_day FROM f JOIN s ON s.x = f.x AND cal_date BETWEEN a AND z
WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.ts_code = f.ts_code AND b.date = cal_date)""",
}
