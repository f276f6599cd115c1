"""Inputs that the market queries share, and the same as DuckDB table expressions."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.boards import board_of_event
from tapeloom.operators.bars import finite, valid_bars
from tapeloom.operators.current import current_bars, current_events
from tapeloom.plans.problems import CURRENT_BARS_SQL, CURRENT_EVENTS_SQL
from tapeloom.sources.tables import table


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current bars whose prices and factor are finite and positive."""
    return valid_bars(current_bars(table(spark, sf_dir, "stock_daily")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current events with a canonical board, a year and finite returns as ``ret``; ``ex`` is a return of the signal day."""
    columns = ("board", "year", "drop_bucket", "d1_direction", "drop_pct", "signal_day_pct", "ret_close_to_best_close_25", "d1_return", "return_start_date", "return_end_date")
    ev = current_events(table(spark, sf_dir, "yizi_events"), columns)
    keep = lambda c: F.when(finite(F.col(c)), F.col(c))
    return ev.select("ts_code", "signal_date", board_of_event("board", "ts_code").alias("board"), F.coalesce("year", F.year("signal_date")).alias("year"), "drop_bucket", "d1_direction", "drop_pct", keep("ret_close_to_best_close_25").alias("ret"), keep("d1_return").alias("ex"), "return_start_date", "return_end_date")


def r6(x: Column | str, name: str | None = None) -> Column:
    """A double to six decimals, as ``floor(x * 1e6 + 0.5) / 1e6``."""
    c = F.col(x) if isinstance(x, str) else x
    return (F.floor(c * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)).alias(name or x)


def q6(x: str, name: str | None = None) -> str:
    """The same in SQL."""
    return f"floor(({x}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS {name or x}"


_FINITE = " AND ".join(f'isfinite("{c}") AND "{c}" > 0' for c in ("open", "high", "low", "close", "adj_factor"))

BARS_SQL = f"""{CURRENT_BARS_SQL},
b0 AS (SELECT ts_code, date, open, high, low, "close" AS c, vol, amount, adj_factor AS f FROM cur WHERE {_FINITE}),
b AS (SELECT *, row_number() OVER w - 1 AS bar_no, c*f AS hc, open*f AS ho, high*f AS hh, low*f AS hl, lag(c) OVER w AS pc, lag(f) OVER w AS pf, lag(c*f) OVER w AS phc,
 CASE WHEN left(ts_code,2) IN ('60','00') THEN 'main' WHEN left(ts_code,2)='30' THEN 'chinext' WHEN left(ts_code,2)='68' THEN 'star' WHEN left(ts_code,2)='92' THEN 'bse' ELSE 'other' END AS board
 FROM b0 WINDOW w AS (PARTITION BY ts_code ORDER BY date))"""

_LIMITS = f"""{BARS_SQL},
l0 AS (SELECT *, pc*pf/f AS ref, (open=high AND high=low AND low=c) AS one,
 CASE WHEN board='main' OR (board='chinext' AND date < DATE '2020-08-24') THEN 0.1::DOUBLE WHEN board IN ('chinext','star') THEN 0.2::DOUBLE WHEN board='bse' THEN 0.3::DOUBLE END AS lim, round_even(c*100.0::DOUBLE, 0) AS cc FROM b),
l1 AS (SELECT *, floor(ref*(1+lim)*100.0::DOUBLE+0.5::DOUBLE+1e-6::DOUBLE) AS up_c, floor(ref*(1-lim)*100.0::DOUBLE+0.5::DOUBLE+1e-6::DOUBLE) AS down_c,
 CASE WHEN board='main' THEN floor(ref*1.05::DOUBLE*100.0::DOUBLE+0.5::DOUBLE+1e-6::DOUBLE) END AS up5_c, CASE WHEN board='main' THEN floor(ref*0.95::DOUBLE*100.0::DOUBLE+0.5::DOUBLE+1e-6::DOUBLE) END AS down5_c,
 (NOT bool_or(NOT one) OVER (PARTITION BY ts_code ORDER BY date)) OR bar_no < 60 AS new_stock FROM l0),
l2 AS (SELECT *, coalesce(cc=up_c, false) OR coalesce(cc=up5_c, false) OR coalesce(c/ref - 1 >= lim * __REACH__, false) AS up, coalesce(cc=down_c, false) OR coalesce(cc=down5_c, false) OR coalesce(c/ref - 1 <= lim * -__REACH__, false) AS down FROM l1),
l AS (SELECT *, coalesce(sum(up::INT) OVER (PARTITION BY ts_code ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS ups3 FROM l2)"""

LIMITS_SQL = _LIMITS.replace("__REACH__", "1e9::DOUBLE")
REACH = 0.3
REACH_SQL = _LIMITS.replace("__REACH__", f"{REACH}::DOUBLE")

EVENTS_SQL = f"""{CURRENT_EVENTS_SQL},
e AS (SELECT ts_code, signal_date, coalesce(CASE WHEN lower(replace(board,' ','')) IN ('主板','main','mainboard') THEN 'main' WHEN lower(replace(board,' ','')) IN ('创业板','創業板','chinext','gem') THEN 'chinext'
  WHEN lower(replace(board,' ','')) IN ('科创板','科創板','star','starmarket') THEN 'star' WHEN lower(replace(board,' ','')) IN ('北交所','bse','beijing') THEN 'bse' END,
  CASE WHEN left(ts_code,2) IN ('60','00') THEN 'main' WHEN left(ts_code,2)='30' THEN 'chinext' WHEN left(ts_code,2)='68' THEN 'star' WHEN left(ts_code,2)='92' THEN 'bse' ELSE 'other' END) AS board,
 coalesce(year, date_part('year', signal_date)::INT) AS year, drop_bucket, d1_direction, CASE WHEN NOT isnan(drop_pct) THEN drop_pct END AS drop_pct,
 CASE WHEN isfinite(ret_close_to_best_close_25) THEN ret_close_to_best_close_25 END AS ret, CASE WHEN isfinite(d1_return) THEN d1_return END AS ex, return_start_date, return_end_date FROM ev)"""
