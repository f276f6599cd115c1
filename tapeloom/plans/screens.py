"""Queries of the formula screener."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.plans.base import BARS_SQL, bars, q6, r6
from tapeloom.screener.columns import horizon_summary, screen, screen_ahead

CROSS = "M5:=MA(CLOSE,5);M20:=MA(CLOSE,20);XG:CROSS(M5,M20) AND VOL>REF(VOL,1);"
PULLBACK = """A:=HHV(HIGH,20); B:=COUNT(CLOSE>OPEN,10)>=6
AND CLOSE>MA(CLOSE,10); XG:B AND ABS(CLOSE/REF(A,1)-1)<0.03 AND BARSCOUNT(CLOSE)>60;"""


def screen_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which the 5-bar mean crosses the 20-bar mean upward on growing volume."""
    return screen(bars(spark, sf_dir), CROSS)


def screen_pullback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen(bars(spark, sf_dir), PULLBACK)


def screen_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their forward returns, latest first."""
    df = screen_ahead(bars(spark, sf_dir), CROSS)
    return df.orderBy(F.col("date").desc(), "ts_code").select("ts_code", "date", *[r6(f"ret_{h}") for h in (1, 3, 5, 10, 20)])


def screen_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return horizon_summary(screen_ahead(bars(spark, sf_dir), CROSS)).select("horizon", "samples", r6("average"))


QUERIES = {f.__name__: f for f in (screen_cross, screen_pullback, screen_returns, screen_summary)}

_W = "PARTITION BY ts_code ORDER BY date"
_MA = lambda n: f"CASE WHEN count(*) OVER ({_W} ROWS {n - 1} PRECEDING) = {n} THEN avg(c) OVER ({_W} ROWS {n - 1} PRECEDING) END"
_CROSS = f"""z0 AS (SELECT *, {_MA(5)} m5, {_MA(20)} m20, lag(vol) OVER ({_W}) pv FROM b), z1 AS (SELECT *, lag(m5) OVER ({_W}) p5, lag(m20) OVER ({_W}) p20 FROM z0),
hit AS (SELECT ts_code, date, 1.0::DOUBLE AS value FROM z1 WHERE m5 > m20 AND p5 <= p20 AND vol > pv)"""
_AHEAD = f"fw AS (SELECT ts_code, date, {', '.join(f'lead(c, {h}) OVER ({_W})/c - 1 AS r{h}' for h in (1, 3, 5, 10, 20))} FROM b), hr AS (SELECT hit.ts_code, hit.date, r1, r3, r5, r10, r20 FROM hit JOIN fw USING (ts_code, date))"

ORACLE = {
    "screen_cross": f"WITH {BARS_SQL}, {_CROSS} SELECT ts_code, date, value FROM hit",
    "screen_pullback": f"""WITH {BARS_SQL}, z0 AS (SELECT *, max(high) OVER ({_W} ROWS 19 PRECEDING) a, sum((c > open)::INT) OVER ({_W} ROWS 9 PRECEDING) k, {_MA(10)} m10, count(c) OVER ({_W}) n FROM b), z1 AS (SELECT *, lag(a) OVER ({_W}) pa FROM z0)
SELECT ts_code, date, 1.0::DOUBLE AS value FROM z1 WHERE k >= 6 AND c > m10 AND abs(c/pa - 1) < 0.03::DOUBLE AND n > 60""",
    "screen_returns": f"WITH {BARS_SQL}, {_CROSS}, {_AHEAD} SELECT ts_code, date, {', '.join(q6(f'r{h}', f'ret_{h}') for h in (1, 3, 5, 10, 20))} FROM hr",
    "screen_summary": f"WITH {BARS_SQL}, {_CROSS}, {_AHEAD} " + " UNION ALL ".join(f"SELECT {h} AS horizon, count(r{h}) AS samples, {q6(f'avg(r{h})', 'average')} FROM hr" for h in (1, 3, 5, 10, 20)),
}
