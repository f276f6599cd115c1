"""Queries over bars: leaders, resampling, adjustment, limits, returns and event studies."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.boards import board_strict, limit_share_by_code
from tapeloom.functions.regimes import regime, regime_number, regime_of_span
from tapeloom.operators import adjust, bars as B, events as E, limits, ranking, returns
from tapeloom.operators.small import checked_broadcast
from tapeloom.plans.base import BARS_SQL, LIMITS_SQL, REACH, REACH_SQL, bars, q6, r6
from tapeloom.sources.tables import table

START, END = "2023-01-01", "2025-12-31"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def amount_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.amount_leaders(bars(spark, sf_dir), "2018-01-01", "2026-12-31", 20, 50)
    names = table(spark, sf_dir, "stock_basic_tdx").groupBy("ts_code").agg(F.min(F.trim("name")).alias("name"))
    df = best.join(checked_broadcast(names), "ts_code", "left")
    yi = [(F.floor(F.col(c) / F.lit(1e8) * F.lit(1e4) + F.lit(0.5)).cast("double") / F.lit(1e4)).alias(f"{c}_yi") for c in ("total_amount", "average_daily_amount", "max_daily_amount")]
    return df.select("rank", "ts_code", "name", "trading_days", "market_days", r6("coverage"), *yi)


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.resample(bars(spark, sf_dir), "W").drop("amount")


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.resample(bars(spark, sf_dir), "M").drop("amount")


def weekly_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(B.moving_averages(B.resample(bars(spark, sf_dir), "W")).select("ts_code", "date", "close", "ma5", "ma10", "ma20"), "ma5", "ma10", "ma20")


def adjusted_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.forward_adjusted_view(bars(spark, sf_dir)).select("ts_code", "date", "open", "high", "low", "close")


def placed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adjust.place_actions(table(spark, sf_dir, "xdxr"), bars(spark, sf_dir))
    return df.select("ts_code", "ex_date", "trade_date", r6("prev_close"), r6("ref_price"), r6("ratio"), "status")


def built_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    df = adjust.factors(b.select("ts_code", "date", "close"), adjust.place_actions(table(spark, sf_dir, "xdxr"), b))
    return df.select("ts_code", "date", r6("built_factor"))


def board_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.board_labels(bars(spark, sf_dir)).filter("board_type <> ''").select("ts_code", "date", "board_type", "up_c", "down_c")


def limit_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = limits.limit_features(bars(spark, sf_dir))
    return df.groupBy("board", F.year("date").alias("year")).agg(F.count("*").alias("bars"), F.count_if("any_limit_up").alias("ups"), F.count_if("any_limit_down").alias("downs"), F.count_if("new_stock").alias("new_bars"), F.sum("limit_ups_prev3").alias("ups_before"))


def strict_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("ts_code")
    return bars(spark, sf_dir).groupBy("ts_code").agg(F.count("*").alias("bars")).select("ts_code", board_strict(code).alias("board"), limit_share_by_code(code).alias("search_limit"))


def market_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(returns.market_index(B.backward_adjusted(bars(spark, sf_dir))), "close_idx", "open_idx")


def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.backward_adjusted(limits.limit_features(bars(spark, sf_dir)))
    df = returns.forward_returns(b, returns.market_index(b), (1, 5, 20))
    return df.groupBy("date", "horizon").agg(F.count("ret_close").alias("n"), F.count_if("entry_blocked").alias("blocked"), *[r6(F.avg(c), c) for c in ("ret_close", "ex_close", "ret_open", "ex_open")])


def best_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = returns.best_close_ahead(B.backward_adjusted(bars(spark, sf_dir)))
    return df.filter("best_close is not null").select("ts_code", "date", "best_date", "end_date", r6("best_return"))


def month_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = returns.monthly_momentum(B.backward_adjusted(bars(spark, sf_dir)))
    return df.select("ts_code", "date", r6("prev_month_return"), r6("current_month_return"))


def one_price_pullbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = E.one_price_pullbacks(bars(spark, sf_dir), "2018-01-01", 5.0, 3.0, REACH)
    return _rounded(df.drop("st_like", "board_close", "d1_close", "close", "prior_63_low"), "d1_return", "drop_pct", "signal_day_pct", "current_month_return", "prev_month_return")


def pullback_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the one-price pullbacks; only the series of instruments that have one are walked."""
    b = bars(spark, sf_dir)
    found = E.one_price_pullbacks(b, "2018-01-01", 5.0, 3.0, REACH).select("ts_code", F.col("board_date").alias("date"), "gap_bars")
    series = B.backward_adjusted(b).join(found.select("ts_code").distinct(), "ts_code", "left_semi").join(found, ["ts_code", "date"], "left")
    df = returns.lowest_bar_path(series, "gap_bars")
    return df.select("ts_code", "date", "entry", "entry_date", "exit_date", "horizon_date", r6("path_return"))


def strong_day_pullbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = E.strong_day_pullbacks(bars(spark, sf_dir), "2018-01-01")
    return _rounded(df.drop("strong_close", "signal_close"), "strong_return", "signal_day_pct", "pullback_pct", "center_ratio", "high_ratio", "low_ratio")


def halvings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = E.halvings(bars(spark, sf_dir), 63, 25, 126)
    return _rounded(df.drop("peak_close", "signal_close"), "drawdown", "terminal_return", "best_return")


def halvings_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against the high of 504 bars."""
    return _rounded(E.halvings(bars(spark, sf_dir)).drop("peak_close", "signal_close"), "drawdown", "terminal_return", "best_return")


def one_price_pullbacks_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the published caps and boards at the limit to the cent."""
    df = E.one_price_pullbacks(bars(spark, sf_dir), "2018-01-01")
    return _rounded(df.drop("st_like", "board_close", "d1_close", "close", "prior_63_low"), "d1_return", "drop_pct", "signal_day_pct", "current_month_return", "prev_month_return")


def holding_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ranking.holding_returns(B.backward_adjusted(bars(spark, sf_dir)), START, END)
    return df.select("ts_code", "first_date", "last_date", "days", r6("total_return"), r6("annualized"), "high_date", "low_date", "bars")


def return_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ranking.panel(ranking.holding_returns(B.backward_adjusted(bars(spark, sf_dir)), START, END), "2023-01-10")
    return _rounded(df, "mean", "median", "up_share", "median_annualized")


def return_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.deciles(ranking.holding_returns(B.backward_adjusted(bars(spark, sf_dir)), START, END), "total_return"), "value")


def endpoint_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ranking.endpoint_returns(B.backward_adjusted(bars(spark, sf_dir)), "2024-01-03", "2025-12-03", 20)
    return df.select("rank", "ts_code", r6("total_return"))


def run_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ranking.run_ups(B.backward_adjusted(bars(spark, sf_dir)), "2024-09-23", "2026-06-30")
    return df.select("ts_code", r6("run_up"), "low_date", "high_date")


def run_up_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments, median rise and shares above two and five times by strict board."""
    df = ranking.run_ups(B.backward_adjusted(bars(spark, sf_dir)), "2024-09-23", "2026-06-30").withColumn("board", board_strict(F.col("ts_code")))
    return df.groupBy("board").agg(F.count("*").alias("n"), r6(F.median("run_up"), "median"), r6(F.avg((F.col("run_up") > 2.0 + 1e-8).cast("double")), "over_200"), r6(F.avg((F.col("run_up") > 5.0).cast("double")), "over_500"))


def index_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ranking.drawdowns(returns.market_index(B.backward_adjusted(bars(spark, sf_dir))), "date", "close_idx")
    return df.select("first_day", "last_day", r6("total_return"), r6("annualized"), r6("max_drawdown"), "max_drawdown_day")


def regime_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by regime interval, and how many 20-session spans stay in one regime."""
    days = bars(spark, sf_dir).select("date").distinct()
    df = days.select("date", regime_number(F.col("date")).alias("interval"), regime(F.col("date")).alias("regime"), regime_of_span(F.col("date"), F.date_add("date", 28)).alias("span"))
    return df.groupBy("interval", "regime").agg(F.count("*").alias("days"), F.count_if(F.col("span") == "cross").alias("crossing"))


def bars_around_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars from 3 ahead of to 3 behind the day of each instrument's highest amount."""
    b = bars(spark, sf_dir)
    top = b.filter("amount > 0").groupBy("ts_code").agg(F.max(F.struct("amount", (-F.unix_date("date")).alias("d"))).alias("m")).select("ts_code", F.date_from_unix_date(-F.col("m.d")).alias("date"))
    return B.around(b, top, 3, 3).select("ts_code", "target_date", "date", "offset", "close")


def weeks_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.overlapping(B.resample(bars(spark, sf_dir), "W"), "2024-02-07", "2024-03-01", "W").select("ts_code", "date", "open", "high", "low", "close")


def latest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last date of the bar table; answered from file statistics where aggregate pushdown is on."""
    return table(spark, sf_dir, "stock_daily").agg(F.max("date").alias("last_date"))


def relative_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the last two years and 30 days per exchange."""
    df = bars(spark, sf_dir)
    last = df.agg(F.max("date").alias("end")).first()["end"]  # one value
    near = df.filter(F.col("date") >= F.date_sub(F.add_months(F.lit(last), -24), 30))
    return near.groupBy(F.substring("ts_code", 8, 2).alias("exchange")).agg(F.count("*").alias("bars"), F.min("date").alias("first_date"))


def limit_downs_after_strong_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong-day signals with how many of the three bars behind them closed at the lower limit."""
    b = bars(spark, sf_dir)
    starts = E.strong_day_pullbacks(b, "2018-01-01").select("ts_code", F.col("signal_date").alias("date"))
    return E.limit_downs_after(b, starts).select("ts_code", "date", F.size("limit_downs").alias("limit_downs"))


QUERIES = {f.__name__: f for f in (
    limit_downs_after_strong_days, amount_leaders, weekly_bars, monthly_bars, weekly_averages, adjusted_view, placed_actions, built_factors, board_labels, limit_days, strict_boards, market_index, forward_returns, best_closes, month_returns,
    one_price_pullbacks, pullback_paths, strong_day_pullbacks, halvings, halvings_published, one_price_pullbacks_published, holding_returns, return_panel, return_deciles, endpoint_leaders, run_ups, run_up_boards, index_drawdown, regime_days,
    bars_around_events, weeks_overlapping, latest_dates, relative_start,
)}

_W = "(PARTITION BY ts_code ORDER BY date)"
_WEEK = "CAST(date + CAST((12 - isodow(date)) % 7 AS INT) AS DATE)"
_WEEKLY = f"wk AS (SELECT ts_code, {_WEEK} AS date, arg_min(open, date) open, max(high) high, min(low) low, arg_max(c, date) c, sum(coalesce(vol,0))::BIGINT vol, count(*) bars FROM b GROUP BY 1, 2)"
_IDX = f"""mi0 AS (SELECT date, avg(hc/phc - 1) r, avg(ho/phc - 1) nt, count(hc/phc - 1) n FROM b GROUP BY 1),
mi1 AS (SELECT date, n, nt, exp(sum(ln(1+coalesce(r,0))) OVER (ORDER BY date)) ci FROM mi0),
mi AS (SELECT date, n, ci, coalesce(lag(ci) OVER (ORDER BY date), 1)*(1+coalesce(nt,0)) oi FROM mi1)"""
_ACTS = f"""x AS (SELECT DISTINCT ts_code, ex_date, coalesce(cash_per10,0) cash, coalesce(rights_price,0) rp, coalesce(bonus_per10,0) bon, coalesce(rights_per10,0) rig FROM xdxr WHERE ts_code IS NOT NULL AND ex_date IS NOT NULL),
xa AS (SELECT x.*, (SELECT min(date) FROM b0 WHERE b0.ts_code = x.ts_code AND date >= ex_date) AS trade, (SELECT arg_max(c, date) FROM b0 WHERE b0.ts_code = x.ts_code AND date < ex_date AND date < coalesce((SELECT min(date) FROM b0 q WHERE q.ts_code = x.ts_code AND q.date >= ex_date), DATE '9999-01-01')) AS prev FROM x),
xn AS (SELECT *, row_number() OVER (PARTITION BY ts_code, trade, prev ORDER BY ex_date, cash, rp, bon, rig) k FROM xa),
wa AS (SELECT *, prev AS cc, (prev - cash/10 + rp*rig/10)/(1 + bon/10 + rig/10) AS ref FROM xn WHERE k = 1
 UNION ALL SELECT n.*, CASE WHEN w.ref > 0 AND w.cc > 0 THEN w.ref ELSE w.cc END, ((CASE WHEN w.ref > 0 AND w.cc > 0 THEN w.ref ELSE w.cc END) - n.cash/10 + n.rp*n.rig/10)/(1 + n.bon/10 + n.rig/10)
 FROM wa w JOIN xn n ON n.ts_code = w.ts_code AND n.trade IS NOT DISTINCT FROM w.trade AND n.prev IS NOT DISTINCT FROM w.prev AND n.k = w.k + 1),
ac AS (SELECT *, CASE WHEN prev IS NULL THEN 'before_listing' WHEN trade IS NULL THEN 'after_data_end' WHEN ref <= 0 OR cc <= 0 THEN 'invalid' ELSE 'applied' END AS status FROM wa)"""
_MONTHS = """mo AS (SELECT ts_code, date_trunc('month', date) m, arg_max(hc, date) last FROM b GROUP BY 1, 2),
mp AS (SELECT *, lag(last,1) OVER (PARTITION BY ts_code ORDER BY m) base, lag(last,2) OVER (PARTITION BY ts_code ORDER BY m) base2 FROM mo)"""
_ONE = f"""{REACH_SQL}, {_MONTHS},
o0 AS (SELECT l.*, hc/base - 1 AS cur_m, base/base2 - 1 AS prev_m, hc/phc - 1 AS pct,
 (round_even(high*100.0::DOUBLE,0)-round_even(low*100.0::DOUBLE,0) <= 1 AND cc-round_even(open*100.0::DOUBLE,0) <= 1 AND cc-round_even(low*100.0::DOUBLE,0) <= 1 AND up AND NOT new_stock AND ups3 = 0) AS d0,
 CASE WHEN count(*) OVER (PARTITION BY l.ts_code ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) = 63 THEN min(hl) OVER (PARTITION BY l.ts_code ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) END AS low63
 FROM l JOIN mp ON mp.ts_code = l.ts_code AND mp.m = date_trunc('month', l.date)),
o1 AS (SELECT *, lag(d0,1) OVER w d0_1, lag(d0,2) OVER w d0_2, lag(hc,1) OVER w hc1, lag(hc,2) OVER w hc2, lag(low63,1) OVER w low1, lag(low63,2) OVER w low2, lag(date,1) OVER w dt1, lag(date,2) OVER w dt2, lag(up,1) OVER w up1 FROM o0 WINDOW w AS {_W}),
o2 AS (SELECT *, coalesce(d0_1 AND hc < hc1, false) s1, coalesce(d0_2 AND NOT (hc1 < hc2) AND hc < hc2, false) s2 FROM o1),
op AS (SELECT ts_code, date AS signal_date, CASE WHEN s1 THEN dt1 ELSE dt2 END AS board_date, CASE WHEN s1 THEN date ELSE dt1 END AS d1_date, CASE WHEN s1 THEN 1 ELSE 2 END AS gap_bars, board,
  CASE WHEN s1 THEN hc/hc1 - 1 ELSE hc1/hc2 - 1 END AS d1_return, CASE WHEN s1 THEN hc/hc1 - 1 ELSE hc/hc2 - 1 END AS drop_pct, pct AS signal_day_pct, CASE WHEN s1 THEN up ELSE up1 END AS d1_limit_up, cur_m, prev_m
 FROM o2 WHERE ((s1 AND coalesce(hc1 <= 3.0::DOUBLE*low1, false)) OR (s2 AND coalesce(hc2 <= 3.0::DOUBLE*low2, false))) AND cur_m <= 5 AND prev_m <= 5 AND date >= DATE '2018-01-01')"""
_ONE_PUBLISHED = _ONE.replace(REACH_SQL, LIMITS_SQL).replace("3.0::DOUBLE*low", "1.2::DOUBLE*low").replace("cur_m <= 5 AND prev_m <= 5", "cur_m <= 0.5::DOUBLE AND prev_m <= 0.5::DOUBLE")
_HOLD = f"""h0 AS (SELECT ts_code, min(date) a, max(date) z, arg_min(hc, date) ca, arg_max(hc, date) cz, max(struct_pack(v := hh, d := -(date - DATE '1970-01-01'))) hi, min(struct_pack(v := hl, d := (date - DATE '1970-01-01'))) lo, count(*) n
 FROM b WHERE date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1),
h AS (SELECT ts_code, a AS first_date, z AS last_date, z - a AS days, cz/ca - 1 AS ret, CASE WHEN z - a >= 365 THEN pow(cz/ca, 365.25::DOUBLE/(z - a)) - 1 END AS ann, DATE '1970-01-01' + CAST(-hi.d AS INT) AS high_date, DATE '1970-01-01' + CAST(lo.d AS INT) AS low_date, n AS bars FROM h0)"""
_RUN = f"""r0 AS (SELECT *, min(hl) OVER (PARTITION BY ts_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) lb FROM b WHERE date BETWEEN DATE '2024-09-23' AND DATE '2026-06-30'),
r1 AS (SELECT *, last_value(CASE WHEN hl <= coalesce(lb, hl) THEN date END IGNORE NULLS) OVER (PARTITION BY ts_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ld FROM r0),
r AS (SELECT ts_code, hh/lb - 1 AS up, ld AS low_date, date AS high_date FROM r1 WHERE lb IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY hh/lb - 1 DESC, date) = 1)"""
_STRONG = f"""z0 AS (SELECT *, coalesce(c/pc > 1.09::DOUBLE, false) strong FROM b), z1 AS (SELECT *, last_value(CASE WHEN strong THEN bar_no END IGNORE NULLS) OVER (PARTITION BY ts_code ORDER BY date ROWS UNBOUNDED PRECEDING) run FROM z0),
z2 AS (SELECT z1.*, s.c sc, s.pc sp, s.date sd, z1.bar_no - run AS t FROM z1 JOIN z0 s ON s.ts_code = z1.ts_code AND s.bar_no = run WHERE z1.bar_no - run BETWEEN 1 AND 7),
z3 AS (SELECT *, max(high) OVER w tp, min(low) OVER w bt, avg(c) OVER w mn, min(c) OVER w ls, sum((c/pc <= 0.95::DOUBLE OR c/open <= 0.95::DOUBLE)::INT) OVER w bad FROM z2 WINDOW w AS (PARTITION BY ts_code, run ORDER BY date ROWS UNBOUNDED PRECEDING)),
z4 AS (SELECT * FROM z3 WHERE tp <= sc*1.08::DOUBLE AND bt >= sp + (sc - sp)*0.5::DOUBLE AND mn >= sc*0.98::DOUBLE AND ls >= sc*0.96::DOUBLE AND c >= sc*0.97::DOUBLE AND bad = 0 AND date >= DATE '2018-01-01')"""
_STRICT = """CASE WHEN right(ts_code,2)='SH' AND left(ts_code,3) IN ('688','689') THEN 'star' WHEN right(ts_code,2)='SZ' AND left(ts_code,3) IN ('300','301','302') THEN 'chinext'
 WHEN right(ts_code,2)='BJ' AND left(ts_code,2)='92' THEN 'bse' WHEN (right(ts_code,2)='SH' AND left(ts_code,3) BETWEEN '600' AND '605') OR (right(ts_code,2)='SZ' AND left(ts_code,3) BETWEEN '000' AND '003') THEN 'main' END"""
_YI = lambda x, n: f"floor(({x})/1e8::DOUBLE*1e4::DOUBLE+0.5::DOUBLE)/1e4::DOUBLE AS {n}"

_FJ = f"""hs AS (SELECT unnest([1,5,20]) horizon),
fw AS (SELECT ts_code, date, hc, lead(ho) OVER w no, lead(date) OVER w nd, coalesce(lead(one AND up) OVER w, false) blocked, lead(hc,1) OVER w c1, lead(date,1) OVER w d1, lead(hc,5) OVER w c5, lead(date,5) OVER w d5, lead(hc,20) OVER w c20, lead(date,20) OVER w d20 FROM l WINDOW w AS {_W}),
fh AS (SELECT fw.*, horizon, CASE horizon WHEN 1 THEN c1 WHEN 5 THEN c5 ELSE c20 END xc, CASE horizon WHEN 1 THEN d1 WHEN 5 THEN d5 ELSE d20 END xd FROM fw, hs),
fj AS (SELECT fh.*, m0.ci m0, m1.ci m1, mo.oi mo FROM fh LEFT JOIN mi m0 ON m0.date = fh.date LEFT JOIN mi m1 ON m1.date = xd LEFT JOIN mi mo ON mo.date = nd)"""

_HALVES = f"""v0 AS (SELECT *, CASE WHEN count(*) OVER p = 63 THEN max(struct_pack(v := hc, n := -bar_no, d := date)) OVER p END pk, CASE WHEN count(*) OVER q = __LONG__ THEN max(hc) OVER q END lh, CASE WHEN count(*) OVER a = 25 THEN max(struct_pack(v := hh, n := -bar_no, d := date)) OVER a END bs,
 lead(hc, 25) OVER (PARTITION BY ts_code ORDER BY date) ec, lead(date, 25) OVER (PARTITION BY ts_code ORDER BY date) ed FROM b
 WINDOW p AS (PARTITION BY ts_code ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY ts_code ORDER BY date ROWS BETWEEN __LONG__ PRECEDING AND 1 PRECEDING), a AS (PARTITION BY ts_code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 25 FOLLOWING)),
v1 AS (SELECT *, hc/pk.v - 1 AS dd, lag(hc/pk.v - 1) OVER (PARTITION BY ts_code ORDER BY date) ld FROM v0), v2 AS (SELECT * FROM v1 WHERE dd < -0.5::DOUBLE AND (ld IS NULL OR ld >= -0.5::DOUBLE)),
th AS (SELECT ts_code, min(bar_no) k FROM v2 GROUP BY 1 UNION ALL SELECT v2.ts_code, min(v2.bar_no) FROM th JOIN v2 ON v2.ts_code = th.ts_code AND v2.bar_no >= th.k + 63 GROUP BY v2.ts_code)"""
_HALVINGS = f"""SELECT v2.ts_code, v2.date AS signal_date, v2.pk.d AS peak_date, (v2.bar_no + v2.pk.n)::INT AS peak_to_signal_bars, {q6('dd', 'drawdown')}, v2.ed AS end_date, {q6('v2.ec/v2.hc - 1', 'terminal_return')}, v2.bs.d AS best_date, {q6('v2.bs.v/v2.hc - 1', 'best_return')},
 coalesce(v2.pk.v > o.lh, false) AS peak_is_long_high, CASE WHEN v2.bs IS NOT NULL THEN 'complete' ELSE 'no_complete_window' END AS status
FROM v2 JOIN th ON th.ts_code = v2.ts_code AND th.k = v2.bar_no LEFT JOIN v0 o ON o.ts_code = v2.ts_code AND o.date = v2.pk.d"""

ORACLE = {
    "amount_leaders": f"""WITH {BARS_SQL}, q AS (SELECT * FROM b WHERE date BETWEEN DATE '2018-01-01' AND DATE '2026-12-31' AND amount >= 0), m AS (SELECT count(DISTINCT date) md FROM q),
p AS (SELECT ts_code, count(DISTINCT date) td, sum(amount) s, avg(amount) a, max(amount) x FROM q GROUP BY 1 HAVING count(DISTINCT date) >= 20 ORDER BY a DESC, td DESC, ts_code LIMIT 50)
SELECT (row_number() OVER (ORDER BY a DESC, td DESC, p.ts_code))::INT AS rank, p.ts_code, n.name, td AS trading_days, md AS market_days, {q6('td/md', 'coverage')}, {_YI('s', 'total_amount_yi')}, {_YI('a', 'average_daily_amount_yi')}, {_YI('x', 'max_daily_amount_yi')}
FROM p CROSS JOIN m LEFT JOIN (SELECT ts_code, min(trim(name)) AS name FROM stock_basic_tdx GROUP BY 1) n ON n.ts_code = p.ts_code""",
    "weekly_bars": f'WITH {BARS_SQL}, {_WEEKLY} SELECT ts_code, date, open, high, low, c AS "close", vol, bars FROM wk',
    "monthly_bars": f'WITH {BARS_SQL} SELECT ts_code, last_day(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(c, date) AS "close", sum(coalesce(vol,0))::BIGINT AS vol, count(*) AS bars FROM b GROUP BY ts_code, last_day(date)',
    "weekly_averages": f"""WITH {BARS_SQL}, {_WEEKLY} SELECT ts_code, date, c AS "close", {', '.join(q6(f'CASE WHEN count(*) OVER (PARTITION BY ts_code ORDER BY date ROWS {n-1} PRECEDING) = {n} THEN avg(c) OVER (PARTITION BY ts_code ORDER BY date ROWS {n-1} PRECEDING) END', f'ma{n}') for n in (5, 10, 20))} FROM wk""",
    "adjusted_view": f"""WITH {BARS_SQL}, z AS (SELECT *, last_value(f) OVER (PARTITION BY ts_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) lf FROM b)
SELECT ts_code, date, round_even(open*f/lf*1e4::DOUBLE,0)/1e4::DOUBLE AS open, round_even(high*f/lf*1e4::DOUBLE,0)/1e4::DOUBLE AS high, round_even(low*f/lf*1e4::DOUBLE,0)/1e4::DOUBLE AS low, round_even(c*f/lf*1e4::DOUBLE,0)/1e4::DOUBLE AS "close" FROM z""",
    "placed_actions": f"""WITH RECURSIVE {BARS_SQL}, {_ACTS} SELECT ts_code, ex_date, CASE WHEN status IN ('applied','invalid') THEN trade END AS trade_date, {q6("CASE WHEN status IN ('applied','invalid') THEN cc END", 'prev_close')},
 {q6("CASE WHEN status IN ('applied','invalid') THEN ref END", 'ref_price')}, {q6("CASE WHEN status = 'applied' THEN cc/ref END", 'ratio')}, status FROM ac""",
    "built_factors": f"""WITH RECURSIVE {BARS_SQL}, {_ACTS}, st AS (SELECT ts_code, trade AS date, product(cc/ref) step FROM ac WHERE status = 'applied' GROUP BY 1, 2)
SELECT ts_code, date, {q6("exp(sum(ln(coalesce(step, 1))) OVER (PARTITION BY ts_code ORDER BY date))", 'built_factor')} FROM b LEFT JOIN st USING (ts_code, date)""",
    "board_labels": f"""WITH {LIMITS_SQL}, z AS (SELECT *, CASE WHEN down AND one THEN 'one_word_down' WHEN up AND one THEN 'one_word_up' WHEN down THEN 'limit_down' WHEN up THEN 'limit_up' ELSE '' END AS board_type FROM l)
SELECT ts_code, date, board_type, up_c, down_c FROM z WHERE board_type <> ''""",
    "limit_days": f"WITH {LIMITS_SQL} SELECT board, date_part('year', date)::INT AS year, count(*) AS bars, sum(up::INT)::BIGINT AS ups, sum(down::INT)::BIGINT AS downs, sum(new_stock::INT)::BIGINT AS new_bars, sum(ups3)::BIGINT AS ups_before FROM l GROUP BY 1, 2",
    "strict_boards": f"WITH {BARS_SQL} SELECT DISTINCT ts_code, {_STRICT} AS board, CASE WHEN left(ts_code,3) IN ('300','301','688','689') THEN 0.2::DOUBLE WHEN left(ts_code,1) IN ('4','8') THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS search_limit FROM b",
    "market_index": f"WITH {BARS_SQL}, {_IDX} SELECT date, {q6('ci', 'close_idx')}, {q6('oi', 'open_idx')}, n FROM mi",
    "forward_returns": f"""WITH {LIMITS_SQL}, {_IDX}, {_FJ}
SELECT date, horizon, count(xc/hc - 1) AS n, sum(blocked::INT)::BIGINT AS blocked, {q6('avg(xc/hc - 1)', 'ret_close')}, {q6('avg(xc/hc - 1 - (m1/m0 - 1))', 'ex_close')}, {q6('avg(xc/no - 1)', 'ret_open')}, {q6('avg(xc/no - 1 - (m1/mo - 1))', 'ex_open')} FROM fj GROUP BY 1, 2""",
    "best_closes": f"""WITH {BARS_SQL}, z AS (SELECT *, count(*) OVER w n, max(struct_pack(v := hc, d := -(date - DATE '1970-01-01'))) OVER w m, lead(date, 25) OVER {_W} e FROM b WINDOW w AS (PARTITION BY ts_code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 25 FOLLOWING))
SELECT ts_code, date, DATE '1970-01-01' + CAST(-m.d AS INT) AS best_date, e AS end_date, {q6('m.v/hc - 1', 'best_return')} FROM z WHERE n = 25""",
    "month_returns": f"WITH {BARS_SQL}, {_MONTHS} SELECT b.ts_code, b.date, {q6('base/base2 - 1', 'prev_month_return')}, {q6('hc/base - 1', 'current_month_return')} FROM b JOIN mp ON mp.ts_code = b.ts_code AND mp.m = date_trunc('month', b.date)",
    "one_price_pullbacks": f"""WITH {_ONE} SELECT ts_code, signal_date, board_date, d1_date, gap_bars, board, d1_limit_up, {q6('d1_return')}, {q6('drop_pct')}, {q6('signal_day_pct')}, {q6('cur_m', 'current_month_return')}, {q6('prev_m', 'prev_month_return')},
 CASE WHEN d1_return < 0 THEN 'down' WHEN d1_return > 0 THEN 'up' ELSE 'flat' END AS d1_direction, date_part('year', signal_date)::INT AS year FROM op""",
    "one_price_pullbacks_published": f"""WITH {_ONE_PUBLISHED} SELECT ts_code, signal_date, board_date, d1_date, gap_bars, board, d1_limit_up, {q6('d1_return')}, {q6('drop_pct')}, {q6('signal_day_pct')}, {q6('cur_m', 'current_month_return')}, {q6('prev_m', 'prev_month_return')},
 CASE WHEN d1_return < 0 THEN 'down' WHEN d1_return > 0 THEN 'up' ELSE 'flat' END AS d1_direction, date_part('year', signal_date)::INT AS year FROM op""",
    "pullback_paths": f"""WITH {_ONE}, s AS (SELECT op.ts_code, op.board_date, gap_bars, b.bar_no k FROM op JOIN b ON b.ts_code = op.ts_code AND b.date = op.board_date),
t3 AS (SELECT s.*, arg_min(b.bar_no - k, struct_pack(v := b.hl, n := b.bar_no)) entry, count(*) n3 FROM s JOIN b ON b.ts_code = s.ts_code AND b.bar_no BETWEEN k+1 AND k+3 GROUP BY ALL),
t4 AS (SELECT t3.ts_code, board_date, entry, max(CASE WHEN b.bar_no = k+entry THEN b.date END) entry_date, max(CASE WHEN b.bar_no = k+entry THEN b.hc END) ec, max(CASE WHEN b.bar_no = k+entry+25 THEN b.date END) horizon_date,
  max(CASE WHEN b.bar_no > k+entry THEN b.hc END) xc, arg_max(CASE WHEN b.bar_no > k+entry THEN b.date END, CASE WHEN b.bar_no > k+entry THEN struct_pack(v := b.hc, n := -b.bar_no) END) exit_date
 FROM t3 JOIN b ON b.ts_code = t3.ts_code AND b.bar_no BETWEEN k+entry AND k+entry+25 WHERE n3 = 3 AND entry >= gap_bars GROUP BY ALL)
SELECT ts_code, board_date AS date, entry::INT AS entry, entry_date, exit_date, horizon_date, {q6('xc/ec - 1', 'path_return')} FROM t4 WHERE horizon_date IS NOT NULL""",
    "strong_day_pullbacks": f"""WITH {BARS_SQL}, {_STRONG}
SELECT ts_code, date AS signal_date, sd AS strong_date, t::INT AS t, {q6('sc/sp - 1', 'strong_return')}, {q6('c*f/(pc*pf) - 1', 'signal_day_pct')}, {q6('c/sc - 1', 'pullback_pct')}, {q6('mn/sc - 1', 'center_ratio')}, {q6('tp/sc - 1', 'high_ratio')}, {q6('bt/sc - 1', 'low_ratio')},
 CASE WHEN c*f/(pc*pf) - 1 < 0 THEN 'down' WHEN c*f/(pc*pf) - 1 > 0 THEN 'up' ELSE 'flat' END AS signal_direction, date_part('year', date)::INT AS year FROM z4""",
    "limit_downs_after_strong_days": f"""WITH {LIMITS_SQL}, {_STRONG}, d AS (SELECT ts_code, date, coalesce(lead(down,1) OVER w, false)::INT + coalesce(lead(down,2) OVER w, false)::INT + coalesce(lead(down,3) OVER w, false)::INT AS k FROM l WINDOW w AS (PARTITION BY ts_code ORDER BY date))
SELECT d.ts_code, d.date, k AS limit_downs FROM d JOIN z4 ON z4.ts_code = d.ts_code AND z4.date = d.date""",
    "halvings": f"""WITH RECURSIVE {BARS_SQL},
{_HALVES.replace('__LONG__', '126')}
{_HALVINGS}""",
    "halvings_published": f"""WITH RECURSIVE {BARS_SQL},
{_HALVES.replace('__LONG__', '504')}
{_HALVINGS}""",
    "holding_returns": f"WITH {BARS_SQL}, {_HOLD} SELECT ts_code, first_date, last_date, days::INT AS days, {q6('ret', 'total_return')}, {q6('ann', 'annualized')}, high_date, low_date, bars FROM h",
    "return_panel": f"""WITH {BARS_SQL}, {_HOLD}, g AS (SELECT 'all' g, ret, ann FROM h UNION ALL SELECT CASE WHEN first_date <= DATE '2023-01-10' THEN 'full_period' ELSE 'later' END, ret, ann FROM h UNION ALL SELECT 'a_year_or_more', ret, ann FROM h WHERE ann IS NOT NULL)
SELECT g AS "group", count(*) AS n, {q6('avg(ret)', 'mean')}, {q6('median(ret)', 'median')}, {q6('avg((ret > 0)::INT)', 'up_share')}, {q6('median(ann)', 'median_annualized')} FROM g GROUP BY 1""",
    "return_deciles": f"WITH {BARS_SQL}, {_HOLD}, d AS (SELECT unnest([10,20,30,40,50,60,70,80,90]) decile, unnest((SELECT quantile_cont(ret, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) FROM h)) v) SELECT decile, {q6('v', 'value')} FROM d",
    "endpoint_leaders": f"""WITH {BARS_SQL}, p AS (SELECT ts_code, max(CASE WHEN date = DATE '2024-01-03' THEN hc END) a, max(CASE WHEN date = DATE '2025-12-03' THEN hc END) z FROM b GROUP BY 1),
t AS (SELECT ts_code, z/a - 1 AS r FROM p WHERE a > 0 AND z > 0 ORDER BY r DESC, ts_code LIMIT 20) SELECT (row_number() OVER (ORDER BY r DESC, ts_code))::INT AS rank, ts_code, {q6('r', 'total_return')} FROM t""",
    "run_ups": f"WITH {BARS_SQL}, {_RUN} SELECT ts_code, {q6('up', 'run_up')}, low_date, high_date FROM r",
    "run_up_boards": f"WITH {BARS_SQL}, {_RUN} SELECT {_STRICT} AS board, count(*) AS n, {q6('median(up)', 'median')}, {q6('avg((up > 2.0::DOUBLE + 1e-8::DOUBLE)::INT)', 'over_200')}, {q6('avg((up > 5)::INT)', 'over_500')} FROM r GROUP BY 1",
    "index_drawdown": f"""WITH {BARS_SQL}, {_IDX}, d AS (SELECT date, ci, ci/max(ci) OVER (ORDER BY date) - 1 dd FROM mi), o AS (SELECT min(date) a, max(date) z, arg_max(ci, date)/arg_min(ci, date) - 1 t, min(dd) w, arg_min(date, struct_pack(dd := dd, d := date)) wd FROM d)
SELECT a AS first_day, z AS last_day, {q6('t', 'total_return')}, {q6('CASE WHEN z > a THEN pow(1+t, 1/((z-a)/365.25::DOUBLE)) - 1 END', 'annualized')}, {q6('w', 'max_drawdown')}, wd AS max_drawdown_day FROM o""",
    "regime_days": f"""WITH {BARS_SQL}, d AS (SELECT DISTINCT date FROM b), n AS (SELECT date, (date >= DATE '2019-02-01')::INT + (date >= DATE '2021-11-30')::INT + (date >= DATE '2024-09-23')::INT + (date >= DATE '2026-07-01')::INT i,
 (date + 28 >= DATE '2019-02-01')::INT + (date + 28 >= DATE '2021-11-30')::INT + (date + 28 >= DATE '2024-09-23')::INT + (date + 28 >= DATE '2026-07-01')::INT j FROM d)
SELECT i AS "interval", CASE WHEN i % 2 = 1 THEN 'bull' ELSE 'bear' END AS regime, count(*) AS days, sum((i <> j)::INT)::BIGINT AS crossing FROM n GROUP BY 1, 2""",
    "bars_around_events": f"""WITH {BARS_SQL}, m AS (SELECT ts_code, date AS td, bar_no AS k FROM b WHERE amount > 0 QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY amount DESC, date) = 1)
SELECT b.ts_code, td AS target_date, b.date, (b.bar_no - k)::INT AS "offset", c AS "close" FROM b JOIN m ON m.ts_code = b.ts_code AND b.bar_no BETWEEN k - 3 AND k + 3""",
    "weeks_overlapping": f"""WITH {BARS_SQL}, {_WEEKLY} SELECT ts_code, date, open, high, low, c AS "close" FROM wk WHERE date - 6 <= DATE '2024-03-01' AND date >= DATE '2024-02-07'""",
    "latest_dates": "SELECT max(date) AS last_date FROM stock_daily",
    "relative_start": f"""WITH {BARS_SQL}, e AS (SELECT max(date) z FROM b) SELECT right(ts_code, 2) AS exchange, count(*) AS bars, min(date) AS first_date FROM b, e WHERE date >= CAST(z - INTERVAL 24 MONTH AS DATE) - 30 GROUP BY 1""",
}
