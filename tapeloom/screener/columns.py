"""Formulas as window expressions, and screening of whole histories."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.operators.bars import full_when, rows_between, series
from tapeloom.screener.formula import Node, chosen, parse


def _truth(x: Column) -> Column:
    return F.when(x, F.lit(1.0)).when(~x, F.lit(0.0))


def _is(x: Column) -> Column:
    return x != 0


def _window(bars: int):
    return rows_between(W.unboundedPreceding if bars <= 0 else 1 - bars, 0)


def column(node: Node, known: dict[str, str]) -> Column:
    """The expression of a node over an instrument's series; ``known`` has the columns of earlier names.

    A missing value stays missing through arithmetic and comparisons; MA and STD need all their bars; COUNT,
    SUM, HHV and LLV take those that there are, and all of them for 0 bars; a division by 0 is missing.
    """
    go = lambda a: column(a, known)
    if node.kind == "number":
        return F.lit(node.value)
    if node.kind == "field":
        return F.col(node.value).cast("double")
    if node.kind == "name":
        return F.col(known[node.value])
    if node.kind == "unary":
        return -go(node.args[0])
    if node.kind == "binary":
        a, b = map(go, node.args)
        ways = {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b),
            ">": lambda: _truth(a > b), "<": lambda: _truth(a < b), ">=": lambda: _truth(a >= b), "<=": lambda: _truth(a <= b), "=": lambda: _truth(a == b), "<>": lambda: _truth(a != b),
            "AND": lambda: _truth(_is(a) & _is(b)), "OR": lambda: _truth(_is(a) | _is(b)),
        }
        return ways[node.value]()
    name, args = node.value, node.args
    if name in ("MA", "STD", "REF", "COUNT", "SUM", "HHV", "LLV", "EVERY", "EXIST"):
        x, n = go(args[0]), int(args[1].value)
        if name == "REF":
            return F.lag(x, n).over(series())
        frame = _window(n)
        if name in ("MA", "STD"):
            agg = F.avg(x) if name == "MA" else F.stddev_samp(x)
            return F.when(F.count(x).over(frame) == n, full_when(n, agg, frame))
        if name in ("COUNT", "EVERY", "EXIST"):
            count = F.count_if(_is(x)).over(frame).cast("double")
            return {"COUNT": count, "EXIST": _truth(count > 0), "EVERY": _truth(count == F.count(F.lit(1)).over(frame))}[name]
        return {"SUM": F.sum, "HHV": F.max, "LLV": F.min}[name](x).over(frame)
    if name == "CROSS":
        a, b = map(go, args)
        return _truth((a > b) & (F.lag(a).over(series()) <= F.lag(b).over(series())))
    if name == "BARSCOUNT":
        return F.count(go(args[0])).over(_window(0)).cast("double")
    if name == "BARSLAST":
        at = F.row_number().over(series())
        return (at - F.last(F.when(_is(go(args[0])), at), ignorenulls=True).over(_window(0))).cast("double")
    if name == "IF":
        return F.when(_is(go(args[0])), go(args[1])).otherwise(go(args[2]))
    if name == "NOT":
        return _truth(~_is(go(args[0])))
    if name in ("MAX", "MIN"):
        a, b = map(go, args)
        return F.when(a.isNotNull() & b.isNotNull(), (F.greatest if name == "MAX" else F.least)(a, b))
    x = go(args[0])
    return {"ABS": lambda: F.abs(x), "LN": lambda: F.when(x > 0, F.ln(x)), "SQRT": lambda: F.when(x >= 0, F.sqrt(x))}[name]()


def evaluate(bars: DataFrame, formula: str) -> DataFrame:
    """``bars`` with ``value``, the deciding output at every bar.

    A step per statement, so that nested windows stand in separate steps over one partitioning and sort.
    """
    statements = parse(formula)
    known: dict[str, str] = {}
    df = bars
    for k, s in enumerate(statements):
        df = df.withColumn(f"_f{k}", column(s.node, known))
        known[s.name] = f"_f{k}"
    value = known[chosen(statements)]
    return df.withColumn("value", F.col(value).cast("double")).drop(*known.values(), *[f"_f{k}" for k in range(len(statements))])


def _is_hit() -> Column:
    v = F.col("value")
    return v.isNotNull() & ~F.isnan(v) & (v != 0) & (F.abs(v) != float("inf"))


def screen(bars: DataFrame, formula: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Hits (ts_code, date, value) from ``start`` to ``end``, without limits over the whole span: the value is
    neither missing nor 0 nor infinite.

    Bars before ``start`` warm the windows up and are filtered after them; bars behind ``end`` are not read.
    """
    if end is not None:
        bars = bars.filter(F.col("date") <= F.lit(end).cast("date"))
    hits = evaluate(bars, formula)
    if start is not None:
        hits = hits.filter(F.col("date") >= F.lit(start).cast("date"))
    return hits.filter(_is_hit()).select("ts_code", "date", "value")


def _ahead(horizons: Sequence[int]) -> list[Column]:
    return [(F.lead("close", h).over(series()) / F.col("close") - 1).alias(f"ret_{h}") for h in horizons]


def screen_ahead(bars: DataFrame, formula: str, horizons: Sequence[int] = (1, 3, 5, 10, 20), start: str | None = None, end: str | None = None) -> DataFrame:
    """:func:`screen` and :func:`forward_closes` of the same bars in one pass: the series look back for the formula and ahead for
    the returns over one partitioning and sort, so the bars are read and shuffled once."""
    hits = evaluate(bars.select("*", *_ahead(horizons)), formula).filter(_is_hit())
    for day, keep in ((start, lambda d: F.col("date") >= d), (end, lambda d: F.col("date") <= d)):
        if day is not None:
            hits = hits.filter(keep(F.lit(day).cast("date")))
    return hits.select("ts_code", "date", "value", *[f"ret_{h}" for h in horizons])


def forward_closes(hits: DataFrame, bars: DataFrame, horizons: Sequence[int] = (1, 3, 5, 10, 20)) -> DataFrame:
    """Hits with ``ret_<h>``: the close h bars later over this one; hits off the bars' dates drop out."""
    ahead = bars.select("ts_code", "date", *_ahead(horizons))
    return hits.join(ahead, ["ts_code", "date"])


def horizon_summary(returns: DataFrame, horizons: Sequence[int] = (1, 3, 5, 10, 20)) -> DataFrame:
    """horizon, samples and average return."""
    rows = F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}").alias("r")) for h in horizons]))
    return returns.select(rows).groupBy("horizon").agg(F.count("r").alias("samples"), F.avg("r").alias("average"))
