"""Adjustment factors from corporate actions."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def place_actions(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """Corporate actions with the bar they take effect on: trade_date, prev_close, ref_price, ratio, status.

    An action takes effect on the first bar on or after its ex-date (an as-of join forward: actions and bars
    are united and sorted once per instrument). Without an earlier bar it is ``before_listing``, without a
    later one ``after_data_end``. Several actions of one bar apply in the order of their ex-dates, each to
    the price that the ones before it leave; ``invalid`` ones (a price not above 0) leave it. Repeated
    actions count once. ``bars``: ts_code, date, close, unique and valid.
    """
    terms = ("cash_per10", "rights_price", "bonus_per10", "rights_per10")
    acts = actions.select("ts_code", "ex_date", *[F.coalesce(F.col(t).cast("double"), F.lit(0.0)).alias(t) for t in terms]).dropna(subset=["ts_code", "ex_date"]).distinct()
    nothing = F.lit(None)
    line = acts.select("ts_code", F.col("ex_date").alias("day"), F.lit(0).alias("kind"), nothing.cast("double").alias("close"), F.struct("ex_date", *terms).alias("action")).unionByName(
        bars.select("ts_code", F.col("date").alias("day"), F.lit(1).alias("kind"), "close", nothing.cast("struct<ex_date:date,cash_per10:double,rights_price:double,bonus_per10:double,rights_per10:double>").alias("action"))
    )
    forth = W.partitionBy("ts_code").orderBy(F.col("day"), F.col("kind"))
    back = W.partitionBy("ts_code").orderBy(F.col("day").desc(), F.col("kind").desc())
    is_bar = F.col("kind") == 1
    line = line.withColumn("prev", F.last(F.when(is_bar, F.col("close")), ignorenulls=True).over(forth.rowsBetween(W.unboundedPreceding, -1)))
    line = line.withColumn("at", F.last(F.when(is_bar, F.col("day")), ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0)))
    placed = line.filter(~is_bar).select("ts_code", "prev", "at", "action")
    chain = placed.groupBy("ts_code", "at", "prev").agg(F.array_sort(F.collect_list("action")).alias("actions"))
    empty = F.expr("cast(array() as array<struct<ex_date:date,cash_per10:double,rights_price:double,bonus_per10:double,rights_per10:double,c:double,ref:double>>)")

    def apply(state, x):
        # (C - cash + rights price * rights) / (1 + bonus + rights), per share, to the price left so far
        ref = (state["price"] - x["cash_per10"] / 10 + x["rights_price"] * x["rights_per10"] / 10) / (1 + x["bonus_per10"] / 10 + x["rights_per10"] / 10)
        good = (ref > 0) & (state["price"] > 0)
        done = F.struct(x["ex_date"].alias("ex_date"), *[x[t].alias(t) for t in terms], state["price"].alias("c"), ref.alias("ref"))
        return F.struct(F.when(good, ref).otherwise(state["price"]).alias("price"), F.concat(state["done"], F.array(done)).alias("done"))

    walked = chain.select("ts_code", "at", "prev", F.aggregate("actions", F.struct(F.col("prev").alias("price"), empty.alias("done")), apply)["done"].alias("done"))
    each = walked.select("ts_code", "at", "prev", F.inline("done"))
    status = F.when(F.col("prev").isNull(), "before_listing").when(F.col("at").isNull(), "after_data_end").when((F.col("ref") <= 0) | (F.col("c") <= 0), "invalid").otherwise("applied")
    each = each.withColumn("status", status)
    on_bar = F.col("status").isin("applied", "invalid")
    return each.select(
        "ts_code", "ex_date", *terms,
        F.when(on_bar, F.col("at")).alias("trade_date"), F.when(on_bar, F.col("c")).alias("prev_close"), F.when(on_bar, F.col("ref")).alias("ref_price"),
        F.when(F.col("status") == "applied", F.col("c") / F.col("ref")).alias("ratio"), "status",
    )


def factors(bars: DataFrame, placed: DataFrame) -> DataFrame:
    """``bars`` with ``built_factor``: the product of the ratios in effect so far, 1 at listing."""
    steps = placed.filter(F.col("status") == "applied").groupBy("ts_code", F.col("trade_date").alias("date")).agg(F.product("ratio").alias("step"))
    run = W.partitionBy("ts_code").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return bars.join(steps, ["ts_code", "date"], "left").withColumn("built_factor", F.product(F.coalesce("step", F.lit(1.0))).over(run)).drop("step")


# The category of distributions, and the exchange of a market number.
DISTRIBUTION, MARKETS = 1, {0: "SZ", 1: "SH", 2: "BJ"}


def distributions(actions: DataFrame) -> DataFrame:
    """Decoded corporate actions (market, code, category, date and their amounts) that are distributions, with ts_code
    instead of market and code, and ex_date; those of unknown markets are left out. In order of code and date."""
    place = F.create_map(*[F.lit(x) for pair in MARKETS.items() for x in pair])
    known = actions.filter(F.col("category") == DISTRIBUTION).withColumn("_place", place[F.col("market").cast("int")]).filter("_place is not null")
    named = known.withColumn("ts_code", F.concat(F.lpad(F.col("code").cast("string"), 6, "0"), F.lit("."), "_place")).withColumnRenamed("date", "ex_date")
    return named.drop("_place", "market", "code", "category").orderBy("ts_code", "ex_date")
