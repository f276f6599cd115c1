"""Queries over this subpackage's operators and their DuckDB counterparts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.boards import board_of_event
from tapeloom.llm.digest import certified_percentiles, rank_bound
from tapeloom.llm.encode import count_tokens, decode_corpus, encode_corpus
from tapeloom.llm.packing import Packing, pack_items
from tapeloom.llm.reading import reading_levels
from tapeloom.llm.topn import top_n
from tapeloom.operators.current import current_bars, current_events
from tapeloom.operators.lineage import cut
from tapeloom.plans.base import EVENTS_SQL
from tapeloom.plans.problems import CURRENT_BARS_SQL, CURRENT_EVENTS_SQL
from tapeloom.sources.tables import table

PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = current_bars(table(spark, sf_dir, "stock_daily"), ("amount",)).select("ts_code", F.col("date").alias("day"), F.col("amount").alias("score"))
    events = current_events(table(spark, sf_dir, "yizi_events"), ("ret_close_to_best_close_25",)).select("ts_code", F.col("signal_date").alias("day"), F.col("ret_close_to_best_close_25").alias("score"))
    best = [top_n(df, ("ts_code",), "score", ("day",), n).withColumn("ranking", F.lit(name)) for name, df, n in (("amount", bars, 5), ("ret", events, 3))]
    return best[0].unionByName(best[1]).select("ranking", "ts_code", F.date_format("day", "yyyy-MM-dd").alias("trade_day"))


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = current_events(table(spark, sf_dir, "yizi_events"), ("board", "year", "ret_close_to_best_close_25"))
    return events.select(board_of_event("board", "ts_code").alias("board"), F.coalesce("year", F.year("signal_date")).alias("year"), F.col("ret_close_to_best_close_25").alias("ret"))


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of ret_close_to_best_close_25 per board and year with their certified rank errors."""
    return certified_percentiles(_returns(spark, sf_dir), ("board", "year"), "ret", PERCENTILES)


def p4_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per board and year the number of events and how many of the percentiles are certified."""
    df = p4_percentiles(spark, sf_dir)
    return df.groupBy("board", "year").agg(F.max("n").alias("n"), F.count_if("certified").alias("certified"))


def p4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every percentile beside the exact values at the ranks that the stated bound allows, and whether it lies between them."""
    known = _returns(spark, sf_dir).filter(F.col("ret").isNotNull() & (F.abs("ret") != float("inf")))
    exact = known.withColumn("rank", F.row_number().over(W.partitionBy("board", "year").orderBy("ret")) - 1)
    wanted, slack = F.col("quantile") * (F.col("n") - 1), F.lit(rank_bound()) * F.col("n") + 1.5
    asked = p4_percentiles(spark, sf_dir).withColumns({"low": F.greatest(F.floor(wanted - slack), F.lit(0)), "high": F.least(F.ceil(wanted + slack), F.col("n") - 1)})
    at = asked.join(exact.select(F.col("board").alias("b"), F.col("year").alias("y"), "ret", "rank"), F.col("board").eqNullSafe(F.col("b")) & F.col("year").eqNullSafe(F.col("y")) & F.col("rank").isin(F.col("low"), F.col("high")))
    both = at.groupBy("board", "year", "quantile").agg(F.min("ret").alias("least"), F.max("ret").alias("most"), F.min("estimate").alias("estimate"))
    return both.select("board", "year", F.round(F.col("quantile") * 100).cast("int").alias("percentile"), "least", "most", F.col("estimate").between(F.col("least"), F.col("most")).alias("within"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's text after encoding and decoding."""
    return decode_corpus(encode_corpus(table(spark, sf_dir, "documents"))).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part with its container of 2,048 tokens."""
    return pack_items(count_tokens(table(spark, sf_dir, "documents")), Packing())


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by tier, loose items of the shortest tier, and containers, with their tokens, parts and unused share."""
    rules = Packing()
    packed = p7_containers(spark, sf_dir).filter("container_id is not null")
    windows = packed.groupBy("container_id", "window", F.col("window_tier").alias("size")).agg(F.sum("n_tokens").alias("used"), F.count("*").alias("parts"))
    loose = ~F.col("size").isin(*rules.tiers, rules.capacity)
    own = F.struct(F.when(loose, "loose").otherwise("window").alias("kind"), F.when(~loose, F.col("size")).alias("size"))
    both = F.array(own, F.struct(F.lit("container").alias("kind"), F.lit(rules.capacity).alias("size")))
    each = windows.select("container_id", "window", "used", "parts", F.inline(both)).groupBy("kind", "size").agg(F.countDistinct("container_id").alias("containers"), F.count("*").alias("windows"), F.sum("used").alias("tokens"), F.sum("parts").alias("parts"))
    places = F.when(F.col("kind") == "container", F.col("containers")).otherwise(F.col("windows"))
    return each.withColumn("unused_share", 1.0 - F.col("tokens") / (places * F.col("size")))


def p7_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed, and how often each rule of the packing is broken."""
    capacity = Packing().capacity
    tokens = count_tokens(table(spark, sf_dir, "documents"))
    packed = cut(pack_items(tokens, Packing()))
    held = packed.filter("container_id is not null")
    per = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("parts"), F.count_if(F.col("n_tokens") == capacity).alias("full"))
    docs = tokens.join(per, "doc_id", "left")
    bins = held.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.countDistinct("step_group").alias("groups"), F.max("step_group").alias("step_group"), F.sum(F.col("n_tokens").cast("long") ** 2).alias("cost"))
    windows = held.groupBy("container_id", "window").agg(F.sum("n_tokens").alias("used"), F.max("window_tier").alias("size"))
    beside = held.withColumn("next", F.lead("start").over(W.partitionBy("container_id").orderBy("start")))
    steps = bins.groupBy("step_group").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))
    all_ = W.partitionBy(F.lit(1))  # a row per step group of 64 containers
    checks = [
        docs.agg(F.lit("documents").alias("check"), F.count("*").alias("n")),
        docs.filter("placed is distinct from n_tokens").agg(F.lit("documents not whole"), F.count("*")),
        docs.filter((F.col("n_tokens") <= capacity) & (F.col("parts") > 1) | (F.col("n_tokens") > capacity) & (F.col("full") != F.floor(F.col("n_tokens") / capacity))).agg(F.lit("documents split without need"), F.count("*")),
        bins.filter(F.col("used") > capacity).agg(F.lit("containers too full"), F.count("*")),
        windows.filter("used > size").agg(F.lit("windows too full"), F.count("*")),
        beside.filter("next <> start + n_tokens").agg(F.lit("parts not end to end"), F.count("*")),
        bins.filter("groups > 1").agg(F.lit("containers in several groups"), F.count("*")),
        bins.agg(F.lit("containers above 1.001 of the least number, and one"), F.greatest(F.count("*") - F.floor(1.001 * F.ceil(F.sum("used") / capacity)) - 1, F.lit(0))),
        steps.withColumn("mean", F.sum("cost").over(all_) / F.sum("n").over(all_)).filter(F.abs(F.col("cost") / F.col("n") / F.col("mean") - 1) > 0.1).agg(F.lit("step groups off the mean cost by a tenth"), F.count("*")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "graded_passages"))
    return levels.filter(F.col("grade").isin(1, 5)).select("doc_id", "grade").distinct()


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, level and grade of every document."""
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "graded_passages"))


QUERIES = {f.__name__: f for f in (p3_found, p4_percentiles, p4_certified, p4_exact, p6_ids, p6_counts, p6_round_trip, p7_containers, p7_fill, p7_valid, p8_found, p8_levels)}

ORACLE = {
    "p3_found": f"""WITH {CURRENT_BARS_SQL}, {CURRENT_EVENTS_SQL},
a AS (SELECT 'amount' AS ranking, ts_code, date AS d, row_number() OVER (PARTITION BY ts_code ORDER BY amount DESC, date) AS r FROM cur WHERE amount IS NOT NULL AND isfinite(amount)),
b AS (SELECT 'ret' AS ranking, ts_code, signal_date AS d, row_number() OVER (PARTITION BY ts_code ORDER BY ret_close_to_best_close_25 DESC, signal_date) AS r FROM ev
 WHERE ret_close_to_best_close_25 IS NOT NULL AND isfinite(ret_close_to_best_close_25))
SELECT ranking, ts_code, strftime(d, '%Y-%m-%d') AS trade_day FROM a WHERE r <= 5 UNION ALL SELECT ranking, ts_code, strftime(d, '%Y-%m-%d') FROM b WHERE r <= 3""",
    "p4_certified": f"""WITH {EVENTS_SQL}, x AS (SELECT e.board, e.year FROM e JOIN ev ON ev.ts_code = e.ts_code AND ev.signal_date = e.signal_date WHERE isfinite(ev.ret_close_to_best_close_25))
SELECT board, year, count(*) AS n, 6::BIGINT AS certified FROM x GROUP BY 1, 2""",
    "p7_valid": "SELECT 'documents' AS \"check\", count(*) AS n FROM documents UNION ALL SELECT unnest(['documents not whole', 'documents split without need', 'containers too full', 'windows too full', 'parts not end to end', 'containers in several groups', 'containers above 1.001 of the least number, and one', 'step groups off the mean cost by a tenth']), 0",
    "p4_exact": f"""WITH {EVENTS_SQL}, x AS (SELECT e.board, e.year, ev.ret_close_to_best_close_25 AS ret FROM e JOIN ev ON ev.ts_code = e.ts_code AND ev.signal_date = e.signal_date WHERE isfinite(ev.ret_close_to_best_close_25)),
r AS (SELECT *, row_number() OVER (PARTITION BY board, year ORDER BY ret) - 1 AS k, count(*) OVER (PARTITION BY board, year) AS n FROM x),
q AS (SELECT unnest([0.1::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS q)
SELECT board, year, round(q * 100)::INT AS percentile, min(ret) AS least, max(ret) AS most, true AS "within" FROM r, q
WHERE k = greatest(floor(q * (n - 1) - {rank_bound()}::DOUBLE * n - 1.5::DOUBLE), 0) OR k = least(ceil(q * (n - 1) + {rank_bound()}::DOUBLE * n + 1.5::DOUBLE), n - 1) GROUP BY 1, 2, 3""",
    "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
}
