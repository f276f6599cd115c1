"""Price limits: reference prices, limit boards and new listings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.boards import board_of, limit_share, limit_share_by_code
from tapeloom.functions.rounding import cents, cents_half_up
from tapeloom.operators.bars import series, up_to_now, numbered, rows_between

NEW_BARS = 60
UPS_BEFORE = 3


def limit_features(bars: DataFrame, reach: float | None = None) -> DataFrame:
    """Adds bar_no, board, limit_pct, ref_price (the last close in today's terms), the limit prices in cents
    (``up_c``, ``down_c``; ``up5_c``, ``down5_c`` on the main board), close_c, is_one_price, new_stock,
    any_limit_up and limit_ups_prev3. All windows share one sort. With ``reach``, a close also counts as at a
    limit if it moved that share of it, for feeds whose boards do not stand at the limit to the cent."""
    main = F.col("board") == "main"
    df = numbered(bars).withColumn("board", board_of(F.col("ts_code")))
    df = df.withColumns({
        "limit_pct": limit_share(F.col("board"), F.col("date")),
        "ref_price": F.lag("close").over(series()) * F.lag("adj_factor").over(series()) / F.col("adj_factor"),
        "close_c": cents(F.col("close")),
        "is_one_price": (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close")),
    })
    df = df.withColumns({
        "up_c": cents_half_up(F.col("ref_price") * (1 + F.col("limit_pct"))),
        "down_c": cents_half_up(F.col("ref_price") * (1 - F.col("limit_pct"))),
        "up5_c": F.when(main, cents_half_up(F.col("ref_price") * 1.05)),
        "down5_c": F.when(main, cents_half_up(F.col("ref_price") * 0.95)),
        "new_stock": (F.max((~F.col("is_one_price")).cast("int")).over(up_to_now()) == 0) | (F.col("bar_no") < NEW_BARS),
    })
    up = F.coalesce(F.col("close_c") == F.col("up_c"), F.lit(False)) | F.coalesce(F.col("close_c") == F.col("up5_c"), F.lit(False))
    down = F.coalesce(F.col("close_c") == F.col("down_c"), F.lit(False)) | F.coalesce(F.col("close_c") == F.col("down5_c"), F.lit(False))
    if reach is not None:
        move = F.col("close") / F.col("ref_price") - 1
        up = up | F.coalesce(move >= F.col("limit_pct") * reach, F.lit(False))
        down = down | F.coalesce(move <= F.col("limit_pct") * -reach, F.lit(False))
    df = df.withColumns({"any_limit_up": up, "any_limit_down": down})
    ups = F.sum(F.col("any_limit_up").cast("int")).over(rows_between(-UPS_BEFORE, -1))
    return df.withColumn("limit_ups_prev3", F.coalesce(ups, F.lit(0)))


def board_labels(bars: DataFrame) -> DataFrame:
    """``board_type``: one_word_up, one_word_down, limit_up, limit_down or the empty text, the first that holds
    (a downward label before an upward one, as both can only hold for prices of a few cents)."""
    df = limit_features(bars)
    one = F.col("is_one_price")
    label = F.when(F.col("any_limit_down") & one, "one_word_down").when(F.col("any_limit_up") & one, "one_word_up").when(F.col("any_limit_down"), "limit_down").when(F.col("any_limit_up"), "limit_up").otherwise("")
    return df.withColumn("board_type", label)


def daily_labels(bars: DataFrame) -> DataFrame:
    """``board_type`` of a day's chart: one_word_up, t_board_up, gap_limit_up, one_word_down, limit_up, limit_down or the
    empty text, the first that holds. Quoted prices count, against the quoted close before (on a first bar its own),
    by the limit of the code; a close is at the limit within 1.1 cents or 0.3 per cent."""
    before = F.coalesce(F.lag("close").over(series()), F.col("close"))
    df = bars.withColumns({"_before": before, "_limit": limit_share_by_code(F.col("ts_code"))})
    c, pc = F.col("close"), F.col("_before")
    two = lambda x: F.rint(x * 100) / 100
    hit = lambda edge: (F.abs(c - two(pc * edge)) <= 0.011) | (F.abs(c / pc - edge) <= 0.003)
    near = lambda x: F.abs(F.col(x) - c) / c <= 0.006
    prices = [two(F.col(x)) for x in ("open", "high", "low", "close")]
    up, down, flat = hit(1 + F.col("_limit")), hit(1 - F.col("_limit")), F.greatest(*prices) == F.least(*prices)
    gap = up & (F.col("open") / pc >= 1.02)
    tee = gap & near("open") & ~flat & near("high") & (F.col("low") < c * 0.994)
    label = F.when(up & flat, "one_word_up").when(tee, "t_board_up").when(gap, "gap_limit_up").when(down & flat, "one_word_down").when(up, "limit_up").when(down, "limit_down").otherwise("")
    return df.withColumn("board_type", label).drop("_before", "_limit")
