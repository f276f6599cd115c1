"""Differences between two copies of a dataset, cell by cell.

Both copies are unpivoted to key-field-value cells, the cells are united with signed counts (left +1 for a
row, right -1), and the cells of one key and field are grouped: a cell that doesn't cancel is a difference.
"""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.codes import as_number, canonical_code
from tapeloom.operators.current import micros
from tapeloom.operators.small import checked_broadcast


@dataclass(frozen=True)
class Tolerance:
    """Values within ``absolute`` or within ``relative`` of the left value's magnitude are equal."""

    absolute: float = 0.0
    relative: float = 0.0


def keyed_sides(left: DataFrame, right: DataFrame, keys: Sequence[str], left_values: Sequence[str], fields: Sequence[str], version: str | None = None) -> DataFrame:
    """A row per key of either copy: ``keys``, the signed counts ``left_rows`` and ``right_rows``, and of every
    value the least and the greatest on each side (``l0_``, ``l1_``, ``r0_``, ``r1_``).

    With ``version`` the left copy holds deliveries, of which a key's latest counts, once. Both copies are
    shuffled once, by the whole key and combined before that, so neither a hot source nor a row that was
    delivered millions of times is a hot key.
    """
    sides = []
    for df, mine, theirs, sign in ((left, left_values, fields, 1), (right, fields, left_values, -1)):
        own = [as_number(F.col(c)).alias(("l_" if sign > 0 else "r_") + c) for c in mine]
        none = [F.lit(None).cast("double").alias(("r_" if sign > 0 else "l_") + c) for c in theirs]
        kind = dict(left.dtypes)[version] if version else "date"
        age = F.coalesce(F.col(version), F.lit("0001-01-01 00:00:00").cast(kind)) if version and sign > 0 else F.lit(None).cast(kind)
        sides.append(df.dropna(subset=list(keys)).select(*keys, F.lit(sign).alias("_sign"), age.alias("_age"), *own, *none))
    rows = sides[0].unionByName(sides[1])
    ends = []
    for c in left_values:
        if version:
            latest = F.max_by(f"l_{c}", "_age")
            ends += [latest.alias(f"l0_{c}"), latest.alias(f"l1_{c}")]
        else:
            ends += [F.min(f"l_{c}").alias(f"l0_{c}"), F.max(f"l_{c}").alias(f"l1_{c}")]
    for c in fields:
        ends += [F.min(f"r_{c}").alias(f"r0_{c}"), F.max(f"r_{c}").alias(f"r1_{c}")]
    counts = [F.sum(F.when(F.col("_sign") > 0, 1).otherwise(0)), F.sum(F.when(F.col("_sign") < 0, -1).otherwise(0))]
    if version:
        counts[0] = F.max(F.when(F.col("_sign") > 0, 1).otherwise(0)).cast("long")
    return rows.groupBy(*keys).agg(counts[0].alias("left_rows"), counts[1].alias("right_rows"), *ends)


def differences(sides: DataFrame, keys: Sequence[str], fields: Mapping[str, Tolerance], missing_right: str, missing_left: str, repeats: str | None = None) -> DataFrame:
    """``keys``, ``diff_kind``, ``left_value``, ``right_value`` of the cells of :func:`keyed_sides` that don't cancel."""
    cells = []
    for sign, low, high, n in ((1, "l0_", "l1_", "left_rows"), (-1, "r0_", "r1_", "right_rows")):
        nothing = F.lit(None).cast("double")
        cells.append(F.struct(F.lit("").alias("field"), F.lit(sign).alias("side"), F.col(n).alias("signed"), nothing.alias("low"), nothing.alias("high")))
        cells += [F.struct(F.lit(f).alias("field"), F.lit(sign).alias("side"), F.col(n).alias("signed"), F.col(low + f).alias("low"), F.col(high + f).alias("high")) for f in fields]
    # A key's cells are grouped where the key is: the grouping below needs no further shuffle.
    long = sides.select(*keys, F.inline(F.array(*cells))).filter("signed <> 0")
    mine, theirs = F.col("side") > 0, F.col("side") < 0
    grouped = long.groupBy(*keys, "field").agg(
        F.sum("signed").alias("net"), F.sum(F.when(mine, F.col("signed")).otherwise(0)).alias("n_left"), F.sum(F.when(theirs, -F.col("signed")).otherwise(0)).alias("n_right"),
        *[F.max(F.when(side, F.col(x))).alias(f"{name}_{x}") for side, name in ((mine, "l"), (theirs, "r")) for x in ("low", "high")],
    )
    both = (F.col("n_left") > 0) & (F.col("n_right") > 0)
    apart = F.greatest(F.abs(F.col("l_high") - F.col("r_low")), F.abs(F.col("r_high") - F.col("l_low")))
    bound = F.lit(None).cast("double")
    for name, t in fields.items():
        scale = F.greatest(F.abs(F.col("l_low")), F.abs(F.col("l_high")))
        bound = F.when(F.col("field") == name, F.lit(t.absolute) + F.lit(t.relative) * scale if t.relative else F.lit(t.absolute)).otherwise(bound)
    same = (F.col("l_low") == F.col("r_high")) & (F.col("l_high") == F.col("r_low"))
    endless = F.greatest(F.abs("l_low"), F.abs("l_high"), F.abs("r_low"), F.abs("r_high")) == float("inf")
    differs = F.coalesce(~same & (endless | (apart > bound)), F.col("l_low").isNull() != F.col("r_low").isNull())
    key_cell = F.col("field") == ""
    kind = F.when(both & ~key_cell & differs, F.col("field")).when(key_cell & (F.col("n_right") == 0), F.lit(missing_right)).when(key_cell & (F.col("n_left") == 0), F.lit(missing_left))
    if repeats:
        kind = kind.when(key_cell & (F.col("net") != 0), F.lit(repeats))
    out = grouped.select(*keys, kind.alias("diff_kind"), F.col("l_low").alias("left_value"), F.col("r_low").alias("right_value"))
    return out.filter(F.col("diff_kind").isNotNull())


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Mapping[str, Tolerance],
    missing_right: str = "missing_in_right",
    missing_left: str = "missing_in_left",
    repeats: str | None = None,
) -> DataFrame:
    """Keys that one copy lacks, and fields in which the copies disagree: ``keys``, ``diff_kind``, values.

    Numeric fields are compared as doubles. NaN and null are "no value"; one side without a value differs
    from the other with one, two without don't differ; an infinite value only equals itself. Rows with a null key are no part of either copy.
    Repeated rows of one side count once, unless ``repeats`` names a kind: then a key whose signed counts don't
    cancel has a row of that kind. If the rows of one key contradict each other, the field differs as soon as any
    pair of values does. Columns beside ``keys`` and ``fields`` are ignored, clashing names included. Empty
    copies give a missing row for every key of the other.
    """
    return differences(keyed_sides(left, right, keys, list(fields), list(fields)), keys, fields, missing_right, missing_left, repeats)


PRICES = ("open", "high", "low", "close")
BAR_TOLERANCES = {p: Tolerance(absolute=0.0002) for p in PRICES} | {"vol": Tolerance(), "amount": Tolerance(relative=1e-6)}


#: Days of a period within which dates are packed before the time of delivery, and the microseconds of that.
_PERIOD, _MICROS = 1024, 1 << 53


def last_factor(stock_daily: DataFrame) -> DataFrame:
    """The factor of each code's last current bar by date; null or NaN there gives null.

    A bar is the last if its date is, and current if its delivery is the latest. Within a period of 1,024 days
    the day and the time of delivery make one long (deliveries from 1828 to 2112), so that the latest of both is a
    hash aggregation with a buffer of fixed width, which leaves a row per code, period and partition before the shuffle.
    """
    rows = stock_daily.dropna(subset=["ts_code", "date"]).select(canonical_code(F.col("ts_code")).alias("ts_code"), F.unix_date("date").alias("day"), micros(F.col("synced_at"), dict(stock_daily.dtypes)["synced_at"]).alias("at"), "adj_factor")
    time = F.least(F.greatest(F.coalesce("at", F.lit(-(_MICROS >> 1))) + F.lit(_MICROS >> 1), F.lit(0)), F.lit(_MICROS - 1))
    period = F.floor(F.col("day") / F.lit(_PERIOD))
    latest = rows.groupBy("ts_code", period.alias("period")).agg(F.max_by("adj_factor", F.pmod(F.col("day"), F.lit(_PERIOD)).cast("long") * F.lit(_MICROS) + time).alias("f"))
    return latest.groupBy("ts_code").agg(F.max_by("f", "period").alias("f")).select("ts_code", as_number(F.col("f")).alias("last_factor"))


def bar_differences(stock_daily: DataFrame, stock_daily_qfq: DataFrame) -> DataFrame:
    """Differences between the current bars, forward-adjusted, and the second system's adjusted copy.

    Prices are compared after multiplying them by their factor over that of the code's last current bar; they have no
    value where a factor has none."""
    coded = [df.filter("ts_code is not null and date is not null").withColumn("ts_code", canonical_code(F.col("ts_code"))) for df in (stock_daily, stock_daily_qfq)]
    sides = keyed_sides(*coded, ("ts_code", "date"), [*BAR_TOLERANCES, "adj_factor"], list(BAR_TOLERANCES), version="synced_at")
    sides = sides.join(checked_broadcast(last_factor(stock_daily)), "ts_code", "left")
    share = F.nullif(F.col("last_factor"), F.lit(0.0))
    sides = sides.withColumns({f"{e}_{p}": F.col(f"{e}_{p}") * F.col("l0_adj_factor") / share for p in PRICES for e in ("l0", "l1")})
    return differences(sides, ("ts_code", "date"), BAR_TOLERANCES, "missing_in_qfq", "missing_in_daily")
