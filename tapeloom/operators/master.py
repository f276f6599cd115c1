"""The security master: union of sources by priority, names, parsing and look-up."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by_priority(df: DataFrame, key: str, column: str, order: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """One row per key: that whose ``column`` comes first in ``order`` (other values last), ties ascending."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    by = W.partitionBy(key).orderBy(F.when(place > 0, place).otherwise(len(order) + 1), *[F.col(t).asc_nulls_last() for t in ties])
    return df.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def build_master(names: DataFrame, base: DataFrame, industries: DataFrame) -> DataFrame:
    """symbol, name and the columns of ``base`` and ``industries``: names and base in full, industries looked up."""
    return names.join(base, "symbol", "full").join(industries, "symbol", "left").withColumn("name", F.trim("name"))


def day(text: Column, pattern: str = "yyyyMMdd") -> Column:
    """A date from text; null for anything else, the empty text included."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")), F.lit(pattern)).cast("date")


def resolve(master: DataFrame, text: str) -> DataFrame:
    """Rows that ``text`` may mean: exact code; else digits, filled to six; else exact name; else part of a name.

    The caller takes it as resolved if there is one row."""
    t = text.strip()
    digits = t.zfill(6) if t.isdigit() else ""
    name = F.trim(F.col("name"))
    how = F.when(F.col("ts_code") == t.upper(), 1).when(F.substring("ts_code", 1, 6) == digits, 2).when(name == t, 3).when(name.contains(t), 4)
    found = master.withColumn("how", how).filter("how is not null")
    best = found.agg(F.min("how").alias("_best"))
    return found.join(F.broadcast(best), F.col("how") == F.col("_best")).drop("_best")


def union_statuses(parts: dict[str, DataFrame], key: str = "ts_code", order: Sequence[str] = ("L", "P", "D")) -> DataFrame:
    """The lists of several listing statuses as one, a row per key: the status that comes first in ``order`` wins, others
    come last, in alphabetical order. Columns that a list lacks are null."""
    out = None
    for status, df in parts.items():
        named = df.withColumn("list_status", F.lit(status))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return first_by_priority(out, key, "list_status", order, ("list_status",))


def resolve_one(master: DataFrame, text: str) -> str:
    """The one code that ``text`` means; ValueError if it means none or several."""
    found = [r.ts_code for r in resolve(master, text).select("ts_code").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{text!r} names {'no' if not found else 'more than one'} instrument")
    return found[0]


def required(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``table`` (unique by ``keys``); a row without a match is an error when it is computed."""
    found = rows.join(table.withColumn("_found", F.lit(True)), list(keys), "left")
    missing = F.concat(F.lit("no match for "), F.to_json(F.struct(*keys)))
    sure = F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(missing).cast("boolean"))
    return found.withColumn("_found", sure).filter("_found").drop("_found")
