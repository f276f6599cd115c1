"""The N highest items of every group, by a two-stage salted ranking."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: Sequence[str], score: str, ties: Sequence[str], n: int, subgroups: int = 32) -> DataFrame:
    """The ``n`` rows of highest ``score`` in every group, with their ``rank`` from 1.

    Equal scores are ordered by ``ties`` ascending (nulls first); rows equal in score and ties take their
    places in no particular order, so ``ties`` should identify a row within its group. Null, NaN and
    infinite scores never count; a group with none left has no row, one with fewer than ``n`` has them all.
    Null group values form a group of their own. Other columns are carried along; one named ``rank`` is replaced.

    Each group is hashed into ``subgroups`` by its ties; the ``n`` best of each subgroup are ranked first,
    and their survivors, ``n * subgroups`` a group at most, once more. Spark cuts either ranking to ``n``
    a (sub)group before its shuffle as well, so a group of any size sends little and no task sorts it whole.
    """
    value = F.col(score).cast("double")
    rows = df.filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    rows = rows.withColumn("__subgroup", F.pmod(F.xxhash64(*ties), F.lit(subgroups)).cast("int"))
    order = [F.col(score).desc(), *[F.col(t).asc_nulls_first() for t in ties]]
    first = rows.withColumn("__place", F.row_number().over(W.partitionBy(*group, "__subgroup").orderBy(*order))).filter(F.col("__place") <= n)
    last = first.drop("__place", "__subgroup").withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return last.filter(F.col("rank") <= n)
