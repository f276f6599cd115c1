"""Join sides whose size is checked before they are broadcast."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators.lineage import cut

#: Bytes up to which a lookup side is broadcast.
BROADCAST_BYTES = 32 << 20


def _bytes(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value as Spark holds it, near enough for a bound: 8 for a number or date, the length of a text."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, T.ArrayType):
        return 16 + F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, kind.elementType)), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_bytes(column[f.name], f.dataType) for f in kind), F.lit(8))
    return F.lit(8)


def checked_broadcast(side: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``side``, computed once and kept in the checkpoint folder, with the hint to broadcast it if it has at most
    ``most_bytes``; a larger one is joined by shuffling. Only its size comes to the driver here."""
    held = cut(side)
    size = held.agg(F.sum(sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in held.schema), F.lit(16))).alias("n")).first()["n"]
    small = (size or 0) <= most_bytes
    out = F.broadcast(held) if small else held
    out._is_broadcast = small
    return out


def is_broadcast(side: DataFrame) -> bool:
    """Whether :func:`checked_broadcast` found ``side`` small enough."""
    return getattr(side, "_is_broadcast", False)
