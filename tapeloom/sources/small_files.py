"""Small reference files: dBase III tables, name lists and industry lists."""

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_dbase(spark: SparkSession, path: str, encoding: str = "ascii") -> DataFrame:
    """A dBase III table as text columns; rows marked as deleted are left out, values are stripped.

    The file is read by the driver: it is a reference table of some thousand rows."""
    with open(path, "rb") as f:
        data = f.read()
    count, header, size = struct.unpack_from("<IHH", data, 4)
    fields, at, start = [], 32, 1
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0", 1)[0].decode("ascii")
        fields.append((name, start, data[at + 16]))
        start += data[at + 16]
        at += 32
    rows = []
    for k in range(count):
        row = data[header + k * size : header + (k + 1) * size]
        if len(row) == size and row[:1] != b"*":
            rows.append(tuple(row[a : a + n].decode(encoding, "replace").strip() for _, a, n in fields))
    return spark.createDataFrame(rows, ", ".join(f"`{name}` string" for name, _, _ in fields))


def read_names(spark: SparkSession, path: str, encoding: str = "GBK") -> DataFrame:
    """symbol and name from lines ``symbol|name``; of repeated symbols the first line counts.

    Spark's text readers know no GBK, so the file's bytes are decoded in a worker."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b["content"].to_pylist():
                rows = [(k, *map(str.strip, x.split("|", 2)[:2])) for k, x in enumerate(data.decode(encoding, "replace").splitlines()) if "|" in x]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["line", "symbol", "name"])

    read = spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "line long, symbol string, name string")
    known = read.filter(F.col("symbol").rlike(r"^\d{6}$"))
    return known.withColumn("n", F.row_number().over(W.partitionBy("symbol").orderBy("line"))).filter("n = 1").select("symbol", "name")


def read_industries(spark: SparkSession, path: str) -> DataFrame:
    """market, symbol, industry_code and industry_code_2 from lines of six or more parts between bars."""
    part = F.split("value", r"\|")
    lines = spark.read.text(path).filter(F.size(part) >= 6)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return lines.select(blank(part[0]).alias("market"), blank(part[1]).alias("symbol"), blank(part[2]).alias("industry_code"), blank(part[5]).alias("industry_code_2"))


def read_snapshot(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """An optional CSV snapshot; an empty table if there is none."""
    return spark.read.schema(schema).csv(path, header=True) if path else spark.createDataFrame([], schema)
