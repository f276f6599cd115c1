"""Binary day files: 32-byte records, one file per instrument, as a Spark data source.

``spark.dataSource.register(DayBars)``, then ``spark.read.format("daybars").load("/folder/**/*.day")``. Files are
split over partitions by number; each is decoded as one array.
"""

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed value: the record's little-endian fields; prices are in hundredths.
RECORD = np.dtype([("date", "<u4"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("amount", "<f4"), ("vol", "<u4"), ("reserved", "<u4")])
SCHEMA = "stem string, date date, open double, high double, low double, close double, vol bigint, amount double"


def decode(data: bytes) -> dict[str, np.ndarray]:
    """Columns of whole records; a broken record at the end and dates out of 2000 to 2099 are left out."""
    rows = np.frombuffer(data[: len(data) // RECORD.itemsize * RECORD.itemsize], RECORD)
    y, m, d = rows["date"] // 10000, rows["date"] // 100 % 100, rows["date"] % 100
    rows = rows[(y >= 2000) & (y < 2100) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= 31)]
    text = rows["date"].astype(str)
    days = np.array([f"{t[:4]}-{t[4:6]}-{t[6:]}" for t in text], "datetime64[D]") if len(rows) else np.zeros(0, "datetime64[D]")
    return {"date": days, **{p: rows[p] / 100.0 for p in ("open", "high", "low", "close")}, "vol": rows["vol"].astype(np.int64), "amount": rows["amount"].astype(np.float64)}


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[InputPartition]:
        found = sorted(p for p in glob.glob(self.path, recursive=True) if os.path.isfile(p))
        return [_Files(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            with open(path, "rb") as f:
                columns = decode(f.read())
            stem = os.path.splitext(os.path.basename(path))[0]
            n = len(columns["date"])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([stem] * n), *[pa.array(x) for x in columns.values()]], names=["stem", *columns])


class DayBars(DataSource):
    """Data source ``daybars``; option ``filesPerTask`` (default 64)."""

    @classmethod
    def name(cls) -> str:
        return "daybars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("filespertask", 64)))


def read_day_bars(spark: SparkSession, path: str) -> DataFrame:
    """Day files through Spark's own binary reader, for file systems that only Spark knows: the same columns."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                columns = decode(data)
                stem = os.path.splitext(os.path.basename(name))[0]
                yield pa.RecordBatch.from_arrays([pa.array([stem] * len(columns["date"]), pa.string()), *[pa.array(x) for x in columns.values()]], names=["stem", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parts, SCHEMA)


class _Tails(_Reader):
    """The last whole record of every file, by seeking to it."""

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        stems, days = [], []
        for path in partition.paths:
            size = os.path.getsize(path)
            if not size:
                continue
            with open(path, "rb") as f:
                f.seek(max(size - RECORD.itemsize, 0))
                tail = f.read()
            got = decode(tail)["date"] if size % RECORD.itemsize == 0 else []
            stems.append(os.path.splitext(os.path.basename(path))[0])
            days.append(got[-1].astype(object) if len(got) else None)
        yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(days, pa.date32())], names=["stem", "last_date"])


class DayTails(DayBars):
    """Data source ``daytails``: stem and last_date of day files."""

    @classmethod
    def name(cls) -> str:
        return "daytails"

    def schema(self) -> str:
        return "stem string, last_date date"

    def reader(self, schema) -> DataSourceReader:
        return _Tails(self.options["path"], int(self.options.get("filespertask", 1024)))


def last_dates(spark: SparkSession, path: str) -> DataFrame:
    """stem and the date of each file's last record, null where it is no date of 2000 to 2099 or the file is broken.
    32 bytes a file are read; empty files have no row."""
    spark.dataSource.register(DayTails)
    return spark.read.format("daytails").load(path)


def close_series(bars: DataFrame, stem: str) -> DataFrame:
    """date and close of one instrument or index, in date order."""
    return bars.filter(F.col("stem") == stem).select("date", "close").orderBy("date")
