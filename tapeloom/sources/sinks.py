"""Sinks: clustered Parquet, CSV with a byte-order mark, JSON summaries and Markdown tables."""

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bars(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet clustered by instrument and sorted by date, so that filters on either skip row groups."""
    spread = df.repartitionByRange(partitions, "ts_code", "date") if partitions else df.repartitionByRange("ts_code", "date")
    spread.sortWithinPartitions("ts_code", "date").write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, name: str, buckets: int) -> None:
    """A table bucketed by instrument: later joins and windows by instrument shuffle nothing."""
    df.write.mode("overwrite").bucketBy(buckets, "ts_code").sortBy("ts_code", "date").format("parquet").saveAsTable(name)


def write_csv(df: DataFrame, path: str, places: int = 6) -> None:
    """CSV parts with a header each and doubles to ``places`` decimals; the first column's name carries a
    byte-order mark, for spreadsheets."""
    fixed = [F.format_string(f"%.{places}f", c).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes]
    out = df.select(*fixed)
    out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0]).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_summary(row: DataFrame, path: str) -> dict:
    """The one row of an aggregate as a JSON file."""
    (found,) = row.limit(2).collect()
    summary = json.loads(json.dumps(found.asDict(), default=str))
    Path(path).write_text(json.dumps(summary, ensure_ascii=False, indent=2), encoding="utf-8")
    return summary


def markdown(df: DataFrame, most: int = 200) -> str:
    """A Markdown table of at most ``most`` rows, in the frame's order; a line below it says so if there are more."""
    rows = df.limit(most + 1).collect()
    cell = lambda x: "—" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows[:most]]
    return "\n".join(lines + (["", f"The first {most} rows; there are more."] if len(rows) > most else [])) + "\n"
