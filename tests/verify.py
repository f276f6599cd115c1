"""Runs queries against their DuckDB counterparts: ``python tests/verify.py [--sf 0.01] [NAME...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings stock_daily stock_daily_qfq xdxr stock_basic_tdx trade_calendar yizi_events graded_passages".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.9g}"
    if hasattr(x, "tolist"):
        return str(x.tolist())
    if isinstance(x, pd.Timestamp):
        return str(x.date()) if x == x.normalize() else str(x)
    return str(x)


def rows(pdf: pd.DataFrame) -> list:
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(cell(x) for x in r) for r in pdf.astype(object).itertuples(index=False))


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    t = time.time()
    got = query(spark, sf_dir).toPandas()
    took = time.time() - t
    if sql is None:
        return len(got) > 0, f"{len(got)} rows (no SQL), {took:.1f} s"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        mine, theirs = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return False, f"{len(a)} and {len(b)} rows; only Spark {mine}; only SQL {theirs}"
    return True, f"{len(a)} rows equal, {took:.1f} s"


def main(args: list[str]) -> int:
    import __spark_entry__ as entry

    from tests.conftest import session

    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args or queries:
        try:
            good, said = compare(spark, con, name, queries[name], oracle.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            good, said = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not good
        print("ok  " if good else "FAIL", name, said, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
