import datetime as dt

from tapeloom.operators.bars import resample
from tapeloom.streaming.resample import weekly_stream

SCHEMA = "ts_code string, date date, open double, high double, low double, close double, vol bigint, amount double"


def test_weekly_stream_equals_batch_for_closed_weeks(spark, tmp_path):
    start = dt.date(2024, 1, 3)
    rows = [(c, start + dt.timedelta(days=i), 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, i, 0.0) for c in "AB" for i in range(40) if (start + dt.timedelta(days=i)).weekday() < 5]
    for k in range(4):
        part = [r for r in rows if 10 * k <= (r[1] - start).days < 10 * k + 10]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = weekly_stream(stream).writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.ts_code, r.date, r.open, r.high, r.low, r.close, r.vol, r.bars) for r in spark.table("weeks").collect()}
    want = {(r.ts_code, r.date, r.open, r.high, r.low, r.close, r.vol, r.bars) for r in resample(spark.createDataFrame(rows, SCHEMA), "W").collect()}
    assert got and got <= want and len(got) >= 2 * 3
