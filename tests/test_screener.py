import datetime as dt
import random

import numpy as np
import pytest

from tapeloom.screener.columns import evaluate, forward_closes, horizon_summary, screen, screen_ahead
from tapeloom.screener.formula import FormulaError, chosen, lookback, parse
from tapeloom.screener.session import run
from tapeloom.streaming.screen import screen_stream

SCHEMA = "ts_code string, date date, open double, high double, low double, close double, vol bigint, amount double"


def series(code, closes, start=dt.date(2024, 1, 1)):
    return [(code, start + dt.timedelta(days=i), c - 0.1, c + 0.2, c - 0.2, float(c), 100 + i % 7, None if i % 11 == 5 else c * 100.0) for i, c in enumerate(closes)]


def many(seed=1, n=70):
    rng = random.Random(seed)
    return [r for code in ("A", "B", "C") for r in series(code, [10 + rng.randint(-8, 8) / 4 for _ in range(n)])]


FORMULAS = [
    "XG:CROSS(CLOSE,MA(CLOSE,2));", "A:=REF(MA(C,5),3);B:C>A\nAND V>REF(V,1);", "COUNT(C>O OR AMOUNT>1000,5)*2-1;", "X:HHV(H,5)-LLV(L,0);", "T:BARSCOUNT(AMOUNT)+BARSLAST(C>11);",
    "E:EVERY(C>9,3) OR EXIST(C>11.5,2);", "S:SUM(AMOUNT,4)/STD(C,6);", "IF(C>10,MAX(C,O),MIN(C,AMOUNT))-ABS(-C);", "N:NOT(AMOUNT>0) OR NOT C>10;", "L:LN(C-9.5)+SQRT(C-9);", "D:C/(C-10);",
]


@pytest.mark.parametrize("formula", FORMULAS)
def test_windows_equal_session(spark, formula):
    rows = many()
    got = {(r.ts_code, r.date): r.value for r in evaluate(spark.createDataFrame(rows, SCHEMA), formula).collect()}
    for code in "ABC":
        mine = [r for r in rows if r[0] == code]
        bars = {k: np.array([np.nan if r[i] is None else r[i] for r in mine], float) for i, k in enumerate(("open", "high", "low", "close", "vol", "amount"), 2)}
        want = run(parse(formula), bars)
        for r, w in zip(mine, want, strict=True):
            g = got[(code, r[1])]
            assert (g is None and np.isnan(w)) or g == pytest.approx(w), (formula, r, g, w)


def test_choice_of_output():
    assert chosen(parse("A:C>1;XG:C>2;B:C>3;")) == "XG"
    assert chosen(parse("SELECT:=C>1;B:C>3;")) == "SELECT"
    assert chosen(parse("A:C>1;B:C>3;")) == "B"


@pytest.mark.parametrize("bad", ["XG:REFX(C,1);", "A:FOO(C);", "A:C>;", "A:B>1;", "", "A:=C;", "MA(C,2.5);", "A:C $ 1;"])
def test_errors(bad):
    with pytest.raises(FormulaError):
        chosen(parse(bad))


def test_warm_up_and_end(spark):
    df = spark.createDataFrame(series("A", [1, 2, 3, 4, 5, 6.0]), SCHEMA)
    got = [(r.date.day, r.value) for r in screen(df, "X:MA(C,3);", "2024-01-04", "2024-01-05").orderBy("date").collect()]
    assert got == [(4, 3.0), (5, 4.0)]


def test_forward_returns_and_summary(spark):
    df = spark.createDataFrame(series("A", [10, 10.2, 10.3, 10.5]), SCHEMA)
    hits = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0), ("A", dt.date(2024, 2, 2), 1.0)], "ts_code string, date date, value double")
    rows = forward_closes(hits, df, (1, 2, 3))
    (r,) = rows.collect()
    assert (r.ret_1, r.ret_2, r.ret_3) == (pytest.approx(10.3 / 10.2 - 1), pytest.approx(10.5 / 10.2 - 1), None)
    assert {s.horizon: s.samples for s in horizon_summary(rows, (1, 2, 3)).collect()} == {1: 1, 2: 1, 3: 0}


def test_one_pass_equals_the_join(spark):
    df = spark.createDataFrame(series("A", [10, 10.2, 10.1, 10.5, 10.4, 10.9, 10.8]) + series("B", [5, 4, 6.0]), SCHEMA)
    for start, end in ((None, None), ("2024-01-03", "2024-01-05")):
        one = screen_ahead(df, "X:C>REF(C,1);", (1, 2), start, end)
        two = forward_closes(screen(df, "X:C>REF(C,1);", start, end), df, (1, 2))
        assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect())) and one.count() > 1


def test_lookback():
    assert lookback(parse("A:=MA(C,5);XG:CROSS(REF(A,2),C);")) == 7
    assert lookback(parse("X:BARSCOUNT(C);")) is None and lookback(parse("X:HHV(H,0);")) is None


def test_stream_equals_batch(spark, tmp_path):
    formula = "M:=MA(C,4);XG:CROSS(C,M) OR COUNT(C>O,3)*0+HHV(H,6)-REF(C,2)>2.5;"
    rows = many(seed=4, n=40)
    for k in range(4):
        part = [r for r in rows if 10 * k <= (r[1] - dt.date(2024, 1, 1)).days < 10 * k + 10]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = screen_stream(stream, formula).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.ts_code, r.date): r.value for r in spark.table("hits").collect()}
    want = {(r.ts_code, r.date): r.value for r in screen(spark.createDataFrame(rows, SCHEMA), formula, "2000-01-01").collect()}
    assert got == pytest.approx(want) and want
    with pytest.raises(FormulaError):
        screen_stream(stream, "X:BARSCOUNT(C);")
