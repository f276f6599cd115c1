import json
import threading
import time
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET

import pytest

from tapeloom import render
from tapeloom.plans import base
from tapeloom.service import serve

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ask(spark):
    server = serve(spark, DATA, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data)) as r:
            return json.loads(r.read())

    yield call
    server.shutdown()


def finished(ask, job):
    for _ in range(600):
        got = ask(f"/api/jobs/{job}")
        if got["state"] != "running":
            return got
        time.sleep(0.1)
    raise AssertionError("still running")


def test_jobs(ask):
    assert ask("/api/health") == {"ok": True} and "amount_leaders" in ask("/api/queries")
    done = finished(ask, ask("/api/query", {"name": "daily_counts"})["id"])
    assert done["state"] == "done" and done["n_rows"] > 200 and len(done["rows"]) == 200
    hits = finished(ask, ask("/api/screen", {"formula": "XG:CLOSE>MA(CLOSE,5);"})["id"])
    assert hits["state"] == "done" and hits["n_rows"] > 0
    bad = finished(ask, ask("/api/search", {"symbol": "none", "start": "2024-03-01", "end": "2024-04-30"})["id"])
    assert bad["state"] == "failed" and "3 bars" in bad["error"]
    assert {j["id"] for j in ask("/api/jobs")} >= {done["id"], hits["id"], bad["id"]}
    for path in ("/api/jobs/none", "/api/nothing"):
        with pytest.raises(urllib.error.HTTPError):
            ask(path)


def test_a_job_can_be_cancelled(ask):
    job = ask("/api/query", {"name": "similar_exact"})["id"]
    assert ask(f"/api/jobs/{job}/cancel", {})["state"] == "cancelled"
    assert finished(ask, job)["state"] == "cancelled"


def test_charts_of_matches(spark):
    bars = base.bars(spark, DATA)
    days = [r.date for r in bars.filter("ts_code = '605999.SH'").orderBy("date").collect()]
    matches = spark.createDataFrame([(1, "605999.SH", days[100], days[120], 0.5), (2, "605999.SH", days[0], days[5], 0.25)], "rank int, ts_code string, start_date date, end_date date, score double")
    sections = render.match_charts(bars, matches, daily=30, others=4)
    assert [len(charts) for _, charts in sections] == [3, 3] and sections[0][0].startswith("1. 605999.SH")
    for name, charts in sections:
        for c in charts:
            assert sum(e.get("class") == "band" for e in ET.fromstring(c)) == 1
    lines = [sum(e.tag.endswith("line") for e in ET.fromstring(charts[0])) for _, charts in sections]
    assert lines == [5 + 81, 5 + 36]
    assert render.page("a & b", sections).count("<svg") == 6


def test_charts_share_an_axis():
    low, high = ([{"date": f"2024-01-0{d}", "open": p, "high": p + 1, "low": p - 1, "close": p, "vol": 1} for d in range(1, 5)] for p in (10, 90))
    axis = render.price_axis(low, high)
    assert axis == (9, 91)
    scales = [[e.text for e in ET.fromstring(render.chart(x, "t", axis=axis)) if e.tag.endswith("text")][1:6] for x in (low, high)]
    assert scales[0] == scales[1]
