"""A small job service over HTTP: ``serve(spark, data, port)``.

GET /api/health, /api/queries, /api/jobs, /api/jobs/{id}?page=; POST /api/search, /api/screen and /api/query with a JSON body
start a job and give its id; POST /api/jobs/{id}/cancel stops it. Results are bounded by ``MOST_ROWS`` and kept for the last
``KEPT`` jobs. For one team's browser, not for the open net.
"""

import json
import threading
import uuid
from collections import OrderedDict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from tapeloom.plans import base, registry
from tapeloom.screener.columns import screen
from tapeloom.similarity.search import SearchRules, search

MOST_ROWS, PAGE, KEPT = 10_000, 200, 50


class Jobs:
    """Jobs that run in threads of their own; each job's Spark work carries its id as a tag, by which it is cancelled."""

    def __init__(self, spark: SparkSession, data: str):
        self.spark, self.data, self.jobs, self.lock = spark, data, OrderedDict(), threading.Lock()

    def frame(self, kind: str, ask: dict) -> DataFrame:
        if kind == "query":
            return registry.QUERIES[ask["name"]](self.spark, self.data)
        bars = base.bars(self.spark, self.data)
        if kind == "screen":
            return screen(bars, ask["formula"], ask.get("start"), ask.get("end"))
        how = {k: ask[k] for k in ("timeframe", "history_only", "exclude_query", "latest") if k in ask}
        return search(bars, ask["symbol"], ask["start"], ask["end"], SearchRules(**ask.get("rules", {})), **how)

    def start(self, kind: str, ask: dict) -> str:
        job = uuid.uuid4().hex
        with self.lock:
            self.jobs[job] = {"id": job, "kind": kind, "ask": ask, "state": "running", "rows": [], "error": None}
            while len(self.jobs) > KEPT:
                self.jobs.popitem(last=False)
        threading.Thread(target=self._run, args=(job, kind, ask), daemon=True).start()
        return job

    def _run(self, job: str, kind: str, ask: dict) -> None:
        record = self.jobs[job]
        context = self.spark.sparkContext
        try:
            context.addJobTag(job)
            rows = [r.asDict() for r in self.frame(kind, ask).limit(MOST_ROWS).collect()]
            record.update(rows=rows, state=record["state"] if record["state"] == "cancelled" else "done")
        except Exception as e:  # noqa: BLE001 - the asker gets it
            if record["state"] != "cancelled":
                record.update(state="failed", error=f"{type(e).__name__}: {str(e)[:500]}")
        finally:
            context.removeJobTag(job)

    def cancel(self, job: str) -> None:
        self.jobs[job]["state"] = "cancelled"
        self.spark.sparkContext.cancelJobsWithTag(job)

    def shown(self, job: str, page: int = 0) -> dict:
        record = self.jobs[job]
        return {**{k: record[k] for k in ("id", "kind", "ask", "state", "error")}, "n_rows": len(record["rows"]), "page": page, "rows": record["rows"][page * PAGE : (page + 1) * PAGE]}


def handler(jobs: Jobs) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _say(self, code: int, what) -> None:
            body = json.dumps(what, default=str, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _answer(self, give) -> None:
            try:
                self._say(200, give())
            except KeyError as e:
                self._say(404, {"error": f"unknown: {e}"})
            except (ValueError, TypeError) as e:
                self._say(400, {"error": str(e)})

        def do_GET(self) -> None:  # noqa: N802
            path, _, asked = self.path.partition("?")
            parts = path.strip("/").split("/")
            page = int(asked.removeprefix("page=")) if asked.startswith("page=") and asked[5:].isdigit() else 0
            ways = {"health": lambda: {"ok": True}, "queries": lambda: sorted(registry.QUERIES), "jobs": lambda: [{k: r[k] for k in ("id", "kind", "state")} for r in jobs.jobs.values()]}
            self._answer((lambda: jobs.shown(parts[2], page)) if parts[:2] == ["api", "jobs"] and len(parts) == 3 else lambda: ways[parts[1] if parts[0] == "api" and len(parts) == 2 else path]())

        def do_POST(self) -> None:  # noqa: N802
            parts = self.path.strip("/").split("/")
            ask = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")

            def give():
                if parts[:2] == ["api", "jobs"] and parts[3:] == ["cancel"]:
                    jobs.cancel(parts[2])
                    return {"id": parts[2], "state": "cancelled"}
                return {"id": jobs.start({"search": "search", "screen": "screen", "query": "query"}[parts[-1]], ask)}

            self._answer(give)

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(spark: SparkSession, data: str, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """The server, not yet running: call ``serve_forever`` on it."""
    return ThreadingHTTPServer((host, port), handler(Jobs(spark, data)))
