"""The HTTP sink: every decision exactly once, whatever fails on the way."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from shipcheck.sources.submit_format import submit_all


@pytest.fixture
def service():
    """Keeps what it is sent by key.  Of the first two batches one is refused before it is kept, one is kept but its reply is lost."""
    state = {"kept": {}, "commits": [], "aborts": [], "asked": 0, "broken": False}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                code = 200
                if self.path == "/decisions":
                    state["asked"] += 1
                    code = 422 if state["broken"] else 503 if state["asked"] <= 2 else 200
                    if state["asked"] != 1 and not state["broken"]:
                        state["kept"].setdefault(body["key"], body["decisions"])
                else:
                    state[f"{self.path[1:]}s"].append(body)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"{}")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", state
    server.shutdown()


def decisions(spark, n=100):
    none = F.lit(None).cast("string")
    return spark.range(n).select(F.format_string("é%03d", "id").alias("email_id"), F.lit("GENERAL").alias("category"), none.alias("status"), F.lit(False).alias("has_defect"), F.array().cast("array<string>").alias("defect_fields"), none.alias("review_reason"), F.array(F.lit("x")).alias("classification_reasons"))


def test_every_decision_once(spark, service):
    url, state = service
    submit_all(decisions(spark), url, "run-1", batch=9)
    got = [d["email_id"] for batch in state["kept"].values() for d in batch]
    assert sorted(got) == [f"é{i:03d}" for i in range(100)] and len(got) == len(set(got))
    assert state["asked"] == len(state["kept"]) + 2 and state["commits"] == [{"run": "run-1", "batches": len(state["kept"]), "decisions": 100}] and not state["aborts"]
    before = dict(state["kept"])
    submit_all(decisions(spark), url, "run-1", batch=9)  # the whole run again: the same keys
    assert state["kept"] == before
    submit_all(decisions(spark, 0), url, "run-2")
    assert state["commits"][-1] == {"run": "run-2", "batches": 0, "decisions": 0}


def test_a_run_that_fails_is_aborted(spark, service):
    url, state = service
    state["broken"] = True
    with pytest.raises(Exception, match="422|aborted"):
        submit_all(decisions(spark, 5), url, "run-3")
    assert state["aborts"] == [{"run": "run-3"}] and not state["commits"] and not state["kept"]
