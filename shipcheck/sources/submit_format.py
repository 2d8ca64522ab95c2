"""Decisions sent to an HTTP service, as a format of df.write:

    spark.dataSource.register(SubmitSink)
    decisions.write.format("shipcheck_submit").option("run", key).mode("append").save(url)

Every task posts its rows to <url>/decisions in batches, each under a key made of the run and the batch's own rows: a batch that
is sent again, by a retry of the request or of the task, has the same key, and a service that keeps keys takes it once.  When all tasks
have ended, <url>/commit tells how many batches and decisions there are; if one fails for good, <url>/abort names the run."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.error import URLError
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.decide import DECISION
from .fetch import TIMEOUT
from .shared import materialise

#: Decisions of a request, tries of one, seconds before the second.
BATCH, TRIES, PAUSE = 500, 4, 0.2


@dataclass
class Sent(WriterCommitMessage):
    batches: int
    decisions: int


class SubmitWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.url, self.run, self.size = options["path"].rstrip("/"), options["run"], int(options.get("batch", BATCH))

    def _post(self, where: str, body: dict) -> None:
        """Tries again after failures that may pass: no connection, a lost reply, a server's error."""
        data = json.dumps(body, ensure_ascii=False).encode("utf-8")
        for n in range(TRIES):
            try:
                with urlopen(Request(f"{self.url}/{where}", data, {"Content-Type": "application/json"}, method="POST"), timeout=TIMEOUT) as r:
                    r.read()
                return
            except (URLError, OSError) as e:
                if n == TRIES - 1 or 400 <= getattr(e, "code", 500) < 500:
                    raise
                time.sleep(PAUSE * 2**n)

    def write(self, rows: Iterator[Row]) -> Sent:
        sent, held = Sent(0, 0), []

        def send() -> None:
            text = json.dumps(held, ensure_ascii=False, sort_keys=True)
            self._post("decisions", {"key": hashlib.sha256(f"{self.run}\n{text}".encode()).hexdigest(), "run": self.run, "decisions": held})
            sent.batches, sent.decisions = sent.batches + 1, sent.decisions + len(held)
            held.clear()

        for row in rows:
            held.append(row.asDict(True))
            if len(held) == self.size:
                send()
        if held:
            send()
        return sent

    def commit(self, messages: list[Sent | None]) -> None:
        done = [m for m in messages if m is not None]
        self._post("commit", {"run": self.run, "batches": sum(m.batches for m in done), "decisions": sum(m.decisions for m in done)})

    def abort(self, messages: list[Sent | None]) -> None:
        self._post("abort", {"run": self.run})


class SubmitSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shipcheck_submit"

    def schema(self) -> str:
        return "email_id string, category string, status string, has_defect boolean, defect_fields array<string>, review_reason string, classification_reasons array<string>"

    def writer(self, schema, overwrite: bool) -> SubmitWriter:
        return SubmitWriter(dict(self.options))


def submit_all(decisions: DataFrame, url: str, run: str, batch: int = BATCH) -> None:
    """Sends all decisions under a run's key.  They are written first and sorted by id, so that a task that runs again makes the same batches."""
    spark = decisions.sparkSession
    spark.dataSource.register(SubmitSink)
    kept = materialise(decisions.select(*DECISION), "submitted")
    kept.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "email_id").sortWithinPartitions("email_id").write.format("shipcheck_submit").options(run=run, batch=batch).mode("append").save(url)
