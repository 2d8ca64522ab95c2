"""Inboxes behind HTTP: payload, attachments and submission."""

from __future__ import annotations

import json
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bundle import attachment_index, attachment_refs, checked, decode_attachments, email_items, email_rows
from .fetch import TIMEOUT, fetched, get


def read_inbox(spark: SparkSession, url: str) -> tuple[DataFrame, DataFrame]:
    """emails and decoded attachments of a JSON payload; attachments are fetched by the executors,
    from absolute addresses or relative to the payload's.  A failed fetch leaves an unreadable row."""
    payload = spark.createDataFrame([(get(url).decode("utf-8"),)], "value string")
    emails = checked(email_rows(email_items(payload)))
    refs = attachment_refs(emails, attachment_index(payload))
    return emails.drop("refs", "ids"), decode_attachments(refs.withColumn("content", fetched(F.when(F.col("inline").isNull(), F.col("source")), url)))


def submit(payload: dict, base: str) -> object:
    """POST the payload to <base>/submit; the reply as JSON, or as text."""
    data = json.dumps(payload, ensure_ascii=False).encode("utf-8")
    with urlopen(Request(base.rstrip("/") + "/submit", data, {"Content-Type": "application/json"}, method="POST"), timeout=TIMEOUT) as r:
        text = r.read().decode("utf-8")
    try:
        return json.loads(text)
    except ValueError:
        return text
