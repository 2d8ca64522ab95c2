"""The stateful stream: late and shared attachments, duplicates over batches, restarts."""

import json
import os
from collections import Counter

import pytest

from shipcheck.operators import decide
from shipcheck.sources import bundle
from shipcheck.streaming.inbox import latest, verify_stream

FORM = "{title}\nShipper: Lumen Ceramics\nConsignee: Old Mill Stores\nNotify Party: Old Mill Stores\nPort of Loading: Antwerp\nPort of Discharge: Valparaiso\nContainers: {n} containers\nGross Weight: 8,100 KGS"
ASK = {"subject": "Compare the SI and the BL", "body": "Kindly verify both."}


@pytest.fixture
def root(tmp_path):
    (tmp_path / "inbox").mkdir()
    (tmp_path / "attachments").mkdir()
    return tmp_path


def mail(root, name, email_id, refs, **more):
    (root / "inbox" / f"{name}.json").write_text(json.dumps(ASK | {"email_id": email_id, "attachments": refs} | more))


def file(root, name, title, n):
    (root / "attachments" / name).write_text(FORM.format(title=title, n=n))


def drained(spark, root, out):
    """One run of the stream over what has arrived; what its batches gave."""
    before = spark.read.parquet(str(out)).count() if os.path.isdir(out) else 0
    q = verify_stream(spark, str(root), str(root / "checkpoint"), lambda d, number: d.write.mode("append").parquet(str(out)))
    q.awaitTermination(200)
    assert q.exception() is None
    rows = spark.read.parquet(str(out)).collect() if os.path.isdir(out) else []
    return rows, len(rows) - before, q


def short(rows):
    return Counter((r["email_id"], r["version"], r["event"], r["status"], r["review_reason"]) for r in rows)


def test_late_attachments_duplicates_and_restarts(spark, root, tmp_path):
    out = tmp_path / "out"
    file(root, "si.txt", "SHIPPING INSTRUCTION", 2)
    mail(root, "a", "a", ["si.txt", "bl.txt"])
    mail(root, "b", "b", ["attachments/si.txt", {"filename": "bl.txt", "content": FORM.format(title="BILL OF LADING", n=3)}])
    rows, _, _ = drained(spark, root, out)
    assert short(rows) == Counter([("a", 1, "decided", "NEEDS_REVIEW", "unreadable"), ("b", 1, "decided", "MISMATCH", None)])
    # the late file comes, and with it another email that shares it; b is delivered again, and an id comes with other contents
    file(root, "bl.txt", "BILL OF LADING", 2)
    mail(root, "c", "c", ["si.txt", "bl.txt"])
    mail(root, "b2", "b", ["attachments/si.txt", {"filename": "bl.txt", "content": FORM.format(title="BILL OF LADING", n=3)}])
    mail(root, "a2", "a", ["si.txt"])
    rows, new, q = drained(spark, root, out)
    assert new == 3 and short(rows) >= Counter([("a", 2, "decided", "OK", None), ("c", 1, "decided", "OK", None)]) and [r["email_id"] for r in rows if r["event"] == "duplicate"] == ["a"]
    # a restart with nothing new repeats nothing
    rows, new, q = drained(spark, root, out)
    assert new == 0
    # a batch reads what is new alone
    file(root, "other.txt", "BILL OF LADING", 9)
    mail(root, "d", "d", ["other.txt"])
    rows, new, q = drained(spark, root, out)
    assert new == 1 and sum(s["numInputRows"] for p in q.recentProgress for s in p["sources"]) <= 8
    # the end state is what a whole inbox gives
    for name in ("b2", "a2"):
        os.remove(root / "inbox" / f"{name}.json")
    whole = decide.decide(*bundle.read_bundle(spark, str(root)))
    last = latest(spark.read.parquet(str(out))).select(*decide.DECISION)
    assert sorted(map(str, last.collect())) == sorted(map(str, whole.collect()))
