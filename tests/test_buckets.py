"""Emails of a bucket share a state, and are still decided, repeated and forgotten one by one."""

import json

import pandas as pd

from shipcheck.streaming import inbox as stream

from test_stream import drained, file, mail, root, short  # noqa: F401

HOUR = 3_600_000


class State:
    def __init__(self, kept=None, watermark=0, out=False):
        self.kept, self.watermark, self.hasTimedOut, self.until = kept, watermark, out, None

    exists = property(lambda self: self.kept is not None)
    get = property(lambda self: (self.kept,))

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        (self.kept,) = value

    def remove(self):
        self.kept = None

    def setTimeoutTimestamp(self, at):
        assert at > self.watermark
        self.until = at


def batch(*rows):
    return pd.DataFrame([(e, pd.Timestamp(hour * HOUR, unit="ms"), k, p, t, m) for e, hour, k, p, t, m in rows], columns=["email_id", "arrived", "kind", "att_pos", "text", "print"])


def test_a_state_of_many_emails():
    gather, s = stream._gathered(10), State()
    told = lambda state, *batches: [tuple(r) for d in gather((0,), iter(batches), state) for r in d[["email_id", "version", "event", "items"]].itertuples(index=False)]
    rows = batch(("a", 1, "email", -1, "A", "p"), ("a", 1, "lost", 0, "x", ""), ("b", 5, "email", -1, "B", "q"), ("c", 2, "found", 1, "y", ""))
    assert told(s, rows.head(2), rows.tail(2)) == [("a", 1, "decided", "[x]"), ("b", 1, "decided", "[]")] and s.until == 11 * HOUR
    assert told(s, batch(("a", 1, "lost", 0, "x", ""), ("b", 5, "email", -1, "B", "q"), ("b", 5, "email", -1, "B2", "z"))) == [("b", 1, "duplicate", None)]
    assert told(s, batch(("a", 3, "found", 0, "z", ""), ("c", 3, "email", -1, "C", "r"))) == [("a", 2, "decided", "[z]"), ("c", 1, "decided", "[y]")]
    s.watermark, s.hasTimedOut = 14 * HOUR, True  # a and c were last heard of at 3, b at 5
    assert told(s) == [] and list(json.loads(s.kept)) == ["b"] and s.until == 15 * HOUR
    s.watermark = 16 * HOUR
    assert told(s) == [] and s.kept is None


def test_few_states_for_many_emails(spark, root, tmp_path, monkeypatch):  # noqa: F811
    monkeypatch.setattr(stream, "BUCKETS", 2)
    file(root, "si.txt", "SHIPPING INSTRUCTION", 2)
    for i in range(9):
        mail(root, f"m{i}", f"m{i}", ["si.txt", "bl.txt"])
    rows, _, q = drained(spark, root, tmp_path / "out")
    assert short(rows) == {(f"m{i}", 1, "decided", "NEEDS_REVIEW", "unreadable"): 1 for i in range(9)}
    assert [o["numRowsTotal"] for o in q.lastProgress["stateOperators"] if o["operatorName"] == "applyInPandasWithState"] == [2]
    assert spark.conf.get(stream._LISTING[0]) == "64"
    file(root, "bl.txt", "BILL OF LADING", 2)
    rows, new, _ = drained(spark, root, tmp_path / "out")
    assert new == 9 and {r["status"] for r in rows if r["version"] == 2} == {"OK"}
