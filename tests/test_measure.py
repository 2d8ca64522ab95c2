"""Stages are counted in the job that makes the result."""

from shipcheck.operators import decide
from shipcheck.operators.measure import STAGES, Measured

from test_snapshots import inbox


def test_counts_of_one_job(spark, tmp_path):
    emails, files = inbox(spark, 40)
    m = Measured()
    m.verify(emails, files.where("email_id <> 'm0003' or att_pos = 0")).write.parquet(str(tmp_path / "v"))
    got = m.counts()
    assert list(got) == list(STAGES) and [got[k]["rows"] for k in STAGES] == [40, 79, 79, 40, 40] and all(x["seconds"] >= 0 for x in got.values())
    assert got["extract"]["documents"] == 79 and got["extract"]["values"] == 79 * 7 and got["classify"]["comparisons"] == 40 and (got["compare"]["ok"], got["compare"]["compared"], got["compare"]["needs_review"]) == (39, 39, 1)
    seen = spark.read.parquet(str(tmp_path / "v"))
    assert sorted(map(str, seen.select(*decide.DECISION).collect())) == sorted(map(str, decide.decide(emails, files.where("email_id <> 'm0003' or att_pos = 0")).collect()))


def test_nothing_passes(spark):
    emails, files = inbox(spark, 0)
    m = Measured()
    m.verify(emails, files).collect()
    assert {(x["rows"], x["seconds"]) for x in m.counts().values()} == {(0, 0.0)}
