"""What never passes the driver: bulk submissions, set fingerprints, audit parts."""

import json

import pytest
from pyspark.sql import functions as F

from shipcheck.operators import decide, report
from shipcheck.sources import audit, sink

from test_snapshots import inbox


@pytest.fixture(scope="module")
def verified(spark, tmp_path_factory):
    emails, files = inbox(spark, 60)
    broken = F.when((F.col("att_pos") == 1) & (F.col("email_id") > "m0040"), F.replace("content", F.lit("2 containers"), F.lit("5 containers"))).otherwise(F.col("content"))
    path = str(tmp_path_factory.mktemp("v") / "verified")
    decide.verify(emails, files.withColumn("content", broken).where("email_id <> 'm0003' or att_pos = 0")).write.parquet(path)
    return emails.withColumn("subject", F.lit("a <b> & \"c\"")), spark.read.parquet(path).withColumn("subject", F.lit("a <b> & \"c\""))


def joined(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))


SHAPE = {"id": "?", "é": [1, {"classification": None, "deep": {"result": 0, "mismatched_fields": []}}], "has_defect": None, "review_code": "", "note": 'say "x"'}


@pytest.mark.parametrize("shapes", [1, 40])
def test_bulk_equals_the_small_submission(spark, verified, tmp_path, shapes):
    """One shape is one expression; more than SHAPES of them are rendered row by row.  Both give the same bytes as the driver's form."""
    _, v = verified
    ids = [f"m{(7 * i) % 60:04d}" for i in range(60)]
    template = {i: SHAPE | {"n": n % shapes} for n, i in enumerate(ids)}
    (tmp_path / "t.json").write_text(json.dumps(template, ensure_ascii=False))
    payload = sink.build_submission(v, template)
    sink.write_submission(payload, str(tmp_path / "small.json"))
    rows = sink.read_template(spark, str(tmp_path / "t.json"))
    sink.write_bulk(v, rows, str(tmp_path / "bulk"))
    assert joined(tmp_path / "bulk") == (tmp_path / "small.json").read_bytes()
    plan = sink.entries(v, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert ("body_of" in plan) == (shapes > sink.SHAPES)


def test_bulk_is_checked(spark, verified, tmp_path):
    _, v = verified
    rows = v.select(F.monotonically_increasing_id().alias("pos"), "email_id", F.lit(json.dumps(SHAPE)).alias("shape"))
    with pytest.raises(sink.SubmissionError, match="ids differ"):
        sink.write_bulk(v.where("email_id <> 'm0010'"), rows, str(tmp_path / "x"))
    with pytest.raises(sink.SubmissionError, match="invalid"):
        sink.write_bulk(v.withColumn("status", F.lit("OK")), rows, str(tmp_path / "x"))
    with pytest.raises(sink.SubmissionError, match="lacks"):
        sink.entries(v, rows.withColumn("shape", F.lit('{"id": 1}')))
    assert not (tmp_path / "x").exists()


def test_equal_sets_are_not_joined(spark):
    a = spark.range(2000).select(F.col("id").cast("string").alias("email_id"))
    assert report.same_ids(a, a.orderBy(F.rand())) and not report.same_ids(a, a.limit(1999)) and not report.same_ids(a, a.withColumn("email_id", F.concat("email_id", F.lit("x"))))
    equal = report.differences(a, a.repartition(7))
    assert equal.count() == 0 and "Join" not in equal._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in report.differences(a, a.where("email_id <> '5'").union(spark.createDataFrame([("new",)], "email_id string"))).collect()} == {("missing", "5"), ("unknown", "new")}


def test_audit_parts(spark, verified, tmp_path):
    """Every section lies where the index says, numbers run over all parts, and the one file is the parts in order."""
    emails, v = verified
    done = audit.write_audit_parts(v, emails, str(tmp_path / "audit"), part=7)
    index = done.index.orderBy("number").collect()
    assert done.included_count == 60 and [r["number"] for r in index] == list(range(1, 61)) and done.included_ids == [f"m{i:04d}" for i in range(60)]
    for r in index:
        (file,) = (tmp_path / "audit" / "parts" / f"part={r['part']}").glob("*.txt")
        section = file.read_bytes()[r["offset"] : r["offset"] + r["length"]].decode()
        assert section.startswith(f"<h2>Email audit: {r['email_id']}</h2>") and section.endswith("</pre>") and "a &lt;b&gt; &amp; &quot;c&quot;" in section
    whole = audit.write_audit(v, emails, str(tmp_path / "one" / "a.html"), problems_only=True)
    page = (tmp_path / "one" / "a.html").read_text()
    assert whole.included_count == page.count("<h2>Email audit: ") == 20 and page.index("m0003</h2>") < page.index("m0041</h2>") and "Problem decisions only" in page
    none = audit.write_audit(v.where("status = 'OK'"), emails.join(v.where("status = 'OK'"), "email_id", "left_semi"), str(tmp_path / "none.html"), problems_only=True)
    assert none.included_count == 0 and "No MISMATCH" in (tmp_path / "none.html").read_text()
