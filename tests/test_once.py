"""Rows are decided once, and ASCII text is matched without Unicode's classes, with the same results."""

import pytest
from pyspark.sql import functions as F

from shipcheck import vocab
from shipcheck.functions import text as t
from shipcheck.operators import decide, extract, identify, report
from shipcheck.plans import catalogue
from shipcheck.sources import audit

from test_snapshots import inbox


def counted(spark, d):
    """d, and how many of its rows have been made."""
    made = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return d.mapInArrow(pass_on, d.schema), made


def test_audit_decides_once(spark):
    v, made = counted(spark, decide.verify(*inbox(spark, 30)).repartition(3))
    rows = audit.audit_parts(v, 7).orderBy("number").collect()
    assert made.value == 30 and [r["number"] for r in rows] == list(range(1, 31))
    assert [r["offset"] for r in rows[:8]] == [sum(x["length"] + 1 for x in rows[:i]) for i in range(7)] + [0]


def test_violations_decide_once(spark):
    d = decide.decide(*inbox(spark, 20)).withColumn("category", F.when(F.col("email_id") == "m0004", "X").otherwise(F.col("category")))
    v, made = counted(spark, d.unionByName(d.where("email_id in ('m0004', 'm0005')")).repartition(2))
    got = sorted(map(tuple, report.violations(v).collect()))
    assert made.value == 22 and got == [("m0004", "duplicate email_id"), ("m0004", "unknown category"), ("m0004", "unknown category"), ("m0005", "duplicate email_id")]


def test_terms_are_padded_once(spark):
    plan = spark.range(1).select(t.found(F.lit(" a bl b "), vocab.BL_TERMS).alias("x"))
    assert "concat" not in plan._jdf.queryExecution().analyzed().toString() and plan.first()["x"] == ["bl"]


def test_ascii_is_matched_without_unicode_classes(spark):
    heads = ["Shipping Instruction", "SHIPPING \t instructions", "shipping instructionx", "ſhipping inſtruction", "BILL OF LADING", "Bill of lading", "x\nOcean bill", "  Proforma invoice", "Ünvoice", "b / l instruction", "", None]
    d = spark.createDataFrame([(h,) for h in heads], "content string").withColumns({"filename": F.lit("a.txt"), "type_hint": F.lit(None).cast("string"), "read_error": F.lit(None).cast("string")})
    for p in [*(x[0] for x in vocab.SI_TITLES), *(x[0] for x in vocab.BL_TITLES), *(x[0] for x in vocab.OTHER_TITLES)]:
        low = F.when(t.ascii_only(F.col("content")), F.lower("content"))
        assert [r[0] for r in d.select(identify._titled(F.col("content"), low, p)).collect()] == [r[0] for r in d.select(F.col("content").rlike("(?iU)" + p)).collect()]
    for p in (vocab.PLACEHOLDER, vocab.THREAD_BOUNDARY, vocab.SI_FILENAME, vocab.BL_FILENAME):
        values = ["N / A", "n /a", "TBA", "x", "> q", "From: b", "a_SI.txt", "bill of lading.pdf", "", None]
        e = spark.createDataFrame([(x,) for x in values], "v string")
        assert all(r[0] == r[1] for r in e.select(t.matches(F.col("v"), p), F.col("v").rlike(p)).collect())


@pytest.mark.parametrize(("line", "fields"), [("1) Shipper: a", [0]), ("as consignee", []), ("x  POL: y |POD: z", [3, 4]), ("to shipper: a", []), ("　Notify Party: a", [2]), ("12 Shipper", [])])
def test_labels_are_sought_where_they_may_stand(line, fields):
    labels = extract.Labels()
    assert [f for f, _, _ in labels.of(line)] == fields
    assert {m.end() for m in labels.places.finditer("of the goods Shipper: a and consignee b")} == {0}


def test_diagnostics_are_parsed_once(spark):
    plan = catalogue.queries()["b8_diagnostics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 0 and plan.count("from_json") + plan.count("JsonToStructs") <= 1


def test_measures_keep_no_rows(spark):
    import glob

    from shipcheck.sources.shared import shared_dir

    before = set(glob.glob(f"{shared_dir(spark)}/measured-*"))
    assert catalogue.queries()["b9_observed_stages"](spark, "/root/testdata/sf0.001").count() > 0
    assert set(glob.glob(f"{shared_dir(spark)}/measured-*")) == before
