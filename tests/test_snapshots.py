"""Versions of decisions: incremental runs, whole versions alone, one file for one id."""

import json

import pytest
from pyspark.sql import functions as F

from shipcheck.operators import decide
from shipcheck.sources import bundle
from shipcheck.sources.snapshots import Snapshots

FORM = "{title}\nShipper: Lumen Ceramics\nConsignee: Old Mill Stores\nNotify Party: Old Mill Stores\nPort of Loading: Antwerp\nPort of Discharge: Valparaiso\nContainers: {n} containers\nGross Weight: 8,100 KGS"


def inbox(spark, n=1000):
    e = spark.range(n).select(F.format_string("m%04d", "id").alias("email_id"), F.lit("Compare the SI and the BL").alias("subject"), F.lit("Kindly verify both.").alias("body"), F.lit("a@b.c").alias("sender"))
    text = lambda t: F.format_string(FORM.replace("{title}", t).replace("{n}", "%d"), F.lit(2))
    a = e.select("email_id", F.inline(F.array(*[F.struct(F.lit(i).alias("att_pos"), F.lit(f"{x}.txt").alias("filename"), text(t).alias("content")) for i, (x, t) in enumerate((("si", "SHIPPING INSTRUCTION"), ("bl", "BILL OF LADING")))])))
    return e, a.withColumns({"type_hint": F.lit(None).cast("string"), "extraction": F.lit("text"), "read_error": F.lit(None).cast("string")})


def test_only_changed_emails_are_decided(spark, tmp_path, monkeypatch):
    from shipcheck.sources import snapshots

    monkeypatch.setattr(snapshots, "ROWS", 100)
    s = Snapshots(spark, str(tmp_path / "store"))
    assert s.manifest() == {"version": 0, "files": []}
    emails, files = inbox(spark)
    one = s.update(emails, files, source="mail", loader="test")
    assert (one["version"], one["processed"], one["ok"], one["decided"], one["source"], one["loader"]) == (1, 1000, 1000, 1000, "mail", "test") and one["generated_at"].endswith("+00:00")
    assert len(one["files"]) >= 10 and all(a["greatest"] < b["least"] for a, b in zip(one["files"], one["files"][1:], strict=False))
    # one attachment of a thousand emails changes
    changed = files.withColumn("content", F.when((F.col("email_id") == "m0420") & (F.col("att_pos") == 1), F.replace("content", F.lit("2 containers"), F.lit("5 containers"))).otherwise(F.col("content")))
    opened = []

    def watched(refs):
        opened.append(refs.select("email_id").distinct().count())
        return refs

    two = s.update(emails, changed, watched)
    assert opened == [1] and (two["version"], two["decided"], two["mismatch"], two["processed"]) == (2, 1, 1, 1000)
    assert len({f["path"] for f in two["files"]} & {f["path"] for f in one["files"]}) == len(one["files"]) - 1  # one file is rewritten
    # both versions can be read whole; a lookup and a page read the files they need
    assert s.read(1).where("status = 'OK'").count() == 1000 and s.read().where("decided_in = 2").select("email_id").first()[0] == "m0420"
    assert s.one("m0420").first()["status"] == "MISMATCH" and len(s.one("m0420").inputFiles()) == 1
    with pytest.raises(LookupError):
        s.one("m04205")
    rows, total = s.page("m0099", 30)
    assert total == 1000 and [r["email_id"] for r in rows.collect()] == [f"m{i:04d}" for i in range(100, 130)] and len(rows.inputFiles()) < 4
    # emails that are new, gone, or both; an unchanged inbox decides nothing
    more = emails.where("email_id <> 'm0001'").unionByName(emails.limit(1).withColumn("email_id", F.lit("a-first")))
    three = s.update(more, changed)
    assert (three["processed"], three["decided"], three["ok"], three["mismatch"]) == (1000, 1, 998, 1) and s.one("a-first").first()["attachments"] is None
    with pytest.raises(LookupError):
        s.one("m0001")
    assert s.update(more, changed)["decided"] == 0 and s.versions() == [1, 2, 3, 4]
    # nobody sees half a version: without its manifest it doesn't exist, and a version is made once
    (tmp_path / "store" / "data" / "unfinished").mkdir()
    assert s.read().count() == 1000
    with pytest.raises(ValueError, match="another run"):
        s._publish({"version": 4, "files": []})


def test_files_of_a_folder_are_opened_once(spark, tmp_path):
    """State of files stands for their contents: a second run opens only what changed."""
    (tmp_path / "b" / "inbox").mkdir(parents=True)
    (tmp_path / "b" / "attachments").mkdir()
    for i in range(4):
        (tmp_path / "b" / "attachments" / f"si{i}.txt").write_text(FORM.format(title="SHIPPING INSTRUCTION", n=2))
        (tmp_path / "b" / "attachments" / f"bl{i}.txt").write_text(FORM.format(title="BILL OF LADING", n=2))
        (tmp_path / "b" / "inbox" / f"{i}.json").write_text(json.dumps({"email_id": f"m{i}", "subject": "Compare the SI and the BL", "attachments": [f"si{i}.txt", f"bl{i}.txt"]}))
    s = Snapshots(spark, str(tmp_path / "store"))

    def update():
        emails, refs, loader = bundle.locate_bundle(spark, str(tmp_path / "b"))
        return s.update(emails, refs, bundle.opened, str(tmp_path / "b"), loader)

    first = update()
    assert (first["ok"], first["decided"], first["loader"]) == (4, 4, "folder of emails") and update()["decided"] == 0
    (tmp_path / "b" / "attachments" / "bl2.txt").write_text(FORM.format(title="BILL OF LADING", n=33))
    third = update()
    assert (third["decided"], third["mismatch"], third["ok"]) == (1, 1, 3)
    whole = decide.decide(*bundle.read_bundle(spark, str(tmp_path / "b")))
    assert sorted(map(str, s.read().select(*decide.DECISION).collect())) == sorted(map(str, whole.collect()))
