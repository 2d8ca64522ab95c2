"""Operator cases, decoders and the whole run over a generated bundle."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from shipcheck import vocab
from shipcheck.functions import text as t
from shipcheck.operators import classify, decide, extract, identify, report
from shipcheck.sources import bundle, decode, sink

SI = "SHIPPING INSTRUCTION\nShipper / Exporter: Nordlicht Textil Co.\nConsignee: Harbor & Pine Ltd\nNotify Party: Harbor & Pine Limited\nPort of Loading: Hamburg (DEHAM)\nPort of Discharge: Singapore (SGSIN)\nNo. of Containers: 1 x 20GP + 3 x 40HC\nTotal Gross Weight: 31.25 MT"
BL = "DRAFT BILL OF LADING\nShipper: NORDLICHT TEXTIL COMPANY\nConsignee: Harbor and Pine Ltd.\nNotify Party: HARBOR AND PINE LIMITED\nLoad Port: Hamburg, Germany\nDischarge Port: SGSIN\nContainers: 4 containers\nGross Weight KG: 31,250 KGS"

def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()]


def test_scalars(spark):
    assert one(spark, t.fold, "Straße &  MÜLLER", "a.b") == ["strasse m ller", "a b"]
    assert one(spark, t.normalize_text, "ACME, Ltd.\n12 Harbour Road", "Café & Co", "T.B.A", "TBA", " n / a", "", None, "½ x") == ["acme limited 12 harbour road", "cafe and company", "t b a", None, None, None, None, "1 2 x"]
    assert one(spark, t.normalize_party, "Same as Consignee", "same as exporter.") == ["__same_as_consignee__", "__same_as_shipper__"]
    assert one(spark, t.normalize_port, "Singapore (SGSIN)", "SINGAPORE", "Port Kembla (Berth 4), Australia (SGSIN)", "SGSIN", "cns ha", "Port Kelang") == ["singapore", "singapore", "port kembla berth 4 australia", "singapore", "shanghai", "port klang"]
    assert one(spark, t.normalize_weight, "12,500 KG", "12.5 MT", "1,000.5 LB", "40.000 KG", "12.5MT", "3 tons", "-4 kg", "x", "12.500,25 kg", "12 500 KG", "____MT", "0.00 kg") == ["12500", "12500", "453.819", "40000", "12.5", None, None, None, "12500.25", "12500", None, "0"]
    assert one(spark, t.normalize_containers, "5 x 20'GP + 4 x 40'HQ", "03 containers", "Three", "40HC x 3", "7", "TBD", "2 × containers") == ["9", "3", "3", None, "7", None, "2"]
    assert one(spark, t.suffix, "a.PDF", ".bashrc", "a.", "x/y.tar.gz") == [".pdf", "", "", ".gz"]
    assert one(spark, t.current_body, "hi\n> old\nx", "a\r\nFrom: b\r\nc", "On Monday X wrote:\nq") == ["hi", "a", ""]


@pytest.mark.parametrize(("subject", "body", "files", "category"), [
    ("Two drafts to compare: SI and BL", "both are below", 2, "BL_COMPARISON"), ("Load 12", "We ask for a new SI", 0, "SI_REQUEST"), ("March", "no remittance yet", 0, "INVOICE_QUERY"), ("Canteen", "soup at noon", 0, "GENERAL"),
    ("A free gift", "for each winner", 0, "SPAM"), ("TO CONFIRM DOCS", "many greetings", 0, "GENERAL"), ("Draft BL", "could you check it with the SI", 0, "BL_COMPARISON"), ("Draft BL", "bye\n> could you check it with the SI", 0, "GENERAL"),
    ("x", "95% off, act now", 0, "SPAM"), ("x", "guaranteed 250% returns on crypto", 0, "SPAM"),
])
def test_classification(spark, subject, body, files, category):
    e = spark.createDataFrame([("e", subject, body, "a@b.c")], "email_id string, subject string, body string, sender string")
    a = spark.createDataFrame([("e", i, f"f{i}.txt", None, "") for i in range(files)], "email_id string, att_pos int, filename string, type_hint string, content string")
    assert classify.classify(e, a).first()["category"] == category


def attachments(spark, rows):
    return spark.createDataFrame([(e, i, n, None, "text", err, c) for e, i, n, c, err in rows], "email_id string, att_pos int, filename string, type_hint string, extraction string, read_error string, content string")


def test_assessment(spark):
    rows = [("e", 0, "x_BL.txt", "BILL OF LADING INSTRUCTION\n...", None), ("e", 1, "BL.txt", "Packing List", None), ("e", 2, "a.txt", "B/L instruction", None), ("e", 3, "si.txt", "ocean bill", None), ("e", 4, "q.txt", "nothing", "broken")]
    got = {r["att_pos"]: r for r in identify.assess(attachments(spark, rows)).collect()}
    assert [got[i]["document_type"] for i in range(5)] == ["SI", "OTHER", "SI", "BL", None]
    assert (got[0]["si_score"], got[0]["bl_score"], got[4]["readable"]) == (14, 3, False)


def test_extraction(spark):
    text = ["SHIPPER / EXPORTER:\nAcme\n1 Road\n\nConsignee (Non-Negotiable)\tBeta\nNotify Party: Same as consignee |POL: X  POD: Y\nGross Weight毛重(KGS): 5\nContainers\n--- \n3", "Gross Weight (KG)\nPURJ123 4", "Gross Weight:\n\n 7,000 KGS\n", "no labels here", None]
    d = spark.createDataFrame(list(enumerate(text)), "k int, content string")
    got = {(r["k"], r["field"]): r["raw"] for r in extract.extract_fields(d, ["k"]).collect()}
    assert len(got) == 7 * len(text)
    assert [got[0, f] for f in vocab.FIELDS] == ["Acme 1 Road", "Beta", "Same as consignee", "X", "Y", "3", "5"]
    assert (got[1, "gross_weight_kg"], got[2, "gross_weight_kg"]) == (None, "7,000 KGS")
    assert not any(got[3, f] or got[4, f] for f in vocab.FIELDS)


def docx(*blocks):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda s: f"<w:p><w:r><w:t>{s}</w:t></w:r></w:p>"
    body = "".join(p(b) if isinstance(b, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in b) + "</w:tbl>" for b in blocks)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx(sheets):
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            cell = lambda c: f"<c><v>{c}</v></c>" if isinstance(c, (int, float)) else f'<c t="inlineStr"><is><t>{c}</t></is></c>'
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{s}"><sheetData>' + "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def pdf(*pages, flate=False):
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{3 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>"]
    for i, lines in enumerate(pages):
        content = ("BT /F1 12 Tf " + " ".join(f"({x}) Tj T*" for x in lines) + " ET").encode()
        content = zlib.compress(content) if flate else content
        objects += [f"<< /Type /Page /Contents {4 + 2 * i} 0 R >>", (f"<< /Length {len(content)} {'/Filter /FlateDecode' if flate else ''} >>\nstream\n", content, "\nendstream")]
    out = b"%PDF-1.4\n"
    for i, o in enumerate(objects, 1):
        out += f"{i} 0 obj\n".encode() + (o.encode() if isinstance(o, str) else o[0].encode() + o[1] + o[2].encode()) + b"\nendobj\n"
    return out


def test_decoders():
    assert decode.docx_text(docx("Title", [["a", "b"], ["", "c"]], "end")) == "Title\na\tb\nc\nend"
    assert decode.xlsx_text(xlsx({"One": [["k", 12.5], [7]], "Empty": [], "Two": [["z"]]})) == "[Worksheet: One]\nk\t12.5\n7\n[Worksheet: Two]\nz"
    for flate in (False, True):
        assert decode.pdf_text(pdf(["a \\(x\\) 1234", "bcd"], [], ["efg"], flate=flate)) == ("a (x) 1234\nbcd\nefg", "embedded text")
    for data, ext in ((b"junk", ".docx"), (b"junk", ".xlsx"), (b"%PDF-1.4 junk", ".pdf"), (pdf([]), ".pdf"), (None, ".pdf")):
        assert decode.decoded(data, ext)["extraction"] == "unreadable"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("bundle")
    (root / "inbox").mkdir()
    (root / "attachments").mkdir()
    mail = {"subject": "Two drafts to compare: SI and BL", "body": "Both are below.", "from": "a@b.c"}
    cases = {
        "e1": mail | {"attachments": ["attachments/si.txt", {"filename": "bl.txt", "content": BL}]}, "e2": mail | {"attachments": [{"path": "si.txt"}, {"name": "bl.docx", "path": "x/bl.docx"}]},
        "e3": mail | {"si_path": "attachments/si.txt"}, "e4": mail | {"attachments": ["si.txt", "lost_BL.pdf"]}, "e5": mail | {"attachments": ["si.txt", "bl.pdf"]}, "e6": {"subject": "Invoice query", "text": "payment"},
        "e7": mail | {"files": {"a": "si.txt", "b": {"filename": "bl.txt", "content": BL.replace("Notify Party: HARBOR AND PINE LIMITED", "Notify Party: TBA")}}}, "e8": mail | {"attachments": ["si.txt", "bl.xlsx"]},
    }
    for i, (k, x) in enumerate(cases.items()):
        (root / "inbox" / f"{k}.json").write_text(json.dumps(x | {["email_id", "id"][i % 2]: k}))
    (root / "attachments" / "si.txt").write_bytes(SI.replace("\n", "\r\n").encode())
    (root / "attachments" / "bl.docx").write_bytes(docx("DRAFT BILL OF LADING", [line.split(": ") for line in BL.replace("4 containers", "5 containers").split("\n")[1:]]))
    (root / "attachments" / "bl.pdf").write_bytes(pdf(BL.split("\n"), flate=True))
    (root / "attachments" / "bl.xlsx").write_bytes(xlsx({"B": [["BILL OF LADING"], *[line.split(": ") for line in BL.split("\n")[1:]]]}))
    (root / "sample_submission.json").write_text(json.dumps({k: {"payload": {"classification": None, "result": None, "has_mismatch": None, "defects": [], "review_code": None}, "schema_version": 1} for k in cases}))
    return root


def test_bundle_to_submission(spark, folder, tmp_path):
    emails, files = bundle.read_bundle(spark, str(folder))
    decisions = decide.decide(emails, files)
    got = {r["email_id"]: (r["category"], r["status"], r["defect_fields"], r["review_reason"]) for r in decisions.collect()}
    bl = "BL_COMPARISON"
    assert got == {
        "e1": (bl, "OK", [], None), "e2": (bl, "MISMATCH", ["container_count"], None), "e3": (bl, "NEEDS_REVIEW", [], "missing_attachment"), "e4": (bl, "NEEDS_REVIEW", [], "unreadable"),
        "e5": (bl, "OK", [], None), "e6": ("INVOICE_QUERY", None, [], None), "e7": (bl, "NEEDS_REVIEW", [], "missing_value"), "e8": (bl, "OK", [], None),
    }
    payload = sink.build_submission(decisions, sink.load_template(str(folder / "sample_submission.json")))
    assert payload["e2"] == {"payload": {"classification": bl, "result": "MISMATCH", "has_mismatch": True, "defects": ["container_count"], "review_code": None}, "schema_version": 1}
    sink.write_submission(payload, str(tmp_path / "out" / "s.json"))
    assert json.loads((tmp_path / "out" / "s.json").read_text()) == payload
    assert report.violations(decisions).count() == 0
    broken = decisions.withColumn("status", F.when(F.col("email_id") == "e1", "MISMATCH").otherwise(F.col("status")))
    assert report.violations(broken).collect()[0]["violation"] == "mismatch without defects"
    with pytest.raises(sink.SubmissionError):
        sink.build_submission(broken, payload)
    with pytest.raises(sink.SubmissionError, match="ids differ"):
        sink.build_submission(decisions.where("email_id <> 'e3'"), payload)
    with pytest.raises(sink.SubmissionError, match="lacks"):
        sink.validate_submission(spark, payload | {"e2": {"payload": {"result": "OK"}}}, list(payload))
    ids = spark.createDataFrame([(i, n) for n, i in enumerate(sorted(payload, reverse=True))], "email_id string, pos int")
    assert [r["email_id"] for r in sink.in_template_order(decisions, ids).collect()] == sorted(payload, reverse=True)
    verified = decide.verify(emails, files)
    text = {r[0]: r[1] for r in report.explain(verified).collect()}
    assert "\nMISMATCH\n\nDefect fields:\n- container_count\n\nReason:\ncontainer_count differs after normalization\nSI = 4\nBL = 5" in text["e2"]
    assert "Attachment: bl.docx\nDetected type: BL\nSource format: DOCX\nExtraction: DOCX text\nEvidence:\n✓ heading: BILL OF LADING" in text["e2"]
    assert "No attachments found." in text["e6"] and "No safe field comparison was performed." in text["e4"]
    record = {r[0]: json.loads(r[1]) for r in report.diagnostics(verified).collect()}
    assert record["e2"]["selected_documents"] == {"si": "si.txt", "bl": "bl.docx"} and record["e2"]["normalized_values"]["bl"]["container_count"] == "5" and record["e6"]["attachments_detected"] == []
    assert record["e4"]["attachments_detected"][1]["read_error"] == "attachment not found" and record["e7"]["fields_extracted"]["bl"]["notify_party"] == "TBA"
    cards = {r["email_id"]: r for r in report.review_cards(report.review_queue(verified)).collect()}
    assert set(cards) == {"e3", "e4", "e7"} and cards["e4"]["issue"] == "si.txt: plain text · lost_BL.pdf: attachment not found" and cards["e7"]["reason"] == "Missing Value" and len(cards["e4"]["evidence"]) == 4
    items = report.attachment_items(verified).where("email_id = 'e2'").orderBy("att_pos").collect()
    assert [(r["filename"], r["detected_type"]) for r in items] == [("si.txt", "SI"), ("bl.docx", "BL")]
    whole = verified.where("email_id = 'e2'").select(report.comparison_record(F.col("comparisons")).alias("c")).first()["c"]
    assert (whole["status"], whole["is_match"], whole["mismatched_fields"], whole["fields"][5]["label"]) == ("mismatch", False, ["container_count"], "container count")
    assert report.one(decisions, "e1").count() == 1
    with pytest.raises(LookupError):
        report.one(decisions, "nobody")


def test_partition_count_does_not_matter(spark, folder):
    emails, files = bundle.read_bundle(spark, str(folder))
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, decide.decide(emails.repartition(int(n)), files.repartition(int(n))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_stream_decides_as_the_batch_does(spark, folder, tmp_path):
    from shipcheck.streaming.inbox import verify_stream

    seen = []
    verify_stream(spark, str(folder), str(tmp_path / "cp"), lambda d, n: seen.extend(map(str, d.select(*decide.DECISION).collect()))).awaitTermination(240)
    assert sorted(seen) == sorted(map(str, decide.decide(*bundle.read_bundle(spark, str(folder))).collect()))


def test_bad_inboxes(spark, tmp_path):
    (tmp_path / "a" / "inbox").mkdir(parents=True)
    (tmp_path / "a" / "inbox" / "x.json").write_text('[{"id": "1"}, {"id": "1"}]')
    with pytest.raises(ValueError, match="one id each"):
        bundle.read_bundle(spark, str(tmp_path / "a"))


def test_http_and_audit(spark, folder, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from shipcheck.sources import audit, http

    got = []

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, data):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            if self.path == "/inbox":
                mails = [{"id": "h1", "subject": "Two drafts to compare: SI and BL", "attachments": ["attachments/si.txt", {"filename": "bl.txt", "content": BL}]}, {"id": "h2", "subject": "Two drafts to compare: SI and BL", "attachments": ["attachments/gone.txt"]}]
                return self._reply(json.dumps({"emails": mails}).encode())
            file = folder / self.path.lstrip("/")
            return self._reply(file.read_bytes()) if file.exists() else self.send_error(404)

        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self._reply(b'{"ok": true}')

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    emails, files = http.read_inbox(spark, base + "/inbox")
    decisions = decide.decide(emails, files)
    assert {r["email_id"]: (r["status"], r["review_reason"]) for r in decisions.collect()} == {"h1": ("OK", None), "h2": ("NEEDS_REVIEW", "unreadable")}
    assert http.submit({"a": "é"}, base) == {"ok": True} and got == [{"a": "é"}]
    verified = decide.verify(emails, files)
    out = audit.write_audit(verified, emails, str(tmp_path / "r" / "audit.html"), problems_only=True, seconds=2.0)
    page = (tmp_path / "r" / "audit.html").read_text()
    assert out.included_ids == ["h2"] and out.included_count == 1 and "NEEDS_REVIEW" in page and "1.00 emails/sec" in page and "NOT COMPARED" in page
    audit.write_audit(verified, emails, str(tmp_path / "r" / "all.html"))
    assert "<td>4<td>4<td>MATCH" in (tmp_path / "r" / "all.html").read_text()
    with pytest.raises(ValueError, match="without a decision"):
        audit.write_audit(verified.where("email_id = 'h1'"), emails, str(tmp_path / "x.html"))
    server.shutdown()


def test_inbox_shapes(spark, tmp_path):
    """Known names, the only JSON beside the template, single files, an index, attachments beside the folder, encoded bytes."""
    import base64

    def decided(path):
        return {r["email_id"]: (r["status"], r["review_reason"]) for r in decide.decide(*bundle.read_bundle(spark, str(path))).collect()}

    mail = {"subject": "Two drafts to compare: SI and BL", "body": "Both are below."}
    (tmp_path / "attachments").mkdir()
    (tmp_path / "attachments" / "si.txt").write_text(SI)
    (tmp_path / "attachments" / "far.txt").write_text(BL)
    (tmp_path / "one").mkdir()
    index = {"A1": {"filename": "bl.txt", "content": BL}, "A2": {"path": "si.txt"}}
    doc = base64.b64encode(docx(*BL.split("\n"))).decode()
    payload = {"messages": [
        mail | {"id": "m1", "attachments": ["si.txt"], "attachment_ids": ["A1"]}, mail | {"id": "m2", "attachments": ["A2", {"id": "A1", "filename": "bl.txt"}]},
        mail | {"id": "m3", "attachments": ["si.txt", {"filename": "bl.docx", "content_base64": doc}]}, mail | {"id": "m4", "attachments": ["si.txt", str(tmp_path / "attachments" / "far.txt")]},
        mail | {"id": "m5", "attachments": ["si.txt", "http://127.0.0.1:9/bl.txt"]}]}
    (tmp_path / "one" / "anything.json").write_text(json.dumps(payload | {"attachments": index}))
    (tmp_path / "one" / "Sample_Submission.json").write_text("{}")
    ok, bad = ("OK", None), ("NEEDS_REVIEW", "unreadable")
    assert decided(tmp_path / "one") == decided(tmp_path / "one" / "anything.json") == {"m1": ok, "m2": ok, "m3": ok, "m4": ok, "m5": bad}
    listed = [x | {"id": k} for k, x in index.items()]
    (tmp_path / "one" / "emails.json").write_text(json.dumps({"data": payload["messages"][:2], "attachments": listed}))  # a known name comes first
    assert decided(tmp_path / "one") == {"m1": ok, "m2": ok}
    (tmp_path / "one" / "inbox.json").write_text(json.dumps({"k1": mail | {"id": "other", "attachment_ids": ["A1"]}, "k2": mail | {"email_id": "own"}}))
    assert set(decided(tmp_path / "one")) == {"k1", "own"}  # a key is an id unless the email has one of its own under that name
    for text, error in (('{"a": 1}', "neither a list"), ("[", "MALFORMED"), ("[]", "one id each")):
        (tmp_path / "one" / "inbox.json").write_text(text)
        with pytest.raises(Exception, match=error):
            decided(tmp_path / "one")
    with pytest.raises(ValueError, match="no inbox"):
        bundle.read_bundle(spark, str(tmp_path / "attachments"))


def test_relative_paths(spark, folder):
    import os

    emails, files = bundle.read_bundle(spark, os.path.relpath(folder) + "/")
    assert files.where("read_error is not null").count() == 1 and emails.count() == 8


def test_paths(spark):
    assert one(spark, bundle.contained, "attachments/a.txt", "../x", "/etc/passwd", "a/../b.txt", "a/../../b", "./Attachments/q", "..", None) == ["a.txt", None, "passwd", "b.txt", None, "q", None, None]
    assert one(spark, lambda c: bundle.candidates(c, ["/r", "/s"]), "x/a.txt", "/abs/b") == [["/r/x/a.txt", "/r/attachments/a.txt", "/s/x/a.txt", "/s/attachments/a.txt"], ["/abs/b"]]


def test_pdf_forms():
    cmap = b"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0053> <0002> <0049> endbfchar 1 beginbfrange <0010> <0019> <0030> endbfrange endcmap"
    font = b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>"
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents 8 0 R /Resources << /Font << /F1 5 0 R >> >> >>"), (5, font)]
    at, head = 0, b""
    for n, body in inner:
        head += b"%d %d " % (n, at)
        at += len(body) + 1
    packed = zlib.compress(head + b"\n".join(b for _, b in inner))
    stream = lambda n, extra, data: b"%d 0 obj\n<< %s /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (n, extra, len(data), data)
    content = b"BT /F1 12 Tf <00010002> Tj T* [<00100011> -20 <001200130014001500160017>] TJ ET"
    file = b"%PDF-1.5\n" + stream(7, b"/Type /ObjStm /N 4 /First %d /Filter /FlateDecode" % len(head), packed) + stream(8, b"", content) + stream(9, b"/Filter /FlateDecode", zlib.compress(cmap))
    assert decode.pdf_text(file) == ("SI\n01234567", "embedded text")


def test_ocr_seam(spark, tmp_path):
    """Scans are read by a given function from bytes to pages; its doubtful pages don't count, and gaps make the email unreadable."""
    scan = pdf(["x"])
    pages = lambda data: [(BL, [("BILL", 90.0), ("", 1.0), ("x", -1)]), ("noise noise noise", [("noise", 12.0)])]
    assert decode.pdf_text(scan, pages) == (BL, "OCR")
    for ocr in (None, lambda d: [("few", [])], lambda d: [(BL, [("a", 29.0)])]):
        with pytest.raises(ValueError, match="no usable embedded text"):
            decode.pdf_text(scan, ocr)
    assert decode.mean_confidence([(" ", 5.0), ("a", -1)]) == 0
    (tmp_path / "attachments").mkdir()
    (tmp_path / "attachments" / "bl.pdf").write_bytes(scan)
    (tmp_path / "inbox.json").write_text(json.dumps([{"id": i, "subject": "Two drafts to compare: SI and BL", "attachments": [{"filename": "si.txt", "text": SI}, "bl.pdf"]} for i in ("s1",)]))
    for text, want in ((BL, ("OK", None)), (BL.replace("Consignee", "Someone"), ("NEEDS_REVIEW", "unreadable"))):
        emails, files = bundle.read_bundle(spark, str(tmp_path), ocr=lambda data, text=text: [(text, [("w", 80.0)])])
        assert decide.decide(emails, files).select("status", "review_reason").first() == want


def test_command_line(spark, folder, tmp_path, capsys):
    from shipcheck.plans import run

    base = ["--source", str(folder)]
    for wrong in (["--explain"], ["--open-attachments"], ["--report-only-problems"], ["--workers", "-1"], ["--email", "nobody"]):
        assert run.main([*base, *wrong]) == 2 and capsys.readouterr().err.startswith("error: ")
    assert run.main(["--source", str(tmp_path / "none")]) == 2
    out = tmp_path / "s.json"
    assert run.main([*base, "--output", str(out), "--benchmark", "--report", str(tmp_path / "a.html"), "--report-only-problems"]) == 0
    said = capsys.readouterr().out
    assert "for 8 emails" in said and "audit report for 4 emails" in said and "BL comparisons: 7" in said and len(json.loads(out.read_text())) == 8
    assert run.main([*base, "--email", "e2", "--explain", "--open-attachments"]) == 0
    said = capsys.readouterr().out
    assert said.startswith("EMAIL: e2\n") and "/attachments/si.txt" in said
    assert run.main([*base, "--email", "e2"]) == 0 and json.loads(capsys.readouterr().out)["final_status"] == "MISMATCH"


def test_unicode_white_space(spark):
    assert one(spark, t.normalize_weight, "12\u00a0500 KG", "12\u202f500,5 kg", "12 500\u00a0KG", "\u00a07\u2003MT") == [None, None, "12500", "7000"]
    rows = [("e", 0, "a.txt", "SHIPPING\u00a0INSTRUCTION", None), ("e", 1, "b.txt", "BILL\u202fOF\u00a0LADING", None), ("e", 2, "c.txt", "\u2003packing\u00a0list", None)]
    assert [r["document_type"] for r in identify.assess(attachments(spark, rows)).orderBy("att_pos").collect()] == ["SI", "BL", "OTHER"]


def test_ties_and_types(spark):
    rows = [("e", i, f"{n}.txt", c, None) for i, (n, c) in enumerate([("x", "SHIPPING INSTRUCTION"), ("y", "SHIPPING INSTRUCTION"), ("z", "BILL OF LADING")])]
    e = spark.createDataFrame([("e",)], "email_id string")
    assert identify.select_documents(e, identify.assess(attachments(spark, rows))).first()["review_reason"] == "wrong_doc_type"
    d = spark.createDataFrame([("SHIPPING INSTRUCTION", "a"), ("bill of lading", "a"), ("bill of lading instruction", "a"), ("si and bol", "a"), ("x", "y")], "c string, n string")
    assert [r[0] for r in d.select(extract.titled_kind(F.col("c"), F.col("n"))).collect()] == ["si", "bl", "si", None, None]


def test_for_people(spark):
    assert one(spark, t.humanize, "missing_value", "BL_COMPARISON", None, "") == ["Missing Value", "BL COMPARISON", "—", "—"]
    n = spark.createDataFrame([(0.25, 300, 1, 9_876_543), (2.5, 5_000_000, None, None)], "s double, b long, d long, n long")
    got = n.select(t.show_duration(F.col("s")), t.show_bytes(F.col("b")), t.show_date(F.col("d")), t.show_number(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("250 ms", "0 KB", "Jan 1, 1970, 12:00 AM", "9,876,543"), ("2.50 s", "4.77 MB", "—", None)]
    assert one(spark, lambda c: t.joined(F.when(c == "x", F.array(F.lit(" a  b "), F.lit(None), F.lit("")))), "x", "y") == ["a b; -", "-"]
    assert one(spark, report.shown_reason, "SI signal", "action: check", "other") == ["SI detected", "comparison wording detected (check)", "other"]


def test_plans_stay_small(spark, folder):
    """Values are bound once: no expression repeats itself, and emails, summaries and contents are exchanged once each."""
    import pathlib

    d = spark.createDataFrame([("1 kg",)], "v string")
    assert len(d.select(t.normalize_weight(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()) < 8_000
    sf = "/root/testdata/sf0.001"
    if pathlib.Path(sf).is_dir():
        from shipcheck.plans import bridge

        emails, files = bridge.emails_and_attachments(spark, sf)
        for n, (d, most) in enumerate(((emails, 0), (decide.decide(emails, files), 100_000))):
            text = d._jdf.queryExecution().optimizedPlan().toString()
            assert not most or len(text) < most
        emails, files = emails.repartition("email_id"), files.repartition("email_id")
        plan = decide.compare(files.select("email_id", F.lit("SI").alias("role"), "content"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") <= 3
