"""The audit report: a summary, then one section per email, as HTML."""

from __future__ import annotations

import re
import shutil
import uuid
from html import escape
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.text import display, joined
from ..operators import report
from .fetch import store
from .inbox_format import listed
from .shared import materialise, numbered, shared_dir


class Audit(NamedTuple):
    path: str
    included_count: int
    index: DataFrame  # email_id, number, part, offset, length: where each section lies

    @property
    def included_ids(self) -> list[str]:
        """The ids in order; for reports that a person reads, not for large ones."""
        return [r[0] for r in self.index.orderBy("number").select("email_id").collect()]


#: Sections of a part.
PART = 1000


def _table(head: list[str], rows) -> str:
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{escape(str(c))}" for c in cells)
    return "<table>" + (line("th", head) if head else "") + "".join(line("td", r) for r in rows) + "</table>"


def escaped(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def _cells(cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), escaped(F.coalesce(c, F.lit("None"))))), ""))


def _pairs(*rows: tuple[str, str]) -> Column:
    return F.concat(F.lit("<table>"), *[_cells(F.array(F.lit(name), F.col(c))) for name, c in rows], F.lit("</table>"))


def _lists(head: list[str], rows: Column) -> Column:
    return F.concat(F.lit(_table(head, [])[: -len("</table>")]), F.array_join(F.transform(rows, _cells), ""), F.lit("</table>"))


def rendered_sections(verified: DataFrame, *keep: str) -> DataFrame:
    """email_id, `keep`, html: each email's section, made where its row lies; its line ends are those of its explanation."""
    none = F.array(F.array(*[F.lit(x) for x in ("No attachments", "-", "-", "-", "-")]))
    return sections(verified, *keep).select("email_id", *keep, F.concat(
        F.lit("<h2>Email audit: "), escaped(F.col("email_id")), F.lit("</h2>"), _pairs(("Email ID", "email_id"), ("Subject", "subject"), ("Category", "category"), ("Evidence", "evidence")),
        _lists(["Attachment", "Detected type", "Evidence", "Source format", "Extraction"], F.when(F.size("files") > 0, F.col("files")).otherwise(none)),
        F.when(F.size("fields") > 0, _lists(["Field", "SI raw", "BL raw", "SI normalized", "BL normalized", "Result"], F.col("fields"))).otherwise(""),
        _pairs(("Final status", "status"), ("Defect fields", "defects"), ("Review reason", "reason")), F.lit("<pre>"), escaped(F.col("explanation")), F.lit("</pre>"),
    ).alias("html"))


def audit_parts(verified: DataFrame, part: int = PART) -> DataFrame:
    """email_id, number, part, offset, length, html: sections in id order, numbered from 1 over all emails, in parts of `part` sections each;
    offset and length are bytes in the part's file, where each section is a line of its own (or several).

    Emails are decided once and written: the range exchange, which samples them first, reads what lies there, and sections are
    rendered behind it, so no text of theirs moves for their numbers."""
    rows = materialise(verified.select(*_EVIDENCE), "auditrows")
    d = rendered_sections(numbered(rows, "email_id", "auditsections", "_place"), "_place")
    d = d.select("email_id", (F.col("_place") + 1).alias("number"), F.expr(f"_place div {part}").alias("part"), F.octet_length("html").cast("long").alias("length"), "html")
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("offset", F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0))).select("email_id", "number", "part", "offset", "length", "html")


#: What a section is made of.
_EVIDENCE = ["email_id", "subject", "category", "status", "defect_fields", "review_reason", "classification_reasons", "attachments", "comparisons"]


def sections(verified: DataFrame, *keep: str) -> DataFrame:
    """email_id, `keep`, subject, category, evidence, files, fields, status, defects, reason, explanation: what an email's section shows, nulls as dashes."""
    value = lambda c: display(c, none="-")
    files = F.transform("attachments", lambda a: F.array(
        value(a["filename"]), F.when(report._examined(), value(a["document_type"])).otherwise("Not evaluated"), F.when(report._examined(), joined(a["reasons"])).otherwise("Not evaluated (not a BL comparison)"), a["source_format"], a["extraction"]))
    fields = F.when(report._examined(), F.transform(report._field_spine(), lambda f: F.array(f["field"], *[value(f[c]) for c in ("si_raw", "bl_raw", "si_norm", "bl_norm")], f["audit_result"])))
    return verified.select(
        "email_id", *keep, value(F.col("subject")).alias("subject"), "category", joined(F.col("classification_reasons")).alias("evidence"), files.alias("files"), fields.alias("fields"),
        value(F.col("status")).alias("status"), joined(F.col("defect_fields")).alias("defects"), value(F.col("review_reason")).alias("reason"), report.explanation().alias("explanation"),
    )


def summary_page(known: DataFrame, shown: int, problems_only: bool, seconds: float) -> str:
    """The head of the report: a row for each count and label."""
    m = report.metrics(known, seconds).first()
    scope = "Problem decisions only" if problems_only else "All processed email decisions"
    of = lambda c, names, zeros: [(r["label"], r["n"]) for r in report.distribution(known, c, names, zeros).orderBy("ord").collect()]  # noqa: E731  (a row per label)
    return "".join([
        "<!doctype html><meta charset=utf-8><title>Decision audit</title><h1>Decision audit</h1><h2>Summary</h2>",
        _table([], [("Emails processed", m["processed"]), ("Emails in this report", shown), ("Scope", scope), ("Runtime", f"{m['runtime_seconds']:.2f} seconds"), ("Throughput", f"{m['throughput']:.2f} emails/sec"),
                    ("Comparisons", m["comparisons"]), ("OK", m["ok"]), ("MISMATCH", m["mismatch"]), ("NEEDS_REVIEW", m["needs_review"])]),
        _table(["Category", "Count"], of("category", v.CATEGORIES, True)), _table(["Review reason", "Count"], of("review_reason", sorted(v.REVIEW_REASONS), False) or [("None", 0)]),
    ])


def write_audit_parts(verified: DataFrame, emails: DataFrame, folder: str, problems_only: bool = False, seconds: float = 0.0, part: int = PART) -> Audit:
    """The report as a folder: summary.html, parts/part=N/*.txt (sections, one behind the other) and index/ (where each email's section lies).

    Of all decisions, or of those that aren't OK; emails without a decision are an error.  Sections are made, numbered and
    written by the executors; the driver sees counts alone."""
    known = report.decided(verified, emails)
    lacking = [r[0] for r in report.undecided(emails, verified).select("email_id").orderBy("email_id").limit(5).collect()]
    if lacking:
        raise ValueError(f"there are emails without a decision: {lacking}")
    parts = materialise(audit_parts(report.problems(known) if problems_only else known, part), "auditparts")
    parts.repartition("part").sortWithinPartitions("part", "number").select("part", F.col("html").alias("value")).write.partitionBy("part").text(f"{folder}/parts")
    parts.drop("html").repartitionByRange("email_id").sortWithinPartitions("email_id").write.parquet(f"{folder}/index")
    index = verified.sparkSession.read.parquet(f"{folder}/index")
    at, path = store(folder)
    with at.open_output_stream(f"{path}/summary.html") as f:
        f.write(summary_page(known, count := index.count(), problems_only, seconds).encode())
        if not count:
            f.write(b"<p>No MISMATCH or NEEDS_REVIEW decisions were included.")
    return Audit(folder, count, index)


def write_audit(verified: DataFrame, emails: DataFrame, path: str, problems_only: bool = False, seconds: float = 0.0) -> Audit:
    """The same as one HTML file, put together from the parts' files in order; a part is never held as a whole."""
    done = write_audit_parts(verified, emails, f"{shared_dir(verified.sparkSession)}/audit-{uuid.uuid4().hex}", problems_only, seconds)
    at, folder = store(done.path)
    files = [f"{folder}/summary.html", *sorted((x.path for x in listed(f"{done.path}/parts", (".txt",), True)), key=lambda p: int(re.search(r"/part=(\d+)/", p)[1]))]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as f:
        for name in files:
            with at.open_input_stream(name) as g:
                shutil.copyfileobj(g, f)
    return Audit(path, done.included_count, done.index)
