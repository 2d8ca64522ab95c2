"""Summary, search, review queue, details, explanations and checks over decisions.

`decisions` are rows of decide(); `verified` are rows of verify(), which hold the evidence as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.text import cell, display, humanize, let


def _none(kind: str = "string") -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


# --- counts


def throughput(processed: Column, seconds: Column) -> Column:
    """Emails a second; 0 if no time was measured."""
    return F.when(seconds > 0, processed / seconds).otherwise(0.0)


def metrics(decisions: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: processed, comparisons, ok, mismatch, needs_review; with `seconds` of work also runtime_seconds and throughput, rounded."""
    is_ = lambda s: F.count_if(F.coalesce(F.col("status") == s, F.lit(False)))
    d = decisions.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("category") == "BL_COMPARISON").alias("comparisons"), is_("OK").alias("ok"), is_("MISMATCH").alias("mismatch"), is_("NEEDS_REVIEW").alias("needs_review"))
    if seconds is None:
        return d
    return d.withColumns({"runtime_seconds": F.round(F.lit(float(seconds)), 3), "throughput": F.round(throughput(F.col("processed"), F.lit(float(seconds))), 2)})


def counts(decisions: DataFrame, column: str, nulls: bool = False) -> DataFrame:
    d = decisions if nulls else decisions.where(F.col(column).isNotNull())
    return d.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def distribution(decisions: DataFrame, column: str, labels: list[str], zeros: bool) -> DataFrame:
    """label, ord, n in the labels' order; labels without rows are there with 0, or left out."""
    spark = decisions.sparkSession
    spine = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(x).alias("label")) for i, x in enumerate(labels)])))
    d = spine.join(counts(decisions, column), "label", "left" if zeros else "inner")
    return d.select("label", "ord", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def labels(rows: DataFrame, column: str) -> DataFrame:
    """label: the distinct values of a column, in order; nulls are none."""
    return rows.where(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct().orderBy("label")


# --- lists


def notable(decisions: DataFrame, n: int = 8) -> DataFrame:
    rank = F.when(F.col("status") == "NEEDS_REVIEW", 0).when(F.col("status") == "MISMATCH", 1).when(F.col("status") == "OK", 2).otherwise(3)
    return decisions.withColumn("rank", rank).orderBy("rank", "email_id").limit(n)


def list_items(decisions: DataFrame, emails: DataFrame | None = None) -> DataFrame:
    """email_id, subject, category, status, review_reason, defect_count; the subject from emails, unless decisions have it."""
    d = decisions if emails is None else decisions.join(emails.select("email_id", "subject"), "email_id")
    return d.select("email_id", "subject", "category", "status", "review_reason", F.size("defect_fields").alias("defect_count"))


def search(items: DataFrame, query: str = "", category: str = "", status: str = "", review_reason: str = "") -> DataFrame:
    """Rows whose id or subject holds the query (case-insensitive, trimmed) and that equal every filter given."""
    q = query.strip().lower()
    if q:
        items = items.where(F.lower("email_id").contains(q) | F.lower("subject").contains(q))
    for column, value in (("category", category), ("status", status), ("review_reason", review_reason)):
        if value:
            items = items.where(F.col(column) == value)
    return items


def one(rows: DataFrame, email_id: str) -> DataFrame:
    """The row of one email; without it, an error."""
    found = rows.where(F.col("email_id") == email_id)
    if found.isEmpty():
        raise LookupError(f"no email {email_id}")
    return found


def problems(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("status").isin("MISMATCH", "NEEDS_REVIEW"))


def review_queue(verified: DataFrame) -> DataFrame:
    """Emails that need review: the list item, attachments without their assessments, and evidence (the
    classification's reasons, then each attachment's)."""
    d = verified.where(F.col("status") == "NEEDS_REVIEW")
    why = F.flatten(F.transform("attachments", lambda a: a["reasons"]))
    shown = F.transform("attachments", lambda a: F.struct(*[a[c].alias(c) for c in ("filename", "source_format", "extraction", "read_error")]))
    return d.select(
        "email_id", "subject", "category", "status", "review_reason", F.size("defect_fields").alias("defect_count"),
        F.coalesce(shown, _none("struct<filename:string,source_format:string,extraction:string,read_error:string>")).alias("attachments"),
        F.concat("classification_reasons", F.coalesce(why, _none())).alias("evidence"),
    )


def review_cards(queue: DataFrame, most: int = 4) -> DataFrame:
    """email_id, subject, reason (for people), issue (each attachment's error, or how it was read) and at most `most` pieces of evidence."""
    issue = F.array_join(F.transform("attachments", lambda a: F.concat(a["filename"], F.lit(": "), F.coalesce(a["read_error"], a["extraction"], F.lit("extraction unavailable")))), " · ")
    return queue.select(
        "email_id", F.coalesce(F.nullif("subject", F.lit("")), F.lit("No subject")).alias("subject"), humanize(F.col("review_reason")).alias("reason"),
        F.coalesce(F.nullif(issue, F.lit("")), F.lit("No attachments were available")).alias("issue"), F.slice("evidence", 1, most).alias("evidence"),
    )


# --- details


def extraction_status(category: Column, status: Column) -> Column:
    return F.when(status == "NEEDS_REVIEW", "INCOMPLETE").when(category == "BL_COMPARISON", "COMPLETE").otherwise("NOT_REQUIRED")


def _was_compared() -> Column:
    return F.col("status").isin("OK", "MISMATCH")


def _examined() -> Column:
    return F.col("category") == "BL_COMPARISON"


def _field_spine() -> Column:
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_ord")) for i, f in enumerate(v.FIELDS)])
    at = lambda x, c: F.get(F.col("comparisons"), x["field_ord"])[c]
    return F.transform(items, lambda x: F.struct(
        x["field"].alias("field"), x["field_ord"].alias("field_ord"), *[at(x, c).alias(to) for c, to in (("si_raw", "si_raw"), ("si_value", "si_norm"), ("bl_raw", "bl_raw"), ("bl_value", "bl_norm"))],
        F.when(_was_compared(), F.upper(at(x, "status"))).otherwise("UNAVAILABLE").alias("result"), F.when(_was_compared(), F.when(at(x, "status") == "match", "MATCH").otherwise("MISMATCH")).otherwise("NOT COMPARED").alias("audit_result"),
    ))


def detail(verified: DataFrame) -> DataFrame:
    """For comparison emails a row per field: raw and normal values of both sides, result (UNAVAILABLE if not compared), and its form in the audit."""
    return verified.where(_examined()).select("email_id", _field_spine().alias("_f")).select("email_id", F.inline("_f"))


def _assessed(a: Column, attachments: Column, by_name: bool) -> Column:
    """The assessment shown for an attachment: its own, or (as lists by name hold one for a name) the last one of its name."""
    last = F.try_element_at(F.filter(attachments, lambda b: b["filename"] == a["filename"]), F.lit(-1)) if by_name else a
    return last


def attachment_items(verified: DataFrame, by_name: bool = True) -> DataFrame:
    """email_id and a row per attachment, in order: filename, source_format, extraction, read_error, detected_type, evidence
    (null and empty where the email is no comparison)."""
    rows = F.transform("attachments", lambda a: let(_assessed(a, F.col("attachments"), by_name), lambda b: F.struct(
        *[a[c].alias(c) for c in ("att_pos", "filename", "source_format", "extraction", "read_error")],
        F.when(_examined(), b["document_type"]).alias("detected_type"), F.when(_examined(), b["reasons"]).otherwise(_none()).alias("evidence"),
    )))
    return verified.select("email_id", F.inline(rows))


def _chosen(pos: str) -> Column:
    return F.get(F.filter("attachments", lambda a: a["att_pos"] == F.col(pos)), F.lit(0))["filename"]


def _field_map(c: str) -> Column:
    """The seven fields to their values, in canonical order; null where no document was read."""
    return F.when(F.col("comparisons").isNotNull(), F.map_from_arrays(F.array(*map(F.lit, v.FIELDS)), F.transform("comparisons", lambda x: x[c])))


def comparison_record(items: Column) -> Column:
    """A comparison as one struct: status, is_match, mismatched_fields, fields (field, label, si, bl, status, match)."""
    label = F.create_map(*[F.lit(x) for kv in v.DISPLAY.items() for x in kv])
    fields = F.transform(items, lambda x: F.struct(x["field"].alias("field"), F.try_element_at(label, x["field"]).alias("label"), x["si_value"].alias("si"), x["bl_value"].alias("bl"), x["status"].alias("status"), (x["status"] == "match").alias("match")))
    wrong = F.transform(F.filter(items, lambda x: x["status"] != "match"), lambda x: x["field"])
    status = F.when(F.size(wrong) == 0, "match").when(F.exists(items, lambda x: x["status"].startswith("missing")), "incomplete").otherwise("mismatch")
    return F.struct(status.alias("status"), (F.size(wrong) == 0).alias("is_match"), wrong.alias("mismatched_fields"), fields.alias("fields"))


def diagnostics(verified: DataFrame) -> DataFrame:
    """email_id, record: everything known about a decision, as JSON (null values are kept)."""
    seen = F.when(_examined(), F.transform("attachments", lambda a: F.struct(
        *[a[c].alias(c) for c in ("filename", "source", "source_format", "extraction", "read_error")], a["document_type"].alias("detected_type"), a["si_score"].alias("si_score"), a["bl_score"].alias("bl_score"), a["reasons"].alias("evidence"))))
    record = F.struct(
        "email_id", "category", "classification_reasons", F.coalesce(seen, F.expr("array()").cast(_DETECTED)).alias("attachments_detected"),
        F.struct(_chosen("si_pos").alias("si"), _chosen("bl_pos").alias("bl")).alias("selected_documents"),
        F.struct(_field_map("si_raw").alias("si"), _field_map("bl_raw").alias("bl")).alias("fields_extracted"),
        F.struct(_field_map("si_value").alias("si"), _field_map("bl_value").alias("bl")).alias("normalized_values"),
        F.col("status").alias("final_status"), "has_defect", "defect_fields", "review_reason",
    )
    return verified.select("email_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


_DETECTED = "array<struct<filename:string,source:string,source_format:string,extraction:string,read_error:string,detected_type:string,si_score:int,bl_score:int,evidence:array<string>>>"


# --- explanation


def shown_reason(reason: Column) -> Column:
    """A classification reason for people."""
    return (
        F.when(reason == "SI signal", "SI detected").when(reason == "BL signal", "BL detected")
        .when(reason.startswith("action: "), F.concat(F.lit("comparison wording detected ("), F.substring(reason, 9, 1 << 20), F.lit(")"))).otherwise(reason)
    )


def shown_evidence(reason: Column) -> Column:
    """A piece of document evidence for people."""
    lead = "content heading: "
    return F.when(reason.startswith(lead), F.concat(F.lit("heading: "), F.upper(F.substring(reason, len(lead) + 1, 1 << 20)))).otherwise(reason)


def _ticked(items: Column, none: str, shown) -> Column:
    return F.transform(F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(none))), lambda x: F.concat(F.lit("✓ "), shown(x)))


def explanation() -> Column:
    """Of a row of verify: the decision and all evidence for it, in sections, as one text."""
    text = lambda *cs: F.array(*[c if isinstance(c, Column) else F.lit(c) for c in cs])
    none = _none()
    file = lambda a, kind: text(F.concat(F.lit("Attachment: "), a["filename"]), F.concat(F.lit("Detected type: "), kind), F.concat(F.lit("Source format: "), a["source_format"]), F.concat(F.lit("Extraction: "), a["extraction"]))
    files_of = F.transform("attachments", lambda a, i: F.concat(
        F.when(i > 0, text("")).otherwise(none), file(a, F.coalesce(a["document_type"], F.lit("UNRESOLVED"))), text("Evidence:"), _ticked(a["reasons"], "no SI/BL identification signal", shown_evidence)))
    others = F.transform("attachments", lambda a: file(a, F.lit("not evaluated (not a BL comparison)")))
    files = F.when(F.coalesce(F.size("attachments"), F.lit(0)) == 0, text("No attachments found.")).when(_examined(), F.flatten(files_of)).otherwise(F.flatten(others))
    head = f"{'Field':<22} {'SI':<29} {'BL':<29} Result"
    rows = F.transform("comparisons", lambda x: F.concat_ws(" ", cell(x["field"], 22), cell(x["si_value"], 29), cell(x["bl_value"], 29), F.upper(x["status"])))
    table = F.when(_was_compared() & F.col("comparisons").isNotNull(), F.concat(text(head, "-" * 89), rows)).otherwise(text("No safe field comparison was performed."))
    wrong = F.filter("comparisons", lambda x: x["status"] != "match")
    differs = F.flatten(F.transform(wrong, lambda x: text(F.concat(x["field"], F.lit(" differs after normalization")), F.concat(F.lit("SI = "), display(x["si_value"])), F.concat(F.lit("BL = "), display(x["bl_value"])))))
    final = (
        F.when(F.col("status") == "MISMATCH", F.concat(text("", "Defect fields:"), F.transform("defect_fields", lambda f: F.concat(F.lit("- "), f)), text("", "Reason:"), F.coalesce(differs, none)))
        .when(F.col("status") == "NEEDS_REVIEW", text("", "Reason:", F.coalesce("review_reason", F.lit("unreadable"))))
        .when(F.col("status") == "OK", text("", "Reason:", "all seven required fields match after normalization")).otherwise(none)
    )
    out = F.concat(
        text(F.concat(F.lit("EMAIL: "), "email_id"), F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit(""))), "", "CLASSIFICATION", F.concat(F.lit("Decision: "), "category"), "", "Why:"),
        _ticked(F.col("classification_reasons"), "no category-specific rule signal; default GENERAL rule applied", shown_reason),
        text("", "DOCUMENT IDENTIFICATION", ""), files, text("", "FIELD COMPARISON", ""), table, text("", "FINAL DECISION", "", F.coalesce("status", F.lit("Not applicable"))), final,
    )
    return F.array_join(out, "\n")


def explain(verified: DataFrame) -> DataFrame:
    """email_id, explanation."""
    return verified.select("email_id", explanation().alias("explanation"))


# --- checks


def violations(decisions: DataFrame) -> DataFrame:
    """email_id, violation: every decision that breaks an invariant, and ids that occur twice."""
    c, s, r = F.col("category"), F.col("status"), F.col("review_reason")
    bad = F.col("defect_fields")
    empty = F.size(bad) == 0
    rule = (
        F.when(c.isNull() | ~c.isin(v.CATEGORIES), "unknown category")
        .when(F.col("has_defect").isNull() | bad.isNull(), "defect columns missing")
        .when(F.size(F.array_except(bad, F.array(*map(F.lit, v.FIELDS)))) > 0, "unknown defect field")
        .when(F.size(F.array_distinct(bad)) < F.size(bad), "repeated defect field")
        .when((c != "BL_COMPARISON") & (s.isNotNull() | F.col("has_defect") | ~empty | r.isNotNull()), "comparison values on another category")
        .when((c == "BL_COMPARISON") & (s.isNull() | ~s.isin(v.STATUSES)), "unknown status")
        .when((s == "OK") & (F.col("has_defect") | ~empty | r.isNotNull()), "defects on OK")
        .when((s == "MISMATCH") & (~F.col("has_defect") | empty | r.isNotNull()), "mismatch without defects")
        .when((s == "NEEDS_REVIEW") & (F.col("has_defect") | ~empty | r.isNull() | ~r.isin(v.REVIEW_REASONS)), "review without reason")
    )
    ids = decisions.select("email_id", rule.alias("violation")).groupBy("email_id").agg(F.collect_list("violation").alias("found"), F.count(F.lit(1)).alias("n"))  # decided once, for both
    return ids.select("email_id", F.explode(F.concat("found", F.when(F.col("n") > 1, F.array(F.lit("duplicate email_id"))).otherwise(_none()))).alias("violation"))


def duplicates(rows: DataFrame, key: str = "email_id") -> DataFrame:
    """key, n: keys that occur more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def undecided(emails: DataFrame, decisions: DataFrame) -> DataFrame:
    """Emails without a decision."""
    return emails.join(decisions.select("email_id"), "email_id", "left_anti")


def decided(emails: DataFrame, decisions: DataFrame) -> DataFrame:
    """Emails with a decision."""
    return emails.join(decisions.select("email_id"), "email_id", "left_semi")


def id_differences(expected: DataFrame, actual: DataFrame, n: int | None = None) -> DataFrame:
    """side, email_id: ids that only one of the two has (the first n of each, if given)."""
    out = None
    for side, a, b in (("missing", expected, actual), ("unknown", actual, expected)):
        d = a.select("email_id").distinct().join(b.select("email_id"), "email_id", "left_anti").select(F.lit(side).alias("side"), "email_id")
        d = d if n is None else d.orderBy("email_id").limit(n)
        out = d if out is None else out.unionByName(d)
    return out


def same_ids(expected: DataFrame, actual: DataFrame) -> bool:
    """Whether both have the same ids, each as often, by one pass without a join: counts and two sums of 64-bit hashes, which don't
    depend on order, are equal."""
    both = expected.select("email_id", F.lit(1).alias("side")).unionByName(actual.select("email_id", F.lit(-1).alias("side")))
    signed = lambda h: F.sum(h.cast("decimal(38,0)") * F.col("side"))
    sums = both.agg(F.sum("side"), signed(F.xxhash64("email_id")), signed(F.xxhash64(F.lit(1), "email_id"))).first()
    return not any(sums)


def differences(expected: DataFrame, actual: DataFrame, n: int | None = None) -> DataFrame:
    """As id_differences; where the fingerprints of both are equal, no rows, and nothing is joined."""
    if same_ids(expected, actual):
        return expected.sparkSession.createDataFrame([], "side string, email_id string")
    return id_differences(expected, actual, n)
