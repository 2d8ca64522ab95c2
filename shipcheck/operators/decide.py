"""Normalise, compare, decide: from extracted fields to one decision per email.

The seven fields of a document stay together in one row, as arrays in canonical order."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.text import containers_rule, forms, let, party_rule, port_rule, weight_rule
from .classify import classify
from .extract import extract_values, field_rows
from .identify import assess, choose, items, summary

#: The rule of each field, in canonical order.
RULES = [party_rule, party_rule, party_rule, port_rule, port_rule, containers_rule, weight_rule]
_SHIPPER, _CONSIGNEE, _NOTIFY = (v.FIELDS.index(f) for f in ("shipper", "consignee", "notify_party"))
Watch = Callable[[str, DataFrame], DataFrame]
#: What an item of a dossier carries beside its assessment.
FIELDS_READ = ["raw", "norm", "ocr"]
DECISION = ["email_id", "category", "status", "has_defect", "defect_fields", "review_reason", "classification_reasons"]


def normalize_values(d: DataFrame, raw: str = "raw", into: str = "norm", unicode: bool = True) -> DataFrame:
    """d with `into`, the normal values of the array column `raw`; a notify party given by reference takes the party it refers to."""
    at = lambda c, i: F.get(c, F.lit(i))
    d = d.withColumn("_forms", forms([at(raw, i) for i in range(len(v.FIELDS))], unicode))

    def resolved(n: Column) -> Column:
        notify = at(n, _NOTIFY)
        party = F.when(notify == v.CONSIGNEE_MARK, at(n, _CONSIGNEE)).when(notify == v.SHIPPER_MARK, at(n, _SHIPPER)).otherwise(notify)
        return F.array(*[party if i == _NOTIFY else at(n, i) for i in range(len(v.FIELDS))])

    values = F.array(*[rule(at(raw, i), at("_forms", i)) for i, rule in enumerate(RULES)])
    return d.withColumn(into, let(values, resolved)).drop("_forms")


def normalize_fields(docs: DataFrame, keys: list[str], unicode: bool = True) -> DataFrame:
    """keys, field, field_ord, raw, norm: a row per field for every row of docs (keys, content)."""
    return field_rows(normalize_values(extract_values(docs), unicode=unicode), keys, raw="raw", norm="norm")


def compared(si: Column, bl: Column) -> Column:
    """From two structs (raw, norm): an array of (field, field_ord, si_raw, bl_raw, si_value, bl_value, status); null if either is null."""

    def one(p: Column) -> Column:
        a, b = p["si_value"], p["bl_value"]
        status = F.when(a.isNull() & b.isNull(), "missing_in_both").when(a.isNull(), "missing_in_si").when(b.isNull(), "missing_in_bl").when(a == b, "match").otherwise("mismatch")
        return F.struct(*[p[c].alias(c) for c in ("field", "field_ord", "si_raw", "bl_raw", "si_value", "bl_value")], status.alias("status"))

    at = lambda side, c, i: F.get(side[c], F.lit(i))
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_ord"), at(si, "raw", i).alias("si_raw"), at(bl, "raw", i).alias("bl_raw"), at(si, "norm", i).alias("si_value"), at(bl, "norm", i).alias("bl_value"))
        for i, f in enumerate(v.FIELDS)
    ])
    return F.when(si.isNotNull() & bl.isNotNull(), F.transform(pairs, one))


def comparison(items: Column) -> Column:
    """match, incomplete or mismatch, from the array of compared fields."""
    return F.when(F.forall(items, lambda x: x["status"] == "match"), "match").when(F.exists(items, lambda x: x["status"].startswith("missing")), "incomplete").when(items.isNotNull(), "mismatch")


def differing(items: Column) -> Column:
    """The fields that don't match, in canonical order."""
    return F.transform(F.filter(items, lambda x: x["status"] != "match"), lambda x: x["field"])


def paired(sides: DataFrame, key: str = "email_id") -> DataFrame:
    """key, comparisons from rows (key, role: SI or BL, raw, norm), by one aggregation; a side without a row has no values."""
    none = F.array(*[F.lit(None).cast("string")] * len(v.FIELDS))
    side = lambda role: F.coalesce(F.first(F.when(F.col("role") == role, F.struct("raw", "norm")), ignorenulls=True), F.struct(none.alias("raw"), none.alias("norm")))
    d = sides.groupBy(key).agg(side("SI").alias("_si"), side("BL").alias("_bl"))
    return d.select(key, compared(F.col("_si"), F.col("_bl")).alias("comparisons"))


def compare(docs: DataFrame, key: str = "email_id", unicode: bool = True) -> DataFrame:
    """key and an array of compared fields for documents (key, role, content)."""
    return paired(normalize_values(extract_values(docs), unicode=unicode), key)


def roll_up(comparisons: DataFrame, key: str = "email_id") -> DataFrame:
    """key, comparison, defect_fields."""
    return comparisons.select(key, comparison(F.col("comparisons")).alias("comparison"), differing(F.col("comparisons")).alias("defect_fields"))


def examine(attachments: DataFrame, unicode: bool = True) -> DataFrame:
    """attachments, assessed, with raw and norm (the seven fields of those that may be an SI or a BL) and ocr; row by row.

    attachments(email_id, att_pos, filename, type_hint, extraction, read_error, content)."""
    a = assess(attachments)
    a = a.withColumn("_text", F.when(F.col("readable") & F.col("document_type").isin("SI", "BL"), F.col("content")))
    a = normalize_values(extract_values(a, "_text"), unicode=unicode).drop("_text")
    return a.withColumn("ocr", F.coalesce(F.lower("extraction").startswith("ocr"), F.lit(False)))


def _unwatched(stage: str, d: DataFrame) -> DataFrame:
    """Decisions pass an observation all the same: a filter on them isn't pushed below it, where it would repeat the
    whole chain of expressions for every column it names."""
    return d.observe(f"decisions {uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows")) if stage == "compare" else d


def dossiers(emails: DataFrame, attachments: DataFrame, unicode: bool = True, watch: Watch = _unwatched) -> DataFrame:
    """emails with `items`, all that is known of their attachments: these are examined where they lie, and no content moves."""
    examined = watch("extract", examine(watch("read", attachments), unicode))
    return watch("load", emails).join(items(examined, *FIELDS_READ), "email_id", "left")


def judge(d: DataFrame, *keep: str, watch: Watch = _unwatched) -> DataFrame:
    """The decision (DECISION), all its evidence and the columns `keep`, from rows of dossiers (email_id, subject, body, sender, items); row by row."""
    d = choose(watch("classify", classify(summary(d))))
    d = d.withColumn("_comparison", F.col("category") == "BL_COMPARISON").withColumn("_chosen", F.col("_comparison") & F.col("review_reason").isNull())
    at = lambda pos: F.when(F.col("_chosen"), F.get(F.filter("items", lambda x: x["att_pos"] == F.col(pos)), F.lit(0)))
    d = d.withColumns({"_si": at("si_pos"), "_bl": at("bl_pos")}).withColumn("comparisons", compared(F.col("_si"), F.col("_bl")))
    d = d.withColumns({"_result": comparison(F.col("comparisons")), "_wrong": differing(F.col("comparisons"))})
    lacking = F.when(F.col("_result") == "incomplete", F.when(F.col("_si.ocr") | F.col("_bl.ocr"), "unreadable").otherwise("missing_value"))
    d = d.withColumn("review_reason", F.when(F.col("_comparison"), F.coalesce("review_reason", lacking)))
    d = d.withColumn("status", F.when(F.col("_comparison"), F.when(F.col("review_reason").isNotNull(), "NEEDS_REVIEW").when(F.col("_result") == "match", "OK").otherwise("MISMATCH")))
    bad = F.coalesce(F.col("status") == "MISMATCH", F.lit(False))
    d = d.withColumns({"has_defect": bad, "defect_fields": F.when(bad, F.col("_wrong")).otherwise(F.expr("cast(array() as array<string>)"))})
    return watch("compare", d.select(*DECISION, "subject", "sender", "attachments", "si_pos", "bl_pos", "comparisons", *keep))


def verify(emails: DataFrame, attachments: DataFrame, unicode: bool = True, watch: Watch = _unwatched) -> DataFrame:
    """One row per email with the decision (DECISION) and all its evidence: subject, sender, attachments
    (assessed), si_pos, bl_pos, comparisons.

    emails(email_id, subject, body, sender), attachments(email_id, att_pos, filename, type_hint,
    extraction, read_error, content).  One branch: attachments are read, decoded, assessed and extracted once, where
    they lie; what is known of them (no contents) is grouped by email and joins it, and all else is row by row.
    watch(stage, rows) sees what leaves each stage (load, read, extract, classify, compare) and hands it on."""
    return judge(dossiers(emails, attachments, unicode, watch), watch=watch)


def decide(emails: DataFrame, attachments: DataFrame, unicode: bool = True) -> DataFrame:
    """One decision per email: DECISION alone."""
    return verify(emails, attachments, unicode).select(*DECISION)
