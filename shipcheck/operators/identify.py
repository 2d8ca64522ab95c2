"""Which attachment is the shipping instruction and which the bill of lading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.text import ascii_only, extraction_method, let, matches, readable, source_format, suffix
from .classify import signal


#: One of these stands in every title.
_TITLE_WORDS = ["instruction", "lading", "ocean", "invoice", "packing", "certificate"]


def _titled(h: Column, low: Column, title: str) -> Column:
    """Whether the head h has a title; low: h in lower case if it is ASCII, else null.  In ASCII the title's word is sought first, and the pattern needs no Unicode classes."""
    word = next(w for w in _TITLE_WORDS if w in title)
    return F.when(low.isNotNull(), low.contains(word) & low.rlike(title)).otherwise(h.rlike("(?iU)" + title))


def assess(attachments: DataFrame) -> DataFrame:
    """attachments with suffix, readable, si_score, bl_score, document_type, reasons; row by row.

    Each pattern is tried once; scores, type and reasons are made from these answers."""
    head = F.translate(F.left(F.coalesce("content", F.lit("")), F.lit(2000)), "\x1c\x1d\x1e\x1f", "    ")
    name, hint = F.coalesce("filename", F.lit("")), F.lower(F.coalesce("type_hint", F.lit("")))
    titles = [*[p for p, _, _ in v.SI_TITLES], *[p for p, _ in v.BL_TITLES], *[p for p, _ in v.OTHER_TITLES]]
    d = attachments.withColumns({
        "suffix": suffix(name), "_titles": let(head, lambda h: let(F.when(ascii_only(h), F.lower(h)), lambda low: F.array(*[_titled(h, low, p) for p in titles]))), "_broken": F.coalesce(F.col("read_error"), F.lit("")) != "",
        "_names": F.struct(matches(name, v.SI_FILENAME).alias("si"), matches(name, v.BL_FILENAME).alias("bl")),
        "_hints": F.struct((hint.contains("shipping instruction") | hint.rlike(r"(?U)\bsi\b")).alias("si"), (hint.contains("bill of lading") | hint.rlike(r"(?U)\bbl\b")).alias("bl")),
    })
    d = d.withColumn("_plain", readable(F.coalesce("content", F.lit("")), F.col("suffix")))
    at = {p: F.get("_titles", F.lit(i)) for i, p in enumerate(titles)}
    none = F.lit(False)
    instruction, other = none, none
    for p, _, score in v.SI_TITLES:
        instruction = instruction | at[p] if score > 10 else instruction
    for p, _ in v.OTHER_TITLES:
        other = other | at[p]
    d = d.withColumns({"_instruction": instruction, "_other": other})
    points = lambda test, n: F.when(test, n).otherwise(0)
    beside = lambda role: points(F.col(f"_names.{role}"), 3) + points(F.col(f"_hints.{role}"), 2)
    si, bl = beside("si"), beside("bl")
    for p, _, score in v.SI_TITLES:
        si = si + points(at[p], score)
    for p, _ in v.BL_TITLES:
        bl = bl + points(at[p] & ~F.col("_instruction"), 10)
    d = d.withColumns({"si_score": si, "bl_score": bl})
    equal = F.col("si_score") == F.col("bl_score")
    kind = F.when(F.col("_other"), "OTHER").when(equal, F.lit(None)).when(F.col("si_score") > F.col("bl_score"), "SI").otherwise("BL")
    reasons = F.array_compact(F.array(
        F.when(F.col("_broken"), "unreadable attachment"), F.when(~F.col("_plain"), "non-text or malformed content"),
        *[F.when(at[p], label) for p, label, _ in v.SI_TITLES], *[F.when(at[p] & ~F.col("_instruction"), label) for p, label in v.BL_TITLES], *[F.when(at[p], label) for p, label in v.OTHER_TITLES],
        *[F.when(F.col(f"_{kind}s.{role}"), f"{what}: {role.upper()}") for kind, what in (("name", "filename"), ("hint", "metadata")) for role in ("si", "bl")],
        F.when(~F.col("_other") & equal & (F.col("si_score") > 0), "ambiguous SI/BL evidence"),
    ))
    return d.select(*attachments.columns, "suffix", (F.col("_plain") & ~F.col("_broken")).alias("readable"), "si_score", "bl_score", kind.alias("document_type"), reasons.alias("reasons"))


def item(assessed: DataFrame, *more: str) -> Column:
    """What is known of an attachment, without its contents, as a struct: position first.  more: further columns that it carries."""
    given = lambda c: F.col(c) if c in assessed.columns else F.lit(None).cast("string")
    return F.struct(
        "att_pos", "filename", source_format(F.col("filename"), given("source_format")).alias("source_format"), extraction_method(F.col("filename"), F.col("extraction")).alias("extraction"),
        F.nullif("read_error", F.lit("")).alias("read_error"), "document_type", "reasons", "readable", given("source").alias("source"), "si_score", "bl_score", signal().alias("signal"), *more,
    )


def items(assessed: DataFrame, *more: str) -> DataFrame:
    """email_id, items: an email's attachments in order, by one aggregation that moves no contents."""
    return assessed.groupBy("email_id").agg(F.array_sort(F.collect_list(item(assessed, *more))).alias("items"))


#: What an item shows of an attachment.
SHOWN = ["att_pos", "filename", "source_format", "extraction", "read_error", "document_type", "reasons", "readable", "source", "si_score", "bl_score"]


def summary(d: DataFrame) -> DataFrame:
    """d with what its `items` come to, row by row: n_attachments, att_text (for classify), n_readable, typed, si and bl (candidates,
    best first), and attachments (shown; null where there are none)."""
    typed = lambda x, *kinds: x["readable"] & F.coalesce(x["document_type"].isin(*kinds), F.lit(False))
    best = lambda role: F.sort_array(F.transform(F.filter("items", lambda x: typed(x, role.upper())), lambda x: F.struct(x[f"{role}_score"].alias("score"), x["att_pos"].alias("att_pos"))), asc=False)
    return d.withColumns({
        "n_attachments": F.when(F.col("items").isNotNull(), F.size("items")).otherwise(0), "att_text": F.array_join(F.transform("items", lambda x: x["signal"]), " "),
        "n_readable": F.size(F.filter("items", lambda x: x["readable"])), "typed": F.exists("items", lambda x: typed(x, "SI", "BL")), "si": best("si"), "bl": best("bl"),
        "attachments": F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in SHOWN])),
    })


def summarise(assessed: DataFrame) -> DataFrame:
    """One row per email with attachments: email_id and the columns of summary."""
    return summary(items(assessed)).drop("items")


def _top(c: str, i: int) -> Column:
    return F.get(c, F.lit(i))


def choose(d: DataFrame) -> DataFrame:
    """d (with the columns of summarise) with si_pos, bl_pos, review_reason.

    The best of each role wins; a tie at the top of a role is no choice (wrong_doc_type)."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    tied = lambda c: F.coalesce(_top(c, 0)["score"] == _top(c, 1)["score"], F.lit(False))
    lacking = F.when(F.col("n_readable") < F.col("n_attachments"), "unreadable").when((F.col("n_attachments") == 1) & F.col("typed"), "missing_attachment").otherwise("wrong_doc_type")
    reason = (
        F.when(F.coalesce("n_attachments", F.lit(0)) == 0, "missing_attachment").when(F.col("n_readable") == 0, "unreadable")
        .when(none("si") | none("bl"), lacking).when(tied("si") | tied("bl"), "wrong_doc_type")
    )
    d = d.withColumn("review_reason", reason)
    pos = lambda c: F.when(F.col("review_reason").isNull(), _top(c, 0)["att_pos"])
    return d.withColumns({"si_pos": pos("si"), "bl_pos": pos("bl")})


def select_documents(emails: DataFrame, assessed: DataFrame) -> DataFrame:
    """email_id, si_pos, bl_pos, review_reason for every row of emails."""
    return choose(emails.select("email_id").join(summarise(assessed), "email_id", "left")).select("email_id", "si_pos", "bl_pos", "review_reason")
