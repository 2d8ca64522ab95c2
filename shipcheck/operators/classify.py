"""Email classification: two projections of term hits and an ordered CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.text import current_body, fold, found, let, padded

#: Term lists that are looked up in subject, body and sender (with spam), in everything, in the current body, and in the scope of requests.
_SPAM = ["SPAM_ACCOUNT", "SPAM_CREDENTIAL", "SPAM_URGENCY", "SPAM_LINK", "SPAM_SUSPICIOUS", "SPAM_PRIZE", "SPAM_PROMOTION", "SPAM_INVESTMENT", "SPAM_CONTEXT", "SPAM_INVESTMENT_STRONG", "SPAM_CRYPTO", "SPAM_PAYMENT"]
_ALL = ["COMPARISON_PHRASES", "COMPARISON_TERMS", "SI_TERMS", "BL_TERMS", "INVOICE_TERMS"]
_NOW = ["COMPARISON_PHRASES", "CURRENT_ACTIONS", "CURRENT_DOCUMENTS", "REQUEST_MARKERS"]
_SCOPE = ["SI_REQUESTS", "SI_TERMS", "REQUEST_TERMS"]
_NONE = "cast(array() as array<string>)"


def _found(text: Column, lists: list[str]) -> dict[str, Column]:
    """By list, its terms that stand in the padded text, in the list's order."""
    return {k: found(text, getattr(v, k)) for k in lists}


def _first(c: Column) -> Column:
    return F.get(c, F.lit(0))


def _some(c: Column) -> Column:
    return F.size(c) > 0


def _spam_reasons(text: Column, h: dict[str, Column] | Column) -> Column:
    has = lambda *names: _any([_some(h[f"SPAM_{n}"]) for n in names])
    say = lambda lead, c: F.concat(F.lit(lead), c)
    first_of = lambda *names: F.coalesce(*[_first(h[f"SPAM_{n}"]) for n in names])
    each = lambda lead, n: F.transform(h[f"SPAM_{n}"], lambda t: F.concat(F.lit(lead), t))
    strong = has("INVESTMENT_STRONG") | (has("CRYPTO") & (F.size(h["SPAM_INVESTMENT"]) >= 2))
    return (
        F.when(has("ACCOUNT") & has("CREDENTIAL", "LINK", "URGENCY"), F.array(say("account risk: ", first_of("ACCOUNT")), say("supporting risk: ", first_of("CREDENTIAL", "LINK", "URGENCY"))))
        .when(F.size(h["SPAM_PRIZE"]) >= 2, each("prize claim: ", "PRIZE"))
        .when(has("CONTEXT") & text.rlike(v.GUARANTEED_RETURN), F.array(F.lit("investment scam signal: guaranteed percentage return"), say("investment context: ", first_of("CONTEXT"))))
        .when(strong, each("investment scam signal: ", "INVESTMENT"))
        .when(has("PROMOTION", "URGENCY", "LINK") & text.rlike(v.EXTREME_DISCOUNT), F.array(F.lit("extreme discount: 90%+ off"), say("supporting promotion: ", first_of("PROMOTION", "URGENCY", "LINK"))))
        .when(has("PAYMENT") & has("LINK", "SUSPICIOUS") & has("URGENCY"), F.array(F.lit("invoice/payment redirect"), say("supporting urgency: ", first_of("URGENCY"))))
        .when(has("SUSPICIOUS") & has("URGENCY", "CREDENTIAL", "ACCOUNT"), F.array(say("suspicious link: ", first_of("SUSPICIOUS")), say("supporting risk: ", first_of("URGENCY", "CREDENTIAL", "ACCOUNT"))))
        .otherwise(F.expr(_NONE))
    )


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def spam_reasons(text: Column) -> Column:
    """Evidence that folded text is spam, by the first of seven rules that holds; empty if none does."""
    return let(padded(text), lambda p: let(F.struct(*[c.alias(k) for k, c in _found(p, _SPAM).items()]), lambda h: _spam_reasons(p, h)))


def signal(content: str = "content") -> Column:
    """What an attachment adds to its email's text: name, type hint and the first 500 characters."""
    return F.concat_ws(" ", "filename", "type_hint", F.left(content, F.lit(500)))


def attachment_signals(attachments: DataFrame) -> DataFrame:
    """email_id, n_attachments, att_text: the attachments' signals, in order; only these move."""
    packed = F.array_sort(F.collect_list(F.struct("att_pos", signal().alias("t"))))
    return attachments.groupBy("email_id").agg(F.count(F.lit(1)).alias("n_attachments"), F.concat_ws(" ", F.transform(packed, lambda x: x["t"])).alias("att_text"))


def classify(emails: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """emails with category and classification_reasons.

    attachments are summed up per email first (only 500 characters of each move); without them, the
    columns n_attachments and att_text of emails are used, or none.  Null texts count as empty."""
    d = emails
    if attachments is not None:
        d = d.join(attachment_signals(attachments), "email_id", "left")
    n = F.coalesce(F.col("n_attachments"), F.lit(0)) if "n_attachments" in d.columns else F.lit(0)
    att = F.coalesce(F.col("att_text"), F.lit("")) if "att_text" in d.columns else F.lit("")
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = d.withColumns({"_sb": fold(F.concat_ws(" ", some("subject"), some("body"), some("sender"))), "_now": fold(current_body(some("body"))), "_subject": padded(fold(some("subject")))})
    d = d.withColumns({"_all": padded(F.trim(F.concat_ws(" ", "_sb", fold(att)))), "_sb": padded(F.col("_sb")), "_now": padded(F.col("_now")), "_attached": n > 0, "_many": n >= 2})
    d = d.withColumn("_scope", F.when(F.col("_attached") | (F.trim("_now") == ""), F.col("_all")).otherwise(F.col("_now")))
    texts = {"_sb": _SPAM, "_subject": ["BL_CONVERSATION"], "_all": _ALL, "_now": _NOW, "_scope": _SCOPE}
    # a column for each list: Spark would copy the parts of a struct to wherever they are used
    d = d.withColumns({f"{c}_{k}": hit for c, lists in texts.items() for k, hit in _found(F.col(c), lists).items()})
    of = {c: {k: F.col(f"{c}_{k}") for k in lists} for c, lists in texts.items()}
    talk, al, now, scope = of["_subject"]["BL_CONVERSATION"], of["_all"], of["_now"], of["_scope"]
    has_si, has_bl, attached = _some(al["SI_TERMS"]), _some(al["BL_TERMS"]), F.col("_attached")
    with_files = attached & (_some(al["COMPARISON_PHRASES"]) | _some(talk) | (has_si & has_bl & (_some(al["COMPARISON_TERMS"]) | F.col("_many"))))
    file_reasons = F.concat(
        al["COMPARISON_PHRASES"], F.transform(talk, lambda t: F.concat(F.lit("BL conversation: "), t)),
        F.array_compact(F.array(F.when(has_si, "SI signal"), F.when(has_bl, "BL signal"), F.concat(F.lit("action: "), _first(al["COMPARISON_TERMS"])))),
    )
    asks = _some(now["COMPARISON_PHRASES"]) | (_some(now["CURRENT_ACTIONS"]) & _some(now["REQUEST_MARKERS"]))
    without_files = ~attached & asks & (_some(now["CURRENT_DOCUMENTS"]) | _some(talk))
    body_reasons = F.array_compact(F.array(
        F.lit("current body comparison request"),
        F.coalesce(F.concat(F.lit("current body phrase: "), _first(now["COMPARISON_PHRASES"])), F.concat(F.lit("current body action: "), _first(now["CURRENT_ACTIONS"]))),
        F.coalesce(F.concat(F.lit("current body document: "), _first(now["CURRENT_DOCUMENTS"])), F.concat(F.lit("subject context: "), _first(talk))),
    ))
    si_asked = _some(scope["SI_REQUESTS"]) | (_some(scope["SI_TERMS"]) & _some(scope["REQUEST_TERMS"]))
    d = d.withColumn("_spam", _spam_reasons(F.col("_sb"), of["_sb"]))
    cases = [
        (_some(F.col("_spam")), "SPAM", F.col("_spam")), (with_files, "BL_COMPARISON", file_reasons), (without_files, "BL_COMPARISON", body_reasons),
        (si_asked, "SI_REQUEST", F.when(_some(scope["SI_REQUESTS"]), scope["SI_REQUESTS"]).otherwise(F.array(F.lit("SI request language")))), (_some(al["INVOICE_TERMS"]), "INVOICE_QUERY", al["INVOICE_TERMS"]),
    ]
    verdict = F.struct(F.lit("GENERAL").alias("category"), F.expr(_NONE).alias("reasons"))
    for test, name, why in reversed(cases):
        verdict = F.when(test, F.struct(F.lit(name).alias("category"), why.alias("reasons"))).otherwise(verdict)
    d = d.withColumn("_verdict", verdict)
    return d.select(*emails.columns, F.col("_verdict.category").alias("category"), F.col("_verdict.reasons").alias("classification_reasons"))
