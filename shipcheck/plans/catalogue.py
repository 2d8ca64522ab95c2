"""The engine's named queries and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions import sql
from ..functions import text as t
from ..operators import classify, decide, extract, identify, measure, report
from ..sources import audit, bundle, decode, inbox_format, sink, snapshots
from ..sources.shared import shared_dir
from ..streaming import inbox as stream
from . import bridge

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spread(d: DataFrame) -> DataFrame:
    """d in as many partitions as there are cores, if its files have fewer splits: row-wise work on one small file
    would run in one task.  Tables with more splits are left alone."""
    cores = d.sparkSession.sparkContext.defaultParallelism
    return d.repartition(cores) if d.rdd.getNumPartitions() < cores else d


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    emails, attachments = bridge.emails_and_attachments(spark, sf)
    return decide.decide(emails, attachments)


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    return decide.verify(*bridge.emails_and_attachments(spark, sf))


_joined = lambda c: F.concat_ws("; ", c)
_E = "expected"
_DOC = "coalesce(text, '')"


def _fold_sql(c: str) -> str:
    for a, b in v.FOLD_PAIRS:
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def _has_sql(c: str, terms: list[str]) -> str:
    return "(" + " or ".join(f"contains(' ' || {c} || ' ', ' {x} ')" for x in terms) + ")"


def _hits_sql(c: str, terms: list[str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"case when contains(' ' || {c} || ' ', ' {x} ') then '{x}' end" for x in terms) + ")"


# --- decisions


@query(bridge.oracle("select category, status, review_reason, count(*) as n from expected group by all", _E))
def decision_counts(spark, sf):
    return _decisions(spark, sf).groupBy("category", "status", "review_reason").agg(F.count(F.lit(1)).alias("n"))


@query(bridge.oracle("select email_id, category, status, has_defect, defect_fields, review_reason, reasons from expected", _E))
def i7_decide(spark, sf):
    return _decisions(spark, sf).select("email_id", "category", "status", "has_defect", _joined("defect_fields").alias("defect_fields"), "review_reason", _joined("classification_reasons").alias("reasons"))


@query(bridge.oracle("select email_id, category, reasons from expected", _E))
def i1_classify(spark, sf):
    emails, attachments = bridge.emails_and_attachments(spark, sf)
    return classify.classify(emails, attachments).select("email_id", "category", _joined("classification_reasons").alias("reasons"))


@query(bridge.oracle("select email_id, case when category = 'SPAM' then reasons else '' end as reasons from expected", _E))
def i2_spam(spark, sf):
    emails, _ = bridge.emails_and_attachments(spark, sf)
    return emails.select("email_id", _joined(classify.spam_reasons(t.fold(F.concat_ws(" ", "subject", "body", "sender")))).alias("reasons"))


_ASSESSED = """select email_id, att_pos,
  cast(case when att_pos = 0 then 13 when dm = 10 then 10 else 0 end as int) as si_score,
  cast(case when att_pos = 0 or dm = 10 then 0 when dm = 7 then 3 when dm = 8 then 13 else 13 end as int) as bl_score,
  case when att_pos = 0 or dm = 10 then 'SI' when dm = 7 then 'OTHER' else 'BL' end as document_type,
  not (att_pos = 1 and dm = 8) as readable,
  case when att_pos = 0 then 'content heading: shipping instruction; filename: SI' when dm = 10 then 'content heading: shipping instruction'
       when dm = 7 then 'content heading: invoice; filename: BL' when dm = 8 then 'non-text or malformed content; content heading: bill of lading; filename: BL'
       else 'content heading: bill of lading; filename: BL' end as reasons
  from attachments_v join facts using (email_id)"""


@query(bridge.oracle(_ASSESSED, "attachments_v"))
def i3_assess(spark, sf):
    _, attachments = bridge.emails_and_attachments(spark, sf)
    return identify.assess(attachments).select("email_id", "att_pos", "si_score", "bl_score", "document_type", "readable", _joined("reasons").alias("reasons"))


@query(bridge.oracle("""select email_id, cast(case when tm in (0, 6, 7, 8, 9) and dm in (0, 1, 2, 3, 4, 5, 6) then 0 else -1 end as int) as si_pos, cast(case when tm in (0, 6, 7, 8, 9) and dm in (0, 1, 2, 3, 4, 5, 6) then 1 else -1 end as int) as bl_pos,
  case when tm not in (0, 6, 7, 8, 9) or dm = 9 then 'missing_attachment' when dm in (7, 10) then 'wrong_doc_type' when dm = 8 then 'unreadable' end as review_reason from facts"""))  # fmt: skip
def i4_select_documents(spark, sf):
    emails, attachments = bridge.emails_and_attachments(spark, sf)
    d = identify.select_documents(emails, identify.assess(attachments))
    return d.withColumns({c: F.coalesce(c, F.lit(-1)).cast("int") for c in ("si_pos", "bl_pos")})


_FIELD_ROWS = """select email_id, 0 as att_pos, f.field, f.raw from facts, lateral (values ('shipper', shipper), ('consignee', consignee), ('notify_party', 'Same as consignee'), ('port_of_loading', port_a), ('port_of_discharge', port_b),
  ('container_count', cast(containers as varchar) || ' x 40HC'), ('gross_weight_kg', cast(weight as varchar) || '000 KG')) f(field, raw) where tm in (0, 6, 7, 8, 9)
union all
select email_id, 1 as att_pos, f.field, f.raw from facts, lateral (values ('shipper', case when dm not in (7, 10) then upper(shipper) end), ('consignee', consignee), ('notify_party', case when dm in (7, 10) then null when dm = 5 then 'TBA' when dm <> 6 then consignee end),
  ('port_of_loading', case when dm not in (7, 10) then port_a end), ('port_of_discharge', case when dm = 3 then 'Elsewhere' when dm not in (7, 10) then port_b end),
  ('container_count', case when dm not in (7, 10) then cast(containers + case when dm = 2 then 1 else 0 end as varchar) || ' containers' end),
  ('gross_weight_kg', case when dm in (7, 10) then null when dm = 4 then cast(weight as varchar) || ' MT' else cast(weight as varchar) || ',000 KGS' end)) f(field, raw) where tm in (0, 6, 7, 8, 9) and dm <> 9"""


@query(bridge.oracle(f"select * from ({_FIELD_ROWS})"))
def i5_extract(spark, sf):
    _, attachments = bridge.emails_and_attachments(spark, sf)
    return extract.extract_fields(attachments, ["email_id", "att_pos"]).select("email_id", "att_pos", "field", "raw")


_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(bridge.oracle(f"""select email_id, att_pos, field, case when raw = 'TBA' or raw is null then null when field = 'notify_party' and raw = 'Same as consignee' then {_NORM.format('consignee')}
  when field in ('shipper', 'consignee', 'notify_party', 'port_of_loading', 'port_of_discharge') then {_NORM.format('raw')} when field = 'container_count' then regexp_extract(raw, '^([0-9]+)', 1)
  else cast(weight * 1000 as varchar) end as norm from ({_FIELD_ROWS}) join facts using (email_id)"""))  # fmt: skip
def h19_normalize_fields(spark, sf):
    _, attachments = bridge.emails_and_attachments(spark, sf)
    keys = ["email_id", "att_pos"]
    return decide.normalize_fields(attachments, keys).select(*keys, "field", "norm")


def _comparisons(spark, sf):
    _, attachments = bridge.emails_and_attachments(spark, sf)
    return decide.compare(attachments.select("email_id", F.when(F.col("att_pos") == 0, "SI").otherwise("BL").alias("role"), "content"))


_STATUS = """select email_id, field, case when dm in (7, 10) and field = 'consignee' then 'match' when dm in (7, 9, 10) then 'missing_in_bl' when dm in (5, 6) and field = 'notify_party' then 'missing_in_bl'
  when dm = 2 and field = 'container_count' then 'mismatch' when dm = 3 and field = 'port_of_discharge' then 'mismatch' else 'match' end as status
  from facts, (select unnest(['shipper', 'consignee', 'notify_party', 'port_of_loading', 'port_of_discharge', 'container_count', 'gross_weight_kg']) as field) where tm in (0, 6, 7, 8, 9)"""


@query(bridge.oracle(_STATUS))
def d10_compare(spark, sf):
    return _comparisons(spark, sf).select("email_id", F.inline("comparisons")).select("email_id", "field", "status")


@query(bridge.oracle(f"""select email_id, case when bool_and(status = 'match') then 'match' when bool_or(status like 'missing%') then 'incomplete' else 'mismatch' end as comparison,
  count(*) filter (status <> 'match') as n_defects from ({_STATUS}) group by email_id"""))  # fmt: skip
def e13_roll_up(spark, sf):
    return decide.roll_up(_comparisons(spark, sf)).select("email_id", "comparison", F.size("defect_fields").cast("long").alias("n_defects"))


# --- reports


@query(bridge.oracle("select count(*) as processed, count(*) filter (category = 'BL_COMPARISON') as comparisons, count(*) filter (status = 'OK') as ok, count(*) filter (status = 'MISMATCH') as mismatch, count(*) filter (status = 'NEEDS_REVIEW') as needs_review from expected", _E))
def e9_metrics(spark, sf):
    return report.metrics(_decisions(spark, sf))


@query(bridge.oracle("select category as label, count(*) as n from expected group by 1", _E))
def e5_by_category(spark, sf):
    return report.counts(_decisions(spark, sf), "category")


@query(bridge.oracle("select status as label, count(*) as n from expected group by 1", _E))
def e6_by_status(spark, sf):
    return report.counts(_decisions(spark, sf), "status", nulls=True)


@query(bridge.oracle("select review_reason as label, count(*) as n from expected where review_reason is not null group by 1", _E))
def e7_by_reason(spark, sf):
    return report.counts(_decisions(spark, sf), "review_reason")


@query(bridge.oracle("select l.label, cast(l.ord as int) as ord, count(e.email_id) as n from (values ('BL_COMPARISON', 0), ('SI_REQUEST', 1), ('INVOICE_QUERY', 2), ('SPAM', 3), ('GENERAL', 4)) l(label, ord) left join expected e on e.category = l.label group by all", _E))
def e8_distribution(spark, sf):
    return report.distribution(_decisions(spark, sf), "category", v.CATEGORIES, zeros=True)


@query("select distinct o_orderpriority as label from orders")
def e11_distinct(spark, sf):
    return report.labels(_table(spark, sf, "orders"), "o_orderpriority")


@query(bridge.oracle("select email_id, category, status, cast(case status when 'NEEDS_REVIEW' then 0 when 'MISMATCH' then 1 when 'OK' then 2 else 3 end as int) as rank from expected order by 4, 1 limit 8", _E))
def f2_notable(spark, sf):
    return report.notable(_decisions(spark, sf)).select("email_id", "category", "status", "rank")


@query(bridge.oracle("select email_id, subject, category, status, review_reason, cast(case when defect_fields = '' then 0 else 1 end as int) as defect_count from expected join emails_v using (email_id)", _E, "emails_v"))
def b10_list_items(spark, sf):
    emails, _ = bridge.emails_and_attachments(spark, sf)
    return report.list_items(_decisions(spark, sf), emails)


@query(bridge.oracle("select email_id, subject, category, status, review_reason, cast(case when defect_fields = '' then 0 else 1 end as int) as defect_count from expected join emails_v using (email_id) where contains(lower(subject), 'compare') and status = 'MISMATCH'", _E, "emails_v"))
def c2_search(spark, sf):
    return report.search(report.list_items(_verified(spark, sf)), query=" COMPARE ", status="MISMATCH")


@query(bridge.oracle(f"""select email_id, subject, review_reason, concat_ws('; ', nullif(e.reasons, ''), a.reasons) as evidence from expected e join emails_v using (email_id)
  left join (select email_id, string_agg(reasons, '; ' order by att_pos) as reasons from ({_ASSESSED}) group by 1) a using (email_id) where status = 'NEEDS_REVIEW'""", _E, "emails_v", "attachments_v"))  # fmt: skip
def c4_review_queue(spark, sf):
    return report.review_queue(_verified(spark, sf)).select("email_id", "subject", "review_reason", _joined("evidence").alias("evidence"))


@query(bridge.oracle("select email_id, status from expected where status in ('MISMATCH', 'NEEDS_REVIEW')", _E))
def c5_problems(spark, sf):
    return report.problems(_decisions(spark, sf)).select("email_id", "status")


@query(bridge.oracle("select email_id, case when status = 'NEEDS_REVIEW' then 'INCOMPLETE' when category = 'BL_COMPARISON' then 'COMPLETE' else 'NOT_REQUIRED' end as extraction_status from expected", _E))
def b16_extraction_status(spark, sf):
    return _decisions(spark, sf).select("email_id", report.extraction_status(F.col("category"), F.col("status")).alias("extraction_status"))


@query(bridge.oracle(f"""select email_id, field, case when e.status in ('OK', 'MISMATCH') then upper(s.status) else 'UNAVAILABLE' end as result
  from (select email_id, status, unnest(['shipper', 'consignee', 'notify_party', 'port_of_loading', 'port_of_discharge', 'container_count', 'gross_weight_kg']) as field from expected where category = 'BL_COMPARISON') e left join ({_STATUS}) s using (email_id, field)""", _E))  # fmt: skip
def b11_detail(spark, sf):
    return report.detail(_verified(spark, sf)).select("email_id", "field", "result")


@query(bridge.oracle("""select email_id, case when k % 5 = 0 and category <> 'BL_COMPARISON' then 'comparison values on another category' when k % 5 = 1 and status = 'OK' then 'defects on OK'
  when k % 5 = 2 then 'unknown category' end as violation from expected where (k % 5 = 0 and category <> 'BL_COMPARISON') or (k % 5 = 1 and status = 'OK') or k % 5 = 2""", _E))  # fmt: skip
def i10_violations(spark, sf):
    d = _decisions(spark, sf).withColumn("k", F.substring("email_id", 7, 8).cast("long") % 5)
    d = d.withColumn("status", F.when((F.col("k") == 0) & (F.col("category") != "BL_COMPARISON"), "OK").otherwise(F.col("status")))
    d = d.withColumn("has_defect", F.when((F.col("k") == 1) & (F.col("status") == "OK") & (F.col("category") == "BL_COMPARISON"), True).otherwise(F.col("has_defect")))
    return report.violations(d.withColumn("category", F.when(F.col("k") == 2, "OTHER").otherwise(F.col("category"))).drop("k"))


@query("select 'missing' as side, email_id from (select 'e' || o_orderkey as email_id from orders where o_orderkey % 3 <> 0 except select 'e' || o_orderkey from orders where o_orderkey % 5 <> 0) union all select 'unknown', email_id from (select 'e' || o_orderkey as email_id from orders where o_orderkey % 5 <> 0 except select 'e' || o_orderkey from orders where o_orderkey % 3 <> 0)")
def d3_id_differences(spark, sf):
    o = _table(spark, sf, "orders").select(F.concat(F.lit("e"), F.col("o_orderkey")).alias("email_id"), "o_orderkey")
    return report.id_differences(o.where("o_orderkey % 3 <> 0").select("email_id"), o.where("o_orderkey % 5 <> 0").select("email_id"))


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def d2_without_decision(spark, sf):
    emails, decisions = _table(spark, sf, "orders").withColumnRenamed("o_orderkey", "email_id"), _table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "email_id")
    return report.undecided(emails, decisions).select(F.col("email_id").alias("o_orderkey"))


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 49)")
def d5_processed_only(spark, sf):
    emails, decisions = _table(spark, sf, "orders").withColumnRenamed("o_orderkey", "email_id"), _table(spark, sf, "lineitem").where("l_quantity > 49").withColumnRenamed("l_orderkey", "email_id")
    return report.decided(emails, decisions).select(F.col("email_id").alias("o_orderkey"))


@query("select o_custkey, count(*) as n from orders group by 1 having count(*) > 1")
def e10_duplicates(spark, sf):
    return report.duplicates(_table(spark, sf, "orders"), "o_custkey")


# --- text functions over the driver's texts


@query(f"select doc_id, md5({_fold_sql(_DOC)}) as folded from documents")
def h1_fold(spark, sf):
    return _spread(_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.md5(t.fold(F.coalesce("text", F.lit("")))).alias("folded"))


@query(f"select conv_id, turn, {_has_sql(_fold_sql(_DOC), ['the', 'of', 'in the'])} as found from conversations")
def h2_has_term(spark, sf):
    return _spread(_table(spark, sf, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", t.has_term(t.fold(F.coalesce("text", F.lit(""))), ["the", "of", "in the"]).alias("found"))


@query(f"select doc_id, {_hits_sql(_fold_sql(_DOC), ['the', 'der', 'que', 'les', 'license'])} as hits from documents")
def h3_hits(spark, sf):
    return _spread(_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", _joined(t.hits(t.fold(F.coalesce("text", F.lit(""))), ["the", "der", "que", "les", "license"])).alias("hits"))


@query("select doc_id, md5(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '')) as cleaned from documents")
def h7_clean(spark, sf):
    return _spread(_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.md5(t.clean(F.col("text"))).alias("cleaned"))


@query("select conv_id, turn, md5(split_part(text || chr(10) || '> quoted', chr(10) || '> quoted', 1)) as body from conversations")
def f8_current_body(spark, sf):
    return _spread(_table(spark, sf, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", F.md5(t.current_body(F.concat("text", F.lit("\n> quoted\nolder")))).alias("body"))


@query("select doc_id, length(left(text, 500)) as n500, length(left(text, 2000)) as n2000 from documents")
def f9_caps(spark, sf):
    return _spread(_table(spark, sf, "documents").select("doc_id", "text")).withColumns({"filename": F.lit("f"), "type_hint": F.lit(None).cast("string")}).select(
        "doc_id", F.when(F.col("text").isNotNull(), F.length(classify.signal("text")) - 2).cast("long").alias("n500"), F.length(F.left("text", F.lit(2000))).cast("long").alias("n2000"))


@query("select page_id, length(regexp_replace(html, '[^A-Za-z0-9]+', '', 'g')) >= 8 as usable from pages")
def a19_usable(spark, sf):
    return _table(spark, sf, "pages").select("page_id", t.usable(F.col("html")).alias("usable"))


@query("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' and not contains(text, chr(0)) and (length(text) - length(replace(text, '�', ''))) / greatest(length(text), 1) < 0.05 and doc_id % 7 <> 0 as readable from documents")
def c6_readable(spark, sf):
    name = F.when(F.col("doc_id") % 7 == 0, "scan.TIFF").otherwise("letter.txt")
    return _spread(_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", t.readable(F.col("text"), t.suffix(name)).alias("readable"))


@query("select c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || ' limited' as norm from customer")
def h4_normalize_text(spark, sf):
    return _table(spark, sf, "customer").select("c_custkey", t.normalize_text(F.concat("c_name", F.lit(", Ltd."))).alias("norm"))


@query("select c_custkey, case c_custkey % 3 when 0 then '__same_as_consignee__' when 1 then '__same_as_shipper__' else trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) end as norm from customer")
def h5_normalize_party(spark, sf):
    raw = F.when(F.col("c_custkey") % 3 == 0, "Same as CNEE.").when(F.col("c_custkey") % 3 == 1, " SAME AS EXPORTER").otherwise(F.col("c_name"))
    return _table(spark, sf, "customer").select("c_custkey", t.normalize_party(raw).alias("norm"))


@query("select n_nationkey, case n_nationkey % 4 when 0 then 'shanghai' when 1 then 'singapore' when 2 then 'port kembla berth 4 australia' else trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) end as norm from nation")
def h6_normalize_port(spark, sf):
    m = F.col("n_nationkey") % 4
    raw = F.when(m == 0, "Shanghai (CNSHA)").when(m == 1, "SGSIN").when(m == 2, "Port Kembla (Berth 4), Australia (SGSIN)").otherwise(F.concat("n_name", F.lit(" (DEHAM)")))
    return _table(spark, sf, "nation").select("n_nationkey", t.normalize_port(raw).alias("norm"))


@query("select o_orderkey, o_orderkey % 6 < 4 as placeholder from orders")
def c10_placeholder(spark, sf):
    raw = F.get(F.array(*map(F.lit, ["TBA", " n / a ", "____MT", "to be  confirmed", "12 MT", "Tbac"])), (F.col("o_orderkey") % 6).cast("int"))
    return _table(spark, sf, "orders").select("o_orderkey", t.is_placeholder(raw).alias("placeholder"))


@query("""select l_orderkey, l_linenumber, cast(cast(l_quantity as bigint) * case l_linenumber % 4 when 0 then 1 when 1 then 1000 when 2 then 1 else 1000 end as varchar) as kg from lineitem""")
def h31_weight(spark, sf):
    q, m = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber") % 4
    raw = F.when(m == 0, F.concat(q, F.lit(" KGS"))).when(m == 1, F.concat(q, F.lit(".0 metric tons"))).when(m == 2, F.concat(q, F.lit(",00"))).otherwise(F.concat(q, F.lit(",000 kg")))
    return _spread(_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")).select("l_orderkey", "l_linenumber", t.normalize_weight(raw).alias("kg"))


@query("select l_orderkey, l_linenumber, cast(case l_linenumber % 4 when 0 then cast(l_quantity as bigint) + 2 when 1 then cast(l_quantity as bigint) when 2 then 7 else cast(l_quantity as bigint) end as varchar) as n from lineitem")
def h32_containers(spark, sf):
    q, m = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber") % 4
    raw = F.when(m == 0, F.concat(q, F.lit(" x 40'HC + 2 X 20GP"))).when(m == 1, F.concat(F.lit("0"), q, F.lit(" containers"))).when(m == 2, "Seven").otherwise(q)
    return _spread(_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")).select("l_orderkey", "l_linenumber", t.normalize_containers(raw).alias("n"))


@query("select l_orderkey, l_linenumber, cast(cast(l_extendedprice as decimal(18,2)) as varchar) as amount from lineitem")
def h30_decimal(spark, sf):
    plain = F.format_number("l_extendedprice", 2)
    european = F.translate(plain, ",.", ".,")
    return _spread(_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")).select("l_orderkey", "l_linenumber", t.decimal_from_text(F.when(F.col("l_linenumber") % 2 == 0, plain).otherwise(european)).cast("decimal(18,2)").cast("string").alias("amount"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def h46_json(spark, sf):
    e = _table(spark, sf, "events").select("event_id", "props")
    items = bundle.email_items(e.select(F.concat(F.lit('[{"id": "'), "event_id", F.lit('", "p": '), "props", F.lit("}]")).alias("value")))
    return items.select(F.expr("try_variant_get(email, '$.id', 'bigint')").alias("event_id"), F.expr("try_variant_get(email, '$.p.k', 'string')").alias("k"))


@query("select c_custkey, c_name as text from customer")
def h47_base64(spark, sf):
    c = _table(spark, sf, "customer").select(F.format_string('[{"id": "%d", "files": {"content_base64": "%s"}}]', "c_custkey", F.base64(F.col("c_name").cast("binary"))).alias("value"))
    c = bundle.attachment_refs(bundle.email_rows(bundle.email_items(c.select(F.replace("value", F.lit('"files": {'), F.lit('"files": {"f": {')).alias("v0")).select(F.replace("v0", F.lit('"}}]'), F.lit('"}}}]')).alias("value")))))
    return c.select(F.col("email_id").cast("long").alias("c_custkey"), F.col("inline").alias("text"))


@query("select c_custkey, case when length(c_name) > 12 then left(c_name, 11) || '…' else c_name end as shown from customer")
def h12_display(spark, sf):
    return _table(spark, sf, "customer").select("c_custkey", t.display(F.col("c_name"), 12).alias("shown"))


#: A template's entry with values at several depths and constants between them.
SHAPE = '{"id": null, "answer": {"kind": "verdict", "classification": null, "result": null, "checks": [{"mismatch_found": false, "defects": []}], "review_code": "?"}, "schema": 1}'


@query(bridge.oracle("""select k as pos, concat('  "', email_id, '": {
    "id": "', email_id, '",
    "answer": {
      "kind": "verdict",
      "classification": "', category, '",
      "result": ', coalesce('"' || status || '"', 'null'), ',
      "checks": [
        {
          "mismatch_found": ', case when has_defect then 'true' else 'false' end, ',
          "defects": ', case when defect_fields = '' then '[]' else '[' || chr(10) || '            "' || defect_fields || '"' || chr(10) || '          ]' end, '
        }
      ],
      "review_code": ', coalesce('"' || review_reason || '"', 'null'), '
    },
    "schema": 1
  }') as line from expected""", _E))
def i9_submission(spark, sf):
    emails, attachments = bridge.emails_and_attachments(spark, sf)
    template = emails.select(F.col("k").alias("pos"), "email_id", F.lit(SHAPE).alias("shape"))
    return sink.entries(decide.decide(emails, attachments), template)


# --- sources: JSON and files made of the star tables, read back


def _payloads(spark, sf):
    """A JSON text per order, in four shapes by o_orderkey % 4."""
    shapes = [
        '{"email_id": "e%1$d", "subject": "S %1$d", "body": "B", "from": "c", "attachments": ["a.txt", "b.txt"]}', '[{"id": "e%1$d", "title": "S %1$d", "text": "B", "sender": "c", "files": {"x": "a.txt"}}]',
        '{"messages": [{"messageId": "e%1$d", "subject": "S %1$d", "content": "B", "fromAddress": "c", "si_path": "a.txt", "bl_path": "b.txt"}]}', '{"e%1$d": {"subject": "S %1$d", "message": "B", "from_address": "c", "attachment_ids": ["i1", "i2"]}}',
    ]
    k = F.col("o_orderkey")
    value = F.format_string(shapes[3], k)
    for i in (2, 1, 0):
        value = F.when(k % 4 == i, F.format_string(shapes[i], k)).otherwise(value)
    return _table(spark, sf, "orders").select(value.alias("value"))


@query("select 'e' || o_orderkey as email_id, 'S ' || o_orderkey as subject, 'B' as body, 'c' as sender, cast(case o_orderkey % 4 when 1 then 1 when 3 then 0 else 2 end as int) as n_refs, cast(case o_orderkey % 4 when 3 then 2 else 0 end as int) as n_ids from orders")
def a6_email_shapes(spark, sf):
    return bundle.email_rows(bundle.email_items(_payloads(spark, sf), single=True)).select("email_id", "subject", "body", "sender", F.size("refs").alias("n_refs"), F.size("ids").alias("n_ids"))


@query("""select 'e' || o_orderkey as email_id, cast(p as int) as att_pos, case p when 0 then 'f' || o_orderkey || '.txt' when 1 then 'g.pdf' else 'h' || o_orderkey || '.txt' end as filename,
  case p when 0 then 'f' || o_orderkey || '.txt' when 1 then 'g.pdf' else 'dir/h' || o_orderkey || '.txt' end as source, case when p < 2 then 't ' || o_orderkey end as inline, case when p = 1 then 'SI' end as type_hint
  from orders, (select unnest([0, 1, 2]) as p)""")
def a23_attachment_refs(spark, sf):
    k = F.col("o_orderkey")
    text = F.format_string('[{"id": "e%d", "attachments": [{"filename": "f%d.txt", "content": "t %d"}, {"name": "g.pdf", "content_base64": "%s", "type": "SI"}, "dir/h%d.txt"]}]', k, k, k, F.base64(F.concat(F.lit("t "), k.cast("string")).cast("binary")), k)
    emails = bundle.email_rows(bundle.email_items(_table(spark, sf, "orders").select(text.alias("value"))))
    return bundle.attachment_refs(emails).select("email_id", "att_pos", "filename", "source", "inline", "type_hint")


@query("""select 'e' || o_orderkey as email_id, cast(p as int) as att_pos, case when s_name is null then 'A' || (o_custkey % 7) else 's' || s_suppkey || '.txt' end as filename, s_name as inline
  from orders cross join (select unnest([0, 1]) as p) left join supplier on s_suppkey = o_custkey % 7""")
def d7_attachment_index(spark, sf):
    entries = _table(spark, sf, "supplier").where("s_suppkey < 7").select(F.format_string('{"attachments": [{"id": "A%d", "filename": "s%d.txt", "content": "%s"}]}', "s_suppkey", "s_suppkey", "s_name").alias("value"))
    key = F.col("o_custkey") % 7
    mails = _table(spark, sf, "orders").select(F.format_string('[{"id": "e%d", "attachments": ["A%d"], "attachment_ids": ["A%d"]}]', "o_orderkey", key, key).alias("value"))
    return bundle.attachment_refs(bundle.email_rows(bundle.email_items(mails)), bundle.attachment_index(entries)).select("email_id", "att_pos", "filename", "inline")


@query("select 'e' || o_orderkey as email_id, cast(0 as int) as att_pos, case when o_orderkey % 5 < 4 then 'text ' || o_orderkey end as text from orders")
def a12_candidate_paths(spark, sf):
    o, k = _table(spark, sf, "orders"), F.col("o_orderkey")
    path = F.format_string("/b/attachments/f%d.txt", k)
    files = o.select(F.concat(F.lit("file://"), path).alias("path"), F.concat(F.lit("text "), k.cast("string")).cast("binary").alias("content"))
    source = F.when(k % 5 == 0, F.format_string("f%d.txt", k)).when(k % 5 == 1, F.format_string("x/y/f%d.txt", k)).when(k % 5 == 2, path).when(k % 5 == 3, F.format_string("attachments/f%d.txt", k)).otherwise(F.format_string("gone%d.txt", k))
    refs = o.select(F.concat(F.lit("e"), k.cast("string")).alias("email_id"), F.lit(0).alias("att_pos"), source.alias("source"), F.lit(None).cast("string").alias("inline"), F.lit(None).cast("binary").alias("encoded"))
    return bundle.resolve(refs, files, ["/b"]).select("email_id", "att_pos", F.col("content").cast("string").alias("text"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'a.txt' when 1 then null when 2 then 'p.txt' else 'b/c.txt' end as path from orders")
def c18_contained_paths(spark, sf):
    source = F.get(F.array(*map(F.lit, ["attachments/x/../a.txt", "x/../../q", "/etc/p.txt", "./b//c.txt"])), (F.col("o_orderkey") % 4).cast("int"))
    return _table(spark, sf, "orders").select("o_orderkey", bundle.contained(source).alias("path"))


@query("select c_custkey, c_name || chr(65533) || chr(10) || 'x' || chr(10) || 'y' as text, 'plain text' as extraction, cast(null as varchar) as error from customer")
def a14_text_decode(spark, sf):
    data = F.concat(F.col("c_name").cast("binary"), F.unhex(F.lit("FF0D0A780D79")))
    return _table(spark, sf, "customer").select("c_custkey", decode.decode(data, F.lit(".txt")).alias("d")).select("c_custkey", "d.text", "d.extraction", "d.error")


@query("""select c_custkey, case c_custkey % 4 when 0 then 'Title' || chr(10) || 'Consignee' || chr(9) || c_name when 1 then '[Worksheet: One]' || chr(10) || 'Consignee' || chr(9) || c_name when 2 then 'Consignee: ' || c_name else '' end as text,
  case c_custkey % 4 when 0 then 'DOCX text' when 1 then 'XLSX cells' when 2 then 'embedded text' else 'unreadable' end as extraction, c_custkey % 4 = 3 as failed from customer""")
def a24_decoded_formats(spark, sf):
    kind = F.get(F.array(*map(F.lit, [".docx", ".xlsx", ".pdf", ".xlsm"])), (F.col("c_custkey") % 4).cast("int"))
    d = _table(spark, sf, "customer").select("c_custkey", kind.alias("k"), bridge.office_file(kind, F.col("c_name")).alias("data"))
    return d.select("c_custkey", decode.decode(F.col("data"), F.col("k")).alias("d")).select("c_custkey", "d.text", "d.extraction", F.col("d.error").isNotNull().alias("failed"))


# --- more decisions and reports


@query(bridge.oracle("select email_id, status, case when review_reason = 'missing_value' and k % 2 = 0 then 'unreadable' else review_reason end as review_reason from expected", _E))
def c9_ocr_gate(spark, sf):
    emails, attachments = bridge.emails_and_attachments(spark, sf)
    scanned = attachments.withColumn("extraction", F.when(F.substring("email_id", 7, 8).cast("long") % 2 == 0, "OCR").otherwise("text"))
    return decide.decide(emails, scanned).select("email_id", "status", "review_reason")


@query(bridge.oracle("""select email_id, case when tm not in (0, 6, 7, 8, 9) then 'missing_attachment' when k % 3 = 0 then case when dm = 8 then 'unreadable' else 'wrong_doc_type' end
  when dm = 9 then 'missing_attachment' when dm in (7, 10) then 'wrong_doc_type' when dm = 8 then 'unreadable' end as review_reason from facts"""))  # fmt: skip
def f3_ties_are_no_choice(spark, sf):
    emails, attachments = bridge.emails_and_attachments(spark, sf)
    twice = attachments.where(F.substring("email_id", 7, 8).cast("long") % 3 == 0).withColumn("att_pos", F.col("att_pos") + 2)
    return identify.select_documents(emails, identify.assess(attachments.unionByName(twice))).select("email_id", "review_reason")


@query(bridge.oracle("select count(*) as processed, count(*) filter (category = 'BL_COMPARISON') as comparisons, count(*) filter (status = 'OK') as ok, count(*) filter (status = 'MISMATCH') as mismatch, count(*) filter (status = 'NEEDS_REVIEW') as needs_review, cast(2.5 as double) as runtime_seconds, round(count(*) / 2.5, 2) as throughput from expected", _E))
def e4_throughput(spark, sf):
    return report.metrics(_decisions(spark, sf), 2.5)


@query(bridge.oracle("""select email_id, att_pos, filename, upper(regexp_extract(filename, '[^.]*$')) as source_format, 'text' as extraction, case when tm in (0, 6, 7, 8, 9) then case when att_pos = 0 or dm = 10 then 'SI' when dm = 7 then 'OTHER' else 'BL' end end as detected_type
  from attachments_v join facts using (email_id)""", "attachments_v"))  # fmt: skip
def b12_attachment_items(spark, sf):
    return report.attachment_items(_verified(spark, sf)).select("email_id", "att_pos", "filename", "source_format", "extraction", "detected_type")


@query(bridge.oracle("""select email_id, subject, case review_reason when 'missing_attachment' then 'Missing Attachment' when 'wrong_doc_type' then 'Wrong Doc Type' when 'missing_value' then 'Missing Value' else 'Unreadable' end as reason,
  coalesce(i.issue, 'No attachments were available') as issue from expected join emails_v using (email_id) left join (select email_id, string_agg(filename || ': text', ' · ' order by att_pos) as issue from attachments_v group by 1) i using (email_id) where status = 'NEEDS_REVIEW'""", _E, "emails_v", "attachments_v"))  # fmt: skip
def f13_review_cards(spark, sf):
    return report.review_cards(report.review_queue(_verified(spark, sf))).select("email_id", "subject", "reason", "issue")


@query(bridge.oracle("""select email_id, status as final_status, case when tm in (0, 6, 7, 8, 9) and dm <= 6 then 'doc_' || k || '_SI.txt' end as si, case when tm in (0, 6, 7, 8, 9) and dm <= 6 then containers || ' x 40HC' end as si_containers,
  case when tm in (0, 6, 7, 8, 9) and dm <= 6 then cast(weight * 1000 as varchar) end as bl_weight from expected e join (select email_id, containers, weight from facts) f using (email_id)""", _E))  # fmt: skip
def b8_diagnostics(spark, sf):
    shape = "final_status string, selected_documents struct<si:string>, fields_extracted struct<si:struct<container_count:string>>, normalized_values struct<bl:struct<gross_weight_kg:string>>"
    d = report.diagnostics(_verified(spark, sf)).select("email_id", F.from_json("record", shape).alias("r"))  # each record is read once
    return d.select("email_id", "r.final_status", "r.selected_documents.si", F.col("r.fields_extracted.si.container_count").alias("si_containers"), F.col("r.normalized_values.bl.gross_weight_kg").alias("bl_weight"))


@query("select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then null when 1 then cast(cast(l_quantity as bigint) as varchar) || '500' else cast(cast(l_quantity as bigint) * 1000 as varchar) end as kg from lineitem")
def h31_unicode_blanks(spark, sf):
    q, m = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber") % 3
    raw = F.when(m == 0, F.concat(q, F.lit("\u00a0500 KG"))).when(m == 1, F.concat(q, F.lit("500\u202fKG"))).otherwise(F.concat(F.lit("\u2003"), q, F.lit("\u00a0metric\u202ftons")))
    return _spread(_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).select("l_orderkey", "l_linenumber", t.normalize_weight(raw).alias("kg"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'SI' when 1 then 'BL' when 2 then 'OTHER' else null end as document_type from orders")
def i3_unicode_titles(spark, sf):
    title = F.get(F.array(*map(F.lit, ["SHIPPING\u00a0INSTRUCTION", "BILL\u202fOF\u00a0LADING", "\u2003Packing\u00a0List", "x\u00a0y"])), (F.col("o_orderkey") % 4).cast("int"))
    none = F.lit(None).cast("string")
    return identify.assess(_table(spark, sf, "orders").select("o_orderkey", title.alias("content"), F.lit("a.txt").alias("filename"), none.alias("type_hint"), none.alias("read_error"))).select("o_orderkey", "document_type")


@query("select n_nationkey, replace(n_name, '_', ' ') as shown, case when n_nationkey % 2 = 0 then '250 ms' else '2.50 s' end as duration, case when n_nationkey % 2 = 0 then '3 KB' else '4.77 MB' end as size from nation")
def h16_for_people(spark, sf):
    even = F.col("n_nationkey") % 2 == 0
    return _table(spark, sf, "nation").select("n_nationkey", t.humanize(F.col("n_name")).alias("shown"), t.show_duration(F.when(even, 0.25).otherwise(2.5)).alias("duration"), t.show_bytes(F.when(even, 3000).otherwise(5_000_000)).alias("size"))


@query("select p_partkey, case p_partkey % 5 when 0 then 'si' when 1 then 'bl' when 2 then 'si' else null end as kind from part")
def h11_titled_kind(spark, sf):
    content = F.get(F.array(*map(F.lit, ["Shipping\u00a0Instruction", "Ocean Bill", "Bill of Lading Instruction", "SI and BOL", "Packing list"])), (F.col("p_partkey") % 5).cast("int"))
    return _table(spark, sf, "part").select("p_partkey", extract.titled_kind(content, F.lit("a.txt")).alias("kind"))


def _explanation_sql() -> str:
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
    n, tick = "chr(10)", "chr(10) || '✓ '"
    bl_pod = f"case when dm = 3 then 'elsewhere' else {norm('port_b')} end"
    bl_boxes = "cast(containers + case when dm = 2 then 1 else 0 end as varchar)"
    sides = {
        "shipper": (norm("shipper"),) * 2, "consignee": (norm("consignee"),) * 2, "notify_party": (norm("consignee"),) * 2, "port_of_loading": (norm("port_a"),) * 2, "port_of_discharge": (norm("port_b"), bl_pod),
        "container_count": ("cast(containers as varchar)", bl_boxes), "gross_weight_kg": ("cast(weight * 1000 as varchar)",) * 2,
    }
    rows = ", ".join(f"rpad('{f}', 22, ' ') || ' ' || rpad({a}, 29, ' ') || ' ' || rpad({b}, 29, ' ') || ' ' || case when {a} = {b} then 'MATCH' else 'MISMATCH' end" for f, (a, b) in sides.items())
    head = f"{'Field':<22} {'SI':<29} {'BL':<29} Result"
    differs = " ".join(f"when '{f}' then 'SI = ' || {a} || {n} || 'BL = ' || {b}" for f, (a, b) in sides.items())
    why = f"'✓ ' || replace(replace(replace(replace(reasons, '; ', {tick}), 'SI signal', 'SI detected'), 'BL signal', 'BL detected'), 'action: compare', 'comparison wording detected (compare)')"
    shown = "a.reasons"
    for title in ("shipping instruction", "bill of lading", "invoice"):
        shown = f"replace({shown}, 'content heading: {title}', 'heading: {title.upper()}')"
    block = f"array_to_string(['Attachment: ' || v.filename, 'Detected type: ' || a.document_type, 'Source format: ' || upper(regexp_extract(v.filename, '[^.]*$')), 'Extraction: text', 'Evidence:', '✓ ' || replace({shown}, '; ', {tick})], {n})"
    files = f"select v.email_id, string_agg({block}, {n} || {n} order by v.att_pos) as files from attachments_v v join ({_ASSESSED}) a on a.email_id = v.email_id and a.att_pos = v.att_pos group by 1"
    return f"""select email_id, array_to_string(['EMAIL: ' || email_id, 'Subject: ' || subject, '', 'CLASSIFICATION', 'Decision: ' || category, '', 'Why:',
  case when reasons = '' then '✓ no category-specific rule signal; default GENERAL rule applied' else {why} end, '', 'DOCUMENT IDENTIFICATION', '', coalesce(files, 'No attachments found.'), '', 'FIELD COMPARISON', '',
  case when status in ('OK', 'MISMATCH') then array_to_string(['{head}', '{"-" * 89}', {rows}], {n}) else 'No safe field comparison was performed.' end, '', 'FINAL DECISION', '', coalesce(status, 'Not applicable'),
  case status when 'OK' then {n} || 'Reason:' || {n} || 'all seven required fields match after normalization' when 'NEEDS_REVIEW' then {n} || 'Reason:' || {n} || review_reason
    when 'MISMATCH' then array_to_string(['', 'Defect fields:', '- ' || defect_fields, '', 'Reason:', defect_fields || ' differs after normalization', case defect_fields {differs} end], {n}) end], {n}) as explanation
  from (select e.email_id, e.category, e.status, e.defect_fields, e.review_reason, e.reasons, m.subject, fs.files, f.* exclude (email_id) from expected e join emails_v m using (email_id) join facts f using (email_id) left join ({files}) fs using (email_id))"""


@query(bridge.oracle(_explanation_sql(), _E, "emails_v", "attachments_v"))
def i11_explain(spark, sf):
    return report.explain(_verified(spark, sf))


# --- sets, versions, formats, measures


@query("""with o as (select concat('email_', cast(o_orderkey as varchar)) as email_id, o_orderkey as k from orders)
select 'equal' as case_, cast(0 as bigint) as missing, cast(0 as bigint) as unknown, true as same
union all select 'unequal', (select count(*) from o where k % 7 <> 0 and k % 5 = 0), (select count(*) from o where k % 7 = 0 and k % 5 <> 0), false""")
def g2_set_equality(spark, sf):
    o = _table(spark, sf, "orders").select(F.concat(F.lit("email_"), F.col("o_orderkey").cast("string")).alias("email_id"), F.col("o_orderkey").alias("k"))
    side = lambda name: F.count_if(F.col("side") == name).alias(name)
    out = None
    for case, a, b in (("equal", o, o.orderBy(F.desc("k"))), ("unequal", o.where("k % 7 <> 0"), o.where("k % 5 <> 0"))):
        d = report.differences(a, b).agg(side("missing"), side("unknown")).withColumn("case_", F.lit(case)).withColumn("same", F.lit(report.same_ids(a, b)))
        out = d if out is None else out.unionByName(d)
    return out


_VERSIONS = """select version, cast(count(*) filter (version = 1 or k % 10 = 3) as bigint) as decided, count(*) as processed, count(*) filter (category = 'BL_COMPARISON') as comparisons,
  count(*) filter (status = 'OK') as ok, count(*) filter (status = 'MISMATCH') as mismatch, count(*) filter (status = 'NEEDS_REVIEW') as needs_review, 'tables' as source, 'bridge' as loader
  from expected, (select unnest([1, 2]) as version) group by version"""


def _snapshots(spark, sf) -> snapshots.Snapshots:
    """Two versions: all emails, then the same with some words added to every tenth."""
    store = snapshots.Snapshots(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")
    emails, attachments = bridge.emails_and_attachments(spark, sf)
    for e in (emails, emails.withColumn("body", F.when(F.col("k") % 10 == 3, F.concat("body", F.lit(" Thanks."))).otherwise(F.col("body")))):
        store.update(e, attachments, source="tables", loader="bridge")
    return store


@query(bridge.oracle(_VERSIONS, _E))
def l10_incremental_versions(spark, sf):
    store = _snapshots(spark, sf)
    names = ["version", "decided", "processed", "comparisons", "ok", "mismatch", "needs_review", "source", "loader"]
    return spark.createDataFrame([tuple(store.summary(n)[c] for c in names) for n in store.versions()], "version int, decided long, processed long, comparisons long, ok long, mismatch long, needs_review long, source string, loader string")


@query(bridge.oracle("""select email_id, category, status, review_reason, cast(case when defect_fields = '' then 0 else 1 end as int) as defect_count, cast((select count(*) from expected) as bigint) as total
  from expected where email_id > 'email_00000500' order by email_id limit 25""", _E))
def l7_page_behind_an_id(spark, sf):
    rows, total = _snapshots(spark, sf).page("email_00000500", 25)
    return rows.drop("subject").withColumn("total", F.lit(total).cast("long"))


@query(bridge.oracle("""select stage, name, cast(value as bigint) as value from (
  select 'load' as stage, 'rows' as name, count(*) as value from expected union all select 'read', 'rows', count(*) from attachments_v union all select 'read', 'characters', sum(length(content)) from attachments_v union all select 'read', 'unreadable', 0
  union all select 'extract', 'rows', count(*) from attachments_v union all select 'extract', 'documents', count(*) from attachments_v join facts using (email_id) where att_pos = 0 or dm <> 7
  union all select 'classify', 'rows', count(*) from expected union all select 'classify', 'comparisons', count(*) filter (category = 'BL_COMPARISON') from expected
  union all select 'compare', 'rows', count(*) from expected union all select 'compare', 'ok', count(*) filter (status = 'OK') from expected union all select 'compare', 'mismatch', count(*) filter (status = 'MISMATCH') from expected
  union all select 'compare', 'needs_review', count(*) filter (status = 'NEEDS_REVIEW') from expected union all select 'compare', 'compared', count(*) filter (tm in (0, 6, 7, 8, 9) and dm <= 6) from expected)""", _E, "attachments_v"))
def b9_observed_stages(spark, sf):
    m = measure.Measured()
    m.verify(*bridge.emails_and_attachments(spark, sf)).write.format("noop").mode("overwrite").save()  # the one job; every column is made, none is kept
    rows = [(stage, k, int(x)) for stage, found in m.counts().items() for k, x in found.items() if k not in ("seconds", "values")]
    return spark.createDataFrame(rows, "stage string, name string, value long")


@query(bridge.oracle("select email_id, category, status, defect_fields, review_reason from expected", _E))
def a3_inbox_format(spark, sf):
    d = bridge.over_inboxes(spark, sf, lambda root: decide.decide(*inbox_format.read_source(spark, root)))
    return d.select("email_id", "category", "status", _joined("defect_fields").alias("defect_fields"), "review_reason")


@query(bridge.oracle("select email_id, category, status, defect_fields, review_reason from expected", _E))
def a11_folder_of_files(spark, sf):
    d = bridge.over_inboxes(spark, sf, lambda root: decide.decide(*bundle.read_bundle(spark, root)))
    return d.select("email_id", "category", "status", _joined("defect_fields").alias("defect_fields"), "review_reason")


@query("select concat('m', cast(o_orderkey as varchar)) as email_id, o_orderpriority as priority, case when o_orderkey % 2 = 0 then o_orderstatus end as second_tag, o_orderkey % 3 = 0 as urgent from orders")
def b6_metadata(spark, sf):
    own = {"email_id": F.concat(F.lit("m"), F.col("o_orderkey").cast("string")), "headers": F.struct(F.struct(F.col("o_orderpriority").alias("level")).alias("priority"), (F.col("o_orderkey") % 3 == 0).alias("urgent"))}
    tags = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("first"), F.col("o_orderstatus"))).otherwise(F.array(F.lit("first")))
    payloads = _table(spark, sf, "orders").select(F.to_json(F.struct(*[c.alias(k) for k, c in own.items()], tags.alias("tags"))).alias("value"))
    get = lambda path, kind: F.try_variant_get("metadata", path, kind)
    return bundle.email_rows(bundle.email_items(payloads, True)).select("email_id", get("$.headers.priority.level", "string").alias("priority"), get("$.tags[1]", "string").alias("second_tag"), get("$.headers.urgent", "boolean").alias("urgent"))


@query(bridge.oracle("""select email_id, row_number() over (order by email_id) as number, (row_number() over (order by email_id) - 1) // 100 as part, cast(count(*) over () as bigint) as total, true as titled
  from expected where status in ('MISMATCH', 'NEEDS_REVIEW')""", _E))
def a29_audit_sections(spark, sf):
    parts = audit.audit_parts(report.problems(_verified(spark, sf)), 100)
    titled = F.col("html").startswith("<h2>Email audit: email_") & F.col("html").endswith("</pre>") & (F.octet_length("html") == F.col("length"))
    total = parts.agg(F.count(F.lit(1)).alias("total"))
    return parts.select("email_id", "number", "part", titled.alias("titled")).withColumn("total", F.lit(total.first()[0]).cast("long"))


@query(bridge.oracle("""select email_id, category, status, defect_fields, review_reason, cast(case when tm in (0, 6, 7, 8, 9) and dm <> 9 then 2 else 1 end as int) as version from expected""", _E))
def j_late_attachments(spark, sf):
    """A stream over emails and shipping instructions, and from its checkpoint once more when the bills have come: the last decisions and how often each email was decided."""
    root, files = bridge.written_inbox(spark, sf, files=False)
    for pos in (0, 1):
        bridge.write_files(files.where(F.col("att_pos") == pos), f"{root}/attachments")
        stream.verify_stream(spark, root, f"{root}/checkpoint", lambda d, n: d.write.mode("append").parquet(f"{root}/decided")).awaitTermination()
    return stream.latest(spark.read.parquet(f"{root}/decided")).select("email_id", "category", "status", _joined("defect_fields").alias("defect_fields"), "review_reason", "version")


# --- two labels on a line, two defects, every rule of the checks, long cells

_TWO_TEXT = """concat_ws(chr(10), 'DRAFT BILL OF LADING', concat('Shipper: ', shipper), concat('Consignee: ', consignee, ' |Notify Party: ', consignee), concat('POL: ', port_a, '  POD: Elsewhere'),
  concat('Containers: ', cast(containers + 1 as string), ' containers'), concat('Gross Weight: ', cast(weight as string), ',000 KGS'))"""


@query(bridge.oracle(f"""select email_id, 'MISMATCH' as status, 'port_of_discharge; container_count' as defect_fields, f.field, f.a as si_raw, f.b as bl_raw, f.c as si_norm, f.d as bl_norm, case when f.field in ('port_of_discharge', 'container_count') then 'MISMATCH' else 'MATCH' end as result
  from facts, lateral (values ('shipper', shipper, shipper, {_NORM.format('shipper')}, {_NORM.format('shipper')}), ('consignee', consignee, consignee, {_NORM.format('consignee')}, {_NORM.format('consignee')}),
  ('notify_party', 'Same as consignee', consignee, {_NORM.format('consignee')}, {_NORM.format('consignee')}), ('port_of_loading', port_a, port_a, {_NORM.format('port_a')}, {_NORM.format('port_a')}), ('port_of_discharge', port_b, 'Elsewhere', {_NORM.format('port_b')}, 'elsewhere'),
  ('container_count', containers || ' x 40HC', (containers + 1) || ' containers', containers::varchar, (containers + 1)::varchar), ('gross_weight_kg', weight || '000 KG', weight || ',000 KGS', (weight * 1000)::varchar, (weight * 1000)::varchar)) f(field, a, b, c, d)
  where tm in (0, 6, 7, 8, 9) and dm <> 9"""))
def b11_detail_values(spark, sf):
    emails, attachments = bridge.emails_and_attachments(spark, sf)
    two = spark.table("facts").select("email_id", F.expr(_TWO_TEXT).alias("_two"))
    a = attachments.join(two, "email_id").withColumns({"content": F.when(F.col("att_pos") == 1, F.col("_two")).otherwise(F.col("content")), "filename": F.when(F.col("att_pos") == 1, "two_BL.txt").otherwise(F.col("filename"))}).drop("_two")
    v_ = decide.verify(emails, a).where("status = 'MISMATCH'")
    return report.detail(v_).drop("field_ord", "audit_result").join(v_.select("email_id", "status", _joined("defect_fields").alias("defect_fields")), "email_id")


#: What breaks each invariant, by o_orderkey % 10: category, status, has_defect, defect_fields, review_reason, and the violation; 0 breaks none.
_BREAKS = [
    ("BL_COMPARISON", "MISMATCH", True, ["shipper", "consignee"], None, None), ("LETTER", None, False, [], None, "unknown category"), ("GENERAL", None, None, [], None, "defect columns missing"),
    ("BL_COMPARISON", "MISMATCH", True, ["colour"], None, "unknown defect field"), ("BL_COMPARISON", "MISMATCH", True, ["shipper", "shipper"], None, "repeated defect field"), ("SPAM", "OK", False, [], None, "comparison values on another category"),
    ("BL_COMPARISON", "MAYBE", False, [], None, "unknown status"), ("BL_COMPARISON", "OK", False, [], "unreadable", "defects on OK"), ("BL_COMPARISON", "MISMATCH", True, [], None, "mismatch without defects"), ("BL_COMPARISON", "NEEDS_REVIEW", False, [], "tired", "review without reason"),
]


@query("select concat('e', cast(o_orderkey as varchar)) as email_id, case o_orderkey % 10 " + " ".join(f"when {i} then '{x[5]}'" for i, x in enumerate(_BREAKS) if x[5]) + " end as violation from orders where o_orderkey % 10 <> 0 union all select concat('e', cast(o_orderkey as varchar)), 'duplicate email_id' from orders where o_orderkey % 13 = 0")
def i10_every_rule(spark, sf):
    o, k = _table(spark, sf, "orders"), F.col("o_orderkey") % 10
    kind = "struct<category:string,status:string,has_defect:boolean,defect_fields:array<string>,review_reason:string>"
    broken = F.coalesce(*[F.when(k == i, F.struct(F.lit(x[0]), F.lit(x[1]), F.lit(x[2]), F.array(*map(F.lit, x[3])).cast("array<string>"), F.lit(x[4])).cast(kind)) for i, x in enumerate(_BREAKS)])
    d = o.select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("email_id"), broken.alias("x"), "o_orderkey").select("email_id", "x.*", "o_orderkey")
    once = report.violations(d.drop("o_orderkey"))
    twice = report.violations(d.where("o_orderkey % 13 = 0").drop("o_orderkey").unionByName(d.where("o_orderkey % 13 = 0").drop("o_orderkey"))).where("violation = 'duplicate email_id'")
    return once.unionByName(twice)


@query("select c_custkey, case when length(x) > 29 then x[:28] || '…' else rpad(x, 29, ' ') end as cell from (select c_custkey, trim(regexp_replace(case when c_custkey % 2 = 0 then c_name else c_name || '  of ' || chr(10) || c_name || ' and ' || c_mktsegment end, '\\s+', ' ', 'g')) as x from customer)")
def h18_long_cells(spark, sf):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("  of \n"), "c_name", F.lit(" and "), "c_mktsegment"))
    return _table(spark, sf, "customer").select("c_custkey", t.cell(raw, 29).alias("cell"))


@query(f"""select c_custkey, {_NORM.format('c_name')} || ' limited' as party, case when c_custkey % 2 = 0 then 'singapore' else {_NORM.format('c_mktsegment')} end as port, c_custkey::varchar as containers, (c_custkey * 1000)::varchar as weight,
  (c_custkey + 0.5)::double as number, f.field, f.raw from customer, lateral (values ('shipper', c_name), ('port_of_loading', c_mktsegment), ('container_count', c_custkey::varchar)) f(field, raw)""")
def k_sql_functions(spark, sf):
    """In SQL text alone: scalar functions, and the table function of fields beside each row."""
    sql.register(spark)
    return spark.sql(f"""select c_custkey, shipcheck_party(concat(c_name, ', Ltd.')) as party, shipcheck_port(case when c_custkey % 2 = 0 then 'Singapore (SGSIN)' else c_mktsegment end) as port, shipcheck_containers(concat(c_custkey, ' x 40HC')) as containers,
      shipcheck_weight(concat(c_custkey, ' MT')) as weight, cast(shipcheck_number(concat(c_custkey, ',5')) as double) as number, f.field, f.raw
      from parquet.`{sf}/customer.parquet`, lateral shipcheck_fields(concat('Shipper: ', c_name, '\n', 'POL: ', c_mktsegment, '\n', 'No. of Containers: ', c_custkey)) f where f.raw is not null""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
