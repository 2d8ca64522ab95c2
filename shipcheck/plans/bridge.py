"""Deterministic emails and attachments from the star tables, by SQL text that Spark and DuckDB share."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..sources.fetch import store
from ..sources.shared import materialise, shared_dir

TABLES = ["orders", "customer", "nation", "supplier", "lineitem"]

#: One row per order with line items: the facts that both documents state.
FACTS = """
select o.o_orderkey as k, concat('email_', lpad(cast(o.o_orderkey as string), 8, '0')) as email_id,
       cast(o.o_orderkey % 12 as int) as tm, cast(o.o_orderkey % 11 as int) as dm,
       s.s_name as shipper, c.c_name as consignee, a.n_name as port_a, b.n_name as port_b, l.containers as containers, l.weight as weight
from orders o
join customer c on c.c_custkey = o.o_custkey
join nation b on b.n_nationkey = c.c_nationkey
join (select l_orderkey, min(l_suppkey) as suppkey, count(*) as containers, cast(sum(l_quantity) as bigint) as weight from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey
join supplier s on s.s_suppkey = l.suppkey
join nation a on a.n_nationkey = s.s_nationkey
"""

#: subject, body and attachments by o_orderkey % 12.
EMAILS = """
select email_id, k, tm, dm, consignee as sender,
  case when tm in (0, 6, 7, 8, 9) then 'Two drafts to compare: SI and BL' when tm = 1 then 'Booking without papers' when tm = 2 then 'Freight invoice of last month' when tm = 3 then 'Canteen menu'
       when tm = 4 then 'The lottery says: you have won' when tm = 5 then 'Account verification due' when tm = 10 then 'Papers' else 'Draft BL of yesterday' end as subject,
  case when tm in (0, 6, 7, 8, 9) then 'Both files are below.' when tm = 1 then 'We ask for a new SI for this load.' when tm = 2 then 'Its payment went to another office.' when tm = 3 then 'Soup is served at noon.'
       when tm = 4 then 'A winner should claim your prize.' when tm = 5 then 'Sign in and act now.' when tm = 10 then 'Could you hold the shipping instruction against the draft BL?'
       else concat_ws(chr(10), 'Until Thursday.', 'On Tuesday a colleague wrote:', '> could you check SI with BL') end as body
from facts
"""

ATTACHMENTS = """
select email_id, 0 as att_pos, concat('doc_', cast(k as string), '_SI.txt') as filename,
  concat_ws(chr(10), 'SHIPPING INSTRUCTION', concat('Shipper / Exporter: ', shipper), concat('Consignee: ', consignee), 'Notify Party: Same as consignee', concat('Port of Loading: ', port_a),
            concat('Port of Discharge: ', port_b), concat('No. of Containers: ', cast(containers as string), ' x 40HC'), concat('Total Gross Weight: ', cast(weight as string), '000 KG')) as content
from facts where tm in (0, 6, 7, 8, 9)
union all
select email_id, 1 as att_pos, concat('doc_', cast(k as string), case when dm = 8 then '_BL.png' when dm = 10 then '_SI2.txt' else '_BL.txt' end) as filename,
  case when dm = 7 then concat_ws(chr(10), 'COMMERCIAL INVOICE', concat('Consignee: ', consignee))
       when dm = 10 then concat_ws(chr(10), 'SHIPPING INSTRUCTION', concat('Consignee: ', consignee))
       else concat_ws(chr(10), 'DRAFT BILL OF LADING', concat(case when dm = 1 then 'EXPORTER' else 'Shipper' end, ': ', upper(shipper)),
            concat(case when dm = 1 then 'Receiver' else 'Consignee' end, case when dm = 1 then chr(9) else ': ' end, consignee),
            case when dm = 5 then 'Notify Party: TBA' when dm <> 6 then concat('Notify Party:', chr(10), '  ', consignee) end,
            concat(case when dm = 1 then 'POL' else 'Load Port' end, ' : ', port_a), concat(case when dm = 1 then 'POD' else 'Discharge Port' end, ': ', case when dm = 3 then 'Elsewhere' else port_b end),
            concat('Containers: ', cast(containers + case when dm = 2 then 1 else 0 end as string), ' containers'),
            concat('Gross Weight: ', cast(weight as string), case when dm = 4 then ' MT' else ',000 KGS' end)) end as content
from facts where tm in (0, 6, 7, 8, 9) and dm <> 9
"""

#: What the rules must decide, from the moduli alone.
EXPECTED = """
select email_id, k, tm, dm,
  case when tm in (0, 6, 7, 8, 9, 10) then 'BL_COMPARISON' when tm = 1 then 'SI_REQUEST' when tm = 2 then 'INVOICE_QUERY' when tm in (4, 5) then 'SPAM' else 'GENERAL' end as category,
  case when tm = 10 then 'NEEDS_REVIEW' when tm in (0, 6, 7, 8, 9) then case when dm in (0, 1, 4) then 'OK' when dm in (2, 3) then 'MISMATCH' else 'NEEDS_REVIEW' end end as status,
  tm in (0, 6, 7, 8, 9) and dm in (2, 3) as has_defect,
  case when tm in (0, 6, 7, 8, 9) and dm = 2 then 'container_count' when tm in (0, 6, 7, 8, 9) and dm = 3 then 'port_of_discharge' else '' end as defect_fields,
  case when tm = 10 then 'missing_attachment' when tm in (0, 6, 7, 8, 9) then case when dm in (5, 6) then 'missing_value' when dm in (7, 10) then 'wrong_doc_type' when dm = 8 then 'unreadable' when dm = 9 then 'missing_attachment' end end as review_reason,
  case when tm in (0, 6, 7, 8, 9) then 'SI signal; BL signal; action: compare' when tm = 1 then 'new si' when tm = 2 then 'invoice; payment'
       when tm = 4 then 'prize claim: lottery; prize claim: you have won; prize claim: winner; prize claim: claim your prize' when tm = 5 then 'account risk: account verification; supporting risk: sign in'
       when tm = 10 then 'current body comparison request; current body phrase: shipping instruction against; current body document: shipping instruction' else '' end as reasons
from facts
"""


def oracle(sql: str, *parts: str) -> str:
    """A DuckDB statement over the views named in parts (facts always)."""
    views = {"facts": FACTS, "emails_v": EMAILS, "attachments_v": ATTACHMENTS, "expected": EXPECTED}
    return "with " + ", ".join(f"{n} as ({views[n]})" for n in ("facts", *parts)) + " " + sql


def facts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(FACTS)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined and dealt out by email once, and written: emails and both kinds of attachments are then made from what lies there."""
    return materialise(facts_of(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "email_id"), "facts")


def emails_and_attachments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    facts(spark, sf_dir).createOrReplaceTempView("facts")
    return views(spark)


def views(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Emails and attachments of the view facts."""
    extra = "cast(null as string) as type_hint, cast('text' as string) as extraction, cast(null as string) as read_error"
    return spark.sql(EMAILS), spark.sql(f"select *, {extra} from ({ATTACHMENTS})")


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def office_bytes(kind: str, name: str) -> bytes:
    """A small document that names a consignee; any other kind is a broken file."""
    if kind == ".docx":
        w, p = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
        row = "".join(f"<w:tc>{p.format(x)}</w:tc>" for x in ("Consignee", name))
        return _zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{p.format("Title")}<w:tbl><w:tr>{row}</w:tr></w:tbl></w:body></w:document>'})
    if kind == ".xlsx":
        s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        cells = "".join(f'<c t="inlineStr"><is><t>{x}</t></is></c>' for x in ("Consignee", name))
        return _zipped({
            "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>', "xl/worksheets/s1.xml": f'<worksheet xmlns="{s}"><sheetData><row>{cells}</row></sheetData></worksheet>',
        })
    if kind == ".pdf":
        content = f"BT /F1 12 Tf (Consignee: {name}) Tj ET"
        objects = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", f"<< /Length {len(content)} >>\nstream\n{content}\nendstream"]
        return ("%PDF-1.4\n" + "".join(f"{i} 0 obj\n{o}\nendobj\n" for i, o in enumerate(objects, 1))).encode()
    return b"broken"


def office_file(kind: Column, name: Column) -> Column:
    @F.pandas_udf(BinaryType())
    def made(kinds: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([office_bytes(k, n) for k, n in zip(kinds, names, strict=True)])

    return made(kind, name)


def write_files(named: DataFrame, folder: str) -> None:
    """The content of each row as a file of its own, at its path below the folder."""
    at, base = store(folder)

    def write(batches):
        made = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if (below := path.rsplit("/", 1)[0]) not in made:
                    at.create_dir(f"{base}/{below}", recursive=True)
                    made.add(below)
                with at.open_output_stream(f"{base}/{path}") as f:
                    f.write(content.encode())
            yield batch.select(["path"])

    named.select("path", "content").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


#: Folders of an inbox's attachments, the least number of its JSON files, and emails of a JSON file beyond that.
FOLDERS, PAYLOADS, MAILS = 64, 16, 5000


def _written(emails: DataFrame, attachments: DataFrame, root: str, files: bool, n: int) -> DataFrame:
    """n emails (about) and the files that they refer to as an inbox at root; the files (att_pos, path, content)."""
    named = attachments.select("email_id", "att_pos", "content", F.concat_ws("/", F.lpad(F.pmod(F.hash("email_id"), F.lit(FOLDERS)).cast("string"), 2, "0"), "filename").alias("path"))
    if files:
        write_files(named, f"{root}/attachments")
    refs = named.groupBy("email_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("att_pos", "path"))), lambda x: x["path"]).alias("attachments"))
    of = F.pmod(F.hash("email_id"), F.lit(max(PAYLOADS, -(-n // MAILS))))
    mails = emails.join(refs, "email_id", "left").select(of.alias("g"), F.struct("email_id", "subject", "body", F.col("sender").alias("from"), "attachments").alias("m"))
    mails.groupBy("g").agg(F.collect_list("m").alias("emails")).select("emails").write.option("maxRecordsPerFile", 1).json(f"{root}/inbox")
    return named


def written_inbox(spark: SparkSession, sf_dir: str, files: bool = True) -> tuple[str, DataFrame]:
    """The same emails as an inbox in the shared folder, payloads of many emails each in inbox/*.json, and the files that they refer to
    (att_pos, path, content), written below attachments/ unless that is left to the caller."""
    root = f"{shared_dir(spark)}/inbox-{uuid.uuid4().hex}"
    return root, _written(*emails_and_attachments(spark, sf_dir), root, files, spark.read.parquet(f"{sf_dir}/orders.parquet").count())


#: Emails of an inbox of over_inboxes: their files, of a disk block each, take about 2 GB.
AT_ONCE = 500_000


def over_inboxes(spark: SparkSession, sf_dir: str, decided: Callable[[str], DataFrame]) -> DataFrame:
    """decided(folder) of all the same emails, written as inboxes of AT_ONCE emails each.  An inbox is removed when what was decided
    of it has been written, so that disk holds the files of one, however many emails there are."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    n, name = max(1, -(-orders // AT_ONCE)), f"{shared_dir(spark)}/decided-{uuid.uuid4().hex}"
    facts_of(spark, sf_dir).withColumn("run", F.pmod(F.xxhash64("email_id"), F.lit(n)).cast("int")).repartition(n, "run").write.partitionBy("run").parquet(f"{name}/facts")
    for run in range(n):
        root = f"{shared_dir(spark)}/inbox-{uuid.uuid4().hex}"
        spark.read.parquet(f"{name}/facts").where(F.col("run") == run).drop("run").repartition(spark.sparkContext.defaultParallelism, "email_id").createOrReplaceTempView("facts")
        _written(*views(spark), root, True, min(orders, AT_ONCE))
        d = decided(root)
        d.write.mode("append").parquet(f"{name}/decisions")
        _removed(spark, root)
    return spark.read.schema(d.schema).parquet(f"{name}/decisions")


def _removed(spark: SparkSession, root: str) -> None:
    """The inbox at root, which over_inboxes has written, is removed: the folders of its files side by side, then what is left."""
    at, base = store(root)

    def remove(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                if at.get_file_info(folder := f"{base}/attachments/{i:02d}").type == fs.FileType.Directory:
                    at.delete_dir(folder)
            yield batch

    spark.range(FOLDERS).mapInArrow(remove, "id long").write.format("noop").mode("overwrite").save()
    at.delete_dir(base)
