"""Continuous inboxes: emails and attachments arrive as files, in any order, and an email is decided again when
something arrives that it lacked.

What has arrived is kept between batches.  References wait for their files, and files for references, in the state of a
stream-stream join with watermarks.  What is known of an email (its texts, its examined attachments without contents) is
in the state of its bucket, and all that follows is row by row.  A batch reads its own files alone, and a restart goes on
from the checkpoint."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.decide import FIELDS_READ, examine, judge
from ..operators.identify import item
from ..sources.bundle import attachment_refs, contained, decode_attachments, email_items, email_rows

#: Hours for which references and files wait for each other.
WAIT = 72
_FILE = "path string, modificationTime timestamp, length long, content binary"
#: Groups of emails that have one state: a call for each email cost milliseconds.  A checkpoint holds for one number of them.
BUCKETS = 2048
#: JSON: by email_id its email, print, items, version, and the time until which it is remembered.
_STATE = "kept string"
#: Tasks that look up the files of a batch, or Spark would take one for each file (up to 10,000); set for the session.
_LISTING = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "64")
_DOSSIER = "email_id string, version int, event string, email string, items string"
#: Of two items for an attachment the surer stays.
_SURE = {"lost": 0, "near": 1, "found": 2}
_REF = ["email_id", "att_pos", "arrived", "filename", "source", "inline", "encoded", "type_hint"]


def arriving(spark: SparkSession, folder: str, names: str = "*", per_batch: int | None = None) -> DataFrame:
    """path, content, arrived of every new file below a folder."""
    d = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", names)
    return (d if per_batch is None else d.option("maxFilesPerTrigger", per_batch)).load(folder).select("path", "content", F.col("modificationTime").alias("arrived"))


def events(emails: DataFrame, files: DataFrame, wait: int = WAIT) -> tuple[DataFrame, str]:
    """Rows (email_id, arrived, kind, att_pos, text, print): the texts of an email (`email`), and the items of its attachments (`found`, `near` if
    a file lies under its name alone, `lost` as long as nothing has come); and the type of an item."""
    span = f"{wait} hours"
    mails = email_rows(email_items(emails.select(F.col("content").cast("string").alias("value"), "arrived").withWatermark("arrived", span), True, ("arrived",)), ("arrived",)).where("email_id is not null")
    head = F.to_json(F.struct("subject", "body", "sender"))
    heads = mails.select("email_id", "arrived", F.lit("email").alias("kind"), F.lit(-1).alias("att_pos"), head.alias("text"), F.sha2(F.concat(head, F.array_join(F.transform("refs", lambda r: F.to_json(r)), "\n")), 256).alias("print"))
    refs = attachment_refs(mails, None, ("arrived",))
    given = F.col("inline").isNotNull() | F.col("encoded").isNotNull()
    places = F.array_distinct(F.array_compact(F.array(contained(F.col("source")), F.regexp_extract("source", r"([^/\\]*)$", 1))))  # the path as given, else its name
    came = files.withWatermark("arrived", span).select(F.regexp_extract("path", "/attachments/(.*)$", 1).alias("_name"), F.col("content").alias("content"), F.col("arrived").alias("_came"))
    near = F.expr(f"_place = _name and _came >= arrived - interval {span} and _came <= arrived + interval {span}")
    sought = refs.where(~given).select(*_REF, F.posexplode(places).alias("_rank", "_place"))
    found = sought.join(came, near).select(*_REF, "content", F.when(F.col("_rank") == 0, "found").otherwise("near").alias("kind"))
    first = refs.select(*_REF, F.lit(None).cast("binary").alias("content"), F.when(given, "found").otherwise("lost").alias("kind"))
    parts = examine(decode_attachments(first.unionByName(found), None, ("kind", "arrived")))
    parts = parts.withColumn("_item", item(parts, *FIELDS_READ))
    shown = parts.select("email_id", "arrived", "kind", "att_pos", F.to_json("_item").alias("text"), F.lit("").alias("print"))
    return heads.unionByName(shown), parts.schema["_item"].dataType.simpleString()


def _gathered(keep: int):
    """The state function: what the groups of a bucket's emails hold after a batch; a row only where that changes what is known."""

    def gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, touched, out, watermark = json.loads(state.get[0]) if state.exists else {}, {}, [], state.getCurrentWatermarkMs()
        for batch in () if state.hasTimedOut else batches:
            times = (batch["arrived"] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)
            for email_id, kind, pos, text, mark, at in zip(*(batch[c].tolist() for c in ("email_id", "kind", "att_pos", "text", "print")), times.tolist(), strict=True):
                known = kept.setdefault(email_id, {"email": None, "print": None, "items": {}, "version": 0})
                changed, latest_ = touched.get(email_id, (False, watermark))  # the watermark of a first batch is 1970
                if kind == "email":
                    if known["email"] is None:
                        known["email"], known["print"], changed = text, mark, True
                    elif mark != known["print"]:  # the same id with other contents; the same once more is no event
                        out.append((email_id, known["version"], "duplicate", text, None))
                elif _SURE[kind] > known["items"].get(str(pos), [-1])[0]:
                    known["items"][str(pos)], changed = [_SURE[kind], text], True
                touched[email_id] = changed, max(latest_, at)
        for email_id, (changed, at) in touched.items():
            known = kept[email_id]
            known["until"] = at + keep * 3_600_000
            if changed and known["email"] is not None:
                known["version"] += 1
                out.append((email_id, known["version"], "decided", known["email"], "[" + ",".join(known["items"][p][1] for p in sorted(known["items"], key=int)) + "]"))
        kept = {k: x for k, x in kept.items() if k in touched or x["until"] >= watermark}
        if kept:
            state.update((json.dumps(kept),))
            state.setTimeoutTimestamp(max(min(x["until"] for x in kept.values()), watermark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["email_id", "version", "event", "email", "items"])

    return gather


def decisions_of(emails: DataFrame, files: DataFrame, wait: int = WAIT) -> DataFrame:
    """A stream of verified decisions (as verify gives them) with version and event: `decided`, first and whenever an attachment
    arrives that was lost before; `duplicate` (nothing decided) for an id that comes again with other contents.

    emails and files: streams as of arriving().  Files and references wait `wait` hours for each other, and
    an email is remembered for twice as long (by the time of what arrives).  Emails without an id are left out."""
    rows, kind = events(emails, files, wait)
    d = rows.withColumn("bucket", F.pmod(F.xxhash64("email_id"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(_gathered(2 * wait), _DOSSIER, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    d = d.withColumn("_email", F.from_json("email", "subject string, body string, sender string"))
    d = d.select("email_id", "version", "event", "_email.*", F.from_json("items", f"array<{kind}>").alias("items"))
    d = d.withColumn("items", F.when(F.size("items") > 0, F.col("items")))
    told = judge(d, "version", "event")
    undecided = ["category", "status", "has_defect", "defect_fields", "review_reason", "classification_reasons"]
    return told.withColumns({c: F.when(F.col("event") == "decided", F.col(c)) for c in undecided})


def verify_stream(spark: SparkSession, bundle: str, checkpoint: str, sink: Callable[[DataFrame, int], None], wait: int = WAIT, per_batch: int | None = None, every: str | None = None) -> StreamingQuery:
    """Verifies the emails of <bundle>/inbox/*.json as they and the files of <bundle>/attachments arrive; each batch goes to
    sink(decisions, number).  every: seconds between batches ("10 seconds"); without it, what is there is worked off and the stream ends."""
    d = decisions_of(arriving(spark, f"{bundle}/inbox", "*.json", per_batch), arriving(spark, f"{bundle}/attachments", "*", per_batch), wait)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    spark.conf.set(*_LISTING)  # a file source asks the session itself, whenever a batch begins
    return d.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def latest(decisions: DataFrame) -> DataFrame:
    """Of all that a stream has decided, each email's last decision."""
    rows = decisions.where("event = 'decided'")
    return rows.groupBy("email_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "email_id"]), "version").alias("d")).select("email_id", "d.*")
