"""The submission sink: decisions rendered in a template's shape, checked, and written as JSON."""

from __future__ import annotations

import json
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as v
from ..operators.report import differences, violations

REQUIRED = set(v.TEMPLATE_KEYS) - {"email_id"}
_ROW = "email_id string, category string, status string, has_defect boolean, defect_fields array<string>, review_reason string"


class SubmissionError(ValueError):
    """A payload that breaks the template or an invariant."""


def meaning(key: str) -> str | None:
    return next((name for name, keys in v.TEMPLATE_KEYS.items() if key.lower() in keys), None)


def told(entry) -> dict:
    """What an entry says under its recognised keys, at any depth; of several the last counts."""
    out: dict = {}
    for key, child in entry.items() if isinstance(entry, dict) else ((None, x) for x in entry) if isinstance(entry, list) else ():
        if key is not None and meaning(key):
            out[meaning(key)] = child
        out |= told(child)
    return out


def rendered(shape, values: dict):
    """The template's entry with every recognised key filled in; all else as it is."""
    if isinstance(shape, dict):
        return {k: values[meaning(k)] if meaning(k) in values else rendered(x, values) for k, x in shape.items()}
    return [rendered(x, values) for x in shape] if isinstance(shape, list) else shape


def load_template(path: str) -> dict:
    """A template is a JSON object of objects by email id, small enough for the driver; its first entry must have all required keys."""
    template = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(template, dict) or not template or not all(isinstance(x, dict) for x in template.values()):
        raise SubmissionError("a template is an object of objects by id")
    if lacking := REQUIRED - set(told(next(iter(template.values())))):
        raise SubmissionError(f"the template lacks {sorted(lacking)}")
    return template


def _held(bad: list, what: str) -> None:
    if bad:
        raise SubmissionError(f"{what}: {[tuple(r) for r in bad]}")


def build_submission(decisions: DataFrame, template: dict) -> dict:
    """The payload, in template order; the ids of both must agree, and what is rendered must hold all invariants."""
    spark = decisions.sparkSession
    expected = spark.createDataFrame([(i,) for i in template], "email_id string")
    _held(differences(expected, decisions, 5).collect(), "ids differ")
    rows = {r["email_id"]: r.asDict() for r in decisions.join(expected, "email_id").select("email_id", *sorted(REQUIRED)).collect()}  # as many as the template has
    payload = {i: rendered(shape, rows[i]) for i, shape in template.items()}
    validate_submission(spark, payload, list(template))
    return payload


def validate_submission(spark: SparkSession, payload: dict, expected_ids: list[str]) -> None:
    """Checks a payload by itself: its ids, that every entry says all that is required, and every invariant."""
    if set(payload) != set(expected_ids):
        raise SubmissionError("the payload's ids are not the expected ones")
    rows = []
    for i, entry in payload.items():
        said = told(entry)
        if lacking := REQUIRED - set(said):
            raise SubmissionError(f"{i} lacks {sorted(lacking)}")
        if not isinstance(said["has_defect"], bool) or not isinstance(said["defect_fields"], list):
            raise SubmissionError(f"{i}: has_defect is a boolean, defect_fields a list")
        rows.append((i, said["category"], said["status"], said["has_defect"], said["defect_fields"], said["review_reason"]))
    _held(violations(spark.createDataFrame(rows, _ROW)).limit(5).collect(), "invalid decisions")


# --- the bulk form


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """pos, email_id, shape (JSON text) of a template's entries, in its order; none of them comes to the driver."""
    entries = F.map_entries(F.from_json("value", "map<string,string>"))
    return spark.read.text(path, wholetext=True).select(F.posexplode(entries).alias("pos", "e")).select("pos", F.col("e.key").alias("email_id"), F.col("e.value").alias("shape"))


def _as_json(name: str, indent: int) -> Column:
    """A decision's value as indented JSON text."""
    c, pad = F.col(name), "\n" + " " * indent
    if name == "defect_fields":
        items = F.array_join(F.transform(c, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), f",{pad}  ")
        return F.when(F.size(c) > 0, F.concat(F.lit(f"[{pad}  "), items, F.lit(f"{pad}]"))).otherwise("[]")
    if name == "has_defect":
        return c.cast("string")
    text = F.to_json(F.array(c))
    return F.coalesce(F.substring(text, F.lit(2), F.length(text) - 2), F.lit("null"))


def compiled(shape: str) -> Column:
    """A template's entry as one Column over decisions: its constant text, and each value in its place, as JSON indented by two."""
    mark = lambda k: f"\x00{k}\x00"
    text = json.dumps(rendered(json.loads(shape), {k: mark(k) for k in v.TEMPLATE_KEYS}), indent=2, ensure_ascii=False).replace("\n", "\n  ")
    parts = re.split(r'"\\u0000(\w+)\\u0000"', text)
    out = []
    for i, part in enumerate(parts):
        before = "".join(parts[:i]).rsplit("\n", 1)[-1]
        out.append(_as_json(part, len(before) - len(before.lstrip(" "))) if i % 2 else F.lit(part))
    return F.concat(*out)


#: Different shapes up to which they become one expression.
SHAPES = 32


def entries(decisions: DataFrame, template: DataFrame) -> DataFrame:
    """pos, line: the submission's text for each row of template (pos, email_id, shape) that has a decision.

    Templates have few different shapes: each is compiled once into an expression.  Beyond SHAPES of them the
    entries are rendered row by row by the same rules."""
    rows = template.join(decisions.select("email_id", *sorted(REQUIRED)), "email_id")
    shapes = [r[0] for r in template.select("shape").distinct().limit(SHAPES + 1).collect()]
    if len(shapes) <= SHAPES:
        body = F.lit(None).cast("string")
        for shape in shapes:
            if lacking := REQUIRED - set(told(json.loads(shape))):
                raise SubmissionError(f"the template lacks {sorted(lacking)}")
            body = F.when(F.col("shape") == shape, compiled(shape)).otherwise(body)
    else:

        @F.pandas_udf("string")
        def body_of(shape: pd.Series, values: pd.Series) -> pd.Series:
            one = lambda s, x: json.dumps(rendered(json.loads(s), json.loads(x)), indent=2, ensure_ascii=False).replace("\n", "\n  ")
            return pd.Series([one(*p) for p in zip(shape, values, strict=True)])

        body = body_of("shape", F.to_json(F.struct("email_id", *sorted(REQUIRED)), {"ignoreNullFields": "false"}))
    key = F.to_json(F.array("email_id"))
    return rows.select("pos", F.concat(F.lit("  "), F.substring(key, F.lit(2), F.length(key) - 2), F.lit(": "), body).alias("line"))


def write_bulk(decisions: DataFrame, template: DataFrame, path: str) -> None:
    """The submission as a folder of text files which, one behind the other, are the JSON object that write_submission writes.

    Ids must be those of the template and decisions hold every invariant, else nothing is written.  Entries are sorted by
    one range exchange; the driver sees counts alone."""
    _held(differences(template, decisions, 5).collect(), "ids differ")
    _held(violations(decisions).limit(5).collect(), "invalid decisions")
    last = template.agg(F.max("pos")).first()[0]
    if last is None:
        raise SubmissionError("a template is an object of objects by id")
    lines = entries(decisions, template)
    text = F.concat(F.when(F.col("pos") == 0, "{\n").otherwise(""), "line", F.when(F.col("pos") == last, "\n}").otherwise(","))
    lines.select("pos", text.alias("value")).orderBy("pos").select("value").write.text(path)


def in_template_order(decisions: DataFrame, template_ids: DataFrame) -> DataFrame:
    """Decisions of the ids of template_ids (email_id, pos), sorted by pos under one range exchange."""
    return decisions.join(template_ids, "email_id").orderBy("pos").drop("pos")


def write_submission(payload: dict, path: str) -> None:
    """Indented JSON with a final line feed; the bytes don't depend on the platform."""
    to = Path(path)
    to.parent.mkdir(parents=True, exist_ok=True)
    to.write_text(json.dumps(payload, indent=2, ensure_ascii=False) + "\n", encoding="utf-8", newline="\n")


def write_decisions(decisions: DataFrame, path: str) -> None:
    """The bulk form: JSON lines, in parallel."""
    decisions.write.mode("overwrite").json(path)
