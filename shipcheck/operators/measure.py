"""Counts and times of every stage of a verification, observed in the one job that makes its result."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .decide import verify

#: The stages, in order, and what each counts beside its rows.
STAGES: dict[str, dict[str, str]] = {
    "load": {}, "read": {"unreadable": "count_if(coalesce(read_error, '') <> '')", "characters": "coalesce(sum(length(content)), 0)"}, "extract": {"documents": "count_if(document_type in ('SI', 'BL'))", "values": "coalesce(sum(size(array_compact(raw))), 0)"},
    "classify": {"comparisons": "count_if(category = 'BL_COMPARISON')"}, "compare": {"compared": "count_if(comparisons is not null)", **{k.lower(): f"count_if(coalesce(status = '{k}', false))" for k in ("OK", "MISMATCH", "NEEDS_REVIEW")}},
}


def _now() -> Column:
    """The clock of the machine at the time when a row passes."""
    return F.expr("cast(reflect('java.lang.System', 'currentTimeMillis') as bigint)")


class Measured:
    """Watches one verification:

        m = Measured(); verified = m.verify(emails, attachments); verified.write...; m.counts()

    Rows are counted as they pass, so nothing runs twice and nothing is cached; the result has to be made once, whole, before counts() answers."""

    def __init__(self):
        self.observed: dict[str, Observation] = {}

    def _watch(self, stage: str, d: DataFrame) -> DataFrame:
        self.observed[stage] = Observation(f"stage {stage}")
        more = [F.expr(sql).cast("long").alias(name) for name, sql in STAGES[stage].items()]
        return d.observe(self.observed[stage], F.count(F.lit(1)).alias("rows"), F.min(_now()).alias("first"), F.max(_now()).alias("last"), *more)

    def verify(self, emails: DataFrame, attachments: DataFrame, unicode: bool = True) -> DataFrame:
        return verify(emails, attachments, unicode, self._watch)

    def counts(self) -> dict[str, dict]:
        """Of each stage rows, seconds from the first row to the last (stages of a job overlap) and its own counts."""
        out = {}
        for stage in STAGES:
            try:
                seen = dict(self.observed[stage].get)
            except Py4JJavaError:  # Spark knew that no row would pass and left the stage out
                seen = {"rows": 0, "first": None, "last": None, **dict.fromkeys(STAGES[stage], 0)}
            first, last = seen.pop("first"), seen.pop("last")
            out[stage] = {"rows": seen.pop("rows"), "seconds": 0.0 if first is None else round((last - first) / 1000, 3), **seen}
        return out
