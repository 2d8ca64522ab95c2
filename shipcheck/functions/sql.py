"""The rules as SQL functions: spark.sql can use what DataFrames use.

    register(spark)
    select shipcheck_port(port), f.field, f.raw from documents, lateral shipcheck_fields(text) f

The functions are made of the same Columns, so there is one definition of each rule; only the two things that need Python (Unicode forms
and finding labels) are called by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import vocab as v
from ..operators.extract import first_values, label_pieces, values_of
from . import text as t

_FORMS, _PIECES = "shipcheck_forms", "shipcheck_pieces"
#: Functions of one text, by name.
FUNCTIONS = {
    "shipcheck_fold": t.fold, "shipcheck_text": lambda c: t.normalize_text(c, _FORMS), "shipcheck_party": lambda c: t.normalize_party(c, _FORMS), "shipcheck_port": lambda c: t.normalize_port(c, _FORMS),
    "shipcheck_number": t.decimal_from_text, "shipcheck_weight": lambda c: t.normalize_weight(c, _FORMS), "shipcheck_containers": lambda c: t.normalize_containers(c, _FORMS),
}
_RETURNS = {"shipcheck_number": "decimal(38,10)"}
#: Operators that a Column's text has in the form of calls; quoted, they are names of functions.
_OPERATORS = re.compile(r"(?<![\w`])(and|or|not|!|<=>|<=|>=|<|>|==|=|\+|-|\*|/|%)\(")


def sql_of(c: Column) -> str:
    """The text of a Column made of functions, operators, lambdas and literals, as SQL that can be parsed."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", c._jc.node().sql())
    return "".join(p if i % 2 else _OPERATORS.sub(r"`\1`(", p) for i, p in enumerate(parts))


def register(spark: SparkSession) -> list[str]:
    """Makes the functions for this session; returns their names."""
    spark.udf.register(_FORMS, t._unicode_forms)
    spark.udf.register(_PIECES, label_pieces)
    for name, rule in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}(value string) returns {_RETURNS.get(name, 'string')} return {sql_of(rule(F.col('value')))}")
    raw = sql_of(first_values(F.col("found")))
    found = sql_of(values_of(F.call_function(_PIECES, F.col("content"))))
    names = ", ".join(f"'{f}'" for f in v.FIELDS)
    spark.sql(f"""create or replace temporary function shipcheck_fields(content string) returns table (field_ord int, field string, raw string)
        return select i, get(array({names}), i), get(raws, i) from (select {raw} as raws from (select {found} as found)) lateral view explode(sequence(0, {len(v.FIELDS) - 1})) x as i""")
    return [*FUNCTIONS, "shipcheck_fields"]
