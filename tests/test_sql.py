"""SQL functions give what the Columns give that they are made of."""

from pyspark.sql import functions as F

from shipcheck.functions import sql, text
from shipcheck.operators import extract

VALUES = ["12,500 KG", "12.500,25 kg", "7\u00a0MT", "-4 kg", "3 tons", "Caf\u00e9 & Co, Ltd.", "Stra\u00dfe", "same as CNEE.", "Singapore (SGSIN)", "SGSIN", "2 x 40'HC + 1 x 20'GP", "Three", "t.b.a", "TBA", " n / a", "", "it's (a) <b> !(c) and(d)", "\\", None]


def test_functions_equal_columns(spark):
    names = sql.register(spark)
    assert names == [*sql.FUNCTIONS, "shipcheck_fields"]
    d = spark.createDataFrame([(v,) for v in VALUES], "v string")
    d.createOrReplaceTempView("sql_values")
    columns = [text.fold, text.normalize_text, text.normalize_party, text.normalize_port, text.decimal_from_text, text.normalize_weight, text.normalize_containers]
    want = d.select("v", *[f(F.col("v")).alias(n) for n, f in zip(sql.FUNCTIONS, columns, strict=True)]).collect()
    got = spark.sql(f"select v, {', '.join(f'{n}(v) as {n}' for n in sql.FUNCTIONS)} from sql_values").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_fields_beside_each_row(spark):
    sql.register(spark)
    docs = spark.createDataFrame([(1, "SHIPPER / EXPORTER:\nAcme\n1 Road\n\nNotify Party: Same as consignee |POL: X  POD: Y\nContainers\n--- \n3"), (2, "nothing"), (3, None)], "k int, content string")
    docs.createOrReplaceTempView("sql_docs")
    got = spark.sql("select k, f.field, f.field_ord, f.raw from sql_docs, lateral shipcheck_fields(content) f").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, extract.extract_fields(docs, ["k"]).select("k", "field", "field_ord", "raw").collect()), key=str) and len(got) == 21
