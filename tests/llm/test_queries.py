"""The subpackage's registered queries: names, and those with SQL against DuckDB."""

import duckdb
import pytest

from shipcheck.llm import queries

SF = "/root/testdata/sf0.001"


def test_names():
    assert [k.split("_")[0] for k in queries.queries()] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    [con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'") for t in ("documents", "embeddings")]
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda r: [str(r[columns.index(c)]) for c in ("doc_id", "vec_id", "lang", "source", "part", "item") if c in columns]
    pairs = zip(sorted(map(tuple, got.select(*columns).collect()), key=key), sorted(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall(), key=key), strict=True)
    for a, b in pairs:
        assert all(x == y or (x is not None and y is not None and not isinstance(x, str) and abs(float(x) - float(y)) < 2e-6) for x, y in zip(a, b, strict=True))
