"""Every query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from shipcheck.plans import catalogue

SF = "/root/testdata/sf0.001"
QUICK = ["i1_classify", "i3_assess", "i5_extract", "h19_normalize_fields", "d10_compare", "decision_counts", "i10_violations", "h1_fold", "h3_hits", "h6_normalize_port", "c10_placeholder", "h31_weight", "h32_containers", "h30_decimal", "d3_id_differences", "c4_review_queue", "i11_explain", "b8_diagnostics", "f3_ties_are_no_choice", "a6_email_shapes", "a23_attachment_refs", "d7_attachment_index", "a12_candidate_paths", "a14_text_decode", "a24_decoded_formats", "c18_contained_paths", "h31_unicode_blanks", "i3_unicode_titles", "i9_submission", "g2_set_equality", "l10_incremental_versions", "l7_page_behind_an_id", "b9_observed_stages", "a3_inbox_format", "a29_audit_sections", "b6_metadata", "k_sql_functions", "b11_detail_values", "i10_every_rule", "h18_long_cells"]


def normal(rows):
    return sorted(tuple("null" if x is None else str(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF)
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert normal(got.select(*columns).collect()) == normal(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
