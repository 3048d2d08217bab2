import pytest
from test_entry import compare

import __spark_entry__ as contract


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p3_terms", "p4_found", "p4_records", "p6_found", "p6_spans", "p6_shared_bases", "p6_span_bases", "p7_found", "p7_audit"])
def test_query_agrees_with_sql(spark, data, name):
    compare(spark, data, name)


def test_containers_hold_all_tokens(spark, data):
    rows = contract.queries()["p8_fill"](spark, data).collect()
    assert len(rows) == 3 and len({r["n_tokens"] for r in rows}) == 1
    assert all(r["fill_share"] > 0.85 for r in rows)


def test_mix_and_rates(spark, data):
    shares = contract.queries()["p9_shares"](spark, data).collect()
    assert abs(sum(r["actual_share"] for r in shares) - 1) < 1e-9
    rates = contract.queries()["p10_rates"](spark, data).collect()
    assert sum(r["n_documents"] for r in rates) == spark.read.parquet(f"{data}/documents.parquet").count()
