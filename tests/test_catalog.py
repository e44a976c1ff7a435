"""The registry, and a cross-section of it against its SQL; `python tests/oracle.py` compares all of it."""

from pathlib import Path

import pytest

import oracle

SMALL = "/root/testdata/sf0.001"
SAMPLE = ("orders_per_minute", "revenue_by_product_location", "silver_routed_counts", "dq_rates", "causation_orphans",
          "node_selection", "reservation_allocation", "state_replay", "rate_limit_replay", "latency_p95",
          "demand_quality", "baseline_forecast", "stream_success_rate")


def test_every_statement_belongs_to_a_query():
    import __spark_entry__ as entry

    from tidewater.plans.catalog import QUERIES, STATEMENTS

    queries, statements = entry.queries(), entry.oracle_sql()
    assert set(statements) <= set(queries) and len(QUERIES) > 80
    assert set(QUERIES) == set(STATEMENTS) and set(QUERIES) <= set(queries)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_statement(spark, name):
    import __spark_entry__ as entry

    assert oracle.compare(entry.queries()[name](spark, SMALL), oracle.connect(SMALL), entry.oracle_sql()[name]) is None


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the generated tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
