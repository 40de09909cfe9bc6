"""Every registered query with SQL, compared with DuckDB on the smallest tables."""
import pytest
from compare import difference, oracle_connection, oracle_table, spark_table
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries

SLOW = {"dup_passage_clusters", "dup_survivors", "dup_provenance", "consolidation_counts"}  # as dup_merged


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - SLOW))
def test_query_equals_sql(spark, connection, name):
    got = spark_table(queries()[name](spark, SMALL))
    assert difference(got, oracle_table(connection, oracle_sql()[name])) is None


def test_entry_and_registration(spark):
    assert entry(spark).count() == 26
    assert set(oracle_sql()) <= set(queries())


def test_rules_on_published_analyses_find_the_faults(spark):
    found = {(r.rule, r.entity_id) for r in queries()["analysis_violations"](spark, SMALL).collect()}
    assert {("analysis_status_known", "q4"), ("analysis_text_clean", "q7"), ("term_grounded_market", "q7"),
            ("evidence_exists", "q8"), ("evidence_spans_commenters", "q8")} <= found
