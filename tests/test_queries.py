"""Every registered query against its SQL."""

import __spark_entry__ as entry
import compare
import pytest

from conftest import SF_DIR

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
# Joins that broadcast by default; here they take the salted way.
SALTED = (
    "answers_detail",
    "apply_templates",
    "cascade_answers",
    "delete_file_cascade",
    "evaluation_requests",
    "ingest_rejects",
    "lookup_many",
    "page_range",
    "search_all_files",
    "similarity_content_neighbors",
    "similarity_neighbors",
    "update_cascade",
)


@pytest.fixture(scope="module")
def database():
    return compare.connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() == 21


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, database, name):
    df = QUERIES[name](spark, SF_DIR)
    assert compare.difference(df, database, ORACLES[name]) is None


@pytest.mark.parametrize("name", SALTED)
def test_salted_query_matches_sql(shuffled, database, name):
    df = QUERIES[name](shuffled, SF_DIR)
    assert compare.difference(df, database, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert not QUERIES[name](spark, SF_DIR).isEmpty()
