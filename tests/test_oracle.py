"""Every query with an SQL text gives the same whole result as the independent engine."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

FOLDER = os.environ.get("COMPARE_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()
MODEL_QUERIES = {
    "logistic_tuned", "logistic_protocol", "logistic_intervals", "tree_tuned", "source_only_sites", "size_matched_run", "history_run", "history_bundle", "annual_cells",
    "sensitivity_run",
}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_oracle_names_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result(spark, duck, name):
    assert differences(spark, duck, name, QUERIES[name], ORACLES[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - MODEL_QUERIES))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).where("support_eligible").count() > 0
