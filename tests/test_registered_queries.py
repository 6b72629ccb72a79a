"""A sample of the registered queries against their SQL; tests/oracle_check.py runs all."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, database

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "a11_boundary_events", "b2_directly_follows", "d3_rejection_rate", "d6_waiting_time_waste",
    "d11_analysis_report", "i4_differentiating_transition", "i8_case_labels_of_orders", "j2_temporal_holdout",
    "j5_first_growth_step", "k3_check_dependencies", "k4_optimal_order", "l3_roles", "l5_wip_features",
]


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    status, ours, theirs = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", (ours[:2], theirs[:2])


def test_every_sql_belongs_to_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
