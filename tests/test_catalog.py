"""Registered queries against their SQL at the smallest scale. OUTFLOW_ALL=1 runs every query that has SQL."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
ESSENTIAL = [
    "a12_tokenise", "b11_complaint_ids_for_account", "c03_asof_backward", "c09_near", "d09_activity_by_six_hours", "d20_score_status",
    "e03_trailing_hours", "f01_atm_day_features", "g28_horizon_eval", "g38_intervention_sim", "h11_connected_components",
    "i07_origin_state", "j02_verify_blocks", "k05_stream_bursts",
]
SQL = entry.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("OUTFLOW_ALL") else ESSENTIAL


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    verdict, _, _ = compare(spark, con, name, entry.queries()[name], SQL[name], FOLDER)
    assert verdict.startswith("ok"), verdict


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
