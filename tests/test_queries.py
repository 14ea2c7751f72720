"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import connect, differences

import __spark_entry__ as entry_points
from ledgerline.plans.queries import ORACLES, QUERIES

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    df = entry_points.queries()[name](spark, SF)
    assert differences(df, con, entry_points.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_only_lanes_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"lanes"}


def test_lanes_match_peak_concurrency(spark):
    queries = entry_points.queries()
    peak = {r["project"]: r["laneCount"] for r in queries["lane_count"](spark, SF).collect()}
    used: dict = {}
    for r in queries["lanes"](spark, SF).collect():
        used[r["project"]] = max(used.get(r["project"], 0), r["lane"] + 1)
    assert used == peak
