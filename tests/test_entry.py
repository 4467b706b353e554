from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import TESTDATA, compare

SMALL = TESTDATA / "sf0.001"
QUICK = ("plurality_vote", "range_join_innermost", "impact", "symbol_status", "p1_found", "p3_found", "blind_rules", "shortest_path", "verdict", "affinity_tiebreak")


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.skipif(not SMALL.exists(), reason="test data not there")
@pytest.mark.parametrize("name", QUICK)
def test_query_against_sql(spark, name):
    assert compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], str(SMALL)) == ""


@pytest.mark.skipif(not SMALL.exists(), reason="test data not there")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["node", "endpoint", "flow"]
