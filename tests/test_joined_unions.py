"""Queries whose plans have the bonds' union twice, joined by exchanges as at size, against what they give with broadcasts."""

import pytest

from molmill.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def exchanged(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    yield lambda on: spark.conf.set(key, "-1" if on else before)
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["g1_largest_fragment", "g2_ring_counts", "j7_connected_fragments", "j7_fragment_candidates"])
def test_exchanges_change_nothing(spark, exchanged, name):
    got = []
    for on in (False, True):
        exchanged(on)
        got.append(sorted(map(tuple, QUERIES[name](spark, SF).collect())))
    assert got[0] == got[1] and got[0]
