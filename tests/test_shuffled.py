"""Sides of joins that grow with the pictures are shuffled, even where Spark takes them for small: a broadcast would go whole through the driver."""

import pytest

from siftwork.catalog import QUERIES
from tests.compare import SMALL


@pytest.mark.parametrize("name", ["class_pairs", "hamming_best_match", "hamming_self_join", "pair_membership", "video_copies"])
def test_no_side_goes_through_the_driver(spark, name):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("10485760")
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert any("SortMergeJoin" in line for line in joins)
    assert [line for line in joins if "Broadcast" in line and "LeftOuter" not in line] == []  # hot chunks alone, a table of fixed bound, are told to all
