"""Steps that held on small tables only because a small file passed for a small table."""

import pytest

from braggflow.plans import derive as D
from braggflow.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _broadcast_rows_are_generated(df):
    """Whether a broadcast side of the plan has an explode, whose rows the estimate of a file's size does not tell."""
    depth = None
    for line in _plan(df).splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if "BroadcastExchange" in line and depth is None:
            depth = at
        elif depth is not None and "Generate explode" in line:
            return True
    return False


@pytest.mark.parametrize("name", ["unique_claims", "filter_legacy", "kept_spots", "label_spots", "centre_of_mass", "small_components_removed", "quality_map", "image_summary", "gaussian_sigma"])
def test_pixels_and_peaks_are_not_broadcast(spark, name):
    """A supplier's row becomes 4,096 pixels."""
    assert not _broadcast_rows_are_generated(QUERIES[name](spark, DATA))


def test_crystals_are_dealt_before_they_are_multiplied(spark):
    from braggflow.operators import reflections

    found = D.within_limits(spark, DATA, reflections.generate(spark, 6, "F"))
    assert found.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert "BroadcastNestedLoopJoin" not in _plan(found).split("BroadcastExchange")[0]
