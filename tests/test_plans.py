"""Plans: filters and columns reach the scan, as-of joins are no nested loops, top rows are limited before the shuffle."""

import os

import pytest

from granary import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_asof_is_an_equi_join(spark):
    text = plan(spark, "jn4_asof")
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "fs3_read_as_of")
    assert "PushedFilters" in text and "props" not in text.split("ReadSchema")[1]


def test_latest_rows_are_limited_early(spark):
    assert "WindowGroupLimit" in plan(spark, "ag28_distinct_on")


def test_walk_forward_has_no_join_with_its_windows(spark):
    text = plan(spark, "flagship_walk_forward")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
