"""Queries that read the graph where it lies: nothing of it is kept on memory or disk."""

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = ["traverse_downstream", "traverse_both_ways", "traverse_upstream", "traverse_dependencies", "context", "diff_edges", "diff_summary", "index_changes", "impact_reasons"]


@pytest.mark.parametrize("name", NAMES)
def test_nothing_of_the_graph_is_kept(spark, name):
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert __spark_entry__.queries()[name](spark, SF).count() > 0
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() <= before
