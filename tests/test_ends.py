"""Queries that ask for the ends of all edges: the codes of ends, owners by tally, and nothing kept."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators import report, validate
from tessera.sources.tables import graph_of

SF = "/root/testdata/sf0.001"
COLUMNS = ("edge_id", "source", "target", "kind", "source_code", "target_code")


@pytest.fixture(scope="module")
def broken(spark, tmp_path_factory):
    """Tables with rows that are alike, and keys that are null or aren't there."""
    folder = str(tmp_path_factory.mktemp("broken"))
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").limit(40)
    some = [lines, lines.withColumn("l_partkey", -F.col("l_partkey")), lines.withColumn("l_orderkey", -F.col("l_orderkey")), lines.withColumn("l_suppkey", F.lit(None).cast("bigint")), lines.withColumn("l_orderkey", F.lit(None).cast("bigint"))]
    for df in some:
        df.write.mode("append").parquet(f"{folder}/lineitem.parquet")
    spark.read.parquet(f"{SF}/orders.parquet").limit(9).withColumns({"o_orderkey": F.col("o_orderkey") + 900_000, "o_custkey": -F.col("o_custkey")}).write.mode("append").parquet(f"{folder}/orders.parquet")
    spark.read.parquet(f"{SF}/customer.parquet").limit(9).withColumns({"c_custkey": F.col("c_custkey") + 900_000, "c_nationkey": F.lit(99).cast("int")}).write.mode("append").parquet(f"{folder}/customer.parquet")
    return folder


def test_codes_of_ends_equal_a_join_by_ids(spark, broken):
    told, joined = graph_of(spark, broken, ended=True), graph_of(spark, broken)
    rows = lambda df: sorted(df.select(*COLUMNS).collect(), key=str)
    found = rows(told.edges)
    assert found == rows(validate._with_codes(joined))
    assert {r.source_code is None for r in found} == {r.target_code is None for r in found} == {True, False}
    by = lambda df: sorted(df.collect(), key=str)
    assert by(report.graph_report(told)) == by(report.graph_report(joined))


def test_owners_that_only_the_tally_of_ids_tells_apart(spark):
    from test_operators import graph

    nodes = [("c", "metadata.catalog"), ("m", "module"), ("a", "attribute"), ("b", "attribute"), ("d", "attribute")]
    # Three attributes and three edges: one has two owners, one none, one a wrong one.
    edges = [("c", "contains", "m"), ("c", "contains", "a"), ("m", "contains", "a"), ("m", "contains", "d")]
    found = {(r.code.rpartition(".")[2], r.nodes) for r in validate.ownership_issues(graph(spark, nodes, edges, unsafe=True)).collect()}
    assert found == {("multiple_owners", "c|m|a"), ("invalid_owner", "b"), ("invalid_owner", "m|d")}


@pytest.mark.parametrize("name", ["validation", "configuration_summary", "graph_report", "diff_report"])
def test_nothing_of_the_graph_is_kept(spark, name):
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert __spark_entry__.queries()[name](spark, SF).count() > 0
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() <= before
