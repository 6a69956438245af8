"""Summaries of graphs in pieces, of which nothing is kept."""

import os
from contextlib import nullcontext

import pytest
from pyspark.sql import functions as F
from test_ends import broken  # noqa: F401
from test_operators import graph

import __spark_entry__
from tessera import storage
from tessera.graph import Graph, Pieces
from tessera.operators import report, validate
from tessera.sources.tables import graph_of, pieces_of

SF = "/root/testdata/sf0.001"


def _stored(spark):
    folder = storage.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    return {name for name in os.listdir(folder) if name.startswith("stored-")}


def _counted(g):
    issues = validate.validate(g).groupBy("severity").count().collect()
    by = {r.severity: r["count"] for r in issues}
    return g.nodes.count(), g.edges.count(), by.get("error", 0), by.get("warning", 0)


def test_summary_of_pieces_counts_what_validation_lists(spark, broken, monkeypatch):  # noqa: F811
    expected = _counted(graph_of(spark, broken))
    monkeypatch.setattr(storage, "SLICE", 1_000)
    before, pieces = _stored(spark), pieces_of(spark, broken)
    assert len(pieces.made) > 6
    row = report.configuration_summary(pieces).first()
    assert (row.nodes, row.edges, row.errors, row.warnings) == expected and row.errors > 0
    assert (row.configuration_id, row.name, row.valid) == ("cfg", "Configuration", False)
    assert _stored(spark) == before and spark.conf.get(storage._CLEANUP) == "false"


def test_configuration_summary_keeps_no_lines(spark):
    before = _stored(spark)
    assert __spark_entry__.queries()["configuration_summary"](spark, SF).count() == 1
    assert _stored(spark) == before


@pytest.mark.parametrize("kind, nodes, edges", [
    ("contains", [("a", "form"), ("b", "command"), ("c", "form")], [("b", "contains", "a"), ("a", "contains", "b"), ("a", "contains", "c")]),
    ("includes", [("a", "subsystem"), ("b", "subsystem"), ("c", "subsystem")], [("a", "includes", "b"), ("b", "includes", "a"), ("b", "includes", "c")]),
])
def test_cycles_that_pass_through_several_pieces(spark, kind, nodes, edges):
    g = graph(spark, nodes, edges, unsafe=True)
    told = validate._with_codes(g)
    part = lambda ids: Graph(g.nodes.filter(F.col("id").isin(*ids)), told.filter(F.col("target").isin(*ids)))
    row = report.configuration_summary(Pieces((lambda: nullcontext(part("a")), lambda: nullcontext(part("bc"))))).first()
    assert (row.nodes, row.edges, row.errors, row.warnings) == _counted(g)
    assert validate.validate(g).filter("code like '%cycle'").filter(F.col("edge_kind") == kind).count() >= 2
