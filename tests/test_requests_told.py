"""Requests that tell what is known of their ends, and lines that are stored in slices."""

import __spark_entry__
from pyspark.sql import functions as F
from test_operators import graph

from tessera import storage
from tessera.operators import validate
from tessera.schema import code
from tessera.sources.tables import graph_of

SF = "/root/testdata/sf0.001"


def test_issues_of_requests_that_tell_equal_those_by_joins(spark):
    g = graph(spark, [("a", "procedure"), ("b", "module"), ("c", "procedure")], [("a", "calls", "c"), ("c", "calls", "b")])
    kinds = (("collected", None), ("resolved", "resolved"), ("unresolved", "missing_target"), ("rejected", "incompatible_kind"), ("partial", "partial_workspace"))
    rows = [(f"{s}{c}{state}{e}", s, "calls", e, ref, [] if n % 2 else ["procedure"], [c] if c else [], state, outcome) for s in ("a", "c", "gone") for n, c in enumerate(("b", "c", "away", None)) for state, outcome in kinds for e in ("calls", None) for ref in ("B",)]
    requests = spark.createDataFrame(rows, "id string, source_node string, category string, edge_kind string, reference string, expected_kinds array<string>, candidates array<string>, state string, outcome string")
    diagnostics = spark.createDataFrame([("x", "missing_target", "a", "B")], "code string, kind string, source_node string, reference string")
    nodes = {r.id: r.code for r in g.nodes.select("id", code().alias("code")).collect()}
    edges = {(r.source, r.target, r.kind): r.edge_id for r in g.edges.collect()}
    told = spark.createDataFrame(
        [(*r, nodes.get(r[1]), [nodes.get(c) for c in r[6]], [edges.get((r[1], c, r[3])) for c in r[6]], r[8] == "missing_target" and r[1] == "a") for r in rows],
        requests.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",source_code string,candidate_codes array<string>,candidate_edges array<string>,diagnosed boolean",
    )
    found = lambda *a: sorted(validate.request_issues(g, *a).collect(), key=str)
    by_joins = found(requests, diagnostics)
    assert found(told) == by_joins and len({r.code for r in by_joins}) == 7


def test_request_issues_shuffle_no_ids(spark):
    df = __spark_entry__.queries()["request_issues"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_lines_in_slices_are_the_same_and_leave_no_shuffle(spark, monkeypatch):
    rows = lambda: sorted(graph_of(spark, SF, ended=True).parts[1].rows.collect(), key=str)
    whole = rows()
    monkeypatch.setattr(storage, "SLICE", 1_000)
    assert rows() == whole and len(whole) > 5_000
    assert spark.conf.get(storage._CLEANUP) == "false"
    made = []
    storage.stored_in_slices(spark, lambda i, n: made.append((i, n)) or spark.range(10).filter(F.col("id") % n == i), 2_500)
    assert made == [(0, 3), (1, 3), (2, 3)]
