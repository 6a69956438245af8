"""Operators on hand-built graphs against plain Python that follows a queue."""

import heapq
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.graph import Graph
from tessera.operators import context, diff, impact, ledger, lookup, report, resolve, traverse, validate
from tessera.plans import service
from tessera.schema import CONTEXT_PRIORITY, EDGE_KINDS, EDGES, NODES, allowed_endpoints
from tessera.sinks import snapshots

P = [("src", None, None, None, None, None, "t", "declared", "exact", "not_applicable")]


def graph(spark, nodes, edges, unsafe=False):
    """`nodes`: (id, kind or metadata.<kind>[, name[, provenance]]); `edges`: (source, kind, target[, provenance])."""
    n = [(x[0], x[2] if len(x) > 2 else x[0].upper(), *(("metadata", x[1][9:]) if x[1].startswith("metadata.") else (x[1], None)), None, x[3] if len(x) > 3 else P, i) for i, x in enumerate(nodes)]
    e = [(x[0], x[2], x[1], x[3] if len(x) > 3 else P, i) for i, x in enumerate(edges)]
    n, e = spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES)
    return Graph.of(n, e) if unsafe else Graph.inserted(n, e)[0]


def edge_id(s, k, t):
    return f"edge:source#{len(s.encode())}:{s};target#{len(t.encode())}:{t};kind:{k}"


def random_graph(seed):
    r = random.Random(seed)
    names = ["a", "bb", "узел", "d", "e", "ff", "g"]
    edges = {(r.choice(names), r.choice(["calls", "reads", "contains", "includes"]), r.choice(names)) for _ in range(14)}
    return [(x, "procedure") for x in names], sorted(edges)


def queue_traverse(edges, start, depth, down=True, kinds=None):
    seen, queue, out = {start}, deque([(start, 0)]), [(start, 0, None)]
    while queue:
        at, d = queue.popleft()
        if d == depth:
            continue
        near = sorted((t if down else s, edge_id(s, k, t)) for s, k, t in edges if (s if down else t) == at and (kinds is None or k in kinds))
        for other, e in near:
            if other not in seen:
                seen.add(other)
                queue.append((other, d + 1))
                out.append((other, d + 1, e))
    return out


def queue_traverse_edges(edges, start, depth):
    seen, queue, out = {start}, deque([(start, 0)]), [(start, 0, None)]
    while queue:
        at, d = queue.popleft()
        if d == depth:
            continue
        for s, t, k in sorted(((s, t, EDGE_KINDS.index(k)) for s, k, t in edges if at in (s, t))):
            other = t if s == at else s
            if other not in seen:
                seen.add(other)
                queue.append((other, d + 1))
                out.append((other, d + 1, edge_id(s, EDGE_KINDS[k], t)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_traversals_follow_the_queue(spark, seed):
    nodes, edges = random_graph(seed)
    g = graph(spark, nodes, edges)
    rows = lambda df: [(r.node_id, r.depth, r.via_edge) for r in df.orderBy("depth", "path").collect()]
    assert rows(traverse.traverse(g, "a", max_depth=3)) == queue_traverse(edges, "a", 3)
    assert rows(traverse.traverse(g, "узел", "upstream", ["calls", "reads"], 4, include_start=False)) == queue_traverse(edges, "узел", 4, False, ("calls", "reads"))[1:]
    assert rows(traverse.traverse_edges(g, "bb", max_depth=2)) == queue_traverse_edges(edges, "bb", 2)
    assert rows(traverse.traverse(g, "nobody")) == [] and rows(traverse.traverse(g, "a", max_depth=0)) == [("a", 0, None)]


def heap_context(edges, seeds, depth):
    best, heap = {}, []
    for s in seeds:
        best[s] = (0, (), s, s)
        heapq.heappush(heap, best[s])
    while heap:
        key = heapq.heappop(heap)
        d, steps, seed, at = key
        if best[at] != key or d == depth:
            continue
        for s, k, t in edges:
            for way, here, other in ((0, s, t), (1, t, s)):
                if here == at:
                    new = (d + 1, (*steps, (CONTEXT_PRIORITY[k], way, edge_id(s, k, t))), seed, other)
                    if other not in best or new < best[other]:
                        best[other] = new
                        heapq.heappush(heap, new)
    return sorted(best.values())


@pytest.mark.parametrize("seed", range(3))
def test_context_takes_the_best_paths(spark, seed):
    nodes, edges = random_graph(seed + 10)
    g = graph(spark, nodes, edges)
    expected = heap_context(edges, ["a", "d"], 2)
    found = context.context(g, context.ContextRequest(("d", "a"), 60_000, 2)).orderBy("position").collect()
    assert [(r.depth, r.seed_id, r.node_id) for r in found] == [(d, s, n) for d, _, s, n in expected]
    small = context.assembled(g, context.ContextRequest(("a",), 100, 2))
    assert small["used_bytes"] == len(small["rendered"].encode()) <= 100 and small["items"][0] == "a"
    with pytest.raises(context.ContextError, match="the seeds need"):
        context.assembled(g, context.ContextRequest(("a",), 10))
    with pytest.raises(context.ContextError):
        context.context(g, context.ContextRequest(("nobody",)))
    with pytest.raises(context.ContextError):
        context.ContextRequest((), 10)


def test_context_text(spark):
    g = graph(spark, [("m", "module", "Мод"), ("p", "procedure", "Run")], [("m", "contains", "p")])
    e = edge_id("m", "contains", "p")
    assert context.assembled(g, context.ContextRequest(("m",), 1000))["rendered"] == f"node kind=module id=1:m name=6:Мод\nreason seed=1:m depth=0\nnode kind=procedure id=1:p name=3:Run\nreason seed=1:m depth=1 path=1:outgoing,contains,{len(e)}:{e}\n"


def queue_impact(old, new, depth, ownership):
    (on, oe), (nn, ne) = old, new
    seeds = []
    for n in on.keys() | nn.keys():
        sides = ["current"] if n not in on else ["previous"] if n not in nn else ["previous", "current"] if on[n] != nn[n] else []
        status = "removed" if sides == ["previous"] else "directly_changed"
        kind = {("current",): "node_added", ("previous",): "node_removed"}.get(tuple(sides), "node_modified")
        seeds += [(n, s, status, (kind, n)) for s in sides]
    for e in oe ^ ne:
        side, kind = ("previous", "edge_removed") if e in oe else ("current", "edge_added")
        seeds += [(n, side, "directly_changed", (kind, edge_id(*e))) for n in {e[0], e[2]}]
    seeds = sorted(set(seeds))
    reasons = {(n, 0, st, s, sd, None) for n, s, st, sd in seeds}
    visited, queue = {(s, n) for n, s, _, _ in seeds}, deque((n, s, 0, sd) for n, s, _, sd in seeds)
    while queue:
        n, s, d, sd = queue.popleft()
        if d == depth:
            continue
        steps = []
        for a, k, b in oe if s == "previous" else ne:
            if b == n and k in ("calls", "reads"):
                steps.append((a, edge_id(a, k, b), "dependency"))
            if ownership and k == "contains" and b == n:
                steps.append((a, edge_id(a, k, b), "ownership"))
        for m, e, way in sorted(steps):
            reasons.add((m, d + 1, "transitively_affected", s, sd if d == 0 else None, (n, e, way)))
            if (s, m) not in visited:
                visited.add((s, m))
                queue.append((m, s, d + 1, sd))
    return reasons


@pytest.mark.parametrize("seed", range(3))
def test_impact_follows_the_queue(spark, seed):
    r = random.Random(seed)
    nodes, edges = random_graph(seed + 20)
    old_n, new_n = {x: x for x, _ in nodes if x != "g"}, {x: x + ("!" if x == "d" else "") for x, _ in nodes if x != "e"}
    old_e, new_e = {e for e in edges if e[0] in old_n and e[2] in old_n and r.random() < 0.9}, {e for e in edges if e[0] in new_n and e[2] in new_n and r.random() < 0.9}
    make = lambda n, e: graph(spark, [(i, "procedure", name) for i, name in n.items()], sorted(e))
    previous, current = make(old_n, old_e), make(new_n, new_e)
    for ownership in (False, True):
        options = impact.ImpactOptions(2, ownership="child_to_owner" if ownership else "disabled")
        expected = queue_impact((old_n, old_e), (new_n, new_e), 2, ownership)
        rows = impact.reasons(previous, current, options).collect()
        found = {(x.node_id, x.depth, x.status, x.snapshot, (x.seed_kind, x.seed_id) if x.depth < 2 else None, None if x.depth == 0 else (x.source_node, x.edge_id, x.propagation and x.reason.partition("_")[0])) for x in rows}
        assert found == expected
        by_node = {}
        for n, d, st, *_ in expected:
            depth, rank = by_node.get(n, (9, 0))
            by_node[n] = min(depth, d), max(rank, ["transitively_affected", "directly_changed", "removed"].index(st))
        nodes_found = impact.affected(previous, current, options).collect()
        assert {x.node_id: (x.depth, ["transitively_affected", "directly_changed", "removed"].index(x.status)) for x in nodes_found} == by_node
        assert sum(x.n_reasons for x in nodes_found) == len(rows)
        totals = {x.metric: x.value for x in impact.summary(impact.affected(previous, current, options)).collect()}
        assert totals["nodes"] == len(by_node) and totals["reasons"] == len(rows)


def test_insertion_and_identity(spark):
    nodes = [("n", "module", "first"), ("n", "module", "last"), (" ", "module"), ("m", "module")]
    rows = [("n", "calls", "m", []), ("n", "calls", "m", P), ("n", "calls", "gone"), ("gone", "calls", "n")]
    n = spark.createDataFrame([(x[0], x[2] if len(x) > 2 else "x", x[1], None, None, P, i) for i, x in enumerate(nodes)], NODES)
    e = spark.createDataFrame([(x[0], x[2], x[1], x[3] if len(x) > 3 else P, i) for i, x in enumerate(rows)], EDGES)
    g, refused = Graph.inserted(n, e)
    assert {(r.id, r.name) for r in g.nodes.collect()} == {("n", "last"), ("m", "x")}
    assert [(r.source, len(r.provenance), r.edge_id) for r in g.edges.collect()] == [("n", 0, edge_id("n", "calls", "m"))]
    assert {(r.source, r.missing_node) for r in refused.collect()} == {("n", "gone"), ("gone", "gone")}
    row = spark.range(1).select(ids.edge_id(F.lit("узел"), F.lit("b"), F.lit("calls")).alias("e"), ids.access_right_id(F.lit("r"), F.lit("Read"), F.lit(None).cast("string")).alias("a"), ids.reference_request_id(F.lit("s"), F.lit("c"), F.lit("r"), F.array(F.lit("z"), F.lit("a"), F.lit("z"))).alias("q")).first()
    assert row.e == edge_id("узел", "calls", "b") and row.a == "access_right:resource#1:r;right#4:Read"
    assert row.q == "reference_request;source#1:s;category#1:c;reference#1:r;expected_kind#1:a;expected_kind#1:z"


def test_validation_finds_each_fault(spark):
    nodes = [("c", "metadata.configuration"), ("k", "metadata.catalog"), ("at", "attribute"), ("at2", "attribute", "x", []), ("mod", "module"), ("p", "procedure"), ("f", "form"), ("s1", "subsystem"), ("s2", "subsystem"), ("s3", "subsystem"), ("q", "query"), ("o1", "metadata.report"), ("o2", "metadata.report")]
    edges = [("c", "contains", "k"), ("k", "contains", "at"), ("c", "contains", "at"), ("k", "contains", "mod"), ("mod", "contains", "p"), ("p", "calls", "p"), ("p", "writes", "k", []), ("k", "contains", "gone"), ("s1", "includes", "s2"), ("s2", "includes", "s1"), ("s2", "includes", "s3"), ("k", "contains", "q"), ("o1", "contains", "o2"), ("o2", "contains", "o1"), ("o2", "contains", "f")]
    issues = {(r.code.rpartition(".")[2], r.nodes) for r in validate.validate(graph(spark, nodes, edges, unsafe=True)).collect()}
    assert issues == {
        ("missing_target", "k|gone"), ("multiple_owners", "c|k|at"), ("invalid_owner", "at2"), ("missing_node", "at2"), ("forbidden_self_loop", "p|p"), ("invalid_edge_endpoints", "p|k"), ("missing_edge", "p|k"),
        ("invalid_edge_endpoints", "k|q"), ("invalid_owner", "k|q"), ("cycle", "s1|s2|s1"), ("cycle", "s2|s1|s2"), ("cycle", "o1|o2|o1|o2"), ("cycle", "o2|o1|o2|o1"), ("cycle", "f|o2|o1|o2"),
    }
    assert validate.is_valid(validate.validate(graph(spark, nodes[:2], edges[:1]))) and validate.validate(graph(spark, [], [])).count() == 0
    assert len(allowed_endpoints()) == len(set(allowed_endpoints()))


def test_requests_ledger_and_their_issues(spark):
    obs = spark.createDataFrame([("a", "calls", "B", ["procedure"], [("s", "unresolved")]), ("a", "calls", "C", ["procedure"], [("s", "resolved")]), ("a", "calls", "D", ["procedure"], [])], "source_node string, category string, reference string, expected_kinds array<string>, provenance array<struct<source:string,resolution:string>>")
    collected = ledger.collect(obs)
    assert sorted(r.problem or "" for r in collected.collect()) == ["", "missing_provenance", "resolved_provenance"]
    first = collected.filter("problem is null").drop("problem")
    done = ledger.finish(first, first.select("id", F.lit("resolved").alias("outcome"), F.array(F.lit("b")).alias("candidates")))
    assert [(r.state, r.candidates) for r in done.collect()] == [("resolved", ["b"])]
    assert done.filter(ledger.lifecycle_problem().isNotNull()).count() == 0
    assert done.withColumn("candidates", F.array().cast("array<string>")).select(ledger.lifecycle_problem().alias("p")).first().p == "candidate_count"
    kept, conflicts = ledger.insert(done.unionByName(done))
    assert kept.count() == 1 and conflicts.count() == 0
    assert ledger.insert(done.unionByName(first))[1].count() == 1
    assert ledger.by(done, category="calls", expected_kind="procedure").count() == 1 and ledger.by(done, state="collected").count() == 0
    g = graph(spark, [("a", "procedure"), ("b", "module")], [])
    diagnostics = spark.createDataFrame([], "code string, kind string, source_node string, reference string")
    issues = {r.code.rpartition(".")[2] for r in validate.request_issues(g, done.withColumn("edge_kind", F.lit("calls")), diagnostics).collect()}
    assert issues == {"incompatible_candidate", "missing_edge_projection"}
    stats = {(r.metric, r.key): r.value for r in report.reference_statistics(done.unionByName(first)).collect()}
    assert stats["total", ""] == 1 and stats["by_outcome", "resolved"] == 1


def test_differences(spark):
    other = [("t", None, None, None, None, None, "t", "declared", "exact", "not_applicable")]
    moved = [("src", "elsewhere", 1, 1, 1, 1, "t", "declared", "exact", "not_applicable")]
    old = graph(spark, [("a", "module"), ("b", "module"), ("c", "module"), ("d", "module")], [("a", "calls", "b"), ("b", "calls", "c"), ("a", "reads", "b")])
    new = graph(spark, [("a", "module", "new"), ("b", "module", "B", other), ("d", "module", "D", moved), ("e", "module")], [("a", "calls", "b", other), ("a", "reads", "b"), ("e", "calls", "a")])
    assert {(r.id, r.change, r.aspects) for r in diff.diff_nodes(old, new).collect()} == {("a", "modified", "semantic_content"), ("b", "modified", "provenance"), ("c", "removed", ""), ("e", "added", "")}
    assert {(r.source, r.kind, r.target, r.change) for r in diff.diff_edges(old, new).collect()} == {("a", "calls", "b", "modified"), ("b", "calls", "c", "removed"), ("e", "calls", "a", "added")}
    assert {(r.entity, r.change): r.n for r in diff.diff_summary(old, new).collect()} == {("node", "added"): 1, ("node", "removed"): 1, ("node", "modified"): 2, ("edge", "added"): 1, ("edge", "removed"): 1, ("edge", "modified"): 1}
    changes = [(r.phase, r.operation, r.entity, r.id) for r in diff.index_changes(old, new).orderBy("phase", "operation", "id").collect()]
    assert [c[:3] for c in changes] == [(0, "remove", "edge"), (1, "remove", "node"), (1, "replace", "node"), (1, "replace", "node"), (2, "add", "node"), (3, "add", "edge"), (4, "refresh", "edge"), (4, "refresh", "edge")]
    assert diff.diff_nodes(old, old).count() == 0
    assert {(r.metric, r.key, r.change) for r in diff.diff_distribution(report.graph_report(old), report.graph_report(new)).collect()} == set()


def test_resolution_outcomes(spark):
    g = graph(spark, [("c", "metadata.catalog", "Goods"), ("d", "metadata.document", "Goods"), ("m", "module", "M"), ("p", "procedure", "Run"), ("f", "function", "Run")], [("m", "contains", "p"), ("m", "contains", "f")])
    refs = spark.createDataFrame([("Goods",), ("goods",), ("M",), ("Nobody",)], "reference string")
    outcomes = lambda df: {r.reference: (r.outcome, r.target, r.n_candidates, r.first_candidate) for r in df.collect()}
    assert outcomes(resolve.resolve_names(g, refs)) == {"Goods": ("ambiguous", None, 2, "c"), "goods": ("missing_target", None, 0, None), "M": ("resolved", "m", 1, "m"), "Nobody": ("missing_target", None, 0, None)}
    assert {(r.reference, r.candidate) for r in resolve.name_candidates(g, refs).collect()} == {("Goods", "c"), ("Goods", "d"), ("M", "m")}
    assert outcomes(resolve.resolve_names(g, refs, "metadata.catalog", folded=True)) == {"Goods": ("resolved", "c", 1, "c"), "goods": ("resolved", "c", 1, "c"), "M": ("incompatible_kind", None, 1, "m"), "Nobody": ("missing_target", None, 0, None)}
    child = spark.createDataFrame([("m", "Run")], "owner string, reference string")
    assert outcomes(resolve.resolve_children(g, child, "procedure")) == {"Run": ("ambiguous", None, 2, "f")}
    assert {r.child_id for r in lookup.owner(g).collect()} == {"p", "f"}


def test_service(spark):
    g = graph(spark, [("c", "metadata.configuration", "Conf"), ("m", "module", "Mod", [("s", "a/b", 1, 1, 1, 1, "t", "declared", "exact", "not_applicable")]), ("p", "procedure", "Run")], [("c", "contains", "m"), ("m", "contains", "p"), ("p", "calls", "p")], unsafe=True)
    s = service.GraphService({"conf": g})
    assert s.configurations() == {"items": ["conf"], "truncated": False} and s.node("conf", "m")["name"] == "Mod"
    assert [r["related_id"] for r in s.relations("conf", "m", "incoming")["items"]] == ["c"]
    assert s.traverse("conf", "c", limit=1) == {"items": [{"node_id": "m", "depth": 1, "via_edge": edge_id("c", "contains", "m")}], "truncated": True}
    assert len(s.tool_relations("conf", "p")["items"]) == 2 and not s.validation("conf")["valid"]
    assert [x["id"] for x in s.symbols("conf", "mO")["items"]] == ["m"] and s.summary("conf")["nodes"] == 3
    assert s.context("conf", "m")["items"][0] == "m" and s.impact("conf", "conf")["items"] == []
    for call, status in ((lambda: s.node("conf", "x"), 404), (lambda: s.node("x", "m"), 404), (lambda: s.relations("conf", "m", limit=101), 400), (lambda: s.traverse("conf", "m", depth=5), 400), (lambda: service.GraphService({}).node("a", "b"), 503)):
        with pytest.raises(service.ServiceError) as e:
            call()
        assert e.value.status == status
    assert service.parameters("a=1%20x&b=%D1%83", {"a", "b"}, {"a"}) == {"a": "1 x", "b": "у"}
    for bad in ("c=1", "a=1&a=2", "a=%zz", "a=%D1", "b=1"):
        with pytest.raises(service.ServiceError):
            service.parameters(bad, {"a", "b"}, {"a"})
    assert service.confined("/r/a/../b", "/r") and not service.confined("/r/../x", "/r") and not service.confined("/rx", "/r")
    rules = [service.Rule("allow", ("*",)), service.Rule("confirm", ("write",)), service.Rule("deny", ("drop",))]
    assert [service.evaluate(rules, t) for t in ("read", "write", "drop")] == ["allow", "confirm", "deny"] and service.evaluate([], "read") == "deny"


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "store")
    with pytest.raises(snapshots.SnapshotError, match="no snapshot"):
        snapshots.read(spark, folder)
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    first = snapshots.write({"t": df}, folder, "v1")
    assert snapshots.current(spark, folder) is None
    snapshots.publish(spark, folder, first)
    assert snapshots.read(spark, folder, sources="v1")["t"].count() == 2
    with pytest.raises(snapshots.SnapshotError, match="changed"):
        snapshots.read(spark, folder, sources="v2")
    second = snapshots.write({"t": df.limit(1)}, folder, "v2")
    snapshots.publish(spark, folder, second)
    assert snapshots.current(spark, folder) == second
    df.write.mode("append").parquet(f"{folder}/snapshots/{second}/t")
    with pytest.raises(snapshots.SnapshotError, match="not as written"):
        snapshots.read(spark, folder)


def test_summaries_of_valid_and_invalid_graphs(spark):
    nodes = [("c", "metadata.configuration", "Conf"), ("k", "metadata.catalog"), ("m", "module"), ("p", "procedure")]
    edges = [("c", "contains", "k"), ("k", "contains", "m"), ("m", "contains", "p")]
    good = report.configuration_summary(graph(spark, nodes, edges)).first()
    assert (good.configuration_id, good.name, good.nodes, good.edges, good.errors, good.valid) == ("c", "Conf", 4, 3, 0, True)
    bad = graph(spark, nodes, edges[:2])
    requests = spark.createDataFrame([("resolved", "resolved"), ("collected", None), ("partial", "partial_workspace")], "state string, outcome string")
    row = report.configuration_summary(bad, requests, requests).first()
    assert (row.errors, row.valid, row.references, row.resolved, row.unresolved, row.diagnostics) == (1, False, 2, 1, 1, 3)
    s = service.GraphService({"good": graph(spark, nodes, edges), "bad": bad})
    assert s.summary("good")["valid"] and not s.summary("bad")["valid"] and s.validation("bad")["errors"] == 1
    assert s.call([service.Rule("allow", ("node",))], "node", "good", "k")["id"] == "k"
    for rules, tool in (([], "node"), ([service.Rule("confirm", ("*",))], "node"), ([service.Rule("allow", ("*",))], "_graph")):
        with pytest.raises(service.ServiceError) as e:
            s.call(rules, tool, "good", "k")
        assert e.value.status == 403
    assert s.call([service.Rule("confirm", ("*",))], "node", "good", "k", confirmed=True)["id"] == "k"


def test_document_diagnostics_have_a_limit(spark):
    g = graph(spark, [("m", "module", "Mod", [("s", "a/b", 1, 1, 1, 1, "t", "declared", "exact", "not_applicable")])], [])
    rows = lambda n: spark.createDataFrame([("m", "k", f"c{i:03}") for i in range(n)], "source_node string, kind string, code string")
    assert len(service.GraphService({"x": g}, {"x": rows(100)}).document_diagnostics("x", "a/b")) == 100
    with pytest.raises(service.ServiceError) as e:
        service.GraphService({"x": g}, {"x": rows(101)}).document_diagnostics("x", "a/b")
    assert e.value.code == "too_many"


def test_ownership_of_deep_trees_and_long_cycles(spark):
    nodes = [(f"n{i:03}", "metadata.report") for i in range(120)]
    chain = [(f"n{i:03}", "contains", f"n{i + 1:03}") for i in range(79)]
    ring = [(f"n{i:03}", "contains", f"n{i + 1 if i < 89 else 80:03}") for i in range(80, 90)]
    tail = [("n085", "contains", "n100"), ("n100", "contains", "n101")]
    found = {r.nodes.split("|")[0]: r.nodes.split("|") for r in validate.ownership_cycle_issues(graph(spark, nodes, chain + ring + tail)).collect()}
    owner = {t: s for s, _, t in ring + tail}
    for start, way in found.items():
        expected, seen, at = [start], set(), start
        while owner[at] not in seen:
            at = owner[at]
            seen.add(at)
            expected.append(at)
        assert way == [*expected, owner[at]], start
    assert found.keys() == owner.keys()
    assert validate.ownership_cycle_issues(graph(spark, nodes, chain)).count() == 0


def test_cycles_of_a_component_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(validate, "STARTS", 2)
    nodes = [(f"s{i}", "subsystem") for i in range(9)]
    edges = [(f"s{i}", "includes", f"s{(i + 1) % 7}") for i in range(7)] + [("s6", "includes", "s7"), ("s7", "includes", "s8")]
    found = {r.nodes for r in validate.subsystem_cycle_issues(graph(spark, nodes, edges)).collect()}
    assert found == {"|".join(f"s{(i + k) % 7}" for k in range(8)) for i in range(7)}


def test_provenance_of_resolvers_joins_that_of_requests(spark):
    kind = "array<struct<source:string,resolution:string>>"
    observed = spark.createDataFrame([("a", "calls", "B", ["procedure"], [("s", "unresolved")])], f"source_node string, category string, reference string, expected_kinds array<string>, provenance {kind}")
    first = ledger.collect(observed).drop("problem")
    outcomes = spark.createDataFrame([(first.first().id, "resolved", ["b"], [("r", "resolved")])], f"id string, outcome string, candidates array<string>, provenance {kind}")
    done = ledger.finish(first, outcomes).first()
    assert [tuple(p) for p in done.provenance] == [("s", "unresolved"), ("r", "resolved")] and done.state == "resolved"
    cases = [([("r", "resolved")], None), ([("r", "unresolved")], "invalid_stage_provenance"), ([("r", "not_applicable")], "not_applicable_provenance"), ([], "missing_provenance")]
    rows = spark.createDataFrame([(str(i), "resolved", ["b"], p) for i, (p, _) in enumerate(cases)], outcomes.schema)
    assert [r.problem for r in ledger.stage_problem(rows).orderBy("id").collect()] == [p for _, p in cases]


def test_registries_that_contradict_themselves(spark):
    rows = [("a", "supported", ["x"], []), ("b", "supported", ["x"], ["x"]), ("b", "unsupported", ["x"], ["node_emitted"]), ("c", "not_applicable", [], []), ("d", "declared_only", ["x"], ["edge_kind_declared"]), ("e", "partially_supported", ["x"], []), ("f", "planned", [], [])]
    registry = spark.createDataFrame(rows, "id string, status string, required array<string>, evidence array<string>").withColumn("category", F.lit("k"))
    assert {(r.id, r.problem) for r in report.inconsistent_capabilities(registry).collect()} == {("a", "status_contradicts_evidence"), ("b", "status_contradicts_evidence"), ("b", "repeated_id"), ("e", "status_contradicts_evidence"), ("f", "status_contradicts_evidence")}
    gaps = spark.createDataFrame([("high",), ("high",)], "priority string")
    assert {(r.metric, r.key): r.value for r in report.coverage_summary(gaps, registry).collect()}["by_gap_priority", "high"] == 2


def test_a_revision_has_one_publisher(spark, tmp_path):
    folder = str(tmp_path / "store")
    one, two = "1" * 32, "2" * 32
    (tmp_path / "store" / "current").mkdir(parents=True)
    (tmp_path / "store" / "current" / "1").write_text("")  # a publisher that was stopped
    assert snapshots.current(spark, folder) is None
    assert snapshots.publish(spark, folder, one) == 2 and snapshots.publish(spark, folder, two) == 3
    assert snapshots.current(spark, folder) == two


def test_builds_and_their_differences(spark):
    old, new = graph(spark, [("a", "module")], []), graph(spark, [("a", "module", "b")], [])
    build = lambda g: {"graph": g, "report": report.graph_report(g)}
    assert diff.builds_equal(diff.diff_builds(build(old), build(old)))
    found = diff.diff_builds(build(old), {"graph": new})
    assert found.keys() == {"nodes", "edges", "summary"} and not diff.builds_equal(found)
    pairs = spark.createDataFrame([("a", "b", "calls"), ("b", "a", "calls")], "source string, target string, kind string")
    g = graph(spark, [("a", "procedure"), ("b", "procedure")], [("a", "calls", "b")])
    assert {(r.source, r.exists) for r in lookup.contains_edge(g, pairs).collect()} == {("a", True), ("b", False)}


def test_seeds_by_name_and_kind(spark):
    g = graph(spark, [("c", "metadata.catalog", "Goods"), ("d", "metadata.document", "Goods"), ("m", "module", "M"), ("p", "procedure", "Run"), ("q", "procedure", "Run")], [("c", "contains", "m")])
    seeds = (context.Seed(name="Goods", kind="metadata.document"), "m", context.Seed(id="m", kind="module"), context.Seed(name="M"))
    assert context.resolved_seeds(g, seeds) == ["d", "m"]
    assert {r.seed_id for r in context.context(g, context.ContextRequest(seeds)).collect()} == {"d", "m"}
    for seed, problem in (("x", "missing_seed"), (context.Seed(name="x"), "missing_seed"), (context.Seed(id="m", kind="query"), "incompatible_seed"), (context.Seed(name="M", kind="query"), "incompatible_seed"), (context.Seed(name="Run"), "ambiguous_seed"), (context.Seed(name="Goods"), "ambiguous_seed")):
        with pytest.raises(context.ContextError) as e:
            context.resolved_seeds(g, (seed,))
        assert e.value.code == problem
    with pytest.raises(context.ContextError):
        context.Seed(id="a", name="b")
