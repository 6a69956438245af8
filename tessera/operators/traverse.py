"""Bounded breadth-first traversals and closures.

A traversal visits each node once, and which edge leads to it is part of the answer: that of the parent that a queue
would have reached first. A queue's order is the lexicographic order of the paths from the start, so each visited node
carries its path as an array, the parent is the least path, and no step needs a global numbering. Paths have at most
`max_depth` steps. Each level joins the frontier with the edges and is settled before the next. The ids of a frontier of
few nodes are broadcast, so that the edges are read where they lie and only those at the frontier are written. Rows of
the graph that are there more than once change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.graph import Graph
from tessera.schema import CONTEXT_PRIORITY, EDGE_KINDS, code
from tessera.storage import few, settled

MAX_DEPTH = 4


def _steps(g: Graph, direction: str, kinds: list[str] | None, key) -> DataFrame:
    """Edges as `at`, `next`, `edge_id` and `key` (what orders the edges of one node); both ends exist."""
    edges = g.edges_of(kinds)
    parts = []
    if direction in ("downstream", "outgoing", "both"):
        parts.append(edges.select(F.col("source").alias("at"), F.col("target").alias("next"), "edge_id", "kind", key("outgoing", "target").alias("key")))
    if direction in ("upstream", "incoming", "both"):
        parts.append(edges.select(F.col("target").alias("at"), F.col("source").alias("next"), "edge_id", "kind", key("incoming", "source").alias("key")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _taken(frontier: DataFrame, steps: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """`steps` from the `frontier` (`at`) to `nodes` (`next`) that aren't `known` (`id`) yet."""
    at, seen = settled(frontier.select("at")), settled(known.select(F.col("id").alias("next")))
    taken = settled(steps.join(few(at), "at", "left_semi").join(few(seen), "next", "left_anti").distinct())
    there = nodes.join(few(settled(taken.select("next").distinct())), "next", "left_semi")
    return taken.join(there, "next", "left_semi")


def _levels(g: Graph, seeds: DataFrame, steps: DataFrame, max_depth: int) -> DataFrame:
    """`seeds` (`id`, `path`) and all they reach: `id`, `depth`, `path` (least), `via_edge`."""
    known = settled(seeds.select("id", F.lit(0).alias("depth"), "path", F.lit(None).cast("string").alias("via_edge")))
    nodes = g.nodes.select(F.col("id").alias("next"))
    for depth in range(1, max_depth + 1):
        frontier = known.filter(F.col("depth") == depth - 1).select(F.col("id").alias("at"), "path")
        found = frontier.join(_taken(frontier, steps, known, nodes), "at")
        best = found.groupBy("next").agg(F.min(F.struct(F.concat("path", "key").alias("path"), F.col("edge_id"))).alias("best"))
        level = settled(best.select(F.col("next").alias("id"), F.lit(depth).alias("depth"), F.col("best.path").alias("path"), F.col("best.edge_id").alias("via_edge")))
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known


def _start(g: Graph, start: str) -> DataFrame:
    return g.nodes.filter(F.col("id") == start).select("id", F.array().cast("array<string>").alias("path")).distinct()


def traverse(g: Graph, start: str, direction: str = "downstream", kinds: list[str] | None = None, max_depth: int = MAX_DEPTH, include_start: bool = True) -> DataFrame:
    """`node_id`, `depth`, `via_edge` and `path`; in order of (`depth`, `path`), neighbours going by id and edge id."""
    found = _levels(g, _start(g, start), _steps(g, direction, kinds, lambda _, other: F.array(F.col(other), F.col("edge_id"))), max_depth)
    out = found.select(F.col("id").alias("node_id"), "depth", "via_edge", "path")
    return out if include_start else out.filter("depth > 0")


def _two_digits(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def traverse_edges(g: Graph, start: str, direction: str = "both", kinds: list[str] | None = None, max_depth: int = 2) -> DataFrame:
    """Like `traverse`, but a node's edges go by (source, target, kind), and the start is always there."""
    key = lambda _, other: F.array("source", "target", _two_digits(F.col("kind_ord")))
    return _levels(g, _start(g, start), _steps(g, direction, kinds, key), max_depth).select(F.col("id").alias("node_id"), "depth", "via_edge", "path")


def ordered(found: DataFrame, limit: int) -> tuple[list, bool]:
    """The first `limit` rows in order of discovery, and whether there are more."""
    rows = found.orderBy("depth", "path").limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def subsystem_members(g: Graph, start: str) -> DataFrame:
    """`member_id`: the metadata that a subsystem includes, itself or through subsystems below it; each once.

    Goes on until no new subsystem is found, so cycles end. Anything but a subsystem has no members.
    """
    subsystems = g.nodes.filter("kind = 'subsystem'").select("id")
    included = g.edges.filter("kind = 'includes'").select(F.col("source").alias("id"), F.col("target").alias("next"))
    below = included.join(subsystems.select(F.col("id").alias("next")), "next", "left_semi")
    known = frontier = settled(subsystems.filter(F.col("id") == start).distinct())
    while not frontier.isEmpty():
        frontier = settled(frontier.join(below, "id").select(F.col("next").alias("id")).distinct().join(known, "id", "left_anti"))
        known = settled(known.unionByName(frontier))
    allowed = g.nodes.filter("kind = 'metadata' and metadata_kind not in ('configuration', 'subsystem', 'form', 'event_subscription', 'unknown')").select(F.col("id").alias("next"))
    return known.join(included, "id").join(allowed, "next", "left_semi").select(F.col("next").alias("member_id")).distinct()


def context_candidates(g: Graph, seeds: DataFrame, direction: str = "both", edge_kinds: list[str] | None = None, node_codes: list[str] | None = None, max_depth: int = 2, wanted: int | None = None) -> DataFrame:
    """`seeds` (`id`) and what is around them, each by its best path.

    The best path is the shortest, then the one whose steps (priority of the edge kind, outgoing before incoming, edge
    id) come first, then that of the first seed. `node_id`, `depth`, `seed_id`, `steps` (array of `direction`,
    `kind`, `edge_id`) and `path`, the key that orders them. As nearer ones come first in that order, no level is
    made beyond that with the last of `wanted`.
    """

    priority = F.element_at(F.create_map(*[x for k, v in CONTEXT_PRIORITY.items() for x in (F.lit(k), F.lit(f"{v:02}"))]), F.col("kind"))
    key = lambda way, _: F.array(F.concat_ws("|", priority, F.lit({"outgoing": "0", "incoming": "1"}[way]), F.col("edge_id")))
    steps = _steps(g, direction, edge_kinds or EDGE_KINDS, key).withColumn("way", F.when(F.substring(F.col("key")[0], 4, 1) == "0", "outgoing").otherwise("incoming"))
    nodes = g.nodes if node_codes is None else g.nodes.filter(code().isin(*node_codes))
    none = F.array().cast("array<string>")
    no_steps = F.array().cast("array<struct<direction:string,kind:string,edge_id:string>>")
    known = settled(seeds.join(g.nodes.select("id"), "id", "left_semi").select("id", F.lit(0).alias("depth"), none.alias("path"), F.col("id").alias("seed_id"), no_steps.alias("steps")))
    for depth in range(1, max_depth + 1):
        if wanted is not None and known.limit(wanted).count() == wanted:
            break
        frontier = known.filter(F.col("depth") == depth - 1).select(F.col("id").alias("at"), F.col("path").alias("before"), "seed_id", F.col("steps").alias("taken"))
        found = frontier.join(_taken(frontier, steps, known, nodes.select(F.col("id").alias("next"))), "at")
        step = F.struct(F.col("way").alias("direction"), "kind", "edge_id")
        best = found.groupBy("next").agg(F.min(F.struct(F.concat("before", "key").alias("path"), "seed_id", F.concat("taken", F.array(step)).alias("steps"))).alias("best"))
        level = settled(best.select(F.col("next").alias("id"), F.lit(depth).alias("depth"), "best.path", "best.seed_id", "best.steps"))
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known.select(F.col("id").alias("node_id"), "depth", "seed_id", "steps", "path")


