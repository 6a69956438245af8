"""What a change between two snapshots affects, and why.

Changed nodes and the ends of changed edges are seeds; from them the change goes to their users along dependency
edges and, if asked, to owners or children, in each snapshot on its own. Every step is a reason, even into a node
seen before; a node is gone on from only where it is reached first. Which seed a first arrival carries is that of the
parent first in queue order, kept as the least (order of the seed, path) as in the traversals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.graph import Graph
from tessera.operators.diff import diff_edges, diff_nodes, differing
from tessera.schema import DEPENDENCY_KINDS, code
from tessera.storage import few, settled


@dataclass(frozen=True)
class ImpactOptions:
    max_depth: int = 1
    kinds: tuple[str, ...] = DEPENDENCY_KINDS
    ownership: str = "disabled"  # child_to_owner, owner_to_child, bidirectional
    provenance: str = "exclude"  # direct_only, propagate


def _seeds(previous: Graph, current: Graph, options: ImpactOptions) -> DataFrame:
    """`node_id`, `snapshot`, `status`, `seed_kind`, `seed_id`, `edge_id`, `edge_kind`, `propagates`; sorted by nothing, each once as differences are."""
    compared, rows = options.provenance != "exclude", differing(previous, current)
    nodes, edges = diff_nodes(previous, current, compared, rows), diff_edges(previous, current, compared, rows)
    snapshots = F.explode(F.when(F.col("change") == "added", F.array(F.lit("current"))).when(F.col("change") == "removed", F.array(F.lit("previous"))).otherwise(F.array(F.lit("previous"), F.lit("current"))))
    only_provenance = F.col("aspects") == "provenance"
    propagates = ~only_provenance | F.lit(options.provenance == "propagate")
    from_nodes = nodes.select(
        F.col("id").alias("node_id"), snapshots.alias("snapshot"), F.when(F.col("change") == "removed", "removed").otherwise("directly_changed").alias("status"),
        F.concat(F.lit("node_"), "change").alias("seed_kind"), F.col("id").alias("seed_id"), F.lit(None).cast("string").alias("edge_id"), F.lit(None).cast("string").alias("edge_kind"), propagates.alias("propagates"),
    )
    ends = edges.select("edge_id", "kind", "change", "aspects", F.explode(F.array_distinct(F.array("source", "target"))).alias("node_id"))
    from_edges = ends.select(
        "node_id", snapshots.alias("snapshot"), F.lit("directly_changed").alias("status"), F.concat(F.lit("edge_"), "change").alias("seed_kind"), F.col("edge_id").alias("seed_id"),
        "edge_id", F.col("kind").alias("edge_kind"), (F.when(F.col("change") == "modified", F.lit(options.provenance == "propagate")).otherwise(True)).alias("propagates"),
    )
    return from_nodes.unionByName(from_edges)


def _snapshot_edges(previous: Graph, current: Graph) -> DataFrame:
    return previous.edges.withColumn("snapshot", F.lit("previous")).unionByName(current.edges.withColumn("snapshot", F.lit("current")), allowMissingColumns=True)


def ways(kind: str, source: str, target: str, options: ImpactOptions) -> list[tuple[str, str, str, str]]:
    """The steps along an edge of a kind: from which of its ends to which, `reason` and `propagation`."""
    out = []
    if kind in DEPENDENCY_KINDS and kind in options.kinds:
        out.append((target, source, "dependency_propagation", "dependency_to_usage"))
    if kind == "contains" and options.ownership in ("child_to_owner", "bidirectional"):
        out.append((target, source, "ownership_propagation", "child_to_owner"))
    if kind == "contains" and options.ownership in ("owner_to_child", "bidirectional"):
        out.append((source, target, "ownership_propagation", "owner_to_child"))
    return out


def _steps(previous: Graph, current: Graph, options: ImpactOptions) -> DataFrame:
    """`snapshot`, `at`, `next`, `edge_id`, `edge_kind`, `reason`, `propagation`."""
    edges = _snapshot_edges(previous, current)
    kinds = [k for k in DEPENDENCY_KINDS if k in options.kinds]

    def part(df: DataFrame, at: str, next_: str, reason: str, propagation: str) -> DataFrame:
        return df.select("snapshot", F.col(at).alias("at"), F.col(next_).alias("next"), "edge_id", F.col("kind").alias("edge_kind"), F.lit(reason).alias("reason"), F.lit(propagation).alias("propagation"))

    out = part(edges.filter(F.col("kind").isin(*kinds)), "target", "source", "dependency_propagation", "dependency_to_usage")
    contains = edges.filter("kind = 'contains'")
    for way in ways("contains", "source", "target", options):
        out = out.unionByName(part(contains, *way))
    return out


def reasons(previous: Graph, current: Graph, options: ImpactOptions | None = None) -> DataFrame:
    """One row for each reason: `node_id`, `snapshot`, `depth`, `status`, `reason`, `seed_kind`, `seed_id`, `source_node`, `edge_id`, `edge_kind`, `propagation`."""
    options = options or ImpactOptions()
    seeds = _seeds(previous, current, options)
    if not previous.parts:  # with parts, what differs is settled already, and what follows from it is made again
        seeds = settled(seeds)
    none = F.lit(None).cast("string")
    out = seeds.select("node_id", "snapshot", F.lit(0).alias("depth"), "status", F.col("seed_kind").alias("reason"), "seed_kind", "seed_id", F.when(F.col("edge_id").isNotNull(), F.col("node_id")).alias("source_node"), "edge_id", "edge_kind", none.alias("propagation"))
    steps = _steps(previous, current, options)
    # Of the queue, only nodes that a step leaves or leads to matter.
    ends = few(settled(steps.select(F.explode(F.array("at", "next")).alias("node_id")).distinct()))
    # Node seeds come before edge seeds of a node, as their kinds sort; the queue starts in order of node and snapshot.
    order = F.array("node_id", "snapshot", "seed_kind", "seed_id")
    queue = settled(seeds.filter("propagates").join(ends, "node_id", "left_semi").select("node_id", "snapshot", "seed_kind", "seed_id", order.alias("path")))
    visited = queue.select("node_id", "snapshot").distinct()
    for depth in range(1, options.max_depth + 1):
        taken = queue.withColumnsRenamed({"node_id": "at"}).join(steps, ["snapshot", "at"])
        taken = settled(taken)
        out = out.unionByName(
            taken.select(F.col("next").alias("node_id"), "snapshot", F.lit(depth).alias("depth"), F.lit("transitively_affected").alias("status"), "reason", "seed_kind", "seed_id", F.col("at").alias("source_node"), "edge_id", "edge_kind", "propagation")
        )
        if depth == options.max_depth:
            break
        new = taken.withColumnRenamed("next", "node_id").join(visited, ["node_id", "snapshot"], "left_anti")
        step = F.concat("path", F.array("node_id", "edge_id", "reason", "propagation"))
        first = new.groupBy("node_id", "snapshot").agg(F.min(F.struct(step.alias("path"), "seed_kind", "seed_id")).alias("first"))
        queue = settled(first.select("node_id", "snapshot", "first.seed_kind", "first.seed_id", "first.path"))
        if queue.isEmpty():
            break
        visited = settled(visited.unionByName(queue.select("node_id", "snapshot")))
    return out


def affected(previous: Graph, current: Graph, options: ImpactOptions | None = None) -> DataFrame:
    """`node_id`, `code`, `depth` (least), `status` (removed, else directly_changed, else transitively_affected), `availability` and `n_reasons`.

    Counts the rows of `reasons` without making them: a node carries the number of seeds that it is gone on from
    with, which is that of its own seeds at depth 0 and one after that.
    """
    options = options or ImpactOptions()
    seeds = _seeds(previous, current, options)
    if not previous.parts:
        seeds = settled(seeds)
    rank = F.when(F.col("status") == "removed", 2).otherwise(1)
    arrivals = [seeds.groupBy("node_id").agg(F.max(rank).alias("rank"), F.count("*").alias("n")).withColumn("depth", F.lit(0))]
    steps = _steps(previous, current, options).select("snapshot", F.col("at").alias("node_id"), "next")
    queue = settled(seeds.filter("propagates").groupBy("node_id", "snapshot").agg(F.count("*").alias("weight")))
    visited = queue.select("node_id", "snapshot")
    for depth in range(1, options.max_depth + 1):
        taken = settled(queue.join(steps, ["snapshot", "node_id"]).groupBy("snapshot", F.col("next").alias("node_id")).agg(F.sum("weight").alias("n")))
        arrivals.append(taken.groupBy("node_id").agg(F.lit(0).alias("rank"), F.sum("n").alias("n")).withColumn("depth", F.lit(depth)))
        if depth == options.max_depth:
            break
        queue = settled(taken.join(visited, ["node_id", "snapshot"], "left_anti").select("node_id", "snapshot", F.lit(1).cast("bigint").alias("weight")))
        if queue.isEmpty():
            break
        visited = visited.unionByName(queue.select("node_id", "snapshot"))
    found = arrivals[0]
    for x in arrivals[1:]:
        found = found.unionByName(x)
    merged = found.groupBy("node_id").agg(F.min("depth").cast("bigint").alias("depth"), F.max("rank").alias("rank"), F.sum("n").alias("n_reasons"))
    side = lambda g, name: g.nodes.select(F.col("id").alias("node_id"), code().alias(name))
    out = merged.join(side(previous, "_p"), "node_id", "left").join(side(current, "_c"), "node_id", "left")
    return told(out.withColumns({"code": F.coalesce("_c", "_p"), "_p": F.col("_p").isNotNull(), "_c": F.col("_c").isNotNull()}))


def told(found: DataFrame, *keep: Column | str) -> DataFrame:
    """What `affected` gives and the columns `keep`, of `node_id`, `code`, `depth`, `rank`, `n_reasons`, and `_p` and `_c`: whether a snapshot has the node."""
    availability = F.when(F.col("_p") & F.col("_c"), "both").when(F.col("_c"), "current_only").otherwise("previous_only")
    status = F.when(F.col("rank") == 2, "removed").when(F.col("rank") == 1, "directly_changed").otherwise("transitively_affected")
    return found.select("node_id", "code", F.col("depth").cast("bigint").alias("depth"), status.alias("status"), availability.alias("availability"), "n_reasons", *keep)


def counters() -> list[Column]:
    """Counters over `affected`."""
    found = {
        "nodes": F.count("*"), "removed": F.count_if(F.col("status") == "removed"), "directly_changed": F.count_if(F.col("status") == "directly_changed"),
        "transitively_affected": F.count_if(F.col("status") == "transitively_affected"), "previous_only": F.count_if(F.col("availability") == "previous_only"),
        "current_only": F.count_if(F.col("availability") == "current_only"), "both": F.count_if(F.col("availability") == "both"),
        "reasons": F.coalesce(F.sum("n_reasons"), F.lit(0)), "max_depth": F.coalesce(F.max("depth"), F.lit(0)),
    }
    return [v.cast("bigint").alias(k) for k, v in found.items()]


def summary(nodes: DataFrame) -> DataFrame:
    """Counters over `affected`, as `metric` and `value`."""
    row = nodes.agg(*counters())
    return row.unpivot([], row.columns, "metric", "value")
