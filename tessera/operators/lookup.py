"""Exact lookups, ownership, neighbours and direct dependencies.

Every function is a plan over the whole graph or over the nodes that a filter names; on a stored snapshot a node id
given as a string is a filter that reaches the scan. Names compare exactly and case matters. Unknown ids give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph import Graph
from tessera.schema import DEPENDENCY_KINDS, code

Kinds = Iterable[str] | None


def node(g: Graph, id_: str) -> DataFrame:
    return g.nodes.filter(F.col("id") == id_)


def contains_node(g: Graph, ids: DataFrame) -> DataFrame:
    """`ids` (column `id`) with `exists`."""
    known = g.nodes.select("id", F.lit(True).alias("_known"))
    return ids.join(known, "id", "left").select(*ids.columns, F.coalesce("_known", F.lit(False)).alias("exists"))


def contains_edge(g: Graph, edges: DataFrame) -> DataFrame:
    """`edges` (columns `source`, `target`, `kind`) with `exists`."""
    known = g.edges.select("source", "target", "kind", F.lit(True).alias("_known"))
    return edges.join(known, ["source", "target", "kind"], "left").select(*edges.columns, F.coalesce("_known", F.lit(False)).alias("exists"))


def nodes_by_kind(g: Graph, kind: str) -> DataFrame:
    """Nodes of a kind, or of `metadata.<kind>`."""
    return g.nodes.filter(code() == kind if "." in kind else F.col("kind") == kind)


def nodes_by_name(g: Graph, name: str, kind: str | None = None) -> DataFrame:
    return (g.nodes if kind is None else nodes_by_kind(g, kind)).filter(F.col("name") == name)


def edge(g: Graph, edge_id: str) -> DataFrame:
    return g.edges.filter(F.col("edge_id") == edge_id)


def edges_by_kind(g: Graph, kind: str) -> DataFrame:
    return g.edges.filter(F.col("kind") == kind)


def outgoing_edges(g: Graph, id_: str | None = None, kinds: Kinds = None) -> DataFrame:
    out = g.edges_of(None if kinds is None else list(kinds))
    return out if id_ is None else out.filter(F.col("source") == id_)


def incoming_edges(g: Graph, id_: str | None = None, kinds: Kinds = None) -> DataFrame:
    out = g.edges_of(None if kinds is None else list(kinds))
    return out if id_ is None else out.filter(F.col("target") == id_)


def relations(g: Graph, direction: str = "downstream", kinds: Kinds = None, id_: str | None = None) -> DataFrame:
    """`node_id`, the related node (`related_id`, `related_name`, `related_code`), `edge_id` and `edge_kind`.

    In order of (related id, edge id) within a node; edges to nodes that don't exist are left out.
    """
    own, other = ("source", "target") if direction == "downstream" else ("target", "source")
    edges = (outgoing_edges if direction == "downstream" else incoming_edges)(g, id_, kinds)
    left = edges.select(F.col(own).alias("node_id"), F.col(other).alias("related_id"), "edge_id", F.col("kind").alias("edge_kind"))
    right = g.nodes.select(F.col("id").alias("related_id"), F.col("name").alias("related_name"), code().alias("related_code"))
    return left.join(right, "related_id").select("node_id", "related_id", "related_name", "related_code", "edge_id", "edge_kind")


def owners(g: Graph, id_: str | None = None) -> DataFrame:
    """All owners of each child, so that children with several can be seen."""
    return relations(g, "upstream", ["contains"], id_)


def owner(g: Graph) -> DataFrame:
    """`child_id` and `owner_id` of the nodes with exactly one owner."""
    found = owners(g).groupBy(F.col("node_id").alias("child_id")).agg(F.count("*").alias("n"), F.min("related_id").alias("owner_id"))
    return found.filter("n = 1").select("child_id", "owner_id")


def children(g: Graph, id_: str | None = None, kind: str | None = None) -> DataFrame:
    out = relations(g, "downstream", ["contains"], id_)
    if kind is None:
        return out
    return out.filter(F.col("related_code") == kind if "." in kind or kind != "metadata" else F.col("related_code").startswith("metadata."))


def neighbors(g: Graph, direction: str = "downstream", kinds: Kinds = None, id_: str | None = None) -> DataFrame:
    """`relations` with each related node once."""
    found = relations(g, direction, kinds, id_)
    return found.groupBy("node_id", "related_id").agg(F.min("related_name").alias("related_name"), F.min("related_code").alias("related_code"))


def _dependency_kinds(kinds: Kinds) -> list[str]:
    """`kinds` as far as they are dependencies; a kind that is none gives nothing."""
    return [k for k in DEPENDENCY_KINDS if kinds is None or k in set(kinds)]


def direct_dependencies(g: Graph, kinds: Kinds = None, id_: str | None = None) -> DataFrame:
    return relations(g, "downstream", _dependency_kinds(kinds), id_)


def direct_usages(g: Graph, kinds: Kinds = None, id_: str | None = None) -> DataFrame:
    return relations(g, "upstream", _dependency_kinds(kinds), id_)
