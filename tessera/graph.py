"""The property graph: a table of nodes and a table of edges."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import AbstractContextManager, nullcontext
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ids import edge_id
from tessera.schema import EDGE_KINDS, METADATA_KINDS, NODE_KINDS, ordinal


@dataclass(frozen=True)
class Part:
    """Nodes and edges that are made row by row from `rows`, which `keys` tell apart.

    The id of each of them tells the keys of its row, and no other part makes it. `make` takes rows and columns to pass
    on, and gives tables of nodes and of edges with these.

    `rows` may tell that they are the rows of a `table` that are `kept`, which `keys` decide, with `values` made of each and
    alike ones taken once. Snapshots of one table are then compared row by row in one reading.
    """

    rows: DataFrame
    keys: tuple[str, ...]
    make: Callable[[DataFrame, tuple[str, ...]], tuple[list[DataFrame], list[DataFrame]]]
    table: DataFrame | None = None
    kept: Column | None = None
    values: tuple[Column, ...] = ()

    def made(self, rows: DataFrame, *keep: str) -> Graph:
        """What `rows` of the part make, with the columns `keep` of their own."""
        nodes, edges = (reduce(DataFrame.unionByName, found) for found in self.make(rows, keep))
        return Graph.of(nodes, edges)


@dataclass(frozen=True)
class Graph:
    """`nodes` (`id`, `name`, `kind`, `metadata_kind`, ...) and `edges` (`source`, `target`, `kind`, `edge_id`, ...).

    Both are unique by their key and immutable; every operator is a function of them. `parts`, if told, make all nodes
    and edges that can differ from those of another snapshot, which has the same parts in the same order.
    """

    nodes: DataFrame
    edges: DataFrame
    parts: tuple[Part, ...] = ()

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, parts: tuple[Part, ...] = ()) -> Graph:
        """Tables that are unique by their keys already, with ordinals and edge ids added."""
        nodes = nodes.withColumns({"kind_ord": ordinal("kind", NODE_KINDS), "metadata_kind_ord": ordinal("metadata_kind", METADATA_KINDS)})
        return cls(nodes, edges.withColumns({"kind_ord": ordinal("kind", EDGE_KINDS), "edge_id": edge_id()}), parts)

    @classmethod
    def inserted(cls, nodes: DataFrame, edges: DataFrame) -> tuple[Graph, DataFrame]:
        """A graph from insertions in the order of `ingest_seq`, then of files and lines, and the edges that were refused.

        The last node of an id and the first edge of a (source, target, kind) stay; an edge needs both its nodes.
        Blank ids are refused like missing ones.
        """
        place = F.get("provenance", F.lit(0))
        nodes = nodes.filter(F.trim("id") != "")
        last = Window.partitionBy("id").orderBy(F.col("ingest_seq").desc(), place["path"].desc(), place["start_line"].desc())
        nodes = nodes.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank")
        first = Window.partitionBy("source", "target", "kind").orderBy("ingest_seq", place["path"], place["start_line"])
        edges = edges.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
        sources = nodes.select(F.col("id").alias("source"), F.lit(True).alias("_source"))
        targets = nodes.select(F.col("id").alias("target"), F.lit(True).alias("_target"))
        known = edges.join(sources, "source", "left").join(targets, "target", "left")
        kept = known.filter("_source and _target").select(*edges.columns)
        refused = known.filter("_source is null or _target is null").select("source", "target", "kind", F.when(F.col("_source").isNull(), F.col("source")).otherwise(F.col("target")).alias("missing_node"))
        return cls.of(nodes, kept), refused

    def edges_of(self, kinds: tuple[str, ...] | list[str] | None) -> DataFrame:
        """All edges, or those of some kinds."""
        return self.edges if kinds is None else self.edges.filter(F.col("kind").isin(*kinds))


@dataclass(frozen=True)
class Pieces:
    """A graph whose nodes and edges are dealt over pieces, each of which is `made` when it is asked for and gone after use.

    Edges that contain a node lie in the piece of that node. Other edges may have ends in other pieces, so edges tell the codes
    of both ends (`source_code`, `target_code`) unless there is one piece only.
    """

    made: tuple[Callable[[], AbstractContextManager[Graph]], ...]

    @classmethod
    def of(cls, g: Graph | Pieces) -> Pieces:
        return g if isinstance(g, Pieces) else cls((lambda: nullcontext(g),))


@dataclass(frozen=True)
class Rows:
    """Nodes and edges of two snapshots that are made row by row, told by names.

    `rows(i, n)` gives those of slice `i` of `n`, each once, with `_p` and `_c`: whether the previous and the current snapshot
    have it. `nodes` are the row's own: id, code, and whether a node of both snapshots differs in them. `ends` are nodes of the
    rest of the graph, each a prefix of the id and the column of the whole number after it, or none if the prefix is the id.
    `inner` are nodes of rows told before, whose only key is in this column; what is alike by it lies in one slice. `edges` go
    from a name to a name by a kind.
    """

    rows: Callable[[int, int], DataFrame]
    keys: tuple[str, ...]
    nodes: dict[str, tuple[Column, str, Column]]
    ends: dict[str, tuple[str, str | None]]
    inner: dict[str, str]
    edges: tuple[tuple[str, str, str], ...]

    def alone(self, i: int, n: int) -> DataFrame:
        """Rows that one snapshot has."""
        return self.rows(i, n).filter("_p != _c")


@dataclass(frozen=True)
class Layers:
    """Two snapshots: the `rest`, which is the same in both, and `rows` over it, in `n` slices.

    No edge of the rest has an end that rows make.
    """

    rest: Graph
    rows: tuple[Rows, ...]
    n: int
