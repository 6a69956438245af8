"""Context for a question: what is around its seeds, rendered until a budget of bytes is used up."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.graph import Graph
from tessera.operators.traverse import context_candidates
from tessera.schema import EDGE_KINDS, code
from tessera.storage import few, settled


class ContextError(ValueError):
    """A request that can't be answered; `code` names why."""

    def __init__(self, code_: str, message: str):
        super().__init__(message)
        self.code = code_


@dataclass(frozen=True, order=True)
class Seed:
    """A node by its id or by its exact name, of a kind (`metadata.<kind>` for metadata) if one is expected."""

    id: str = ""
    name: str = ""
    kind: str = ""

    def __post_init__(self) -> None:
        if bool(self.id) == bool(self.name):
            raise ContextError("invalid_seeds", "a seed has an id or a name")


@dataclass(frozen=True)
class ContextRequest:
    seeds: tuple[str | Seed, ...]  # a string is an id
    budget: int = 16_384
    max_depth: int = 2
    max_candidates: int = 50
    direction: str = "both"
    edge_kinds: tuple[str, ...] = field(default_factory=lambda: tuple(EDGE_KINDS))
    node_codes: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        for ok, name, message in (
            (1 <= self.budget <= 65_536, "invalid_budget", "the budget is 1 to 65,536 bytes"),
            (1 <= len(self.seeds) <= 16, "invalid_seeds", "there are 1 to 16 seeds"),
            (0 <= self.max_depth <= 4, "invalid_depth", "the depth is 0 to 4"),
            (1 <= self.max_candidates <= 128, "invalid_candidates", "there are 1 to 128 candidates"),
            (len(set(self.seeds)) <= self.max_candidates, "invalid_candidates", "all seeds are candidates"),
            (bool(self.edge_kinds) and set(self.edge_kinds) <= set(EDGE_KINDS), "invalid_edge_kinds", "edge kinds are named"),
            (self.node_codes is None or bool(self.node_codes), "invalid_node_kinds", "node kinds are named"),
        ):
            if not ok:
                raise ContextError(name, message)


def resolved_seeds(g: Graph, seeds: tuple[str | Seed, ...]) -> list[str]:
    """The ids of the seeds, sorted and each once; the first seed in order that names no single node is an error.

    What is collected is a row for each id, and for each name and kind.
    """
    wanted = sorted({Seed(id=s) if isinstance(s, str) else s for s in seeds})
    ids, names = [s.id for s in wanted if s.id], [s.name for s in wanted if s.name]
    nodes = g.nodes.select("id", "name", code().alias("code"))
    kinds = {r["id"]: r["code"] for r in nodes.filter(F.col("id").isin(*ids)).collect()} if ids else {}
    found: dict[str, list] = {}
    for r in nodes.filter(F.col("name").isin(*names)).groupBy("name", "code").agg(F.count("*").alias("n"), F.min("id").alias("least")).collect() if names else ():
        found.setdefault(r["name"], []).append(r)
    out = set()
    for s in wanted:
        if s.id:
            actual = [kinds[s.id]] if s.id in kinds else []
            fitting = [(1, s.id)] if actual and s.kind in ("", actual[0]) else []
        else:
            actual = sorted(r["code"] for r in found.get(s.name, ()))
            fitting = [(r["n"], r["least"]) for r in found.get(s.name, ()) if s.kind in ("", r["code"])]
        if not actual:
            raise ContextError("missing_seed", f"no node {s.id or s.name}")
        if not fitting:
            raise ContextError("incompatible_seed", f"{s.id or s.name} is {', '.join(actual)} and no {s.kind}")
        if sum(n for n, _ in fitting) > 1:
            raise ContextError("ambiguous_seed", f"{s.name} can mean {sum(n for n, _ in fitting)} nodes, {min(least for _, least in fitting)} first")
        out.add(fitting[0][1])
    return sorted(out)


def _sized(c: Column) -> Column:
    return F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)


def rendered(g: Graph, candidates: DataFrame) -> DataFrame:
    """`candidates` with `fragment`, two lines of text each, and `cost_bytes`."""
    nodes = g.nodes.select(F.col("id").alias("node_id"), "name", code().alias("code"))
    nodes = nodes.join(few(settled(candidates.select("node_id"))), "node_id", "left_semi").dropDuplicates(["node_id"])
    steps = F.array_join(F.transform("steps", lambda s: F.concat(s["direction"], F.lit(","), s["kind"], F.lit(","), _sized(s["edge_id"]))), ";")
    first = F.concat(F.lit("node kind="), "code", F.lit(" id="), _sized(F.col("node_id")), F.lit(" name="), _sized(F.col("name")), F.lit("\n"))
    seed = F.concat(F.lit("reason seed="), _sized(F.col("seed_id")), F.lit(" depth="), F.col("depth").cast("string"))
    second = F.when(F.col("depth") == 0, F.concat(seed, F.lit("\n"))).otherwise(F.concat(seed, F.lit(" path="), F.size("steps").cast("string"), F.lit(":"), steps, F.lit("\n")))
    out = candidates.join(nodes, "node_id").withColumn("fragment", F.concat(first, second))
    return out.withColumn("cost_bytes", F.octet_length("fragment").cast("bigint"))


def context(g: Graph, request: ContextRequest) -> DataFrame:
    """`node_id`, `depth`, `seed_id`, `fragment`, `cost_bytes`, `position` and `included`.

    Of the candidates the first `max_candidates` stay. Seeds are always in; the others are, in order, until one
    doesn't fit, and none after it. As every fragment costs something, that is a running sum. The windows run over
    at most `max_candidates` rows.
    """
    spark = g.nodes.sparkSession
    seeds = spark.createDataFrame([(s,) for s in resolved_seeds(g, request.seeds)], "id string")
    found = context_candidates(g, seeds, request.direction, list(request.edge_kinds), None if request.node_codes is None else list(request.node_codes), request.max_depth, request.max_candidates)
    order = ["depth", "path", "seed_id", "node_id"]
    kept = rendered(g, settled(found.orderBy(*order).limit(request.max_candidates)))
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = kept.withColumn("_used", F.sum("cost_bytes").over(running)).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return out.select("node_id", F.col("depth").cast("bigint").alias("depth"), "seed_id", "fragment", "cost_bytes", "position", (F.col("_used") <= request.budget).alias("included"))


def assembled(g: Graph, request: ContextRequest) -> dict:
    """The bundle: text, items, bytes used and left, and how many were left out for the budget."""
    rows = context(g, request).orderBy("position").collect()
    needed = sum(r["cost_bytes"] for r in rows if r["depth"] == 0)
    if needed > request.budget:
        raise ContextError("insufficient_budget", f"the seeds need {needed} bytes of {request.budget}")
    items = [r for r in rows if r["included"]]
    used = sum(r["cost_bytes"] for r in items)
    return {"rendered": "".join(r["fragment"] for r in items), "items": [r["node_id"] for r in items], "used_bytes": used, "remaining_bytes": request.budget - used, "budget_omitted": len(rows) - len(items)}
