"""The bounded facade: what clients may ask, within limits and with closed error codes.

Answers are small lists of plain rows. Three orders are kept apart: relations of the graph service go by edge id,
dependencies by (node, edge id), and those of the tool service by (source, target, kind).
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph import Graph
from tessera.operators import context, impact, lookup, report, traverse, validate
from tessera.schema import EDGE_KINDS, code

MAX_ROWS, DEFAULT_ROWS, MAX_DEPTH = 100, 50, 4
#: What `GraphService.call` may call.
TOOLS = "configurations node relations traverse tool_relations tool_traverse validation diagnostic_rows summary impact context symbols document_diagnostics".split()
SYMBOL_KINDS = ("module", "procedure", "function", "query")


class ServiceError(ValueError):
    """`code` is not_ready (503), not_found (404), invalid_parameter (400), too_many (400) or denied (403)."""

    STATUS = {"not_ready": 503, "not_found": 404, "invalid_parameter": 400, "too_many": 400, "denied": 403}

    def __init__(self, code_: str, message: str):
        super().__init__(message)
        self.code, self.status = code_, self.STATUS[code_]


def parameters(query: str, allowed: set[str], required: set[str] = frozenset()) -> dict[str, str]:
    """A query string's parameters: each allowed, each once, none required left out, percent signs well-formed."""
    out: dict[str, str] = {}
    for pair in filter(None, query.split("&")):
        name, _, raw = pair.partition("=")
        decoded, i = bytearray(), 0
        data = raw.replace("+", " ").encode()
        while i < len(data):
            if data[i] == 37:
                try:
                    decoded.append(int(data[i + 1 : i + 3].decode("ascii"), 16) if len(data) >= i + 3 else int("x"))
                except ValueError:
                    raise ServiceError("invalid_parameter", f"{name} is not well-formed") from None
                i += 3
            else:
                decoded.append(data[i])
                i += 1
        if name not in allowed or name in out:
            raise ServiceError("invalid_parameter", f"{name} is unknown or there twice")
        try:
            out[name] = decoded.decode()
        except UnicodeDecodeError:
            raise ServiceError("invalid_parameter", f"{name} is not UTF-8") from None
    if required - out.keys():
        raise ServiceError("invalid_parameter", f"{', '.join(sorted(required - out.keys()))} left out")
    return out


def _limit(limit: int) -> int:
    if not 1 <= limit <= MAX_ROWS:
        raise ServiceError("invalid_parameter", f"the limit is 1 to {MAX_ROWS}")
    return limit


def _bounded(df: DataFrame, limit: int) -> dict:
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    return {"items": rows[:limit], "truncated": len(rows) > limit}


def confined(path: str, *roots: str) -> bool:
    """Whether a path stays below every root once its dots are worked out."""
    clean = posixpath.normpath(path)
    return all(clean == r or clean.startswith(r.rstrip("/") + "/") for r in map(posixpath.normpath, roots)) and not clean.startswith("..")


@dataclass(frozen=True)
class Rule:
    """What a policy says about tools whose name it lists ("*" for all)."""

    effect: str  # allow, confirm, deny
    tools: tuple[str, ...]

    def names(self, tool: str) -> bool:
        return "*" in self.tools or tool in self.tools


def evaluate(rules: list[Rule], tool: str) -> str:
    """deny over everything, deny too where no rule names the tool, confirm over allow."""
    effects = {r.effect for r in rules if r.names(tool)}
    return "deny" if not effects or "deny" in effects else "confirm" if "confirm" in effects else "allow"


@dataclass(frozen=True)
class GraphService:
    """Queries over the graphs of named configurations."""

    graphs: dict[str, Graph]
    diagnostics: dict[str, DataFrame] = field(default_factory=dict)
    requests: dict[str, DataFrame] = field(default_factory=dict)

    def _graph(self, configuration: str) -> Graph:
        if not self.graphs:
            raise ServiceError("not_ready", "no snapshot is published")
        if configuration not in self.graphs:
            raise ServiceError("not_found", f"no configuration {configuration}")
        return self.graphs[configuration]

    def configurations(self, limit: int = DEFAULT_ROWS) -> dict:
        names = sorted(self.graphs)
        return {"items": names[: _limit(limit)], "truncated": len(names) > limit}

    def node(self, configuration: str, id_: str) -> dict:
        found = lookup.node(self._graph(configuration), id_).select("id", "name", "kind", F.col("metadata_kind").alias("metadataKind")).collect()
        if not found:
            raise ServiceError("not_found", f"no node {id_}")
        return found[0].asDict()

    def relations(self, configuration: str, id_: str, direction: str = "outgoing", kind: str | None = None, limit: int = DEFAULT_ROWS) -> dict:
        """In order of edge ids."""
        if direction not in ("outgoing", "incoming") or (kind is not None and kind not in EDGE_KINDS):
            raise ServiceError("invalid_parameter", "direction or kind")
        self.node(configuration, id_)
        way = {"outgoing": "downstream", "incoming": "upstream"}[direction]
        found = lookup.relations(self._graph(configuration), way, None if kind is None else [kind], id_)
        return _bounded(found.orderBy("edge_id"), _limit(limit))

    def traverse(self, configuration: str, id_: str, direction: str = "downstream", kinds: list[str] | None = None, depth: int = MAX_DEPTH, include_start: bool = False, limit: int = DEFAULT_ROWS) -> dict:
        if not 0 <= depth <= MAX_DEPTH or direction not in ("downstream", "upstream"):
            raise ServiceError("invalid_parameter", f"the depth is 0 to {MAX_DEPTH}")
        self.node(configuration, id_)
        found = traverse.traverse(self._graph(configuration), id_, direction, kinds, depth, include_start)
        return _bounded(found.orderBy("depth", "path").drop("path"), _limit(limit))

    def tool_relations(self, configuration: str, id_: str, direction: str = "both", kinds: list[str] | None = None, limit: int = DEFAULT_ROWS) -> dict:
        """In order of (source, target, kind); an edge from a node to itself once."""
        self.node(configuration, id_)
        edges = self._graph(configuration).edges_of(kinds)
        ends = {"outgoing": F.col("source") == id_, "incoming": F.col("target") == id_, "both": (F.col("source") == id_) | (F.col("target") == id_)}
        return _bounded(edges.filter(ends[direction]).orderBy("source", "target", "kind_ord").select("source", "target", "kind", "edge_id"), _limit(limit))

    def tool_traverse(self, configuration: str, id_: str, direction: str = "both", kinds: list[str] | None = None, depth: int = 2, limit: int = DEFAULT_ROWS) -> dict:
        self.node(configuration, id_)
        return _bounded(traverse.traverse_edges(self._graph(configuration), id_, direction, kinds, depth).orderBy("depth", "path").drop("path"), _limit(limit))

    def validation(self, configuration: str, limit: int = DEFAULT_ROWS) -> dict:
        issues = validate.validate(self._graph(configuration)).persist()
        try:
            counts = {r["severity"]: r["count"] for r in issues.groupBy("severity").count().collect()}
            found = _bounded(issues.orderBy("severity", "code", "nodes", "edge_id"), _limit(limit))
        finally:
            issues.unpersist()
        return found | {"valid": not counts.get("error"), "errors": counts.get("error", 0), "warnings": counts.get("warning", 0)}

    def diagnostic_rows(self, configuration: str, limit: int = DEFAULT_ROWS) -> dict:
        self._graph(configuration)
        if configuration not in self.diagnostics:
            return {"items": [], "truncated": False}
        return _bounded(self.diagnostics[configuration].orderBy("source_node", "kind", "reference", "code"), _limit(limit))

    def summary(self, configuration: str) -> dict:
        return report.configuration_summary(self._graph(configuration), self.requests.get(configuration), self.diagnostics.get(configuration)).first().asDict()

    def call(self, rules: list[Rule], tool: str, *arguments, confirmed: bool = False, **named):
        """A method by its name, if the policy allows it, or wants it confirmed and it is."""
        effect = evaluate(rules, tool)
        if effect == "deny" or effect == "confirm" and not confirmed or tool not in TOOLS:
            raise ServiceError("denied", f"{tool} is {'to be confirmed' if effect == 'confirm' else 'not allowed'}")
        return getattr(self, tool)(*arguments, **named)

    def impact(self, previous: str, current: str, depth: int = 1, limit: int = DEFAULT_ROWS) -> dict:
        """What differs between two configurations and what that affects."""
        options = impact.ImpactOptions(max_depth=depth)
        return _bounded(impact.affected(self._graph(previous), self._graph(current), options).orderBy("node_id"), _limit(limit))

    def context(self, configuration: str, seed: str, depth: int = 2, candidates: int = 50, budget: int = 16_384) -> dict:
        if not 1 <= budget <= 32_768:
            raise ServiceError("invalid_parameter", "the budget is 1 to 32,768 bytes")
        self.node(configuration, seed)
        return context.assembled(self._graph(configuration), context.ContextRequest((seed,), budget, depth, candidates))

    def symbols(self, configuration: str, text: str, limit: int = DEFAULT_ROWS, strict: bool = False) -> dict:
        """Modules, procedures, functions and queries whose name holds `text` in any case and that stand in one place.

        `strict` refuses more than the limit instead of cutting off.
        """
        found = _bounded(symbol_search(self._graph(configuration).nodes, text).orderBy("name", "kind", "path", "start_line", "id"), _limit(limit))
        if strict and found["truncated"]:
            raise ServiceError("invalid_parameter", f"more than {limit} symbols")
        return found

    def document_diagnostics(self, configuration: str, path: str) -> list[dict]:
        """Diagnostics whose source node is located in a document; more than `MAX_ROWS` are an error."""
        if configuration not in self.diagnostics:
            return []
        located = self._graph(configuration).nodes.select(F.col("id").alias("source_node"), F.explode("provenance").alias("p")).filter(F.col("p.path") == path).select("source_node").distinct()
        found = _bounded(self.diagnostics[configuration].join(located, "source_node", "left_semi").orderBy("source_node", "kind", "code"), MAX_ROWS)
        if found["truncated"]:
            raise ServiceError("too_many", f"{path} has more than {MAX_ROWS} diagnostics")
        return found["items"]


def symbol_search(nodes: DataFrame, text: str) -> DataFrame:
    """`id`, `name`, `kind`, `path`, `start_line` of the symbols that match and have exactly one location."""
    hit = nodes.filter(F.col("kind").isin(*SYMBOL_KINDS) & F.contains(F.lower("name"), F.lit(text.lower())))
    places = F.array_distinct(F.filter(F.transform("provenance", lambda p: F.struct(p["path"].alias("path"), p["start_line"].alias("start_line"))), lambda x: x["path"].isNotNull()))
    one = hit.withColumn("_places", places).filter(F.size("_places") == 1)
    return one.select("id", "name", code().alias("kind"), F.col("_places")[0]["path"].alias("path"), F.col("_places")[0]["start_line"].alias("start_line"))
