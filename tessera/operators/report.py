"""Counts over a graph, its diagnostics and its reference requests, as long tables.

`section`, `metric`, `key` and `value`: each distribution is one grouping, and its rows sum to the section's total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.graph import Graph, Pieces
from tessera.operators import validate
from tessera.schema import code
from tessera.storage import settled

_COLUMNS = ("section", "metric", "key", "value")
OUTCOMES = "resolved missing_target ambiguous incompatible_kind invalid_owner unsupported partial_workspace".split()


def _long(df: DataFrame, section: str, metric: str, key, value=None) -> DataFrame:
    found = df.groupBy(key.alias("key")).agg((F.count("*") if value is None else value).cast("bigint").alias("value"))
    return found.select(F.lit(section).alias("section"), F.lit(metric).alias("metric"), "key", "value")


def _totals(df: DataFrame, section: str, metrics: dict) -> DataFrame:
    row = df.agg(*(v.cast("bigint").alias(k) for k, v in metrics.items()))
    return row.unpivot([], list(metrics), "metric", "value").select(F.lit(section).alias("section"), "metric", F.lit("").alias("key"), "value")


def _with_provenance():
    return F.coalesce(F.size("provenance"), F.lit(0)) > 0


def node_summary(g: Graph) -> DataFrame:
    totals = {"total": F.count("*"), "with_provenance": F.count_if(_with_provenance()), "without_provenance": F.count_if(~_with_provenance())}
    return _totals(g.nodes, "nodes", totals).unionByName(_long(g.nodes, "nodes", "by_kind", code()))


def edge_summary(g: Graph) -> DataFrame:
    totals = {"total": F.count("*"), "with_provenance": F.count_if(_with_provenance()), "without_provenance": F.count_if(~_with_provenance())}
    if {"source_code", "target_code"} <= set(g.edges.columns):  # one pass, as edges tell whether their ends are there
        totals |= {f"missing_{end}s": F.count_if(F.col(f"{end}_code").isNull()) for end in ("source", "target")}
        kinds = settled(g.edges.groupBy("kind").agg(*(v.alias(k) for k, v in totals.items())))
        return _totals(kinds, "edges", {k: F.coalesce(F.sum(k), F.lit(0)) for k in totals}).unionByName(_long(kinds, "edges", "by_kind", F.col("kind"), F.sum("total")))
    out = _totals(g.edges, "edges", totals).unionByName(_long(g.edges, "edges", "by_kind", F.col("kind")))
    for end in ("source", "target"):
        missing = g.edges.join(g.nodes.select(F.col("id").alias(end)), end, "left_anti")
        out = out.unionByName(_totals(missing, "edges", {f"missing_{end}s": F.count("*")}))
    return out


def diagnostic_summary(diagnostics: DataFrame) -> DataFrame:
    """All diagnostics are recoverable."""
    out = _totals(diagnostics, "diagnostics", {"total": F.count("*"), "recoverable": F.count("*")})
    for metric, column in (("by_code", "code"), ("by_severity", "severity"), ("by_kind", "kind")):
        out = out.unionByName(_long(diagnostics, "diagnostics", metric, F.col(column)))
    return out


def reference_statistics(requests: DataFrame) -> DataFrame:
    """By outcome; requests that are only collected are passed over, those of a partial workspace are unresolved."""
    done = requests.filter("state != 'collected'")
    name = F.when(F.col("outcome") == "partial_workspace", "unresolved").otherwise(F.col("outcome"))
    totals = {"total": F.count("*"), "with_provenance": F.count_if(_with_provenance()), "without_provenance": F.count_if(~_with_provenance()), "resolution_numerator": F.count_if(F.col("outcome") == "resolved"), "resolution_denominator": F.count("*")}
    return _totals(done, "references", totals).unionByName(_long(done, "references", "by_outcome", name))


def graph_report(g: Graph, diagnostics: DataFrame | None = None, requests: DataFrame | None = None) -> DataFrame:
    out = node_summary(g).unionByName(edge_summary(g))
    if diagnostics is not None:
        out = out.unionByName(diagnostic_summary(diagnostics))
    return out if requests is None else out.unionByName(reference_statistics(requests))


def merged_statistics(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("section", "metric", "key").agg(F.sum("value").cast("bigint").alias("value"))


def observed_coverage(g: Graph) -> DataFrame:
    """`entity`, `code`, `total`, `with_provenance`, `without_provenance` of every kind that occurs."""
    def part(df: DataFrame, entity: str, key) -> DataFrame:
        return df.groupBy(key.alias("code")).agg(F.count("*").alias("total"), F.count_if(_with_provenance()).alias("with_provenance"), F.count_if(~_with_provenance()).alias("without_provenance")).select(F.lit(entity).alias("entity"), "code", "total", "with_provenance", "without_provenance")

    return part(g.nodes, "node", code()).unionByName(part(g.edges, "edge", F.col("kind")))


def unregistered_kinds(g: Graph, registry: DataFrame) -> DataFrame:
    """Kinds that occur and that `registry` (`entity`, `code`) doesn't name."""
    return observed_coverage(g).join(registry.select("entity", "code").distinct(), ["entity", "code"], "left_anti").select("entity", "code", "total")


# Statuses, categories whose absence weighs most, and what to do about the first kind of evidence missing.
STATUSES = "supported partially_supported unsupported not_applicable declared_only".split()
CORE = "metadata_entity semantic_node ownership_relation metadata_reference semantic_edge".split()
ACTIONS = (
    (("node_emitted",), "Emit the typed node in its owning adapter and add representative integration coverage"),
    (("ownership_edge_emitted",), "Emit and validate the owner-child edge with provenance"),
    (("reference_resolved", "semantic_edge_emitted"), "Complete typed resolution and emit the resulting semantic edge"),
    (("provenance_attached",), "Attach provenance at the fact creation site and add regression coverage"),
    (("positive_test_exists", "negative_test_exists"), "Add the missing representative positive or negative test"),
)


def _any(column: Column, names: tuple[str, ...] | list[str]) -> Column:
    return F.arrays_overlap(column, F.array(*map(F.lit, names)))


def coverage_report(g: Graph, registry: DataFrame) -> DataFrame:
    """The gaps of a `registry` (`id`, `entity`, `code`, `category`, `status`, `required`, `evidence`: arrays of names).

    Gaps are what is not supported whole and applies. A gap is critical where emitted facts lack provenance or calls
    lack their diagnostic, high where a core category is not there at all, medium where support or a test is partial,
    else low. `observed` counts the facts of the kind in the graph. A registry names each `id` once (`repeated_ids`).
    """
    seen = observed_coverage(g).select("entity", "code", "total")
    out = registry.join(seen, ["entity", "code"], "left").withColumn("missing", F.array_sort(F.array_except("required", "evidence")))
    missing, evidence, status = F.col("missing"), F.col("evidence"), F.col("status")
    gap = (status != "not_applicable") & ~((status == "supported") & (F.size(missing) == 0))
    bare = _any(missing, ["provenance_attached"]) & _any(evidence, ["node_emitted", "semantic_edge_emitted"])
    mute = (F.col("id") == "metadata_reference.bsl_call") & _any(missing, ["diagnostic_emitted"])
    absent = F.col("category").isin(*CORE) & status.isin("unsupported", "declared_only")
    partial = (status == "partially_supported") | _any(missing, ["positive_test_exists", "negative_test_exists"])
    priority = F.when(bare | mute, "critical").when(absent, "high").when(partial, "medium").otherwise("low")
    action = F.when(F.lit(False), "")
    for names, text in ACTIONS:
        action = action.when(_any(missing, names), text)
    action = action.otherwise(F.concat(F.lit("Complete missing evidence for "), "id"))
    return out.filter(gap).select("id", "entity", "code", "category", "status", F.array_join("missing", ",").alias("missing"), priority.alias("priority"), action.alias("action"), F.coalesce("total", F.lit(0)).cast("bigint").alias("observed"))


def inconsistent_capabilities(registry: DataFrame) -> DataFrame:
    """Rows of a registry whose status contradicts their evidence, or whose `id` is there more than once."""
    lacking = F.size(F.array_except("required", "evidence")) > 0
    fits = (
        F.when(F.col("status") == "supported", ~lacking).when(F.col("status") == "partially_supported", lacking & (F.size("evidence") > 0)).when(F.col("status") == "unsupported", ~_any(F.col("evidence"), ["node_emitted", "semantic_edge_emitted"]))
        .when(F.col("status") == "not_applicable", F.size("required") == 0).when(F.col("status") == "declared_only", _any(F.col("evidence"), ["node_kind_declared", "edge_kind_declared"])).otherwise(False)
    )
    repeated = registry.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("repeated_id").alias("problem"))
    return registry.filter(~fits).select("id", F.lit("status_contradicts_evidence").alias("problem")).unionByName(repeated)


def coverage_summary(report: DataFrame, registry: DataFrame) -> DataFrame:
    """Capabilities by category and status, and gaps by priority, as long rows."""
    out = _totals(registry, "coverage", {"total": F.count("*")})
    for df, metric, column in ((registry, "by_category", "category"), (registry, "by_status", "status"), (report, "by_gap_priority", "priority")):
        out = out.unionByName(_long(df, "coverage", metric, F.col(column)))
    return out


def configuration_summary(g: Graph | Pieces, requests: DataFrame | None = None, diagnostics: DataFrame | None = None) -> DataFrame:
    """One row: the configuration node, the sizes of the graph, what its validation finds, and its references."""
    found = validate.summary(g)
    text, number = (lambda c: F.lit(found[c]).cast("string").alias(c)), (lambda c: F.lit(found[c]).cast("bigint").alias(c))
    spark = SparkSession.active()
    conf = spark.range(1).select(text("configuration_id"), text("name"), *map(number, ("nodes", "edges", "errors", "warnings")), F.lit(found["errors"] == 0).alias("valid"))
    parts = []
    if diagnostics is not None:
        parts.append(diagnostics.agg(F.count("*").alias("diagnostics")))
    if requests is not None:
        done = requests.filter("state != 'collected'")
        parts.append(done.agg(F.count("*").alias("references"), F.count_if(F.col("outcome") == "resolved").alias("resolved"), F.count_if(F.col("outcome") == "partial_workspace").alias("unresolved")))
    for part in parts:  # single rows
        conf = conf.join(F.broadcast(part))
    return conf
