"""Resolution of references: each reference gets an outcome and its candidates.

Outcomes: `resolved`, `missing_target`, `ambiguous`, `incompatible_kind`, `missing_owner`, `invalid_owner`. References
are rows, so a whole workspace resolves in one join. Rows keep their columns and gain `outcome`, `target` (where
resolved), `n_candidates` and `first_candidate` (the least id). All candidates of a name are rows of their own
(`name_candidates`), for a frequent name has no bound to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.graph import Graph
from tessera.schema import code

def _with(refs: DataFrame, out: DataFrame, outcome: Column, target: Column, n: Column, first: Column) -> DataFrame:
    return out.select(*refs.columns, outcome.alias("outcome"), F.when(outcome == "resolved", target).alias("target"), n.cast("bigint").alias("n_candidates"), first.alias("first_candidate"))


def resolve_ids(g: Graph, refs: DataFrame, expected_kind: str | None = None) -> DataFrame:
    """`refs` has `reference`, a node id. Where they tell its code already (`reference_code`, null for none), they stay where they are."""
    if "reference_code" in refs.columns:
        return _by_code(refs, refs.withColumn("_code", F.col("reference_code")), expected_kind)
    targets = g.nodes.select(F.col("id").alias("reference"), code().alias("_code"))
    return _by_code(refs, refs.join(targets, "reference", "left"), expected_kind)


def _by_code(refs: DataFrame, out: DataFrame, expected_kind: str | None) -> DataFrame:
    fits = F.lit(True) if expected_kind is None else F.col("_code") == expected_kind
    outcome = F.when(F.col("_code").isNull(), "missing_target").when(fits, "resolved").otherwise("incompatible_kind")
    known = F.when(F.col("_code").isNotNull(), F.col("reference"))
    return _with(refs, out, outcome, F.col("reference"), known.isNotNull().cast("int"), known)


def resolve_names(g: Graph, refs: DataFrame, expected_kind: str | None = None, folded: bool = False) -> DataFrame:
    """`refs` has `reference`, a name; `folded` compares in lower case.

    The kind is looked at first: candidates of another kind only tell `incompatible_kind`, with the first by id.
    """
    nodes, keyed = _named(g, refs, folded)
    fits = F.lit(True) if expected_kind is None else F.col("_code") == expected_kind
    found = nodes.join(keyed.select("_name").distinct(), "_name", "left_semi").groupBy("_name").agg(
        F.count("*").alias("n_all"), F.count_if(fits).alias("n_fit"), F.min(F.when(fits, F.col("id"))).alias("fit"), F.min("id").alias("first")
    )
    out = keyed.join(found, "_name", "left")
    n_all, n_fit = F.coalesce("n_all", F.lit(0)), F.coalesce("n_fit", F.lit(0))
    outcome = F.when(n_fit == 1, "resolved").when(n_fit > 1, "ambiguous").when(n_all > 0, "incompatible_kind").otherwise("missing_target")
    return _with(refs, out, outcome, F.col("fit"), F.when(n_fit > 0, n_fit).otherwise(F.least(n_all, F.lit(1))), F.coalesce("fit", "first"))


def _named(g: Graph, refs: DataFrame, folded: bool) -> tuple[DataFrame, DataFrame]:
    fold = F.lower if folded else (lambda c: c)
    return g.nodes.select(fold(F.col("name")).alias("_name"), "id", code().alias("_code")), refs.withColumn("_name", fold(F.col("reference")))


def name_candidates(g: Graph, refs: DataFrame, expected_kind: str | None = None, folded: bool = False) -> DataFrame:
    """`reference` and `candidate`: every node that a name of `refs` can mean, a row each."""
    nodes, keyed = _named(g, refs.select("reference").distinct(), folded)
    found = nodes if expected_kind is None else nodes.filter(F.col("_code") == expected_kind)
    return keyed.join(found, "_name").select("reference", F.col("id").alias("candidate"))


def resolve_children(g: Graph, refs: DataFrame, expected_kind: str | None = None) -> DataFrame:
    """`refs` has `owner` and `reference`, a name under that owner.

    The name is resolved first and its kind looked at after, so two children of one name are ambiguous whatever
    their kinds.
    """
    wanted = refs.select("owner", "reference").distinct()
    owners = g.nodes.select(F.col("id").alias("owner"), F.lit(True).alias("_owner"))
    held = g.edges.filter("kind = 'contains'").select(F.col("source").alias("owner"), F.col("target").alias("id"))
    named = held.join(g.nodes.select("id", F.col("name").alias("reference"), code().alias("_code")), "id")
    found = named.join(wanted, ["owner", "reference"], "left_semi").groupBy("owner", "reference").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.min("_code").alias("_code"))
    out = refs.join(owners, "owner", "left").join(found, ["owner", "reference"], "left")
    fits = F.lit(True) if expected_kind is None else F.col("_code") == expected_kind
    outcome = F.when(F.col("_owner").isNull(), "missing_owner").when(F.col("n").isNull(), "missing_target").when(F.col("n") > 1, "ambiguous").when(fits, "resolved").otherwise("incompatible_kind")
    return _with(refs, out, outcome, F.col("least"), F.coalesce("n", F.lit(0)), F.col("least"))


def resolve_owned(g: Graph, refs: DataFrame) -> DataFrame:
    """`refs` has `owner` and `reference`, a node id that the owner must contain."""
    owners = g.nodes.select(F.col("id").alias("owner"), F.lit(True).alias("_owner"))
    targets = g.nodes.select(F.col("id").alias("reference"), F.lit(True).alias("_target"))
    held = g.edges.filter("kind = 'contains'").select(F.col("source").alias("owner"), F.col("target").alias("reference"), F.lit(True).alias("_held"))
    out = refs.join(owners, "owner", "left").join(targets, "reference", "left").join(held, ["owner", "reference"], "left")
    outcome = F.when(F.col("_owner").isNull(), "missing_owner").when(F.col("_target").isNull(), "missing_target").when(F.col("_held").isNull(), "invalid_owner").otherwise("resolved")
    known = F.when(F.col("_target"), F.col("reference"))
    return _with(refs, out, outcome, F.col("reference"), known.isNotNull().cast("int"), known)


def resolve_owners(g: Graph, refs: DataFrame, expected_kind: str | None = None) -> DataFrame:
    """`refs` has `reference`, a node id, whose only owner is looked for."""
    nodes = g.nodes.select(F.col("id").alias("reference"), F.lit(True).alias("_target"))
    held = g.edges.filter("kind = 'contains'").select(F.col("target").alias("reference"), F.col("source").alias("id"))
    found = held.join(g.nodes.select("id", code().alias("_code")), "id").groupBy("reference").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.min("_code").alias("_code"))
    out = refs.join(nodes, "reference", "left").join(found, "reference", "left")
    fits = F.lit(True) if expected_kind is None else F.col("_code") == expected_kind
    outcome = F.when(F.col("_target").isNull(), "missing_target").when(F.col("n").isNull(), "missing_owner").when(F.col("n") > 1, "ambiguous").when(fits, "resolved").otherwise("incompatible_kind")
    return _with(refs, out, outcome, F.col("least"), F.coalesce("n", F.lit(0)), F.col("least"))
