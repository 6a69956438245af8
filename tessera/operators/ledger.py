"""The ledger of reference requests: collected once, finished once, never contradicted.

A request has `id`, `source_node`, `category`, `reference`, `expected_kinds`, `candidates`, `state`, `outcome` and
`provenance`. It is `collected` until a resolution makes it terminal; what its outcome is decides its state and how
many candidates it must have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import reference_request_id

# Outcome, the state that goes with it, least and most candidates.
RULES = {
    "resolved": ("resolved", 1, 1),
    "missing_target": ("unresolved", 0, 0),
    "ambiguous": ("ambiguous", 2, None),
    "incompatible_kind": ("rejected", 1, None),
    "invalid_owner": ("rejected", 0, None),
    "unsupported": ("rejected", 0, 0),
    "partial_workspace": ("partial", 0, 0),
}
_EMPTY = "array<string>"


def _no_provenance() -> Column:
    return F.coalesce(F.size("provenance"), F.lit(0)) <= 0


def collect(observations: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Requests from `source_node`, `category`, `reference`, `expected_kinds`, `provenance`, with columns to `keep`.

    `problem` tells why an observation can't be one: its provenance must be there and all unresolved.
    """
    problem = F.when(_no_provenance(), "missing_provenance").when(~F.forall("provenance", lambda p: p["resolution"] == "unresolved"), "resolved_provenance")
    return observations.select(
        reference_request_id("source_node", "category", "reference", "expected_kinds").alias("id"), "source_node", "category", "reference", F.array_sort(F.array_distinct("expected_kinds")).alias("expected_kinds"),
        F.array().cast(_EMPTY).alias("candidates"), F.lit("collected").alias("state"), F.lit(None).cast("string").alias("outcome"), "provenance", problem.alias("problem"), *keep,
    )


def stage_problem(outcomes: DataFrame) -> DataFrame:
    """`outcomes` with `problem`: a resolver's `provenance` must be there and say what the outcome's state says."""
    state = F.create_map(*[F.lit(x) for outcome, (s, _, _) in RULES.items() for x in (outcome, s)])
    wrong = ~F.forall("provenance", lambda p: p["resolution"] == F.element_at(state, F.col("outcome")))
    return outcomes.withColumn("problem", F.when(_no_provenance(), "missing_provenance").when(F.exists("provenance", lambda p: p["resolution"] == "not_applicable"), "not_applicable_provenance").when(wrong, "invalid_stage_provenance"))


def finish(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Collected requests with the outcome of their `id` in `outcomes` (`id`, `outcome`, `candidates`, `provenance`).

    The provenance of the resolver joins that of the request; without such a column the request keeps its own alone.
    Requests that are terminal already stay as they are.
    """
    new = outcomes.select("id", F.col("outcome").alias("_outcome"), F.array_sort(F.array_distinct("candidates")).alias("_candidates"), *([F.col("provenance").alias("_provenance")] if "provenance" in outcomes.columns else []))
    return _finished(requests.join(new, "id", "left"), requests.columns)


def finish_in_place(requests: DataFrame) -> DataFrame:
    """Like `finish`, for requests that hold what they are finished with: `new`, a struct of `outcome`, `candidates` and `provenance`; null for none."""
    new = [F.col("new.outcome").alias("_outcome"), F.array_sort(F.array_distinct("new.candidates")).alias("_candidates"), F.col("new.provenance").alias("_provenance")]
    return _finished(requests.select("*", *new), [c for c in requests.columns if c != "new"])


def _finished(out: DataFrame, columns: list[str]) -> DataFrame:
    state = F.create_map(*[F.lit(x) for outcome, (s, _, _) in RULES.items() for x in (outcome, s)])
    open_ = (F.col("state") == "collected") & F.col("_outcome").isNotNull()
    return out.select(*(
        F.when(open_, F.element_at(state, F.col("_outcome"))).otherwise(F.col("state")).alias("state") if c == "state" else
        F.when(open_, F.col("_outcome")).otherwise(F.col("outcome")).alias("outcome") if c == "outcome" else
        F.when(open_, F.col("_candidates")).otherwise(F.col("candidates")).alias("candidates") if c == "candidates" else
        F.when(open_, F.array_distinct(F.concat("provenance", F.coalesce("_provenance", F.slice("provenance", 1, 0))))).otherwise(F.col("provenance")).alias("provenance") if c == "provenance" and "_provenance" in out.columns else F.col(c)
        for c in columns
    ))


def lifecycle_problem() -> Column:
    """Null, or what is wrong with a request's state, outcome and number of candidates."""
    n = F.size("candidates")
    out = F.when((F.col("state") == "collected") & (F.col("outcome").isNotNull() | (n > 0)), "collected_with_outcome")
    for outcome, (state, least, most) in RULES.items():
        own = F.col("outcome") == outcome
        out = out.when(own & (F.col("state") != state), "state_of_another_outcome").when(own & ((n < least) | (F.lit(False) if most is None else n > most)), "candidate_count")
    return out.when((F.col("state") != "collected") & F.col("outcome").isNull(), "terminal_without_outcome")


def insert(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests by id with their provenance put together, and the ids whose copies contradict each other."""
    content = F.struct("source_node", "category", "reference", "expected_kinds", "candidates", "state", "outcome")
    grouped = requests.groupBy("id").agg(F.collect_set(content).alias("_contents"), F.array_distinct(F.flatten(F.collect_list("provenance"))).alias("provenance"))
    conflicts = grouped.filter("size(_contents) > 1").select("id", F.size("_contents").cast("bigint").alias("n_contents"))
    kept = grouped.filter("size(_contents) = 1").select("id", F.col("_contents")[0].alias("_c"), "provenance")
    return kept.select("id", "_c.*", "provenance"), conflicts


def by(requests: DataFrame, **equal: str) -> DataFrame:
    """Requests by `id`, `category`, `source_node`, `outcome` or `state`, or by one `expected_kind`."""
    for column, value in equal.items():
        requests = requests.filter(F.array_contains("expected_kinds", value) if column == "expected_kind" else F.col(column) == value)
    return requests
