"""What a change affects where the snapshots are told in layers, with the results of `impact.affected` and `impact.summary`.

A row tells every step into its own nodes, so arrivals there are sums over columns, and no step is shuffled by ids. Steps
lead from the rest of the graph into rows and from rows into those told after them, so two passes over the rows do: one, over
those that one snapshot has, for seeds at nodes of the rest, which is then gone through; and one over all, slice by slice.
What a slice shuffles is removed when it is done.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from contextlib import ExitStack
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.graph import Layers, Rows
from tessera.operators.impact import ImpactOptions, counters, told, ways
from tessera.schema import code
from tessera.storage import FEW_KEYS, few, new_folder, shuffles_removed, stored, stored_for_now

_BOTH = ("p", "c")
_NULL = "node_id string, code string, depth int, rank int, n_reasons bigint, _p boolean, _c boolean"


def _steps_into(r: Rows, options: ImpactOptions) -> dict[str, Counter]:
    """For each node of a row, the names that steps lead to it from and how many do."""
    out = {x: Counter() for x in r.nodes}
    for source, kind, target in r.edges:
        for at, next_, *_ in ways(kind, source, target, options):
            if next_ not in out:
                raise ValueError(f"a step leads from {at} out of its rows to {next_}")
            out[next_][at] += 1
    return out


def _id_of(r: Rows, name: str) -> Column:
    if name in r.nodes:
        return r.nodes[name][0]
    prefix, key = r.ends.get(name) or ("", r.inner[name])
    return F.concat(F.lit(prefix), F.col(key).cast("string")) if key else F.lit(prefix)


def _edge_seeds(r: Rows, name: str) -> Column:
    """How many seeds the edges of a row that one snapshot has leave at the end `name`; an edge with both ends null leaves one, at the node."""
    ends = [s if name == t else t for s, _, t in r.edges if name in (s, t)]
    return reduce(Column.__add__, (F.when(_id_of(r, name).isNull() & _id_of(r, other).isNull(), 0).otherwise(1) for other in ends)).cast("bigint")


def _counted(r: Rows, name: str, i: int, n: int, by: Column) -> DataFrame:
    """`by`, and the seeds at the end `name` in both snapshots."""
    seeds = r.alone(i, n).select(by, *(F.when(F.col(f"_{s}"), _edge_seeds(r, name)).otherwise(0).alias(s) for s in _BOTH))
    return seeds.groupBy(*(c for c in seeds.columns if c not in _BOTH)).agg(*(F.sum(s).alias(s) for s in _BOTH))


def _through_rest(layers: Layers, options: ImpactOptions, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """What is found in the rest, and for each depth the nodes gone on from, `node_id`, with weights `p` and `c`."""
    counted = [keep(_counted(r, name, i, layers.n, _id_of(r, name).alias("node_id"))) for i in range(layers.n) for r in layers.rows for name in r.ends]
    seeds = keep(reduce(DataFrame.unionByName, counted).groupBy("node_id").agg(*(F.sum(s).alias(s) for s in _BOTH)))
    edges = layers.rest.edges
    dealt = [edges.filter(F.col("kind") == kind).select(F.col(at).alias("node_id"), F.col(next_).alias("next")) for kind, at, next_ in _ways_of_rest(options)]
    found = [seeds.select("node_id", F.lit(0).alias("depth"), F.lit(1).alias("rank"), (F.col("p") + F.col("c")).alias("n_reasons"))]
    queues = [seeds]
    steps = keep(reduce(DataFrame.unionByName, dealt)) if dealt else None
    left = few(keep(steps.select("node_id").distinct())) if dealt else None
    seen = seeds
    for depth in range(1, options.max_depth + 1 if dealt else 1):
        frontier = few(keep(queues[-1].join(left, "node_id", "left_semi")))
        taken = keep(steps.join(frontier, "node_id").groupBy(F.col("next").alias("node_id")).agg(*(F.sum(s).alias(s) for s in _BOTH)))
        found.append(taken.select("node_id", F.lit(depth).alias("depth"), F.lit(0).alias("rank"), (F.col("p") + F.col("c")).alias("n_reasons")))
        if depth == options.max_depth:
            break
        before = seen.select("node_id", *(F.col(s).alias(f"_{s}") for s in _BOTH))
        first = {s: F.when((F.col(s) > 0) & (F.coalesce(f"_{s}", F.lit(0)) == 0), 1).otherwise(0).cast("bigint") for s in _BOTH}
        queue = keep(taken.join(before, "node_id", "left").select("node_id", *(c.alias(s) for s, c in first.items())).filter("p > 0 or c > 0"))
        if queue.isEmpty():
            break
        queues.append(queue)
        seen = keep(seen.unionByName(queue).groupBy("node_id").agg(*(F.sum(s).alias(s) for s in _BOTH)))
    merged = reduce(DataFrame.unionByName, found).groupBy("node_id").agg(F.min("depth").alias("depth"), F.max("rank").alias("rank"), F.sum("n_reasons").alias("n_reasons"))
    nodes = layers.rest.nodes.select(F.col("id").alias("node_id"), code().alias("code"), F.lit(True).alias("_there"))
    there = F.coalesce("_there", F.lit(False))
    return merged.join(nodes, "node_id", "left").select("node_id", "code", "depth", "rank", "n_reasons", there.alias("_p"), there.alias("_c")), queues


def _ways_of_rest(options: ImpactOptions) -> list[tuple[str, str, str]]:
    return [(kind, at, next_) for kind in dict.fromkeys(("contains", *options.kinds)) for at, next_, *_ in ways(kind, "source", "target", options)]


def _weights(layers: Layers, queues: list[DataFrame], keep: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame | dict[str, int]]:
    """By the name of an end: its weights for each depth and snapshot by `_key`, or, for a node that is always the same, alone."""
    out = {}
    for name, (prefix, key) in ((name, end) for r in layers.rows for name, end in r.ends.items()):
        if not key:
            rows = [q.filter(F.col("node_id") == prefix).first() for q in queues]
            out[name] = {f"{name}_{d}{s}": row[s] for d, row in enumerate(rows) if row for s in _BOTH}
            continue
        number = F.substring(F.col("node_id"), len(prefix) + 1, 20).try_cast("bigint")
        of = [q.select("node_id", number.alias("_key"), F.lit(d).alias("_d"), *_BOTH).filter(F.col("node_id") == F.concat(F.lit(prefix), F.col("_key").cast("string"))) for d, q in enumerate(queues)]
        sums = [F.sum(F.when(F.col("_d") == d, F.col(s)).otherwise(0)).alias(f"{name}_{d}{s}") for d in range(len(queues)) for s in _BOTH]
        out[name] = keep(reduce(DataFrame.unionByName, of).groupBy("_key").agg(*sums))
    return out


def _evaluated(layers: Layers, r: Rows, i: int, options: ImpactOptions, weights: dict, before: dict[str, DataFrame]) -> DataFrame:
    """A slice of rows with `<node>_depth`, `<node>_rank` and `<node>_n`, and the weights of nodes that later rows lead on from."""
    df, key = r.rows(i, layers.n), r.keys[0]
    asked = [(later, x) for later in layers.rows for x in later.inner if x in r.nodes]
    for later, x in asked:  # a node that isn't there can have seeds as well
        counts = _counted(later, x, i, layers.n, F.col(later.inner[x]).alias("_key")).withColumnsRenamed({s: f"_at_{x}{s}" for s in _BOTH})
        df = df.join(counts, df[key] == counts["_key"], "full_outer").withColumn(key, F.coalesce(key, "_key")).drop("_key")
    for name in (*r.ends, *r.inner):
        found = weights[name] if name in r.ends else before[name]
        if isinstance(found, dict):
            df = df.withColumns({c: F.lit(v).cast("bigint") for c, v in found.items()})
        else:
            column = r.ends[name][1] if name in r.ends else r.inner[name]
            df = df.join(few(found, FEW_KEYS) if name in r.ends else found, F.col(column).cast("bigint") == F.col("_key"), "left").drop("_key")
    here = {s: F.coalesce(f"_{s}", F.lit(False)) for s in _BOTH}
    df = df.withColumns({f"_{s}": c for s, c in here.items()})
    known, zero = set(df.columns), F.lit(0).cast("bigint")
    weight = lambda name, d, s: F.coalesce(f"{name}_{d}{s}", zero) if f"{name}_{d}{s}" in known else zero
    at_edges = Counter(x for s, _, t in r.edges for x in {s, t})
    depths = range(1, options.max_depth + 1)

    def goes_on(x: str, condition: Column, n: Column) -> Column:
        return F.when(condition & r.nodes[x][0].isNotNull(), n).otherwise(zero)

    seeds = {}
    for x, (_, _, changed) in r.nodes.items():
        for s, other in (_BOTH, _BOTH[::-1]):
            own = F.when(here[s] & ~here[other], 1 + at_edges[x]).when(here[s] & changed, 1).otherwise(0).cast("bigint")
            seeds[f"{x}_s{s}"] = own + F.coalesce(f"_at_{x}{s}", zero) if any(x == y for _, y in asked) else own
    df = df.withColumns(seeds)
    df = df.withColumns({f"{x}_0{s}": goes_on(x, F.lit(True), F.col(f"{x}_s{s}")) for x in r.nodes for s in _BOTH})
    known |= {f"{x}_0{s}" for x in r.nodes for s in _BOTH}
    for d in depths:
        arrivals = {f"{x}_a{d}{s}": F.when(here[s], sum((m * weight(at, d - 1, s) for at, m in steps.items()), zero)).otherwise(zero) for x, steps in _steps_into(r, options).items() for s in _BOTH}
        df = df.withColumns(arrivals)
        first = lambda x, s: reduce(Column.__and__, (F.col(f"{x}_{e}{s}") == 0 for e in range(d)), F.col(f"{x}_a{d}{s}") > 0)  # noqa: B023, E731
        df = df.withColumns({f"{x}_{d}{s}": goes_on(x, first(x, s), F.lit(1).cast("bigint")) for x in r.nodes for s in _BOTH})
        known |= {f"{x}_{d}{s}" for x in r.nodes for s in _BOTH}
    out = []
    for x in r.nodes:
        n = [F.col(f"{x}_{'s' if d == 0 else f'a{d}'}p") + F.col(f"{x}_{'s' if d == 0 else f'a{d}'}c") for d in (0, *depths)]
        depth = reduce(lambda c, d: c.when(n[d] > 0, d), depths, F.when(n[0] > 0, 0))  # noqa: B023
        rank = F.when(F.col("_p") & ~F.col("_c"), 2).when(n[0] > 0, 1).otherwise(0)
        out += [depth.alias(f"{x}_depth"), rank.alias(f"{x}_rank"), reduce(Column.__add__, n).alias(f"{x}_n")]
        if any(x == y for _, y in asked):
            out += [F.col(f"{x}_{d}{s}") for d in range(options.max_depth) for s in _BOTH]
    return df.select(*r.keys, "_p", "_c", *out)


def _found(r: Rows, df: DataFrame) -> DataFrame:
    of = lambda x, id_, name: df.filter(f"{x}_n > 0").select(id_.alias("node_id"), F.when(F.col("_p") | F.col("_c"), name).alias("code"), *(F.col(f"{x}_{c}").alias(a) for c, a in (("depth", "depth"), ("rank", "rank"), ("n", "n_reasons"))), "_p", "_c")
    return reduce(DataFrame.unionByName, (of(x, id_, name) for x, (id_, name, _) in r.nodes.items()))


def _pass(layers: Layers, options: ImpactOptions, of_rest: Callable[[DataFrame], None], of_rows: Callable[[Rows, DataFrame], None]) -> None:
    """Gives what is found in the rest to `of_rest`, and all rows, slice by slice, to `of_rows`."""
    if options.provenance != "exclude":
        raise ValueError("layers don't tell the provenance of nodes and edges")
    with ExitStack() as all_slices, shuffles_removed(layers.rest.nodes.sparkSession):
        keep = lambda df: all_slices.enter_context(stored_for_now(df))
        with ExitStack() as while_rest:
            found, queues = _through_rest(layers, options, lambda df: while_rest.enter_context(stored_for_now(df)))
            of_rest(found)
            weights = _weights(layers, queues, keep)
        for i in range(layers.n):
            with ExitStack() as one_slice:
                before = {}
                for r in layers.rows:
                    df = _evaluated(layers, r, i, options, weights, before)
                    if asked := {x for later in layers.rows for x in later.inner if x in r.nodes}:
                        df = one_slice.enter_context(stored_for_now(df))
                        before |= {x: df.select(F.col(r.keys[0]).alias("_key"), *(f"{x}_{d}{s}" for d in range(options.max_depth) for s in _BOTH)) for x in asked}
                    of_rows(r, df)


def affected(layers: Layers, options: ImpactOptions | None = None) -> DataFrame:
    """As `impact.affected`. Of rows, their keys and what was counted are stored, and nodes are made of these."""
    options = options or ImpactOptions()
    spark = layers.rest.nodes.sparkSession
    rest, folders = [], [new_folder(spark) for _ in layers.rows]

    def write(r: Rows, df: DataFrame) -> None:
        kept = [c for c in df.columns if c in (*r.keys, "_p", "_c") or c.endswith(("_depth", "_rank", "_n"))]
        df.select(*kept).write.mode("append").option("compression", "zstd").parquet(folders[layers.rows.index(r)])

    _pass(layers, options, lambda df: rest.append(stored(df)), write)
    found = [rest[0], *(_found(r, spark.read.parquet(folder)) for r, folder in zip(layers.rows, folders, strict=True))]
    found = reduce(DataFrame.unionByName, found)
    # Ids tell rows apart, but for those that null keys leave null.
    null = found.filter("node_id is null").groupBy("node_id").agg(F.lit(None).cast("string").alias("code"), F.min("depth").alias("depth"), F.max("rank").alias("rank"), F.sum("n_reasons").alias("n_reasons"), F.lit(False).alias("_p"), F.lit(False).alias("_c"))
    return told(found.filter("node_id is not null").unionByName(null))


def summary(layers: Layers, options: ImpactOptions | None = None) -> DataFrame:
    """As `impact.summary` of what is affected, which is counted slice by slice; nothing stays stored."""
    spark = layers.rest.nodes.sparkSession
    rows, nulls = [], []

    def count(df: DataFrame) -> None:
        is_null = F.col("node_id").isNull().alias("_null")
        for row in told(df, is_null, "rank").groupBy("_null").agg(*counters(), F.min("depth").alias("_depth"), F.max("rank").alias("_rank")).collect():
            (nulls if row["_null"] else rows).append(row.asDict())

    _pass(layers, options or ImpactOptions(), count, lambda r, df: count(_found(r, df)))
    if nulls:
        merged = [(None, None, min(x["_depth"] for x in nulls), max(x["_rank"] for x in nulls), sum(x["reasons"] for x in nulls), False, False)]
        null = spark.createDataFrame(merged, _NULL)
        rows.append(told(null).agg(*counters()).first().asDict())
    rows = rows or [told(spark.createDataFrame([], _NULL)).agg(*counters()).first().asDict()]
    total = {m: (max if m == "max_depth" else sum)(x[m] for x in rows) for m in rows[0] if not m.startswith("_")}
    return spark.createDataFrame(list(total.items()), "metric string, value bigint")
