"""Watching a project: when files come, change or go, the graph is built anew and published whole.

A stream of ticks compares the state of the whole folder with that of the published snapshot, for a stream of files
takes each path once and never tells of an edit or a deletion. A difference rebuilds the snapshot from the full folder,
so repeated ticks do no harm, and several changes within a tick make one build. A build that fails keeps the published
snapshot, is told, and is tried again when the folder has changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.graph import Graph
from tessera.operators import validate
from tessera.sinks import snapshots
from tessera.sources import projects, xml

def rebuild(spark: SparkSession, root: str, folder: str) -> str | None:
    """Builds and publishes the graph of `root`; gives the snapshot's id, or None where the sources are as before.

    A graph with errors is not published: `ValueError`.
    """
    state = snapshots.source_state(xml.files(spark, root))
    now = snapshots.current(spark, folder)
    if now is not None:
        try:
            snapshots.read(spark, folder, now, state, verify=False)
            return None
        except snapshots.SnapshotError:
            pass
    project = projects.read_project(spark, root)
    if not validate.is_valid(validate.validate(project.graph)):
        raise ValueError("the graph has errors")
    new = snapshots.write({"nodes": project.graph.nodes, "edges": project.graph.edges, "diagnostics": project.diagnostics}, folder, state)
    snapshots.publish(spark, folder, new)
    return new


def published(spark: SparkSession, folder: str) -> Graph:
    """The graph of the published snapshot."""
    tables = snapshots.read(spark, folder, verify=False)
    return Graph(tables["nodes"], tables["edges"])


def watch(spark: SparkSession, root: str, folder: str, checkpoint: str, on_event: Callable[[int, str], None] | None = None, once: bool = False, every: str = "250 milliseconds") -> StreamingQuery:
    """A stream that looks at `root` at every tick and rebuilds after a change; `on_event` hears what came of it."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    failed: list[str] = []

    def looked(batch: DataFrame, number: int) -> None:
        state = snapshots.source_state(xml.files(spark, root))
        if failed == [state]:
            return
        failed.clear()
        try:
            outcome = rebuild(spark, root, folder)
        except ValueError as e:  # the published snapshot stays
            outcome = f"failed: {e}"
            failed.append(state)
        if outcome and on_event:
            on_event(number, outcome)

    writer = ticks.writeStream.foreachBatch(looked).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=every)).start()


def event_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Streaming counts of `events` (`ts`, `event_type`) by tumbling window, with a bound on lateness."""
    counted = events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n")
