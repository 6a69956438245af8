"""Snapshots on disk: written whole, checked, then published by moving one pointer.

A snapshot is a folder with a table each for nodes, edges, and whatever else belongs to it, and a manifest with the
format, the state of the sources it was made from, and the rows and checksum of every table. A reader takes a snapshot
only if format and sources agree and the checksums hold. What is published last stays until the next is whole.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "tessera-snapshot-1"


class SnapshotError(ValueError):
    """A snapshot that can't be used; `code` is incompatible, source_mismatch, checksum_mismatch or missing."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def source_state(files: DataFrame) -> str:
    """One value for all `files` (`path`, `content`), whatever their order."""
    row = files.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\0", "path", F.sha2("content", 256)), 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h'] or 0}"


def _checksum(df: DataFrame) -> dict:
    columns = [F.col(c) for c in sorted(df.columns)]
    text: Column = F.to_json(F.struct(*columns))
    row = df.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("h")).first()
    return {"rows": row["n"], "checksum": str(row["h"] or 0)}


def _manifest_frame(spark: SparkSession, manifest: dict) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(F.lit(json.dumps(manifest, sort_keys=True)).alias("manifest"))


def write(tables: dict[str, DataFrame], folder: str, sources: str) -> str:
    """Writes a snapshot under `folder` and gives its id; it is read back before it counts as written."""
    spark = next(iter(tables.values())).sparkSession
    snapshot = uuid.uuid4().hex
    place = f"{folder}/snapshots/{snapshot}"
    sums = {}
    for name, df in tables.items():
        df.write.parquet(f"{place}/{name}")
        sums[name] = _checksum(spark.read.parquet(f"{place}/{name}"))
    manifest = {"format": FORMAT, "sources": sources, "tables": sums}
    _manifest_frame(spark, manifest).coalesce(1).write.text(f"{place}/manifest")
    return snapshot


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _revisions(spark: SparkSession, folder: str) -> list[int]:
    fs, p = _path(spark, f"{folder}/current")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []


def publish(spark: SparkSession, folder: str, snapshot: str) -> int:
    """Makes a written snapshot the current one, and gives its revision.

    A revision is a file that only one publisher can create; who comes second takes the next. Pointers are only added.
    """
    while True:
        revision = max(_revisions(spark, folder), default=0) + 1
        fs, p = _path(spark, f"{folder}/current/{revision}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(p):
                continue
            raise
        out.write(bytearray(snapshot.encode()))
        out.close()
        return revision


def current(spark: SparkSession, folder: str) -> str | None:
    """The id of the published snapshot; a revision whose file is not written yet doesn't count."""
    for revision in reversed(_revisions(spark, folder)):
        row = spark.read.text(f"{folder}/current/{revision}").first()
        if row is not None and len(row[0]) == 32:
            return row[0]
    return None


def read(spark: SparkSession, folder: str, snapshot: str | None = None, sources: str | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a snapshot (the published one by default), if it is whole and made from `sources`."""
    snapshot = snapshot or current(spark, folder)
    place = f"{folder}/snapshots/{snapshot}"
    if snapshot is None or not _exists(spark, f"{place}/manifest"):
        raise SnapshotError("missing", f"no snapshot in {folder}")
    manifest = json.loads(spark.read.text(f"{place}/manifest").first()[0])
    if manifest.get("format") != FORMAT:
        raise SnapshotError("incompatible", f"the format is {manifest.get('format')}")
    if sources is not None and manifest["sources"] != sources:
        raise SnapshotError("source_mismatch", "the sources have changed")
    out = {}
    for name, expected in manifest["tables"].items():
        df = spark.read.parquet(f"{place}/{name}")
        if verify and _checksum(df) != expected:
            raise SnapshotError("checksum_mismatch", f"table {name} is not as written")
        out[name] = df
    return out
