"""Results that loops read again: kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast at most, where their number is looked at first.
FEW = 1_000_000
#: Keys, a long each, that are broadcast at most.
FEW_KEYS = 3_000_000
#: Rows that are shuffled at once, where a table is stored in slices.
SLICE = 6_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or a folder of our own where that is unset and all runs in one process."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not configured and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoints-"))
    return (configured or str(sc._jsc.sc().getCheckpointDir().get())).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once and written where every executor can read it; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Like `settled`, for large tables: in columns, which take less room."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles is removed when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


@contextmanager
def stored_for_now(df: DataFrame) -> Iterator[DataFrame]:
    """Like `stored`, until the block ends; what it shuffles is removed when it is written."""
    spark = df.sparkSession
    folder = new_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        with shuffles_removed(spark):
            df.write.parquet(folder)
        yield spark.read.parquet(folder)
    finally:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(rows: int) -> int:
    """Into how many slices a table of `rows` is dealt."""
    return max(1, -(-rows // SLICE))


def stored_in_slices(spark: SparkSession, make: Callable[[int, int], DataFrame], rows: int) -> DataFrame:
    """`make(i, n)` for every slice `i` of `n`, stored one after the other as one table; `n` follows from the number of `rows`.

    What a slice shuffles is removed when it is written, so that disk holds the shuffle of one slice at a time.
    """
    folder, n = new_folder(spark), slices(rows)
    with shuffles_removed(spark):
        for i in range(n):
            make(i, n).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """`df`, which is settled or stored, as one side of a join: broadcast if it has at most `most` rows, so that the other stays where it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
