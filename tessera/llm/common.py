"""Helpers the training-data operators share: table access, shared storage, column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship

#: The code points that separate words: space and the five controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or one of our own where that is unset and all
    runs in one process.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        current = sc._jsc.sc().getCheckpointDir()
    return str(current.get()).rstrip("/")


def settled(df: DataFrame, files: int | None = None) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that a lost executor loses nothing.

    `files` is the number of files at most, for tables whose size is known to be small for it.
    """
    shared_dir(df.sparkSession)
    return (df if files is None else df.coalesce(files)).checkpoint(eager=True)


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def fresh(name: str, taken: Iterable[str]) -> str:
    """`name`, lengthened until no column of `taken` has it in any letter case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column called exactly `name`, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: Column) -> Column:
    """The maximal runs of code points outside `BLANKS`; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))
