"""Shared plumbing of the corpus operators: readers and the folder all executors see."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """name, with underscores before it as long as df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame, *but: str) -> list[Column]:
    """All columns of df except but, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in but]


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir`` of the session.

    Only a local session may lack it; then one machine holds everything and a temporary folder serves.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="planlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver remove path when it ends; a driver that is killed leaves it."""
    place, files = _place(spark, path)
    files.deleteOnExit(place)


_passing = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``materialize`` writes within, at the end: what is needed of them later must be written outside or checkpointed."""
    paths: list[str] = []
    _passing.stack = [*getattr(_passing, "stack", []), paths]
    try:
        yield
    finally:
        _passing.stack.pop()
        for path in paths:
            place, files = _place(spark, path)
            files.delete(place, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later plans start from files that outlive any executor.

    The files go with the innermost ``scratch``, or with keep the one around that; without one when the driver ends, as lazy results may still read them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    around = getattr(_passing, "stack", [])[: -1 if keep else None]
    if around:
        around[-1].append(path)
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def joinable(df: DataFrame, name: str) -> DataFrame:
    """df, an aggregate, written and made ready for one side of a join on a hot key.

    A join with an aggregate right below it keeps the partitioning of that, and with it a hot key's rows in one task. From files, both sides are shuffles
    of the join's own, whose hot partitions AQE can split, or the engine broadcasts the table if its files are small.
    """
    return materialize(df, name)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for the small tables of iterative steps."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
