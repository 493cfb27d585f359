"""A table that grows batch by batch and survives a run that is killed anywhere: no row is lost, none comes twice.

A batch's files go to a folder of their own first; the batch counts once a small manifest with its number has been renamed into the log, which happens whole or not at
all. Readers take only folders that a manifest names. A batch that is run again, because the run before it was killed between writing and
committing, writes another folder, and that of a batch which is in the log already is skipped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from planlake.operators.scan import last_averages, moving_averages
from planlake.sources.folders import Files

_MANIFEST = "batch long, folder string, info string"


class CommitLog:
    """The table at path: path/data holds the folders of batches, path/log their manifests."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._files = Files(spark, path)

    def _manifest(self, batch: int) -> str:
        return f"{self.path}/log/{batch:020d}.json"

    def committed(self, batch: int) -> bool:
        return self._files.exists(self._manifest(batch))

    def manifests(self) -> DataFrame:
        """(batch, folder, info) of the batches in the log."""
        names = [n for n in self._files.names(f"{self.path}/log") if n.endswith(".json")]
        if not names:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).json([f"{self.path}/log/{n}" for n in names])

    def stage(self, rows: DataFrame) -> str:
        """Writes the rows of a batch to a folder that no reader sees yet."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, batch: int, folder: str, info: str = "") -> bool:
        """Enters a staged folder as the batch's; False if another run has entered one before, whose rows then stand."""
        return self._files.publish(json.dumps({"batch": batch, "folder": folder, "info": info}) + "\n", self._manifest(batch))

    def append(self, rows: DataFrame, batch: int, info: str = "") -> bool:
        """Whether the rows went in: those of a batch that is in the log do not."""
        return not self.committed(batch) and self.commit(batch, self.stage(rows), info)

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        folders = [r.folder for r in self.manifests().select("folder").collect()]
        rows = self.spark.read.schema(self.schema)
        return rows.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def read_batch(self, batch: int) -> DataFrame:
        """The rows of one committed batch, none for a number that the log lacks."""
        found = self.manifests().where(F.col("batch") == batch).first()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{found.folder}") if found else self.spark.createDataFrame([], self.schema)

    def latest(self, before: int | None = None) -> int:
        """The greatest batch in the log, or of those below before; -1 without any."""
        numbers = [int(n.split(".")[0]) for n in self._files.names(f"{self.path}/log") if n.endswith(".json")]
        return max((n for n in numbers if before is None or n < before), default=-1)

    def vacuum(self) -> int:
        """Removes folders that no manifest names, left by runs that were killed; returns how many. Not to be run beside a writer."""
        known = {r.folder.split("/")[-1] for r in self.manifests().select("folder").collect()}
        left = [n for n in self._files.names(f"{self.path}/data") if n not in known]
        for name in left:
            self._files.remove(f"{self.path}/data/{name}")
        return len(left)


def stream_to(rows: DataFrame, log: CommitLog, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> StreamingQuery:
    """All that has arrived since the last run, batch by batch, transformed and committed; a restart repeats the batch that was not committed, with the same number."""

    def one(batch: DataFrame, number: int) -> None:
        if not log.committed(number):
            log.append(transform(batch), number)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def slices(key: Column, n: int) -> Column:
    """The number of the slice, from 0 to n - 1, that a key falls into, the same in every run."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def flush_every(rows: DataFrame, log: CommitLog, key: str, transform: Callable[[DataFrame], DataFrame], every: int = 1_000_000) -> int:
    """Runs transform over rows in slices of about every rows by key, each committed before the next; returns how many slices it ran.

    The rows are dealt to folders of slices first, once, under the log's path, so that each slice reads its own folder only and a run that follows one which was
    killed sees the same rows; it skips the slices that are in the log. Rows without key are in one slice.
    """
    files, frozen, name = Files(log.spark, log.path), f"{log.path}/input", "__slice"
    if not files.exists(f"{frozen}/_SUCCESS"):
        n = max(1, -(-rows.count() // every))
        rows.withColumn(name, slices(F.col(key), n)).write.mode("overwrite").partitionBy(name).parquet(frozen)
    dealt = log.spark.read.schema(StructType([*rows.schema.fields, StructField(name, IntegerType())])).parquet(frozen)
    ran = 0
    for k in sorted(int(x.split("=")[1]) for x in files.names(frozen) if x.startswith(f"{name}=")):
        if not log.committed(k):
            log.append(transform(dealt.where(F.col(name) == k).drop(name)), k)
            ran += 1
    return ran


def averages_to(rewards: DataFrame, path: str, checkpoint: str, decay: float = 0.9) -> tuple[CommitLog, StreamingQuery]:
    """The log of (component, step, average) of a stream (component, step, value), and the run that fills it with all that has arrived.

    A batch is averaged by the prefix scan, so a component that holds most of it is spread over tasks; where each component stands after a batch is a log of its
    own, one small table a batch, from which the next goes on. A run that is killed between the two logs' commits makes up for the second.
    """
    spark = rewards.sparkSession
    averages = CommitLog(spark, f"{path}/averages", "component string, step long, average double")
    states = CommitLog(spark, f"{path}/states", "component string, average double")

    def one(batch: DataFrame, number: int) -> None:
        before = states.read_batch(states.latest(number))
        if not averages.committed(number):
            averages.append(moving_averages(batch, "value", ["step"], "component", decay=decay, start=before).select("component", "step", "average"), number)
        if not states.committed(number):
            ended = last_averages(averages.read_batch(number), ["step"], "component")
            idle = before.join(ended, "component", "left_anti")
            states.append(ended.unionByName(idle), number)

    return averages, rewards.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
