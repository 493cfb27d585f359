"""Folders that the driver and all executors see, and the few file operations that a commit needs, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, another raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="planlake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Files:
    """The file system of a path, on the driver; only small control files pass through it."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def write_text(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def publish(self, text: str, path: str) -> bool:
        """Writes text beside path and renames it there, so that path appears whole or not at all; False if it was there already."""
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        self.write_text(beside, text)
        if not self.exists(path) and self._fs.rename(self._path(beside), self._path(path)):
            return True
        self.remove(beside)
        return False

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def remove_at_exit(self, path: str) -> None:
        self._fs.deleteOnExit(self._path(path))


def passing_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    Files(spark, path).remove_at_exit(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what reads it starts from files that outlive any executor, and sees the same rows each time."""
    path = passing_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
