"""Incremental runs over growing folders, and running averages of rewards over a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def growing_folder(spark: SparkSession, path: str, schema: str, files_at_a_time: int = 16) -> DataFrame:
    """JSON lines that arrive in files; each file is read once, as the checkpoint of the query records."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).json(path)


def run_once(rows: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """All that has arrived since the last run, transformed and appended as Parquet; a restart repeats nothing."""
    return transform(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_average(rewards: DataFrame, decay: float = 0.9) -> DataFrame:
    """(component, step, average) of a stream (component, step, value): each component's exponential moving average, kept as state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        average = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("step")
        out = []
        for step, value in zip(rows["step"], rows["value"], strict=True):
            average = value if average is None else decay * average + (1 - decay) * value
            out.append((key[0], step, average))
        state.update((average,))
        yield pd.DataFrame(out, columns=["component", "step", "average"])

    return rewards.groupBy("component").applyInPandasWithState(update, "component string, step long, average double", "average double", "append", "NoTimeout")
