"""Pluggable external functions over rows: classifiers, samplers, judges and planners, with dead letters and resumption."""

from __future__ import annotations

import json
import subprocess
import time
import traceback
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.functions.nested import upper_median
from planlake.sources.folders import shared_folder
from planlake.sources.tables import not_done


def apply_rows(rows: DataFrame, fn: Callable[[dict], dict], out_schema: str, key: str = "key", retries: int = 0, wait: float = 1.0, workers: int | None = None, stagger: float = 0.0) -> DataFrame:
    """(key, out_schema..., error, trace): fn of each row as a dict; what it raises becomes a dead letter, not a failed task.

    workers: rows are dealt to so many tasks, which bounds how often fn runs at once; stagger: each starts so many seconds after the one before it.
    """
    names = [c.strip().split(" ")[0] for c in out_schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if stagger:
            time.sleep(stagger * TaskContext.get().partitionId())
        for batch in batches:
            done = []
            for row in batch.to_dict("records"):
                for attempt in range(retries + 1):
                    try:
                        done.append({key: row[key], **fn(row), "error": None, "trace": None})
                        break
                    except Exception as e:
                        if attempt == retries:
                            done.append({key: row[key], "error": str(e)[:500], "trace": traceback.format_exc()[:2000]})
                        else:
                            time.sleep(wait * 2**attempt)
            yield pd.DataFrame(done, columns=[key, *names, "error", "trace"], dtype=object)

    dealt = rows.repartition(workers) if workers else rows
    return dealt.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {out_schema}, error string, trace string")


def apply_batches(rows: DataFrame, fn: Callable[[list[dict]], list[dict]], out_schema: str, key: str = "key", size: int = 16, retries: int = 0, wait: float = 1.0) -> DataFrame:
    """(key, out_schema..., error, trace): fn of size rows at a time, whose answers are joined back by key.

    An answer may be missing, which is an error of its row, and come in any order; of several for a key the last counts. What fn raises is tried
    again, longer apart each time, and is then an error of all rows of its batch.
    """
    names = [c.strip().split(" ")[0] for c in out_schema.split(",")]

    def attempt(some: list[dict]) -> tuple[dict, str | None, str | None]:
        for k in range(retries + 1):
            try:
                return {a[key]: a for a in fn(some) if a.get(key) is not None}, None, None
            except Exception as e:
                if k == retries:
                    return {}, str(e)[:500], traceback.format_exc()[:2000]
                time.sleep(wait * 2**k)
        raise AssertionError("unreachable")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every, done = batch.to_dict("records"), []
            for at in range(0, len(every), size):
                some = every[at : at + size]
                found, error, trace = attempt(some)
                for row in some:
                    answer = found.get(row[key])
                    done.append({**{n: (answer or {}).get(n) for n in names}, key: row[key], "error": error or (None if answer else "no answer"), "trace": trace})
            yield pd.DataFrame(done, columns=[key, *names, "error", "trace"], dtype=object)

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {out_schema}, error string, trace string")


def command(argv: list[str], timeout: float = 900.0) -> Callable[[dict], dict]:
    """A row function that hands the row as JSON to a program and reads a JSON object from it; a program that fails or takes too long raises."""

    def fn(row: dict) -> dict:
        out = subprocess.run(argv, input=json.dumps(row, default=str), capture_output=True, text=True, timeout=timeout, check=False)
        if out.returncode:
            raise RuntimeError(f"exit {out.returncode}: {out.stderr[-400:]}")
        return json.loads(out.stdout)

    return fn


class Chat(Protocol):
    """What a model is to this package."""

    def chat(self, messages: list[dict], temperature: float = 0.0, max_tokens: int = 1024) -> str: ...


class TableChat:
    """Answers from a table of what the last message says; a message that it lacks raises."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def chat(self, messages: list[dict], temperature: float = 0.0, max_tokens: int = 1024) -> str:
        return self.answers[messages[-1]["content"]][:max_tokens]


def judged(rows: DataFrame, judges: list[Callable[[list[tuple[str, str, bool]]], list[float | None]]], plan: str, gold: str, key: str = "key", seed: int = 42) -> DataFrame:
    """rows with r_soft: the upper median of the judges' scores of plan beside gold, 0 without any.

    A judge is given (first, second, swapped) for many rows at once. Which of the two stands first is decided by a digest of seed, judge and key, and a score
    outside 0 to 1 is none.
    """

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = []
            for j, judge in enumerate(judges):
                swapped = [zlib.crc32(f"{seed}:{j}:{k}".encode()) % 2 == 1 for k in batch[key]]
                given = judge([(g, p, s) if s else (p, g, s) for p, g, s in zip(batch[plan], batch[gold], swapped, strict=True)])
                scores.append([x if x is not None and 0 <= x <= 1 else None for x in given])
            yield pd.DataFrame({key: batch[key], "scores": [[s for s in some if s is not None] for some in zip(*scores, strict=True)]})

    kind = rows.schema[key].dataType.simpleString()
    scored = rows.select(key, plan, gold).mapInPandas(asked, f"{key} {kind}, scores array<double>")
    return rows.join(scored.select(key, F.coalesce(upper_median(F.col("scores")), F.lit(0.0)).alias("r_soft")), key, "left")


def resumed(rows: DataFrame, done: DataFrame, fn: Callable[[dict], dict], out_schema: str, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(results, failures) of the rows that are not done yet."""
    out = apply_rows(not_done(rows, done, key), fn, out_schema, key)
    return out.where("error IS NULL").drop("error", "trace"), out.where("error IS NOT NULL").select(key, "error", "trace")


def once_per_key(rows: DataFrame, key: str, fn: Callable[[dict], dict], out_schema: str) -> DataFrame:
    """fn of each distinct key, joined back: an expensive function never sees a key twice."""
    return rows.join(apply_rows(rows.select(key).distinct(), fn, out_schema, key), key, "left")


def joined_responses(requests: DataFrame, responses: DataFrame, element: str) -> DataFrame:
    """requests with the parsed line of responses (text of JSON lines) that has their id; of repeated ids the last line counts."""
    lines = responses.select(F.monotonically_increasing_id().alias("r"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    parsed = lines.select("r", "line", F.from_json("t", f"id string, {element}").alias("p")).where("p.id IS NOT NULL")
    last = parsed.groupBy(F.col("p.id").alias("id")).agg(F.max_by("p", F.struct("r", "line")).alias("p"))
    return requests.join(last.select("id", F.col("p").dropFields("id").alias("response")), "id", "left")


def weak_steps(plans: DataFrame, scores: DataFrame, below: float = 0.5) -> DataFrame:
    """(plan_key, places): "subtask.step" of the steps scored below; a missing score is not weak."""
    rows = plans.select("plan_key", F.posexplode("subtasks").alias("subtask_idx", "s")).select("plan_key", "subtask_idx", F.posexplode("s.steps").alias("step_idx", "t"))
    hit = rows.join(scores, ["plan_key", "subtask_idx", "step_idx"], "left").where(F.col("score") < below)
    place = F.concat_ws(".", F.col("subtask_idx").cast("string"), F.col("step_idx").cast("string"))
    return hit.groupBy("plan_key").agg(F.array_sort(F.collect_list(place)).alias("places"))


def refined(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame], bool], rounds: int) -> DataFrame:
    """A bounded loop of improvement over all rows; each round ends in a reliable checkpoint. calls.refine leaves finished rows alone and goes on where it stopped."""
    shared_folder(start.sparkSession)
    now = start
    for k in range(rounds):
        if done(now):
            break
        now = step(now, k).checkpoint()
    return now
