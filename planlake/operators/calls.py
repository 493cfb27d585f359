"""Calls of models and programs from rows: a client with retries, a stored cache of answers, samplers, programs that stay up, and loops that go on where they stopped."""

from __future__ import annotations

import json
import os
import queue
import signal
import subprocess
import threading
import time
import traceback
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlake.streaming.commitlog import CommitLog


@dataclass
class HttpChat:
    """A model behind an HTTP address that takes {model, messages, temperature, max_tokens} as JSON and answers with choices of messages.

    A call that fails is tried again, later each time; the last failure is raised. key_variable names the environment variable that holds the key,
    which is read where the call is made and travels with no task.
    """

    url: str
    model: str
    key_variable: str | None = None
    timeout: float = 120.0
    wait: float = 1.0
    more: dict = field(default_factory=dict)

    def _once(self, payload: dict) -> str:
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        request = urllib.request.Request(self.url, json.dumps(payload).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]

    def chat(self, messages: list[dict], temperature: float = 0.3, max_tokens: int = 16_000, retries: int = 2) -> str:
        payload = {"model": self.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens, **self.more}
        for attempt in range(retries + 1):
            try:
                return self._once(payload)
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(self.wait * 2**attempt)
        raise AssertionError("unreachable")


class Pace:
    """Lets so many calls begin in a second, evenly; for the threads of one task."""

    def __init__(self, per_second: float | None):
        self._gap, self._next, self._lock = (1 / per_second if per_second else 0.0), 0.0, threading.Lock()

    def wait(self) -> None:
        with self._lock:
            now = time.monotonic()
            at = max(now, self._next)
            self._next = at + self._gap
        time.sleep(at - now)


def request_digest(*parts: Column) -> Column:
    """A digest of what a request says: messages and parameters, as JSON text."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


ANSWERS = "digest string, answer string"


def cached_answers(requests: DataFrame, ask: Callable[[dict], str], cache: CommitLog, *parts: str, in_flight: int = 4, workers: int | None = None, per_second: float | None = None) -> DataFrame:
    """requests with answer and error: what ask says to each, from the cache where it was asked before.

    parts are the columns that make a request: they are digested, requests alike are asked once, and those whose digest is in the cache not at all. What ask says
    anew becomes the cache's next batch; what it raises is an error of the rows, not stored, and so asked again by the next run. A task has in_flight
    calls open at once and begins per_second of them a second; workers bounds the tasks. cache is a log of ANSWERS, shared by any number of runs
    one after the other.
    """
    keyed = requests.withColumn("__digest", request_digest(*[F.col(c) for c in parts]))
    known = cache.read()
    fresh = keyed.select("__digest", *parts).dropDuplicates(["__digest"]).join(known.select(F.col("digest").alias("__digest")), "__digest", "left_anti")
    dealt = fresh.repartition(workers) if workers else fresh

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(per_second)

        def one(row: dict) -> tuple:
            pace.wait()
            try:
                return row["__digest"], ask({k: v for k, v in row.items() if k != "__digest"}), None
            except Exception as e:
                return row["__digest"], None, f"{type(e).__name__}: {e}"[:500]

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(one, batch.to_dict("records"))), columns=["digest", "answer", "error"], dtype=object)

    number = cache.latest() + 1
    failures = CommitLog(cache.spark, f"{cache.path}/failures", f"{ANSWERS}, error string")
    asked = dealt.mapInPandas(run, f"{ANSWERS}, error string")
    # one pass over the calls: all go to a staged table, from which answers and failures are taken
    staged = failures.stage(asked)
    said = cache.spark.read.schema(f"{ANSWERS}, error string").parquet(f"{failures.path}/{staged}")
    cache.append(said.where("error IS NULL").select("digest", "answer"), number)
    told = cache.read().select(F.col("digest").alias("__digest"), "answer")
    errors = said.where("error IS NOT NULL").select(F.col("digest").alias("__digest"), "error")
    return keyed.join(told, "__digest", "left").join(errors, "__digest", "left").drop("__digest")


def samples(prompts: DataFrame, ask: Callable[[list[dict]], list[str]], key: list[str], pairs: int = 1, each: int = 2, size: int = 16) -> DataFrame:
    """(key, pair_idx, sample_id, raw_text, error): each samples for each of pairs of each prompt, asked size at a time.

    ask gets rows as dicts, with pair_idx and sample_id, and answers in their order; an answer short, or what it raises, is an error of the rows.
    """
    wanted = prompts.withColumn("pair_idx", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1)))).withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, out = batch.to_dict("records"), []
            for at in range(0, len(rows), size):
                some = rows[at : at + size]
                try:
                    said, error = list(ask(some)), "no answer"
                except Exception as e:
                    said, error = [], f"{type(e).__name__}: {e}"[:500]
                said += [None] * (len(some) - len(said))
                out += [(*[r[k] for k in (*key, "pair_idx", "sample_id")], t, None if t is not None else error) for r, t in zip(some, said, strict=False)]
            yield pd.DataFrame(out, columns=[*key, "pair_idx", "sample_id", "raw_text", "error"], dtype=object)

    kinds = ", ".join(f"`{k}` {wanted.schema[k].dataType.simpleString()}" for k in key)
    return wanted.mapInPandas(run, f"{kinds}, pair_idx int, sample_id int, raw_text string, error string")


class Program:
    """A program that reads a JSON object a line and answers each with one; it stays up between rows, and is killed with all it started when it misses a deadline."""

    def __init__(self, argv: list[str]):
        self.argv = argv
        self._run: subprocess.Popen | None = None
        self._lines: queue.Queue = queue.Queue()

    def _started(self) -> subprocess.Popen:
        if self._run is None or self._run.poll() is not None:
            self._lines = queue.Queue()
            self._run = subprocess.Popen(self.argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, start_new_session=True)
            threading.Thread(target=self._listen, args=(self._run, self._lines), daemon=True).start()
        return self._run

    @staticmethod
    def _listen(run: subprocess.Popen, lines: queue.Queue) -> None:
        for line in run.stdout:
            lines.put(line)
        lines.put(None)

    def ask(self, row: dict, deadline: float) -> dict:
        run = self._started()
        try:
            run.stdin.write(json.dumps(row, default=str) + "\n")
            run.stdin.flush()
            line = self._lines.get(timeout=deadline)
        except queue.Empty:
            self.stop()
            raise TimeoutError(f"no answer in {deadline:g} s") from None
        except OSError:
            line = None
        if line is None:
            code = run.wait()
            self.stop()
            raise RuntimeError(f"the program ended with {code}")
        return json.loads(line)

    def stop(self) -> None:
        if self._run is not None:
            try:
                os.killpg(self._run.pid, signal.SIGKILL)
            except ProcessLookupError:
                pass
            self._run.wait()
            self._run = None


def apply_programs(rows: DataFrame, argv: list[str], out_schema: str, key: str = "key", pool: int = 4, deadline: float = 900.0) -> DataFrame:
    """(key, out_schema..., error, trace): each row as JSON through one of pool programs of its task, which stay up from row to row.

    A program that misses the deadline is killed with its children and started anew for the next row; its row, like one whose program ends or answers no JSON
    object, becomes a dead letter.
    """
    names = [c.strip().split(" ")[0] for c in out_schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idle: queue.Queue[Program] = queue.Queue()
        every = [Program(argv) for _ in range(pool)]
        for p in every:
            idle.put(p)

        def one(row: dict) -> tuple:
            program = idle.get()
            try:
                said = program.ask(row, deadline)
                return (row[key], *[said.get(n) for n in names], None, None)
            except Exception as e:
                return (row[key], *[None] * len(names), f"{type(e).__name__}: {e}"[:500], traceback.format_exc()[:2000])
            finally:
                idle.put(program)

        try:
            with ThreadPoolExecutor(pool) as threads:
                for batch in batches:
                    yield pd.DataFrame(list(threads.map(one, batch.to_dict("records"))), columns=[key, *names, "error", "trace"], dtype=object)
        finally:
            for p in every:
                p.stop()

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {out_schema}, error string, trace string")


def refine(rows: DataFrame, path: str, step: Callable[[DataFrame, int], DataFrame], unfinished: str, rounds: int) -> DataFrame:
    """rows after up to so many rounds of step, each of which gets only the rows that unfinished, a condition in SQL, still holds of.

    step returns rows of the same columns. What a round makes is committed under path, finished and unfinished rows apart, so that a run that follows one which
    was killed begins after the last committed round. Rows that are unfinished after the last round come as they stand.
    """
    spark, kinds = rows.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    done, left = CommitLog(spark, f"{path}/done", kinds), CommitLog(spark, f"{path}/left", kinds)
    still = F.coalesce(F.expr(unfinished), F.lit(False))

    def enter(made: DataFrame, number: int) -> None:
        # the round's rows are written once; the log of those left is the mark of a round that is over
        staged = CommitLog(spark, f"{path}/made", kinds)
        if not staged.committed(number):
            staged.append(made.select(*rows.columns), number)
        known = staged.read_batch(number)
        done.append(known.where(~still), number)
        left.append(known.where(still), number)

    if left.latest() < 0:
        enter(rows, 0)
    for k in range(left.latest(), rounds):
        now = left.read_batch(k)
        if now.isEmpty():
            break
        enter(step(now, k), k + 1)
    return done.read().unionByName(left.read_batch(left.latest()))
