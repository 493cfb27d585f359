"""Clients, stored answers, samplers, programs that stay up, loops that go on, and graphs as tables."""

import http.server
import json
import os
import random
import sys
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from planlake.operators import batch, calls, compare, graph, rewards
from planlake.operators import plan as P
from planlake.queries.plandata import order_components, order_plans
from planlake.queries.registry import Tables
from planlake.streaming.commitlog import CommitLog


class Answers(http.server.BaseHTTPRequestHandler):
    said: list = []

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Answers.said.append((asked, self.headers.get("Authorization")))
        last = asked["messages"][-1]["content"]
        if last == "fail" or (last == "twice" and sum(a["messages"] == asked["messages"] for a, _ in Answers.said) < 3):
            self.send_error(503)
            return
        body = json.dumps({"choices": [{"message": {"content": f"{asked['model']}:{last}"}}]}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    Answers.said = []
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{s.server_port}/chat"
        s.shutdown()


def test_a_client_tries_again(server, monkeypatch):
    monkeypatch.setenv("SOME_KEY", "k1")
    client = calls.HttpChat(server, "m", key_variable="SOME_KEY", wait=0.01, more={"stream": False})
    say = lambda text: [{"role": "user", "content": text}]
    assert client.chat(say("hello"), temperature=0.5, max_tokens=9) == "m:hello"
    assert Answers.said[0] == ({"model": "m", "messages": say("hello"), "temperature": 0.5, "max_tokens": 9, "stream": False}, "Bearer k1")
    assert client.chat(say("twice")) == "m:twice" and len(Answers.said) == 4
    with pytest.raises(OSError):
        client.chat(say("fail"), retries=1)
    assert len(Answers.said) == 6


def test_a_second_run_asks_nothing(spark, server, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0.1), (2, "b", 0.1), (3, "a", 0.1), (4, "a", 0.2), (5, "fail", 0.1), (6, None, 0.1)], "id int, said string, heat double")
    cache = CommitLog(spark, str(tmp_path / "cache"), calls.ANSWERS)

    def ask(row):
        return calls.HttpChat(server, "m", wait=0.01).chat([{"role": "user", "content": row["said"] or "nothing"}], row["heat"], retries=0)

    ask_all = lambda: {r.id: (r.answer, bool(r.error)) for r in calls.cached_answers(rows, ask, cache, "said", "heat").collect()}
    want = {1: ("m:a", False), 2: ("m:b", False), 3: ("m:a", False), 4: ("m:a", False), 5: (None, True), 6: ("m:nothing", False)}
    assert ask_all() == want and len(Answers.said) == 5
    assert ask_all() == want and len(Answers.said) == 6  # only the failure is asked again
    more = calls.cached_answers(rows.where("id < 3").withColumn("heat", F.lit(0.9)), ask, cache, "said", "heat")
    assert {r.id: r.answer for r in more.collect()} == {1: "m:a", 2: "m:b"} and len(Answers.said) == 8


def test_calls_in_flight_are_bounded(spark, tmp_path):
    rows = spark.range(24).selectExpr("id", "cast(id AS string) AS said")
    marks = tmp_path / "marks"
    marks.mkdir()

    def ask(row):
        began = time.time()
        time.sleep(0.2)
        (marks / row["said"]).write_text(f"{began} {time.time()}")
        return row["said"]

    got = calls.cached_answers(rows, ask, CommitLog(spark, str(tmp_path / "cache"), calls.ANSWERS), "said", in_flight=3, workers=2).collect()
    assert all(r.answer == r.said for r in got) and len(got) == 24
    spans = [tuple(map(float, (marks / str(i)).read_text().split())) for i in range(24)]
    most = max(sum(a <= t < b for a, b in spans) for t, _ in spans)
    assert 2 <= most <= 6


def test_calls_keep_a_pace():
    pace, began = calls.Pace(50), time.monotonic()
    for _ in range(11):
        pace.wait()
    assert 0.19 <= time.monotonic() - began < 1


def test_workers_are_bounded_and_staggered(spark):
    rows = spark.range(6).selectExpr("id AS key").repartition(6)
    out = batch.apply_rows(rows, lambda r: {"at": time.time(), "pid": os.getpid()}, "at double, pid long", workers=2, stagger=0.4)
    got = out.select("at", F.spark_partition_id().alias("part")).collect()
    first = {p: min(r["at"] for r in got if r.part == p) for p in {r.part for r in got}}
    assert len(first) == 2 and first[1] - first[0] >= 0.1


def test_samples_of_prompts(spark):
    prompts = spark.createDataFrame([("q", 0, "x"), ("q", 1, "bad"), ("r", 0, "short")], "question_id string, profile_index int, prompt string")

    def ask(rows):
        if any(r["prompt"] == "bad" for r in rows):
            raise ValueError("no")
        return [f"{r['prompt']}{r['pair_idx']}{r['sample_id']}" for r in rows if r["prompt"] != "short"]

    got = {(r.question_id, r.profile_index, r.pair_idx, r.sample_id): r.raw_text or r.error for r in calls.samples(prompts, ask, ["question_id", "profile_index"], pairs=2, size=1).collect()}
    assert got == {(q, p, i, j): f"x{i}{j}" if (q, p) == ("q", 0) else "ValueError: no" if q == "q" else "no answer" for q, p in (("q", 0), ("q", 1), ("r", 0)) for i in (0, 1) for j in (0, 1)}


PROGRAM = """
import json, os, subprocess, sys, time
for line in sys.stdin:
    row = json.loads(line)
    if row["key"] == 500:
        subprocess.Popen([sys.executable, "-c", "import time; open(%r, 'w').write('up'); time.sleep(3); open(%r, 'w').write('late')"])
        time.sleep(60)
    if row["key"] == 700:
        sys.exit(3)
    print("no json" if row["key"] == 900 else json.dumps({"twice": 2 * row["key"], "pid": os.getpid()}), flush=True)
"""


def test_programs_stay_up(spark, tmp_path):
    """A thousand rows over four programs; one that hangs is killed with its child, one that ends is started anew, and their rows are dead letters."""
    mark = str(tmp_path / "mark")
    rows = spark.range(1000).selectExpr("id AS key").coalesce(1)
    out = calls.apply_programs(rows, [sys.executable, "-c", PROGRAM % (mark, mark)], "twice long, pid long", pool=4, deadline=2).collect()
    good = [r for r in out if r.error is None]
    assert len(out) == 1000 and all(r.twice == 2 * r.key for r in good)
    bad = {r.key: r.error.split(":")[0] for r in out if r.error}
    assert bad == {500: "TimeoutError", 700: "RuntimeError", 900: "JSONDecodeError"}
    assert 4 <= len({r.pid for r in good}) <= 6
    time.sleep(4)
    assert not os.path.exists(mark) or open(mark).read() == "up"


def test_refining_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(i, 0, "") for i in range(8)], "key int, score int, path string")
    seen = []

    def step(now, k, stop=None):
        seen.append((k, now.count()))
        if k == stop:
            raise InterruptedError
        return now.selectExpr("key", "score + 1 AS score", f"concat(path, '{k}') AS path")

    folder = str(tmp_path / "loop")
    with pytest.raises(InterruptedError):
        calls.refine(rows, folder, lambda now, k: step(now, k, 2), "score < key", 4)
    assert seen == [(0, 7), (1, 6), (2, 5)]
    seen.clear()
    got = {r.key: (r.score, r.path) for r in calls.refine(rows, folder, step, "score < key", 4).collect()}
    assert seen == [(2, 5), (3, 4)]  # the rounds before are not run again, and finished rows are left alone
    assert got == {i: (min(i, 4), "0123"[: min(i, 4)]) for i in range(8)}
    seen.clear()
    assert calls.refine(rows, folder, step, "score < key", 4).count() == 8 and not seen
    assert calls.refine(rows.where("false"), str(tmp_path / "none"), step, "score < key", 4).count() == 0


def plain_layers(nodes, edges):
    left, out, k = set(nodes), {}, 0
    known = {(a, b) for a, b in edges if a in left and b in left}
    while left:
        free = {n for n in left if not any(b == n and a in left for a, b in known)}
        if not free:
            break
        out |= dict.fromkeys(free, k)
        left, k = left - free, k + 1
    return {n: out.get(n) for n in nodes}


def test_layers_of_graphs(spark):
    rng = random.Random(7)
    graphs = {g: ([f"n{i}" for i in range(rng.randint(0, 12))], []) for g in range(25)}
    for nodes, edges in graphs.values():
        edges += [(rng.choice([*nodes, "ghost"]), rng.choice(nodes)) for _ in range(rng.randint(0, 2 * len(nodes))) if nodes]
        edges += edges[:2]
    nodes = spark.createDataFrame([(g, n) for g, (ns, _) in graphs.items() for n in ns], "graph int, node string")
    edges = spark.createDataFrame([(g, a, b) for g, (_, es) in graphs.items() for a, b in es], "graph int, src string, dst string")
    got = {(r.graph, r.node): r.layer for r in graph.layers(nodes, edges.union(edges.limit(3))).collect()}
    assert got == {(g, n): k for g, (ns, es) in graphs.items() for n, k in plain_layers(ns, es).items()}
    stuck = {(r.graph, r.node) for r in graph.on_cycles(nodes, edges).collect()}
    ahead = {k for k, v in got.items() if v is None}
    assert stuck <= ahead and bool(stuck) == bool(ahead)
    assert graph.layers(nodes.where("false"), edges).count() == 0


def test_table_graphs_equal_graphs_in_rows(spark, sf):
    rows = P.graph_measures(order_components(Tables(spark, sf)).where("k % 5 = 0"))
    nodes = rows.select(F.col("k").alias("graph"), F.explode("step_ids").alias("node"))
    edges = rows.select(F.col("k").alias("graph"), F.explode("edges").alias("e")).select("graph", "e.src", "e.dst")
    got = Counter(tuple(r) for r in graph.measures(nodes, edges).select("graph", "n_nodes", "cyclic", "longest", "width", F.round("parallel", 9)).collect())
    want = Counter(tuple(r) for r in rows.select("k", "dag.n_nodes", "cyclic", "dag.longest", "dag.width", F.round("dag.parallel", 9)).collect())
    assert got == want


def test_one_graph_of_many_nodes(spark):
    """A tree of 100,000 nodes with a hot root, 9 layers deep."""
    nodes = spark.range(100_000).select(F.lit("g").alias("graph"), F.col("id").alias("node"))
    edges = nodes.where("node > 0").select("graph", F.expr("CASE WHEN node <= 50000 THEN 0 ELSE (node - 1) div 5 END").alias("src"), F.col("node").alias("dst"))
    got = graph.measures(nodes, edges).first()
    assert (got.n_nodes, got.cyclic, got.longest, got.width) == (100_000, False, 3, 50_000)


def test_rounds_over_all_rows(spark):
    start = spark.createDataFrame([(1, 0), (2, 5)], "key int, score int")
    seen = []

    def step(now, k):
        seen.append(k)
        return now.selectExpr("key", "score + 1 AS score")

    got = batch.refined(start, step, lambda now: now.where("score < 3").count() == 0, 9)
    assert seen == [0, 1, 2] and {tuple(r) for r in got.collect()} == {(1, 3), (2, 8)}
    assert batch.refined(start, step, lambda now: False, 0).count() == 2


def test_profile_sensitivity(spark, sf):
    """Plans of one question are told from plans of two: the first likeness is exact, the second that of a stated draw, which no other run changes."""
    plans = P.components(order_plans(Tables(spark, sf)).where("k % 4 = 0"))
    got = compare.profile_sensitivity(plans, 300).first()
    names = rewards.COLUMNS
    rows = plans.select("question_id", "profile_index", *names).collect()
    by_question = {}
    for r in rows:
        by_question.setdefault(r.question_id, []).append(r)

    def jaccard(a, b):
        a, b = set(map(str, a)), set(map(str, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    def bag(a, b):
        a, b = Counter(a), Counter(b)
        return sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0

    alike = [(bag(a.roles, b.roles) + sum(jaccard(a[k], b[k]) for k in names[1:])) / 5 for some in by_question.values() for i, a in enumerate(some) for b in some[i + 1 :]]
    assert got.same == pytest.approx(sum(alike) / len(alike)) and got.gap == pytest.approx(got.same - got.cross)
    assert compare.profile_sensitivity(plans, 300).first().cross == got.cross
