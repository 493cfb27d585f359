"""Prefix scans, quantiles by selection, typed checks, mended JSON, literals before patterns, and runs that are killed."""

import json
import math
import os
import random
import re
import signal
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from planlake.functions import jsonx, typed
from planlake.functions.literals import matches_where_possible, required_literals
from planlake.functions.text import PEDAGOGY, PERSON_REFERENCE, SECOND_PERSON, SKELETON
from planlake.operators import plan as P
from planlake.operators import quantiles, rewards, scan
from planlake.streaming import incremental
from planlake.streaming.commitlog import CommitLog, averages_to, flush_every, stream_to

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def fold(xs, decay, start=None):
    out = []
    for x in xs:
        start = x if start is None else decay * start + (1 - decay) * x
        out.append(start)
    return out


@pytest.mark.parametrize("decay", [0.9, 0.999, 0.0])
def test_averages_of_a_hot_component(spark, decay):
    """A component of many buckets, some on three levels, beside small ones, equals the fold."""
    rng = random.Random(6)
    series = {"hot": [rng.uniform(-5, 5) for _ in range(5000)], "one": [3.0], "few": [rng.uniform(0, 1) for _ in range(40)], None: [1.0, 2.0]}
    rows = [(c, 7 * i - 100, x) for c, xs in series.items() for i, x in enumerate(xs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "component string, step long, value double")
    start = spark.createDataFrame([("few", 10.0), ("gone", 1.0)], "component string, average double")
    for before, known in ((None, {}), (start, {"few": 10.0})):
        got = scan.moving_averages(df, "value", ["step"], "component", decay=decay, start=before, bucket=16)
        assert sorted(got.columns) == ["average", "component", "step", "value"]
        found = {(r.component, r.step): r.average for r in got.collect()}
        want = {(c, 7 * i - 100): x for c, xs in series.items() for i, x in enumerate(fold(xs, decay, known.get(c)))}
        assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


@pytest.mark.parametrize("decay", [0.9, 0.5, 1e-3])
def test_averages_over_whole_buckets(spark, decay):
    """A series longer than a bucket of the production size, whose ends fade away within the next: the levels end."""
    xs = [float(i % 101) for i in range(9000)]
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(xs)], "component string, step long, value double")
    got = {r.step: r.average for r in scan.moving_averages(df, "value", ["step"], "component", decay=decay).collect()}
    assert all(math.isclose(got[i], x, rel_tol=1e-9, abs_tol=1e-9) for i, x in enumerate(fold(xs, decay))) and len(got) == 9000
    assert all(scan.bucket_rows(d) >= 2 for d in (0.0, 1e-320, 1e-200, decay, 0.999999, 1.0))


def test_averages_gather_no_series(spark):
    df = spark.range(100).selectExpr("'c' AS component", "id AS step", "cast(id AS double) AS value")
    plan = scan.moving_averages(df, "value", ["step"], "component")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Python" not in plan and "Pandas" not in plan
    assert scan.moving_averages(df.where("step < 0"), "value", ["step"], "component").count() == 0


def test_averages_over_a_stream_go_on(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    parts = [[("a", 0, 1.0), ("b", 0, 4.0)], [("a", 1, 2.0), ("a", 2, 8.0)], [("b", 3, 0.0), ("c", 9, 5.0)]]
    for i, rows in enumerate(parts):
        (source / f"{i}.json").write_text("".join(json.dumps({"component": c, "step": s, "value": v}) + "\n" for c, s, v in rows))
        log, run = averages_to(incremental.growing_folder(spark, str(source), "component string, step long, value double"), out, check)
        run.awaitTermination()
    got = {(r.component, r.step): round(r.average, 9) for r in log.read().collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 1.1, ("a", 2): 1.79, ("b", 0): 4.0, ("b", 3): 3.6, ("c", 9): 5.0}


@pytest.mark.parametrize("few", [4096, 5])
def test_quantiles_of_one_group(spark, sf, few):
    """All rows in one group, through narrowing ranges and outright, with ties, nulls, negative, huge and tiny values."""
    rng = random.Random(4)
    values = [rng.choice([0.0, -1.5, 1e300, -1e300, 1e-300, rng.gauss(0, 1), float(rng.randint(0, 9))]) for _ in range(3000)]
    rows = [("all", v) for v in values] + [("all", None), ("none", None), (None, 2.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    ordered = sorted(values)
    places = [0, 1, 7, 1499, 1500, 2998, 2999, 5000]
    ranks = spark.createDataFrame([("all", p) for p in places] + [("two", 1), (None, 0)], "g string, rank long")
    got = {(r.g, r["rank"]): r.value for r in quantiles.order_statistics(df, "v", ranks, "g", bins=8 if few == 5 else 1024, few=few).collect()}
    assert got == {("all", p): ordered[p] for p in places[:-1]} | {("two", 1): 2.0, (None, 0): 2.0}


def test_quantiles_equal_the_built_in_ones(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.lit(1).alias("g"), F.col("l_extendedprice").cast("double").alias("x"), F.col("l_partkey").alias("n"))
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.925, "e": 1.0}
    got = quantiles.percentiles(rows, "x", shares, "g").first()
    want = rows.select(F.percentile("x", F.array(*[F.lit(p) for p in shares.values()]))).first()[0]
    assert [round(got[k], 6) for k in shares] == [round(x, 6) for x in want]
    values = sorted(r.n for r in rows.select("n").collect())
    got = quantiles.nearest_ranks(rows, "n", shares, "g").first()
    assert [got[k] for k in shares] == [values[round(p * (len(values) - 1))] for p in shares.values()]


def test_selection_equals_the_queries(spark, sf, duck):
    """The selections of texts' lengths by language, and those of one group that holds all rows."""
    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", F.length("text").cast("long").alias("n"))
    got = {r.lang: (r.median, r.p25, r.p75) for r in quantiles.percentiles(docs, "n", {"median": 0.5, "p25": 0.25, "p75": 0.75}, "lang").collect()}
    assert got == {r.lang: (r.median, r.p25, r.p75) for r in duck.execute(entry.oracle_sql()["q02_len_stats"]).df().itertuples()}
    shares = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    got = {r.lang: tuple(r)[1:] for r in quantiles.nearest_ranks(docs, "n", shares, "lang").collect()}
    assert got == {r.lang: (r.p50, r.p90, r.p95, r.p99) for r in duck.execute(entry.oracle_sql()["q03_nearest_rank"]).df().itertuples()}


PLAN = {
    "agents": [{"agent_role": "r", "goal": "g", "tools": ["RagTool"]}],
    "subtasks": [{"id": "S1", "name": "n", "steps": [{"id": "S1-1", "agent": "r", "objective": "o", "instruction": "i", "expected_output": "e", "depends_on": []}]}],
    "execution_order": ["S1-1", {"loop": {"steps": ["S1-1"]}}],
}


def changed(path, value):
    plan = json.loads(json.dumps(PLAN))
    at = plan
    for p in path[:-1]:
        at = at[p]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(plan)


def test_a_fault_for_each_wrong_type(spark):
    step = ("subtasks", 0, "steps", 0)
    cases = [((k,), v, f"$.{k}: {kind} for ARRAY") for k in PLAN for v, kind in (("x", "STRING"), ({}, "OBJECT"), (None, "NULL"), (3, "NUMBER"), (True, "BOOLEAN"))]
    cases += [((k,), KeyError, f"$.{k}: missing") for k in PLAN]
    cases += [(("agents", 0, k), 1.5, f"$.agents[0].{k}: NUMBER for {'ARRAY' if k == 'tools' else 'STRING'}") for k in ("agent_role", "goal", "tools")]
    cases += [(("agents", 0, "tools", 0), [], "$.agents[0].tools[0]: ARRAY for STRING"), (("agents", 0), "a", "$.agents[0]: STRING for OBJECT"), (("subtasks", 0, "steps"), {}, "$.subtasks[0].steps: OBJECT for ARRAY")]
    cases += [((*step, k), False, f"$.subtasks[0].steps[0].{k}: BOOLEAN for STRING") for k in ("id", "agent", "objective", "instruction", "expected_output", "tool")]
    cases += [((*step, "depends_on"), "S", "$.subtasks[0].steps[0].depends_on: STRING for ARRAY"), ((*step, "requires_human_input"), "no", "$.subtasks[0].steps[0].requires_human_input: STRING for BOOLEAN")]
    cases += [((*step, "tool"), None, None), ((*step, "depends_on"), KeyError, None), (("execution_order", 1), 4, "$.execution_order[1]: NUMBER for STRING|OBJECT")]
    rows = spark.createDataFrame([(i, changed(path, value)) for i, (path, value, _) in enumerate(cases)], "i int, text string")
    got = {r.i: r.faults for r in rows.select("i", P.type_faults(F.col("text")).alias("faults")).collect()}
    assert got == {i: [fault] if fault else [] for i, (_, _, fault) in enumerate(cases)}
    odd = spark.createDataFrame([(json.dumps({"agents": [], "subtasks": []}),), ("[1]",), ("",), (None,)], "text string")
    assert [r[0] for r in odd.select(P.type_faults(F.col("text"))).collect()] == [["$.execution_order: missing"], ["$: missing"], ["$: missing"], ["$: missing"]]
    kinds = spark.range(1).select(*[typed.kind_of(F.parse_json(F.lit(x))).alias(f"c{i}") for i, x in enumerate(['{"a":1}', "[]", '"x"', "1", "1.5", "1e99", "true", "null"])])
    assert list(kinds.first()) == ["OBJECT", "ARRAY", "STRING", "NUMBER", "NUMBER", "NUMBER", "BOOLEAN", "NULL"]


def plain_last_object(text):
    depth, start, quoted, escaped, found = 0, 0, False, False, None
    for i, c in enumerate(text or ""):
        if quoted:
            escaped, quoted = (not escaped and c == "\\"), (escaped or c != '"')
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            found = text[start : i + 1] if depth == 0 else found
    return found


def test_last_object_is_found_without_python(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice('{}"\\ab é\n') for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [None, "", '{"a": "}{", "b": "\\"}"} x {']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", jsonx.last_object("t").alias("o"))
    assert all(r.o == plain_last_object(r.t) for r in df.collect())
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": "he said "no" to it", "b": 1}', {"a": 'he said "no" to it', "b": 1}),
        ('so {"a": "the "x" call, and "y" too"} ok', {"a": 'the "x" call, and "y" too'}),
        ('{"a": ""x"", "b": ["p "q" r", "s"],}', {"a": '"x"', "b": ['p "q" r', "s"]}),
        ('{"a": "q\\"z", "b": "c:\\d"}', {"a": 'q"z', "b": "c:\\d"}),
        ('{a: "an "odd" one", // note\n "b": null}', {"a": 'an "odd" one', "b": None}),
        ('{"a": "fine, as: it \\"is\\""}', {"a": 'fine, as: it "is"'}),
    ],
)
def test_stray_quotes_are_mended(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(jsonx.object_text(F.col("t")).alias("o"), jsonx.object_variant(F.col("t")).cast("string").alias("v")).first()
    assert json.loads(got.o) == want and json.loads(got.v) == want


def test_literals_are_required(spark):
    patterns = [p for _, p in (*PEDAGOGY, *SKELETON)] + [SECOND_PERSON, PERSON_REFERENCE, r"a+b*c{2}", r"x?y?", r"(foo|)bar", r"[abc]d", r"(?:ab|cd)+e", "é|ab"]
    assert required_literals(r"x?y?") == () and required_literals("é|ab") == () and required_literals(r"(foo|)bar") == ("bar",)
    rng = random.Random(1)
    bits = ["predict", "Walk it all through", "example", "sample code", "extract a rule", "you", "LEARNER", "abcce", "ccd", "bar", "foo", " ", "-", "\n", "xx", "step-by-step", "aabbcc", "identify an error", "like php", "Analogy", "é", "K"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 5))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").withColumn("l", F.lower("t"))
    for p in patterns:
        bad = df.where(~matches_where_possible(F.col("t"), F.col("l"), p).eqNullSafe(F.coalesce(F.col("t").rlike("(?i)" + p), F.lit(False)))).count()
        assert bad == 0 and all(any(x in t.lower() for x in required_literals(p) or ("",)) for t in texts if re.search(p, t, re.I | re.A))


def test_mined_orders_are_part_of_the_reward(spark):
    plan = lambda *names: json.dumps({"agents": [], "subtasks": [{"id": f"S{i}", "name": n, "steps": []} for i, n in enumerate(names)], "execution_order": []})
    rows = spark.createDataFrame([(1, plan("a", "b")), (2, plan("b", "a")), (3, plan("a")), (None, plan("A ", "b", "c")), (5, "none")], "k int, completion string")
    rows = rows.withColumns({"gold_plan": F.col("completion"), "learner_profile": F.lit(None).cast("string")})
    mined = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    config = rewards.RewardConfig(ped_mode="lite")
    got = {r.k: round(r.r_ped, 6) for r in rewards.score(rows, config, mined=mined, keys=("k",)).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.5, None: round(0.5 * 2 / 3, 6), 5: 0.0}
    with pytest.raises(ValueError, match="keys"):
        rewards.score(rows, config, mined=mined)


KILLED = """
import os, signal, sys
sys.path.insert(0, {root!r})
from planlake.session import session
from planlake.streaming import commitlog, incremental
spark = session("killed", "local[2]", spark_sql_shuffle_partitions="2", spark_ui_enabled="false")
log = commitlog.CommitLog(spark, {out!r}, "id long, twice long")
plain = log.commit
def commit(batch, folder, info=""):
    if batch == 2:
        os.kill(os.getpid(), signal.SIGKILL)
    return plain(batch, folder, info)
log.commit = commit
rows = incremental.growing_folder(spark, {source!r}, "id long", 1)
commitlog.stream_to(rows, log, {check!r}, lambda b: b.selectExpr("id", "id * 2 AS twice")).awaitTermination()
"""


def test_a_run_killed_between_writing_and_committing(spark, tmp_path):
    """The driver is killed with files written and no manifest; the next run ends with the rows of one clean run."""
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    for i in range(5):
        (source / f"{i}.json").write_text("".join(json.dumps({"id": 10 * i + j}) + "\n" for j in range(10)))
    script = KILLED.format(root=ROOT, out=out, check=check, source=str(source))
    ended = subprocess.run([sys.executable, "-c", script], capture_output=True, timeout=300, check=False)
    assert ended.returncode == -signal.SIGKILL
    log = CommitLog(spark, out, "id long, twice long")
    assert log.latest() == 1 and log.read().count() == 20
    rows = incremental.growing_folder(spark, str(source), "id long", 1)
    stream_to(rows, log, check, lambda b: b.selectExpr("id", "id * 2 AS twice")).awaitTermination()
    assert sorted(tuple(r) for r in log.read().collect()) == [(i, 2 * i) for i in range(50)]
    assert log.vacuum() == 1 and log.vacuum() == 0 and log.read().count() == 50


def test_a_batch_counts_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"), "id long")
    assert log.read().count() == 0 and log.latest() == -1
    assert log.append(spark.range(3), 0) and not log.append(spark.range(9), 0)
    late = log.stage(spark.range(50))
    assert not log.commit(0, late) and log.read().count() == 3 and log.latest(0) == -1
    assert log.append(spark.range(0), 1) and log.read().count() == 3 and log.read_batch(1).count() == 0


def test_slices_go_on_after_a_run_that_broke_off(spark, tmp_path):
    rows = spark.createDataFrame([(i if i % 9 else None, f"v{i}") for i in range(90)], "id int, v string")
    log = CommitLog(spark, str(tmp_path / "t"), "id int, v string")
    seen = []

    def broken(part):
        seen.append(part.count())
        if len(seen) == 4:
            raise InterruptedError
        return part

    with pytest.raises(InterruptedError):
        flush_every(rows, log, "id", broken, every=10)
    assert log.latest() >= 2 and log.read().count() == sum(seen[:3])
    rest = flush_every(rows.where("false"), log, "id", lambda part: part, every=10)  # the input was kept
    assert rest > 0 and sorted(r.v for r in log.read().collect()) == sorted(f"v{i}" for i in range(90))
    assert flush_every(rows, log, "id", broken, every=10) == 0
