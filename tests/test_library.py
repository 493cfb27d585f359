"""Readers, curation, training rows, batch functions and streams on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from planlake import schemas
from planlake.functions import jsonx, nested, text
from planlake.operators import batch, curation, training
from planlake.sources import tables
from planlake.streaming import incremental


def test_tolerant_scan(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_bytes(b'\xef\xbb\xbf{"question_id": "1", "canonical_query": "a"}\n\n{broken\n{"question_id": " ", "canonical_query": "b"}\n')
    good, bad = tables.jsonl_tolerant(spark, str(p), "question_id string, canonical_query string")
    assert (good.count(), bad.count(), tables.questions(spark, str(p)).count()) == (2, 1, 1)
    with pytest.raises(Exception, match="(?i)malformed|corrupt|FAILFAST"):
        tables.jsonl(spark, str(p), "question_id string").collect()


def test_comma_joined_and_split_index(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"plan": "x"},\n{"answer": "y"}')
    got = tables.comma_joined(spark, str(tmp_path / "a.json"), "struct<plan:string,answer:string>").orderBy("place").collect()
    assert [(r.item.plan, r.item.answer) for r in got] == [("x", None), (None, "y")]
    (tmp_path / "s.json").write_text(json.dumps({"train_qids": ["1", "2"], "dev_qids": ["2"]}))
    with pytest.raises(ValueError):
        tables.split_index(spark, str(tmp_path / "s.json"))
    index = tables.split_index(spark, str(tmp_path / "s.json"), strict=False)
    assert [r.question_id for r in curation.overlapping(index).collect()] == ["2"]


def test_two_layouts(spark):
    nested_rows = spark.createDataFrame([("1", "q", [(("me", ["x"]), "a"), (("you", []), "b")])], schemas.QAP)
    assert [r.key for r in tables.two_layouts(nested_rows).orderBy("key").collect()] == ["1__0", "1__1"]


def test_params_and_sections():
    assert tables.scalar_params("a: 1\nparams:\n  x: 3\n  y: 0.5\n  z: true\n  w: 'text'\n  n: null\nb: 2") == {"x": 3, "y": 0.5, "z": True, "w": "text", "n": None}
    assert tables.sections("===\n1. One\n===\nbody\n===\n2. Two\n===\nmore") == {1: ("One", "body"), 2: ("Two", "more")}
    assert tables.renumbered("§1 and §12", {1: 12, 12: 3}) == "§12 and §3"


def test_label_responses(spark):
    cases = ['{"labels": ["errors", "api usage", "errors", "odd"], "reasoning": "r"}', '```json\n{"labels": "REVIEW"}\n```', 'so {"labels": ["LEARNING"]} there', "it is CONCEPTUAL, I think", "nothing"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = df.select("i", jsonx.label_response(F.col("t")).alias("r")).orderBy("i").collect()
    assert [(r.r.labels, r.r.parse_warning) for r in got] == [(["ERRORS", "API_USAGE"], False), (["REVIEW"], False), (["LEARNING"], False), (["CONCEPTUAL"], True), ([], True)]


def test_json_helpers(spark):
    df = spark.createDataFrame([('{"a": "}"} then {"b": {"c": 1}} end',), ('[{"role": "user", "content": "u"}, {"role": "assistant", "content": "é"}]',), ("plain",)], "t string")
    got = df.select(jsonx.last_object("t").alias("o"), jsonx.payload_text("t").alias("p")).collect()
    assert got[0].o == '{"b": {"c": 1}}' and got[1].p == "é" and got[2].p == "plain"
    fixed = spark.createDataFrame([('{a: 1, "b": [1, 2,],}',)], "t string").select(jsonx.object_text(F.col("t"))).first()[0]
    assert json.loads(fixed) == {"a": 1, "b": [1, 2]}


def test_jaccards(spark):
    row = spark.createDataFrame([(["x", "x", "y"], ["x", "y", "y"], [], [])], "a array<string>, b array<string>, c array<string>, d array<string>")
    m, s, e = row.select(nested.multiset_jaccard(F.col("a"), F.col("b")), nested.set_jaccard(F.col("a"), F.col("b")), nested.set_jaccard(F.col("c"), F.col("d"))).first()
    assert (m, s, e) == (0.5, 1.0, 1.0)


def test_text_signals(spark):
    row = spark.createDataFrame([("You said your background in python helps. Next",)], "t string")
    r = row.select(text.anchor_count(F.col("t")), text.matches(F.col("t"), text.SECOND_PERSON), text.phase(F.lit("Please summarize")), text.role_family(F.lit("Code Reviewer"))).first()
    assert tuple(r) == (1, True, "consolidate", "reviewer")


def test_curation_routes(spark):
    profile = lambda d: (d, ["b", "a"])
    records = spark.createDataFrame([("1", "q", [(profile("good"), "x"), (profile("bad"), "y"), (profile("new"), "z")]), ("2", "q", [(profile("bad"), "y")])], schemas.QAP)
    annotated = spark.createDataFrame([("1", profile("good "), "x", True, "high"), ("1", profile("good"), "x", False, "low"), ("1", profile("bad"), "y", False, "high"), ("1", profile("odd"), "y", None, None)], schemas.ANNOTATED)
    kept = curation.filtered_records(records, curation.verdict_of_keys(annotated)).collect()
    assert [(r.question_id, [p.profile.self_description for p in r.profiles_answers]) for r in kept] == [("1", ["good", "new"])]
    review = {r.key.description: (r.contradicted, r.unsure, r.missing) for r in curation.review_set(annotated).collect()}
    assert review == {"good": (False, True, False), "odd": (False, False, True)}


def test_splits_are_stratified(spark):
    rows = spark.createDataFrame([(str(q), i) for q in range(300) for i in range(1 + q % 2)], "question_id string, profile_index int")
    split = curation.stratified_split(rows, "question_id", "profile_index")
    n = {(r.stratum, r.split): r["count"] for r in split.groupBy("stratum", "split").count().collect()}
    assert n == {(s, p): k for s in (1, 2) for p, k in (("test", 15), ("dev", 15), ("train", 120))}
    assert curation.overlapping(split).count() == 0


def test_training_rows(spark):
    out = ([("tutor", "g", "b", None, [])], [("S1", "one", "o", [])], ["S1-1"])
    rows = spark.createDataFrame([("1", 0, (("q", ("", [], None, None)), out))], schemas.PLAN_RECORD)
    row = training.prompt_and_completion(training.outline_messages(rows, "sys")).first()
    assert [m.role for m in row.prompt] == ["system", "user"] and json.loads(row.completion)["subtasks"][0]["id"] == "S1"
    samples = spark.createDataFrame([("1", 0, 0, i, t) for i, t in enumerate(['{"agents": [{"agent_role": "tutor"}], "subtasks": [{"name": "one"}]}', '{"agents": [], "subtasks": []}', "junk"])], "question_id string, profile_index int, pair_idx int, sample_id int, raw_text string")
    gold = spark.createDataFrame([("1", 0, ["tutor"], ["one"])], "question_id string, profile_index int, roles array<string>, names array<string>")
    pair = training.preference_pairs(samples, gold).first()
    assert "tutor" in pair.chosen and pair.delta_struct == 1.0


def test_dead_letters_and_resumption(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 0), ("c", 2)], "key string, v int")
    done = spark.createDataFrame([("c",)], "key string")
    results, failures = batch.resumed(rows, done, lambda r: {"x": 1 / r["v"]}, "x double")
    assert [tuple(r) for r in results.collect()] == [("a", 1.0)] and [r.key for r in failures.collect()] == ["b"]


def test_stream_repeats_nothing(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("r", 1, 1.0), ("r", 2, 0.0)], "component string, step long, value double").write.json(source)
    for _ in range(2):
        incremental.run_once(incremental.growing_folder(spark, source, "component string, step long, value double"), out, state, lambda d: d.where("step > 0")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
