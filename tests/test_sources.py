"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from planlake import schemas
from planlake.sources import tables
from planlake.streaming import incremental


def written(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return str(folder)


def test_a_file_for_each_split(spark, tmp_path):
    paths = {s: written(tmp_path / s, "a.json", [{"id": s}]) for s in ("train", "valid")}
    assert sorted((r.id, r.split) for r in tables.split_files(spark, paths, "id string").collect()) == [("train", "train"), ("valid", "valid")]


def test_split_index_strict_and_lenient(spark, tmp_path):
    path = written(tmp_path / "i", "index.json", ['{"train_qids": ["1", "2"],', ' "dev_qids": ["3"]}'])
    with pytest.raises(ValueError, match="test"):
        tables.split_index(spark, path)
    assert sorted((r.question_id, r.split) for r in tables.split_index(spark, path, strict=False).collect()) == [("1", "train"), ("2", "train"), ("3", "dev")]


def test_counterfactual_plans_as_objects_and_as_text(spark, tmp_path):
    plan = {"agents": [{"agent_role": "a"}]}
    base = {"question_id": "1", "profile_index": 0, "cf_profile_self_description": "d", "cf_profile_skills": ["s"]}
    path = written(tmp_path / "cf", "a.json", [{**base, "cf_plan": plan}, {**base, "cf_plan": json.dumps(plan)}])
    rows = tables.counterfactuals(spark, path).collect()
    assert [json.loads(r.cf_plan) for r in rows] == [plan, plan] and {(r.description, tuple(r.skills)) for r in rows} == {("d", ("s",))}


def test_both_layouts_in_one_scan(spark, tmp_path):
    flat = {"question_id": "f", "profile_index": 3, "plan": {"input": {"query": "q", "learner": {"about_me": "me", "top_tags": ["t"]}}}}
    nested = {"question_id": "n", "canonical_query": "cq", "profiles_answers": [{"profile": {"self_description": "one", "skills": []}}, {"profile": {"self_description": "two", "skills": ["s"]}}]}
    path = written(tmp_path / "two", "a.json", [flat, nested])
    schema = f"question_id string, profile_index int, canonical_query string, profiles_answers array<struct<profile:{schemas.PROFILE},answer:string>>, plan struct<input:{schemas.INPUT}>"
    rows = {r.key: r for r in tables.two_layouts(tables.jsonl(spark, path, schema)).collect()}
    assert sorted(rows) == ["f__3", "n__0", "n__1"] and rows["f__3"].learner.about_me == "me" and rows["n__1"].learner.skills == ["s"]
    assert tables.two_layouts(tables.jsonl(spark, path, schema), limit=2).count() == 2


def test_questions_need_an_id_and_a_query(spark, tmp_path):
    path = written(tmp_path / "q", "a.json", ["﻿" + json.dumps({"question_id": " 1 ", "canonical_query": "x"}), "", "broken {", {"question_id": " ", "canonical_query": "x"}, {"question_id": "2", "canonical_query": " "}, {"question_id": 3, "canonical_query": "y"}])
    assert sorted((r.question_id, r.canonical_query) for r in tables.questions(spark, path).collect()) == [("1", "x"), ("3", "y")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("é", 1, "train"), (None, 2, "dev"), ("x,y", 3, "train")], "t string, n int, split string")
    tables.write_jsonl(rows, str(tmp_path / "j"), by="split")
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j/split=dev")).collect()] == [{"t": None, "n": 2}]
    assert "é" in "".join(r.value for r in spark.read.text(str(tmp_path / "j/split=train")).collect())
    tables.write_csv(rows.coalesce(1), str(tmp_path / "c"))
    assert sorted(r.n for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["1", "2", "3"]
    digests = tables.file_digests(spark, str(tmp_path / "c/*.csv")).collect()
    assert len(digests) == 1 and len(digests[0].sha256) == 64 and digests[0].length > 10
    assert [r.n for r in tables.first_rows(rows, 2, "n").collect()] == [1, 2]


def test_resumption_and_batches(spark):
    rows = spark.createDataFrame([(i, f"k{i}") for i in range(7)], "position long, key string")
    left = tables.not_done(rows, rows.where("position < 3").union(rows.where("position < 2")))
    assert sorted(r.key for r in left.collect()) == ["k3", "k4", "k5", "k6"]
    assert [r.batch for r in tables.batches(rows, 3, "position").orderBy("position").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_incremental_runs_repeat_nothing(spark, tmp_path):
    source = tmp_path / "in"
    written(source, "a.json", [{"id": 1}])
    rows = lambda: incremental.growing_folder(spark, str(source), "id int")
    for k in (2, 3):
        incremental.run_once(rows(), str(tmp_path / "out"), str(tmp_path / "check"), lambda df: df.withColumn("twice", F.col("id") * 2)).awaitTermination()
        written(source, f"{k}.json", [{"id": k}])
    incremental.run_once(rows(), str(tmp_path / "out"), str(tmp_path / "check"), lambda df: df.withColumn("twice", F.col("id") * 2)).awaitTermination()
    assert sorted((r.id, r.twice) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 2), (2, 4), (3, 6)]


def test_running_average_is_kept_between_batches(spark, tmp_path):
    source = tmp_path / "r"
    written(source, "a.json", [{"component": "x", "step": 0, "value": 1.0}, {"component": "x", "step": 1, "value": 0.0}, {"component": "y", "step": 0, "value": 5.0}])
    for k in range(2):
        stream = incremental.running_average(incremental.growing_folder(spark, str(source), "component string, step long, value double"))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        written(source, "b.json", [{"component": "x", "step": 2, "value": 2.0}])
    got = {(r.component, r.step): round(r.average, 6) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("x", 0): 1.0, ("x", 1): 0.9, ("x", 2): 1.01, ("y", 0): 5.0}


def test_configuration_and_sections():
    assert tables.scalar_params("model: x\nparams:\n  a: 1\n  b: 2.5 # why\n  c: true\n  d: null\n  e: 'txt'\nother:\n  a: 9\n") == {"a": 1, "b": 2.5, "c": True, "d": None, "e": "txt"}
    text = "====\n1. First thing\n====\nbody §2\n====\n2. Second\n====\nmore"
    assert tables.sections(text) == {1: ("First thing", "body §2"), 2: ("Second", "more")}
    assert tables.renumbered("see §1, §12 and §2", {1: 2, 2: 3, 12: 1}) == "see §2, §1 and §3"
