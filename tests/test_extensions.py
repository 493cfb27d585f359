"""Extension points, repairs, draws and reports."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from planlake.functions import jsonx
from planlake.operators import audit, batch, compare, curation, rewards
from planlake.operators import plan as P
from planlake.operators.ordering import ranked, shuffled
from planlake.sources import tables


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": "x, note: y",}', {"a": "x, note: y"}),
        ('{a: 1, // why\n "b": [1, 2,], }', {"a": 1, "b": [1, 2]}),
        ('{"a": "http://x", /* c */ b: 2}', {"a": "http://x", "b": 2}),
        (r'{"a": "C:\dir", "q": "say \"hi\", k: v"}', {"a": "C:\\dir", "q": 'say "hi", k: v'}),
    ],
)
def test_repairs_leave_strings_alone(spark, text, want):
    assert json.loads(one(spark, text, jsonx.object_text)) == want


def test_lists_are_read_where_there_is_no_object(spark):
    assert json.loads(one(spark, '```json\n[{"a": 1}, {"a": 2}]\n```', jsonx.object_or_list_text)) == [{"a": 1}, {"a": 2}]
    assert json.loads(one(spark, 'so: {"a": [1]} end', jsonx.object_or_list_text)) == {"a": [1]}
    assert one(spark, "nothing", jsonx.object_or_list_text) is None


def test_python_spacing(spark):
    text = '{"a":[1,2],"é":null}'
    assert one(spark, text, jsonx.python_json()) == '{"a": [1, 2], "é": null}'
    assert one(spark, text, jsonx.python_json(2)) == json.dumps(json.loads(text), ensure_ascii=False, indent=2)


def test_batches_join_answers_by_key(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "key long, text string").repartition(1)

    def classify(some):
        assert len(some) <= 4
        if any(r["key"] == 9 for r in some):
            raise ValueError("broken")
        return [{"key": r["key"], "label": r["text"].upper()} for r in reversed(some) if r["key"] != 2]

    got = {r.key: (r.label, r.error) for r in batch.apply_batches(rows, classify, "label string", size=4, retries=1, wait=0.0).collect()}
    assert got[0] == ("T0", None) and got[2] == (None, "no answer") and got[9] == (None, "broken")


def test_commands_are_timed(spark):
    echo = batch.command([sys.executable, "-c", "import json,sys; r = json.load(sys.stdin); print(json.dumps({'out': r['text'] * 2}))"], 30)
    slow = batch.command([sys.executable, "-c", "import time; time.sleep(30)"], 0.2)
    rows = spark.createDataFrame([(1, "ab")], "key long, text string")
    assert batch.apply_rows(rows, echo, "out string").first().out == "abab"
    assert "timed out" in batch.apply_rows(rows, slow, "out string").first().error


def test_judges_are_swapped_and_their_upper_median_counts(spark):
    rows = spark.createDataFrame([(i, "plan", "gold") for i in range(40)], "key long, plan string, gold string")

    def careful(pairs):
        assert all((a, b) == (("gold", "plan") if s else ("plan", "gold")) for a, b, s in pairs) and len({s for _, _, s in pairs}) == 2
        return [0.2] * len(pairs)

    judges = [careful, lambda pairs: [0.6] * len(pairs), lambda pairs: [None] * len(pairs), lambda pairs: [7.0] * len(pairs)]
    assert {r.r_soft for r in batch.judged(rows.repartition(1), judges, "plan", "gold").collect()} == {0.6}
    assert {r.r_soft for r in batch.judged(rows, judges[2:], "plan", "gold").collect()} == {0.0}


def test_table_chat():
    chat = batch.TableChat({"hi": "hello"})
    assert chat.chat([{"role": "user", "content": "hi"}], max_tokens=4) == "hell"
    with pytest.raises(KeyError):
        chat.chat([{"role": "user", "content": "?"}])


def test_counterfactual_profiles_differ(spark):
    schema = "question_id string, profile_index int, learner struct<description:string,skills:array<string>>"
    rows = spark.createDataFrame([(f"q{i}", 0, (f"d{i % 5}", ["s"])) for i in range(50)] + [("blank", 0, ("", []))], schema)
    got = {r.question_id: r for r in compare.counterfactual_profiles(rows).collect()}
    assert len(got) == 51 and got["blank"].description.startswith("d")
    assert all(got[f"q{i}"].description != f"d{i % 5}" for i in range(50))
    assert {r.question_id: r.description for r in compare.counterfactual_profiles(rows.repartition(7)).collect()} == {k: r.description for k, r in got.items()}
    same = spark.createDataFrame([("a", 0, ("d", ["s"]))], schema)
    assert compare.counterfactual_profiles(same).first().description == "d"
    assert compare.counterfactual_profiles(same.where("false")).count() == 0


def test_random_pairs_are_as_many_as_asked(spark):
    rows = spark.createDataFrame([(f"q{i // 3}", i % 3, i) for i in range(300)], "question_id string, profile_index int, v int")
    pairs = compare.random_pairs(rows, ("v",), 100).collect()
    assert len(pairs) == 100 and all(p.question_id != p.other_id for p in pairs)


@pytest.mark.parametrize("bucket_rows", [7, 10_000])
def test_ranks_are_those_of_one_window(spark, bucket_rows):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(500)], "id long, g string")
    got = ranked(rows, shuffled(F.col("id"), 1), "id", "g", bucket_rows=bucket_rows)
    want = rows.selectExpr("*", "row_number() OVER (PARTITION BY g ORDER BY md5(concat('1:', id)), id) AS place", "count(*) OVER (PARTITION BY g) AS n")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_group_zscore_both_ways(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 5.0), (None, 1.0), (None, 3.0)], "g string, v double")
    want = sorted(round(r[0], 9) for r in rows.select(rewards.group_zscore(F.col("v"), "g")).collect())
    assert sorted(round(r.z, 9) for r in rewards.with_group_zscore(rows, "v", "g").collect()) == want


def test_reward_values_keep_their_order(spark):
    plan = json.dumps({"agents": [{"agent_role": "a", "goal": "g", "tools": []}], "subtasks": [{"id": "S1", "name": "n", "steps": [{"id": "S1-1", "agent": "a", "objective": "o", "instruction": "i", "expected_output": "e"}]}], "execution_order": ["S1-1"]})
    got = rewards.reward_values(spark, [plan, "garbage", plan], gold_plan=[plan])
    assert got[0] == pytest.approx(0.55) and got[1] == pytest.approx(-10) and got[2] == pytest.approx(0.55 * 0.7)


def test_strict_assignment_raises(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "question_id string, v int")
    splits = spark.createDataFrame([("a", "train"), ("c", "test")], "question_id string, split string")
    assert [tuple(r) for r in curation.assigned(rows, splits, strict=False).collect()] == [("a", 1, "train")]
    with pytest.raises(Exception, match="record without a split: b"):
        curation.assigned(rows, splits).collect()
    left, right = curation.orphans(rows, splits)
    assert [r.question_id for r in left.collect()] == ["b"] and [r.question_id for r in right.collect()] == ["c"]
    assert [r.v for r in curation.in_file_order(spark.createDataFrame([("10", 0, 1), ("9", 1, 2), ("9", 0, 3)], "question_id string, profile_index int, v int")).collect()] == [1, 3, 2]


def test_rubric_ladder(spark):
    rows = spark.createDataFrame([(0, 0), (2, 0), (2, 1), (4, 1), (4, 2), (5, 0)], "failed int, major int")
    assert [r[0] for r in rows.select(audit.rubric_rating(F.col("failed"), F.col("major"))).collect()] == ["Excellent", "Good", "Acceptable", "Acceptable", "Failing", "Failing"]
    passed = spark.createDataFrame([(7, 10), (8, 10), (0, 0)], "p int, n int")
    assert [r[0] for r in passed.select(audit.substantive(F.col("p"), F.col("n"))).collect()] == [False, True, False]


def test_sinks_append_and_describe(spark, tmp_path):
    good, bad = spark.createDataFrame([(1, "é", None)], "key long, t string, n int"), spark.createDataFrame([(2, "broken")], "key long, error string")
    for _ in range(2):
        tables.append_results(good, bad, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out/plans")).collect()]
    assert lines == ['{"key":1,"t":"é","n":null}'] * 2 and spark.read.json(str(tmp_path / "out/failures")).count() == 2
    record = json.loads(tables.metadata_record(spark, str(tmp_path / "out/plans/*.json"), {"lr": 0.1}, note="x"))
    assert record["params"] == {"lr": 0.1} and len(record["files"]) == 2 and all(len(f["sha256"]) == 64 for f in record["files"])
    row = spark.createDataFrame([(1, float("nan"), 2.5)], "n int, bad double, good double").select("n", "bad", F.struct("good").alias("s"))
    assert json.loads(tables.stats_document(row)) == {"n": 1, "bad": None, "s": {"good": 2.5}}


def test_the_last_line_of_the_last_file_wins(spark, tmp_path):
    for name, lines in (("a.json", ['{"id": "x", "v": 1}', '{"id": "x", "v": 2}']), ("b.json", ['{"id": "x", "v": 3}', '{"id": "y", "v": 4}', '{"id": "x", "v": 5}'])):
        (tmp_path / name).write_text("\n".join(lines) + "\n" + " " * (5000 if name == "a.json" else 0))
    rows = tables.with_position(tables.jsonl(spark, str(tmp_path), "id string, v int"))
    assert sorted((r.id, r.v) for r in tables.last_of_each(rows, "id", "position").collect()) == [("x", 5), ("y", 4)]


def test_personalization_summary_skips_what_is_missing(spark):
    rows = spark.createDataFrame([(0.5, 2, 1.0, None), (0.0, 0, None, 0.5)], "second_person double, n_anchors int, skill_share double, token_share double")
    got = P.personalization_summary(rows).first()
    assert (got.mean_second_person, got.mean_n_anchors, got.mean_skill_share, got.mean_token_share, got.n_with_skill) == (0.25, 1.0, 1.0, 0.5, 1)


def test_steps_in_sql_are_not_joined_back_by_the_plan(spark):
    from planlake import schemas
    from planlake.sqlfunctions import register

    register(spark)
    texts = ['{"subtasks": [{"name": "a", "steps": [{"id": "S1-1"}, {"id": "S1-2", "agent": "x"}]}, {"name": "b"}, {"name": "c", "steps": [{"id": "S3-1"}]}]}', '{"subtasks": null}', "{}", None]
    plans = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.from_json("t", schemas.OUTPUT).alias("p"))
    got = spark.sql("SELECT k, x.* FROM {plans} r, LATERAL plan_steps(r.p) x", plans=plans)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.k, r.subtask_idx, r.subtask, r.step_idx, r.id, r.agent) for r in got.collect()) == [(0, 0, "a", 0, "S1-1", None), (0, 0, "a", 1, "S1-2", "x"), (0, 2, "c", 0, "S3-1", None)]


def _rollout(spark, *names):
    said = [json.dumps({"agents": [], "subtasks": [{"id": "S1", "name": n, "steps": []}, {"id": "S2", "name": "z", "steps": []}], "execution_order": []}) for n in names]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, completion string")
    return rows.withColumns({"gold_plan": F.col("completion"), "learner_profile": F.lit(None).cast("string")})


def test_rewards_with_mined_orders_write_no_plans(spark):
    from planlake.sources.folders import Files, shared_folder

    folder = shared_folder(spark)
    before = Files(spark, folder).names(folder)
    mined = spark.createDataFrame([("a", "z")], "a string, b string")
    scored = rewards.score(_rollout(spark, "a", "b"), rewards.RewardConfig(ped_mode="full"), judges=[F.lit(0.5)], mined=mined, keys=("k",)).select("k", "r_ped", "reward")
    assert {r.k: round(r.r_ped, 6) for r in scored.collect()} == {0: 0.5, 1: 0.4}
    assert Files(spark, folder).names(folder) == before


def test_rewards_read_no_loops(spark):
    """Loops are texts of their own, parsed entry by entry; no score needs them."""
    scored = rewards.score(_rollout(spark, "a"), rewards.RewardConfig(ped_mode="lite"))
    assert "from_json" not in scored._jdf.queryExecution().optimizedPlan().toString().replace("jsontostructs", "from_json")
    assert scored.count() == 1


def test_phases_follow_the_numbers_of_steps(spark):
    said = {"S10-1": "Summarize the general rule", "S2-2": "run the test cases", "S2-10": "explain what went wrong", "S1-1": "predict the result", "odd": "x", "S99999999999-1": "y"}
    steps = [{"id": k, "agent": "a", "instruction": v} for k, v in said.items()]
    told = lambda xs: json.dumps({"agents": [], "subtasks": [{"id": "S1", "name": "a", "steps": xs}], "execution_order": []})
    ordered = sorted(steps[:4], key=lambda s: tuple(int(x) for x in s["id"][1:].split("-"))) + [steps[4], steps[5]]
    renumbered = [s | {"id": f"S1-{i}"} for i, s in enumerate(ordered, 1)]
    rows = spark.createDataFrame([(0, told(steps)), (1, told(renumbered))], "k int, completion string").withColumns({"gold_plan": F.lit(None).cast("string"), "learner_profile": F.lit(None).cast("string")})
    got = {r.k: r.r_ped for r in rewards.score(rows, rewards.RewardConfig(ped_mode="lite")).collect()}
    assert got[0] == got[1] > 0
