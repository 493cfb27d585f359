"""Plan operators on hand-written plans, each with at most one defect."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from planlake import schemas
from planlake.operators import compare, rewards
from planlake.operators import plan as P
from planlake.plans import analysis

GOOD = {
    "agents": [{"agent_role": "tutor", "goal": "g", "backstory": "b", "tools": []}, {"agent_role": "runner", "goal": "g", "backstory": "b", "tools": ["CodeInterpreterTool"]}],
    "subtasks": [
        {"id": "S1", "name": "probe", "subtask_objective": "o1", "steps": [{"id": "S1-1", "agent": "tutor", "objective": "o", "instruction": "Ask the learner to predict.", "tool": None, "requires_human_input": True, "expected_output": "e", "depends_on": []}]},
        {
            "id": "S2",
            "name": "apply",
            "subtask_objective": "o2",
            "steps": [
                {"id": "S2-1", "agent": "runner", "objective": "o", "instruction": "Run the code.", "tool": "CodeInterpreterTool", "requires_human_input": False, "expected_output": "ok=true", "depends_on": ["S1-1"]},
                {"id": "S2-2", "agent": "tutor", "objective": "o", "instruction": "Summarize.", "tool": None, "requires_human_input": False, "expected_output": "e", "depends_on": ["S2-1"]},
            ],
        },
    ],
    "execution_order": ["S1-1", {"loop": {"steps": ["S2-1"], "condition": "S2-1.ok == false", "max_iterations": 3}}, "S2-2"],
}


def broken(change):
    plan = copy.deepcopy(GOOD)
    change(plan)
    return plan


def step(plan, i=0):
    return plan["subtasks"][1]["steps"][i]


DEFECTS = {
    "missing execution_order": lambda p: p.pop("execution_order"),
    "empty agents": lambda p: p.update(agents=[]),
    "agent without a key": lambda p: p["agents"][0].pop("goal"),
    "unknown tool of an agent": lambda p: p["agents"][0].update(tools=["Hammer"]),
    "undeclared agent": lambda p: step(p).update(agent="ghost"),
    "tool outside the pool": lambda p: step(p).update(tool="Hammer"),
    "tool not declared by the agent": lambda p: step(p, 1).update(tool="CodeInterpreterTool"),
    "execution_order differs from the steps": lambda p: p["execution_order"].append("S9-9"),
}


def frame(spark, plans):
    lines = [json.dumps({"question_id": str(i), "profile_index": 0, "plan": {"input": {"query": "q", "learner": {}}, "output": p}}) for i, p in enumerate(plans)]
    return spark.createDataFrame([(x,) for x in lines], "t string").select(F.from_json("t", schemas.PLAN_RECORD).alias("r")).select("r.*")


def test_measures_of_the_good_plan(spark):
    row = analysis.measured(frame(spark, [GOOD])).first()
    assert (row.n_agents, row.n_subtasks, row.n_steps, row.n_tools, row.n_loops) == (2, 2, 3, 1, 1)
    assert row.human_ratio == pytest.approx(1 / 3)
    assert row.dag.asDict() == {"n_nodes": 3, "n_edges": 2, "longest": 3, "width": 1, "parallel": 0.0}
    assert (row.dependency_completeness, row.tool_relevance, row.invalid_tool_calls, row.cyclic, row.any_issue) == (1.0, 1.0, 0, False, False)


@pytest.mark.parametrize("message", [None, *DEFECTS])
def test_strict_schema_names_the_defect(spark, message):
    plan = GOOD if message is None else broken(DEFECTS[message])
    assert P.strict_error(P.components(frame(spark, [plan]))).first().error == message


def test_cycles_and_unknown_parents(spark):
    two = broken(lambda p: p["subtasks"][0]["steps"][0].update(depends_on=["S2-2"]))
    own = broken(lambda p: step(p).update(depends_on=["S2-1"]))
    unknown = broken(lambda p: step(p).update(depends_on=["S8-1"]))
    rows = P.integrity(P.graph_measures(P.components(frame(spark, [two, own, unknown])))).orderBy("question_id").collect()
    assert [r.cyclic for r in rows] == [True, True, False]
    assert [r.dag.longest for r in rows] == [0, 0, 2]
    assert rows[2].unknown_dependency and rows[2].dag.n_edges == 2 and rows[2].dependency_completeness == 0.5


def test_width_of_parallel_steps(spark):
    wide = broken(lambda p: step(p, 1).update(depends_on=["S1-1"]))
    dag = P.graph_measures(P.components(frame(spark, [wide]))).first().dag
    assert (dag.longest, dag.width, round(dag.parallel, 4)) == (2, 2, 0.3333)


def test_rewards(spark):
    rows = spark.createDataFrame([("gold", json.dumps(GOOD)), ("fenced", f"```json\n{json.dumps(GOOD)}\n```"), ("prose", f"Here: {json.dumps(GOOD)} done"), ("garbage", "none")], "k string, completion string")
    rows = rows.withColumns({"gold_plan": F.lit(json.dumps(GOOD)), "learner_profile": F.lit("{}")})
    got = {r.k: round(r.reward, 6) for r in rewards.score(rows).collect()}
    assert got == {"gold": 0.55, "fenced": 0.55, "prose": 0.55, "garbage": -10.0}
    with pytest.raises(ValueError):
        rewards.RewardConfig(pers_mode="some")


def test_zscore(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 0.0), ("b", 2.0)], "g string, v double")
    assert sorted(round(r[0], 3) for r in df.select(rewards.group_zscore(F.col("v"), "g")).collect()) == [-1.732, 0.0, 0.577, 0.577, 0.577]


def test_similarity_is_symmetric_and_whole_on_itself(spark):
    other = broken(lambda p: p["agents"].append({"agent_role": "tutor", "goal": "g", "backstory": "b", "tools": []}))
    rows = P.components(frame(spark, [GOOD, other])).select("question_id", *rewards.COLUMNS)
    a, b = rows.where("question_id = '0'").select(F.struct(*rewards.COLUMNS).alias("a")), rows.where("question_id = '1'").select(F.struct(*rewards.COLUMNS).alias("b"))
    pick = lambda n: {k: F.col(f"{n}.{k}") for k in rewards.COLUMNS}
    r = a.join(b).select(P.similarity(pick("a"), pick("b")).alias("x"), P.similarity(pick("b"), pick("a")).alias("y"), P.similarity(pick("a"), pick("a")).alias("z")).first()
    assert r.x == r.y == pytest.approx((2 / 3 + 4) / 5) and r.z == 1.0


def test_pairs_within_questions(spark):
    rows = frame(spark, [GOOD, GOOD, GOOD]).withColumns({"profile_index": F.col("question_id").cast("int"), "question_id": F.lit("q")})
    pairs = compare.profile_divergence(compare.features(P.components(rows))).collect()
    assert len(pairs) == 3 and all(r.role == r.family == r.tools == 1.0 and r.step_diff == 0 for r in pairs)


def test_precedence(spark):
    rows = P.components(frame(spark, [GOOD, broken(lambda p: p["subtasks"].reverse()), broken(lambda p: p["subtasks"].pop())]))
    mined = P.mined_precedence(rows.where("question_id = '0'"))
    assert [(r.a, r.b) for r in mined.collect()] == [("probe", "apply")]
    got = {r.question_id: r.compatibility for r in P.precedence_compatibility(rows, mined, "question_id").collect()}
    assert got == {"0": 1.0, "1": 1.0, "2": 1.0}


def test_rubric(spark):
    row = P.rubric_checks(P.components(frame(spark, [GOOD]))).first()
    assert all(row[k] for k in ("tools_declared_are_used", "agents_are_used", "tools_in_pool", "order_covers_steps", "order_is_topological", "loops_are_sound"))
