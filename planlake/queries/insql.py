"""Plans measured in SQL, by the session functions, beside the same measures by columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.queries import plans
from planlake.queries.plandata import order_plans
from planlake.queries.registry import catalogue
from planlake.sqlfunctions import register

query, QUERIES, SQL = catalogue()


@query(plans.SQL["q54_plan_graph"])
def q112_plan_graph_in_sql(t):
    register(t.spark)
    rows = order_plans(t).select("k", F.to_json("plan.output").alias("said"))
    return t.spark.sql(
        """WITH p AS (SELECT k, parse_plan(said) AS plan FROM {rows}), g AS (SELECT k, plan_step_ids(plan) AS ids, plan_edges(plan) AS edges, size(plan_all_edges(plan)) AS n_edges FROM p)
        SELECT k, has_cycle(ids, edges) AS cyclic, CAST(size(ids) AS BIGINT) AS n_nodes, CAST(n_edges AS BIGINT) AS n_edges, CAST(longest_path(ids, edges) AS BIGINT) AS longest, CAST(graph_width(ids, edges) AS BIGINT) AS width,
          round(parallelism(ids, edges), 6) AS parallel, round(dependency_completeness(ids, edges), 6) AS completeness FROM g""",
        rows=rows,
    )


@query(plans.SQL["q68_reward_off"])
def q113_reward_in_sql(t):
    register(t.spark)
    return t.spark.sql(
        """WITH p AS (SELECT k, parse_plan(completion) AS c, parse_plan(gold_plan) AS gold FROM {rows}), r AS (SELECT k, r_struct(c, gold) AS s, r_hard(c, 10.0D) AS h FROM p)
        SELECT k, round(s, 9) AS r_struct, h + 0.0D AS r_hard, 0.0D AS r_pers, 0.0D AS r_ped, round(compose_reward(s, 0.0D, 0.0D, h), 9) AS reward FROM r""",
        rows=plans._rollouts(t),
    )


@query(plans.SQL["q64_agent_load"])
def q114_plan_steps_in_sql(t):
    register(t.spark)
    return t.spark.sql(
        """WITH s AS (SELECT k, x.agent FROM (SELECT k, plan.output AS p FROM {rows}) r, LATERAL plan_steps(r.p) x), n AS (SELECT k, agent, count(*) AS n FROM s GROUP BY ALL)
        SELECT agent, count(*) AS n_plans, sum(n) AS n_steps, max(n) AS most FROM n GROUP BY agent""",
        rows=order_plans(t),
    )
