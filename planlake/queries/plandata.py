"""Plan records made from orders: a plan for each order, a question for each customer, a step for each line item.

The same records are told twice, as nested structs for the operators and as flat tables in SQL, so that every measure of a plan has an
oracle that knows no nesting. Line items are numbered within their order; step n depends on step n // 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlake import schemas
from planlake.functions.nested import let
from planlake.operators import plan as P

#: Fixed values of the catalogue: what instructions and objectives say. The last two are long enough to be personal.
PHRASES = (
    "Ask the learner to predict the result before showing it.",
    "Look up the official documentation and explain the rule.",
    "Have the learner write a small program.",
    "Run the test cases and check that they pass.",
    "Explain what went wrong and what to fix.",
    "Summarize the general rule in their own words.",
    "Walk through the worked example step by step.",
    "Identify the error and its root cause.",
    "Iterate until the build compiles.",
    "Recall prior knowledge from your background.",
    "Because you build tools, start from your background and compare the new rule to it. Then state in one sentence what differs, and keep that sentence for the next step of the plan.",
    "When you are ready, take the furniture catalogue and sort its items by price. Write the order down, count the items in each group, and hand in the finished table before the next round begins.",
)
TOOLS_OF = {"A": ["RagTool"], "N": ["RagTool", "FileReadTool"], "R": []}
GHOST, NO_AGENTS = 17, 29

_PHRASES_SQL = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"

#: l: a row for each step (k plan, n place, m steps of the plan); g: a row for each plan.
LINES = f"""l0 AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax, l_discount, l_returnflag, l_linestatus) AS n,
  count(*) OVER (PARTITION BY l_orderkey) AS m, l_returnflag AS f, CASE l_linestatus WHEN 'F' THEN 'S1' ELSE 'S2' END AS sub, CAST(l_quantity AS BIGINT) AS q, l_partkey AS p, l_suppkey AS u, l_tax > 0.04 AS human FROM lineitem),
l AS (SELECT *, sub || '-' || n AS id, CASE WHEN q % {GHOST} = 0 THEN 'ghost' ELSE f END AS agent, CASE u % 5 WHEN 0 THEN 'RagTool' WHEN 1 THEN 'FileReadTool' WHEN 2 THEN '' WHEN 4 THEN CASE WHEN q % 11 = 0 THEN 'BadTool' ELSE 'RagTool' END END AS tool,
  {_PHRASES_SQL}[p % {len(PHRASES)} + 1] AS instruction, {_PHRASES_SQL}[q % {len(PHRASES)} + 1] AS objective, q % 13 = 0 AS dangling, q = 50 AND n = 1 AND m > 1 AS cyc,
  q % 19 <> 0 OR (m >= 4 AND n >= m - 1) AS ordered, m >= 4 AND n >= m - 1 AS looped FROM l0),
g AS (SELECT k, CAST(o_custkey AS VARCHAR) AS question_id, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, any_value(m) AS m, k % {NO_AGENTS} = 0 AS bare, list_sort(list(DISTINCT f)) AS roles,
  list_sort(list(DISTINCT sub)) AS subs, bool_or(cyc) AS cyclic FROM l JOIN orders ON o_orderkey = k GROUP BY k, o_custkey, o_orderkey)"""
#: Whether the agent of a step declares a tool, in SQL over l and g.
DECLARED = "(NOT g.bare AND ((agent = 'A' AND tool = 'RagTool') OR (agent = 'N' AND tool IN ('RagTool', 'FileReadTool'))))"
#: The name of a subtask.
NAME = "CASE {sub} WHEN 'S1' THEN 'Probe ' || k % 3 ELSE 'Apply ' || k % 2 END"


def _phrase(x: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (x % len(PHRASES)).cast("int") + 1)


def _step(x: Column, xs: Column) -> Column:
    n, m = x["n"], F.size(xs)
    parent = F.when(n > 1, F.array(F.element_at(xs, F.greatest(F.lit(1), F.floor(n / 2).cast("int")))["id"])).otherwise(F.array().cast("array<string>"))
    dangling = F.when(x["q"] % 13 == 0, F.array(F.lit("S9-9"))).otherwise(F.array().cast("array<string>"))
    back = F.when((x["q"] == 50) & (n == 1) & (m > 1), F.array(F.element_at(xs, F.least(F.lit(2), m))["id"])).otherwise(F.array().cast("array<string>"))
    u = x["u"] % 5
    tool = F.when(u == 0, "RagTool").when(u == 1, "FileReadTool").when(u == 2, "").when(u == 4, F.when(x["q"] % 11 == 0, "BadTool").otherwise("RagTool"))
    return F.struct(
        x["id"].alias("id"),
        F.when(x["q"] % GHOST == 0, "ghost").otherwise(x["f"]).alias("agent"),
        _phrase(x["q"]).alias("objective"),
        _phrase(x["p"]).alias("instruction"),
        tool.alias("tool"),
        x["human"].alias("requires_human_input"),
        F.lit("e").alias("expected_output"),
        F.concat(parent, dangling, back).alias("depends_on"),
    )


def _output(xs: Column, k: Column) -> Column:
    none = F.array().cast("array<string>")
    declared = F.create_map(*[c for f, tools in TOOLS_OF.items() for c in (F.lit(f), F.array(*[F.lit(t) for t in tools]).cast("array<string>"))])
    roles = F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["f"])))
    agents = F.transform(
        F.when(k % NO_AGENTS == 0, none).otherwise(roles),
        lambda f: F.struct(f.alias("agent_role"), F.concat(F.lit("goal "), f).alias("goal"), F.lit(None).cast("string").alias("backstory"), F.concat(F.lit("knows "), f).alias("description"), declared[f].alias("tools")),
    )
    subtasks = F.transform(
        F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["sub"]))),
        lambda s: F.struct(
            s.alias("id"),
            F.when(s == "S1", F.concat(F.lit("Probe "), (k % 3).cast("string"))).otherwise(F.concat(F.lit("Apply "), (k % 2).cast("string"))).alias("name"),
            _phrase(k).alias("subtask_objective"),
            F.transform(F.filter(xs, lambda x: x["sub"] == s), lambda x: _step(x, xs)).alias("steps"),
        ),
    )
    m = F.size(xs)
    looped = lambda x: (m >= 4) & (x["n"] >= m - 1)
    plain = F.transform(F.filter(xs, lambda x: (x["q"] % 19 != 0) & ~looped(x)), lambda x: x["id"])
    last = F.element_at(xs, -1)
    condition = F.when(k % 31 == 0, "").otherwise(F.concat(last["id"], F.lit(".ok == false")))
    inner = F.array_join(F.transform(F.filter(xs, looped), lambda x: F.concat(F.lit('"'), x["id"], F.lit('"'))), ",")
    loop = F.concat(F.lit('{"loop":{"steps":['), inner, F.lit('],"condition":"'), condition, F.lit('","max_iterations":'), (last["q"] % 6 + 1).cast("string"), F.lit("}}"))
    order = F.concat(plain, F.when(m >= 4, F.array(loop)).otherwise(none), F.when(k % 7 == 0, F.array(F.lit("S8-8"))).otherwise(none))
    return F.struct(agents.alias("agents"), subtasks.alias("subtasks"), order.alias("execution_order")).cast(schemas.OUTPUT)


def order_plans(t) -> DataFrame:
    """(question_id, profile_index, k, segment, plan) of all orders with line items."""
    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus"]
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*key))).alias("xs"))
    numbered = F.transform(
        "xs",
        lambda x, i: let(
            F.when(x["l_linestatus"] == "F", "S1").otherwise("S2"),
            lambda sub: F.struct(
                (i + 1).alias("n"), x["l_returnflag"].alias("f"), sub.alias("sub"), F.concat(sub, F.lit("-"), (i + 1).cast("string")).alias("id"), x["l_quantity"].cast("long").alias("q"), x["l_partkey"].alias("p"), x["l_suppkey"].alias("u"), (x["l_tax"] > 0.04).alias("human")
            ),
        ),
    )
    lines = lines.select(F.col("l_orderkey").alias("k"), numbered.alias("xs"))
    orders = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = orders.join(lines, F.col("o_orderkey") == F.col("k")).withColumn("profile_index", place)
    learner = F.struct(
        F.concat(F.lit("I trade in "), "c_mktsegment").alias("about_me"), F.array(F.lower("c_mktsegment")).alias("top_tags"), F.lit(None).cast("string").alias("self_description"), F.lit(None).cast("array<string>").alias("skills")
    )
    question = F.struct(F.concat(F.lit("question "), F.col("o_custkey").cast("string")).alias("query"), learner.alias("learner"))
    plan = F.struct(question.alias("input"), _output(F.col("xs"), F.col("k")).alias("output"))
    return rows.select(F.col("o_custkey").cast("string").alias("question_id"), "profile_index", "k", F.col("c_mktsegment").alias("segment"), plan.alias("plan"))


def order_components(t) -> DataFrame:
    return P.components(order_plans(t))


def _first(xs: Column, when: Column, change) -> Column:
    """xs with its first element changed where when holds."""
    return F.transform(xs, lambda x, i: F.when(when & (i == 0), change(x)).otherwise(x))


def with_faulty_roles(plans: DataFrame) -> DataFrame:
    """plans with faults for audits to find: of every eleventh the first agent comes twice, of every thirteenth the first has no role."""
    k, agents = F.col("k"), F.col("plan.output.agents")
    twice = F.when(k % 11 == 0, F.concat(agents, F.slice(agents, 1, 1))).otherwise(agents)
    return plans.withColumn("plan", F.col("plan").withField("output.agents", _first(twice, k % 13 == 0, lambda a: a.withField("agent_role", F.lit("")))))


def with_foreign_tools(plans: DataFrame) -> DataFrame:
    """plans with faults for audits to find: of every seventeenth the first agent has a tool outside the pool."""
    tooled = _first(F.col("plan.output.agents"), F.col("k") % 17 == 0, lambda a: a.withField("tools", F.array_append(a["tools"], F.lit("HomeMadeTool"))))
    return plans.withColumn("plan", F.col("plan").withField("output.agents", tooled))


def with_faulty_subtasks(plans: DataFrame) -> DataFrame:
    """plans with faults for audits to find: of every seventh, from the third on, all subtasks are called S1, and of every fifth, from the second on, the first has no name."""
    k = F.col("k")
    alike = F.transform("plan.output.subtasks", lambda s: F.when(k % 7 == 3, s.withField("id", F.lit("S1"))).otherwise(s))
    return plans.withColumn("plan", F.col("plan").withField("output.subtasks", _first(alike, k % 5 == 2, lambda s: s.withField("name", F.lit("")))))
