"""The measures in SQL: session functions over arrays, plans and rewards, and a table function that flattens a plan, for ``spark.sql``.

A plan is a STRUCT as ``parse_plan`` makes it of a text, of the type that ``schemas.OUTPUT`` names; components are read off it by further functions. Functions are temporary: call
``register`` once a session. The definitions are SQL, so that Catalyst inlines them as it does any expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from planlake import schemas

_LIST = "ARRAY<STRING>"
_EDGES = "ARRAY<STRUCT<src: STRING, dst: STRING>>"
_TYPES = {"LIST": _LIST, "EDGES": _EDGES, "PLAN": schemas.OUTPUT}

#: (name and parameters, type of the result, body). A function may use those before it.
FUNCTIONS = (
    # similarities
    ("set_jaccard(a LIST, b LIST)", "DOUBLE", "coalesce(try_divide(CAST(size(array_intersect(a, b)) AS DOUBLE), size(array_union(a, b))), 1.0D)"),
    ("word_set(t STRING)", "LIST", "filter(array_distinct(split(lower(trim(t)), '\\\\s+')), w -> w <> '')"),
    ("word_jaccard(a STRING, b STRING)", "DOUBLE", "CASE WHEN size(word_set(a)) > 0 AND size(word_set(b)) > 0 THEN set_jaccard(word_set(a), word_set(b)) END"),
    ("occurrences(xs LIST, x STRING)", "INT", "size(filter(xs, y -> y = x))"),
    (
        "multiset_jaccard(a LIST, b LIST)",
        "DOUBLE",
        "coalesce(try_divide(CAST(aggregate(array_union(a, b), 0, (n, k) -> n + least(size(filter(a, y -> y = k)), size(filter(b, y -> y = k)))) AS DOUBLE), aggregate(array_union(a, b), 0, (n, k) -> n + greatest(size(filter(a, y -> y = k)), size(filter(b, y -> y = k))))), 1.0D)",
    ),
    ("edge_jaccard(a EDGES, b EDGES)", "DOUBLE", "coalesce(try_divide(CAST(size(array_intersect(a, b)) AS DOUBLE), size(array_union(a, b))), 1.0D)"),
    # plans and their components
    ("parse_plan(t STRING)", "PLAN", "coalesce(try_variant_get(try_parse_json(t), '$.plan.output', '{PLAN}'), try_variant_get(try_parse_json(t), '$.output', '{PLAN}'), CASE WHEN ltrim(t) LIKE '{{%' THEN try_variant_get(try_parse_json(t), '$', '{PLAN}') END)"),
    ("plan_roles(p PLAN)", "LIST", "transform(coalesce(p.agents, array()), a -> a.agent_role)"),
    ("plan_names(p PLAN)", "LIST", "transform(coalesce(p.subtasks, array()), s -> s.name)"),
    ("plan_step_ids(p PLAN)", "LIST", "flatten(transform(coalesce(p.subtasks, array()), s -> transform(coalesce(s.steps, array()), t -> t.id)))"),
    ("plan_tools(p PLAN)", "LIST", "filter(flatten(transform(coalesce(p.subtasks, array()), s -> transform(coalesce(s.steps, array()), t -> t.tool))), x -> coalesce(x, '') <> '')"),
    (
        "plan_all_edges(p PLAN)",
        "EDGES",
        "flatten(flatten(transform(coalesce(p.subtasks, array()), s -> transform(coalesce(s.steps, array()), t -> transform(filter(coalesce(t.depends_on, array()), d -> coalesce(d, '') <> ''), d -> named_struct('src', d, 'dst', t.id))))))",
    ),
    ("plan_edges(p PLAN)", "EDGES", "array_distinct(plan_all_edges(p))"),
    # graphs
    ("known_edges(ids LIST, edges EDGES)", "EDGES", "filter(edges, e -> array_contains(ids, e.src))"),
    (
        "graph_layers(ids LIST, edges EDGES)",
        "STRUCT<left: ARRAY<STRING>, widths: ARRAY<INT>>",
        "aggregate(array_distinct(ids), named_struct('left', array_distinct(ids), 'widths', CAST(array() AS ARRAY<INT>)), (acc, x) -> transform(array(filter(acc.left, s -> NOT exists(edges, e -> e.dst = s AND array_contains(acc.left, e.src)))), "
        "free -> CASE WHEN size(free) = 0 THEN acc ELSE named_struct('left', array_except(acc.left, free), 'widths', array_append(acc.widths, size(free))) END)[0])",
    ),
    ("has_cycle(ids LIST, edges EDGES)", "BOOLEAN", "size(graph_layers(ids, edges).left) > 0"),
    ("is_acyclic(ids LIST, edges EDGES)", "BOOLEAN", "NOT has_cycle(ids, edges)"),
    ("longest_path(ids LIST, edges EDGES)", "INT", "CASE WHEN has_cycle(ids, edges) THEN 0 ELSE size(graph_layers(ids, edges).widths) END"),
    ("graph_width(ids LIST, edges EDGES)", "INT", "CASE WHEN has_cycle(ids, edges) THEN 0 ELSE coalesce(array_max(graph_layers(ids, edges).widths), 0) END"),
    ("parallelism(ids LIST, edges EDGES)", "DOUBLE", "CASE WHEN size(ids) > 0 THEN 1 - CAST(longest_path(ids, edges) AS DOUBLE) / size(array_distinct(ids)) ELSE 0.0D END"),
    ("dependency_completeness(ids LIST, edges EDGES)", "DOUBLE", "coalesce(try_divide(CAST(size(known_edges(ids, edges)) AS DOUBLE), size(edges)), 1.0D)"),
    (
        "tool_calls(p PLAN)",
        "STRUCT<used: INT, declared: INT>",
        "aggregate(flatten(transform(coalesce(p.subtasks, array()), s -> filter(coalesce(s.steps, array()), t -> coalesce(t.tool, '') <> ''))), named_struct('used', 0, 'declared', 0), "
        "(n, t) -> named_struct('used', n.used + 1, 'declared', n.declared + CAST(exists(coalesce(p.agents, array()), a -> coalesce(a.agent_role = t.agent AND array_contains(coalesce(a.tools, array()), t.tool), false)) AS INT)))",
    ),
    ("tool_relevance(p PLAN)", "DOUBLE", "coalesce(try_divide(CAST(tool_calls(p).declared AS DOUBLE), tool_calls(p).used), 1.0D)"),
    ("invalid_tool_calls(p PLAN)", "INT", "tool_calls(p).used - tool_calls(p).declared"),
    # likeness of plans, and rewards
    (
        "structural_similarity(a PLAN, b PLAN)",
        "DOUBLE",
        "(multiset_jaccard(plan_roles(a), plan_roles(b)) + set_jaccard(plan_names(a), plan_names(b)) + set_jaccard(plan_step_ids(a), plan_step_ids(b)) + edge_jaccard(plan_edges(a), plan_edges(b)) + set_jaccard(plan_tools(a), plan_tools(b))) / 5.0D",
    ),
    ("scaffold_score(a PLAN, b PLAN)", "DOUBLE", "0.5D * multiset_jaccard(plan_roles(a), plan_roles(b)) + 0.5D * set_jaccard(plan_names(a), plan_names(b))"),
    (
        "r_struct(c PLAN, gold PLAN)",
        "DOUBLE",
        "CASE WHEN c IS NULL THEN 0.0D ELSE 0.25D * CAST(is_acyclic(plan_step_ids(c), plan_edges(c)) AS INT) + 0.25D * dependency_completeness(plan_step_ids(c), plan_edges(c)) + 0.20D * tool_relevance(c) + 0.30D * CASE WHEN gold IS NULL THEN 0.0D ELSE structural_similarity(c, gold) END END",
    ),
    (
        "is_usable(c PLAN)",
        "BOOLEAN",
        "coalesce(size(c.agents) > 0 AND size(c.subtasks) > 0 AND forall(c.agents, a -> coalesce(a.agent_role, '') <> '') AND forall(c.subtasks, s -> coalesce(s.id, '') <> '' AND forall(coalesce(s.steps, array()), t -> coalesce(t.id, '') <> '' AND coalesce(t.agent, '') <> '' AND coalesce(t.instruction, '') <> '')), false)",
    ),
    ("r_hard(c PLAN, penalty DOUBLE)", "DOUBLE", "CASE WHEN c IS NOT NULL AND is_usable(c) AND is_acyclic(plan_step_ids(c), plan_edges(c)) AND invalid_tool_calls(c) = 0 THEN 0.0D ELSE -penalty END"),
    ("r_counterfactual(c PLAN, gold PLAN, other PLAN)", "DOUBLE", "CASE WHEN other IS NULL THEN 0.0D ELSE CASE WHEN c IS NULL OR gold IS NULL THEN 0.0D ELSE structural_similarity(c, gold) END - CASE WHEN c IS NULL THEN 0.0D ELSE structural_similarity(c, other) END END"),
    ("upper_median(xs ARRAY<DOUBLE>)", "DOUBLE", "try_element_at(array_sort(xs), CAST(size(xs) / 2 AS INT) + 1)"),
    ("compose_reward(struct_part DOUBLE, pers_part DOUBLE, ped_part DOUBLE, hard_part DOUBLE)", "DOUBLE", "0.55D * struct_part + 0.25D * pers_part + 0.20D * ped_part + hard_part"),
)

#: (name and parameters, columns, query).
TABLE_FUNCTIONS = (
    (
        "plan_steps(p PLAN)",
        "subtask_idx INT, subtask STRING, step_idx INT, id STRING, agent STRING, tool STRING, instruction STRING, depends_on ARRAY<STRING>",
        # one generator over nothing else: a lateral join with it becomes that generator, where a subquery of several would be joined back by the whole plan
        "SELECT * FROM inline(flatten(transform(coalesce(p.subtasks, array()), (s, i) -> transform(coalesce(s.steps, array()), (t, j) -> named_struct('subtask_idx', i, 'subtask', s.name, 'step_idx', j, "
        "'id', t.id, 'agent', t.agent, 'tool', t.tool, 'instruction', t.instruction, 'depends_on', t.depends_on)))))",
    ),
)


def _typed(text: str) -> str:
    for name, kind in _TYPES.items():
        text = text.replace(f" {name}", f" {kind}")
    return text


def register(spark: SparkSession) -> None:
    """Makes all functions known to the session, in place of any of their names."""
    for signature, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_typed(signature)} RETURNS {_typed(' ' + kind).strip()} RETURN {body.replace('{PLAN}', schemas.OUTPUT).replace('{{', '{')}")
    for signature, columns, body in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_typed(signature)} RETURNS TABLE ({columns}) RETURN {body}")
