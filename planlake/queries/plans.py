"""The plan operators over plans made from orders: sizes, graphs, validators, audits, rewards, training rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planlake.functions.normalize import agent, learner, outline, schedule
from planlake.functions.text import PEDAGOGY, PHASES, PLAN_ANCHORS, SECOND_PERSON, SKELETON
from planlake.operators import audit, compare, rewards, training
from planlake.operators import plan as P
from planlake.queries.plandata import DECLARED, LINES, NAME, order_components, order_plans, with_faulty_roles, with_faulty_subtasks, with_foreign_tools
from planlake.queries.registry import catalogue

query, QUERIES, SQL = catalogue()

_NL = "chr(10)"


@query(f"""WITH {LINES} SELECT l.k, CASE WHEN any_value(bare) THEN 0 ELSE len(any_value(roles)) END::BIGINT AS n_agents, len(any_value(subs))::BIGINT AS n_subtasks, count(*) AS n_steps,
 round(count(*) / len(any_value(subs)), 6) AS steps_per_subtask, CASE WHEN any_value(bare) THEN 0 ELSE list_contains(any_value(roles), 'A')::INT + 2 * list_contains(any_value(roles), 'N')::INT END::BIGINT AS n_tools,
 CASE WHEN any_value(bare) THEN 0 WHEN list_contains(any_value(roles), 'N') THEN 2 WHEN list_contains(any_value(roles), 'A') THEN 1 ELSE 0 END::BIGINT AS n_distinct_tools, (count(*) >= 4)::BIGINT AS n_loops,
 count(*) FILTER (looped) AS n_loop_steps, CASE WHEN count(*) >= 4 THEN arg_max(q, n) % 6 + 1 ELSE 0 END::BIGINT AS max_iterations, count(*) FILTER (human) AS n_human, round(count(*) FILTER (human) / count(*), 6) AS human_ratio
 FROM l JOIN g USING (k) GROUP BY l.k""")
def q53_plan_complexity(t):
    rows = P.complexity(order_components(t))
    whole = ("n_agents", "n_subtasks", "n_steps", "n_tools", "n_distinct_tools", "n_loops", "n_loop_steps", "max_iterations", "n_human")
    return rows.na.fill(0, ["max_iterations"]).select("k", *[F.col(c).cast("long").alias(c) for c in whole], F.round("steps_per_subtask", 6).alias("steps_per_subtask"), F.round("human_ratio", 6).alias("human_ratio"))


@query(f"""WITH {LINES}, w AS (SELECT k, max(c) AS width FROM (SELECT k, floor(log2(n)) AS d, count(*) AS c FROM l GROUP BY ALL) GROUP BY k)
SELECT l.k, any_value(cyclic) AS cyclic, count(*) AS n_nodes, (count(*) - 1 + count(*) FILTER (dangling) + count(*) FILTER (cyc))::BIGINT AS n_edges, CASE WHEN any_value(cyclic) THEN 0 ELSE max(floor(log2(n))) + 1 END::BIGINT AS longest,
 CASE WHEN any_value(cyclic) THEN 0 ELSE any_value(width) END::BIGINT AS width, round(CASE WHEN any_value(cyclic) THEN 1 ELSE 1 - (max(floor(log2(n))) + 1) / count(*) END, 6) AS parallel,
 round(CASE WHEN count(*) - 1 + count(*) FILTER (dangling) + count(*) FILTER (cyc) = 0 THEN 1 ELSE (count(*) - 1 + count(*) FILTER (cyc)) / (count(*) - 1 + count(*) FILTER (dangling) + count(*) FILTER (cyc)) END, 6) AS completeness
 FROM l JOIN g USING (k) JOIN w USING (k) GROUP BY l.k""")
def q54_plan_graph(t):
    rows = P.graph_measures(order_components(t))
    whole = [F.col(f"dag.{c}").cast("long").alias(c) for c in ("n_nodes", "n_edges", "longest", "width")]
    return rows.select("k", "cyclic", *whole, F.round("dag.parallel", 6).alias("parallel"), F.round("dependency_completeness", 6).alias("completeness"))


@query(f"""WITH {LINES}, s AS (SELECT l.*, bare, roles, coalesce(tool, '') <> '' AS uses, coalesce({DECLARED}, false) AS ok FROM l JOIN g USING (k))
SELECT k, count(*) FILTER (uses AND NOT ok) AS invalid_tool_calls, count(*) FILTER (bare OR NOT list_contains(roles, agent)) AS unknown_agents, count(*) FILTER (dangling) AS unknown_dependencies,
 round(coalesce(count(*) FILTER (uses AND ok) / nullif(count(*) FILTER (uses), 0), 1), 6) AS relevance FROM s GROUP BY k""")
def q55_plan_references(t):
    rows = P.graph_measures(order_components(t))
    return rows.select("k", *[F.col(c).cast("long").alias(c) for c in ("invalid_tool_calls", "unknown_agents", "unknown_dependencies")], F.round("tool_relevance", 6).alias("relevance"))


_FLAGS = f"""s AS (SELECT l.k, any_value(bare) AS bare, any_value(cyclic) AS cyclic, bool_or(bare OR NOT list_contains(roles, agent)) AS ghost, bool_or(tool = 'BadTool') IS TRUE AS outside, bool_or(coalesce(tool, '') <> '' AND NOT coalesce({DECLARED}, false)) AS undeclared,
 l.k % 7 = 0 AS extra, bool_or(NOT ordered) AS missing, bool_or(dangling) AS dangling FROM l JOIN g USING (k) GROUP BY l.k)"""


@query(f"""WITH {LINES}, {_FLAGS}, e AS (SELECT CASE WHEN bare THEN 'empty agents' WHEN ghost THEN 'undeclared agent' WHEN outside THEN 'tool outside the pool' WHEN undeclared THEN 'tool not declared by the agent'
 WHEN extra OR missing THEN 'execution_order differs from the steps' END AS error FROM s) SELECT error, count(*) AS n FROM e GROUP BY error""")
def q56_strict_schema(t):
    return P.strict_error(order_components(t)).groupBy("error").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, {_FLAGS} SELECT count(*) AS n, count(*) FILTER (ghost) AS unknown_agent, count(*) FILTER (dangling) AS unknown_dependency, count(*) FILTER (extra) AS order_unknown, count(*) FILTER (missing) AS order_missing,
 count(*) FILTER (cyclic) AS in_cycle, count(*) FILTER (ghost OR dangling OR extra OR missing OR cyclic) AS any_issue FROM s""")
def q57_integrity(t):
    flags = ("unknown_agent", "unknown_dependency", "order_unknown", "order_missing", "in_cycle", "any_issue")
    return P.integrity(order_components(t)).agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in flags])


@query(f"""WITH {LINES}, {_FLAGS} SELECT count(*) AS n, round(avg((NOT bare)::INT), 6) AS schema_valid, round(avg((NOT cyclic)::INT), 6) AS no_cycle, round(avg((NOT undeclared)::INT), 6) AS no_invalid_tool, count(*) FILTER (undeclared) AS n_invalid_tool FROM s""")
def q58_mechanical_audit(t):
    return audit.mechanical(order_components(t)).select("n", *[F.round(c, 6).alias(c) for c in ("schema_valid", "no_cycle", "no_invalid_tool")], "n_invalid_tool")


@query(f"""WITH {LINES}, p AS (SELECT CASE WHEN bare THEN 0 ELSE len(roles) + (k % 11 = 0)::INT END AS a, len(subs) AS s, NOT bare AND k % 11 = 0 AND k % 13 <> 0 AS twice, len(subs) = 2 AND k % 7 = 3 AS ids, NOT bare AND k % 13 = 0 AS role, k % 5 = 2 AS name FROM g)
SELECT count(*) AS n, round(avg(a), 6) AS mean_agents, median(a)::DOUBLE AS median_agents, min(a)::BIGINT AS min_agents, max(a)::BIGINT AS max_agents, round(avg(s), 6) AS mean_subtasks, median(s)::DOUBLE AS median_subtasks, min(s)::BIGINT AS min_subtasks,
 max(s)::BIGINT AS max_subtasks, round(avg(twice::INT), 6) AS repeated_roles, round(avg(ids::INT), 6) AS repeated_ids, round(avg(role::INT), 6) AS empty_role, round(avg(name::INT), 6) AS empty_name FROM p""")
def q59_outline_audit(t):
    out = audit.outlines(P.components(with_faulty_subtasks(with_faulty_roles(order_plans(t)))))
    cast = {c: F.col(c).cast("long") for c in ("min_agents", "max_agents", "min_subtasks", "max_subtasks")}
    return out.withColumns(cast | {c: F.round(c, 6) for c in ("mean_agents", "mean_subtasks", "repeated_roles", "repeated_ids", "empty_role", "empty_name")} | {c: F.col(c).cast("double") for c in ("median_agents", "median_subtasks")})


@query(f"""WITH {LINES}, s AS (SELECT l.k, count(*) AS steps, count(*) FILTER (bare OR NOT list_contains(roles, agent)) AS agent, count(*) FILTER (tool IS NOT NULL AND NOT coalesce({DECLARED}, false)) AS tool, (l.k % 7 = 0)::INT AS extra, (count(*) >= 4 AND l.k % 31 = 0)::INT AS loops, count(*) FILTER (l.k % 7 = 3 AND sub = 'S2') AS prefix FROM l JOIN g USING (k) GROUP BY l.k)
SELECT count(*) AS n, round(sum(agent) / sum(steps), 6) AS unknown_agent, round(sum(tool) / sum(steps), 6) AS bad_tool, round(sum(prefix) / sum(steps), 6) AS bad_prefix, round(sum(extra) / count(*), 6) AS unknown_in_order, sum(loops)::BIGINT AS bad_loops,
 round(avg(steps), 6) AS mean_steps, median(steps)::DOUBLE AS median_steps, min(steps)::BIGINT AS min_steps, max(steps)::BIGINT AS max_steps FROM s""")
def q60_schedule_audit(t):
    out = audit.schedules(P.components(with_faulty_subtasks(order_plans(t))))
    rounded = {c: F.round(c, 6) for c in ("unknown_agent", "bad_tool", "bad_prefix", "unknown_in_order", "mean_steps")}
    return out.withColumns(rounded | {"median_steps": F.col("median_steps").cast("double")})


@query(f"""WITH {LINES}, v AS (SELECT 'role' AS kind, unnest(roles) AS value FROM g WHERE NOT bare UNION ALL SELECT 'name', {NAME.format(sub='s')} FROM (SELECT k, unnest(subs) AS s FROM g)), c AS (SELECT kind, value, count(*) AS n FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS place FROM c) SELECT kind, count(*) AS n_distinct, sum(n)::BIGINT AS n, round(sum(n) FILTER (place <= 2) / sum(n), 6) AS top_share FROM r GROUP BY kind""")
def q61_diversity_audit(t):
    return audit.diversity(order_components(t), 2).select("kind", "n_distinct", "n", F.round("top_share", 6).alias("top_share"))


@query(f"""WITH {LINES}, c AS (SELECT l.k, count(*) >= 4 AS loop, l.k % 31 = 0 AS blank, arg_max(q, n) % 6 + 1 AS rounds, arg_max(id, n) AS last FROM l GROUP BY l.k)
SELECT k, CASE WHEN NOT blank THEN last END AS step, NOT blank AND rounds BETWEEN 2 AND 5 AS ok, blank AS bad FROM c WHERE loop""")
def q62_loop_conditions(t):
    rows = order_components(t).select("k", F.explode("loops").alias("x"))
    parsed = P.loop_condition(F.col("x"))
    return rows.select("k", parsed["step"].alias("step"), parsed["ok"].alias("ok"), P.bad_loop(F.col("x")).alias("bad"))


_DECLARED_TOOLS = "CASE r WHEN 'A' THEN ['RagTool'] WHEN 'N' THEN ['FileReadTool', 'RagTool'] ELSE CAST([] AS VARCHAR[]) END"


@query(f"""WITH {LINES}, a AS (SELECT k, r, {_DECLARED_TOOLS} AS declared FROM (SELECT k, unnest(roles) AS r FROM g WHERE NOT bare)), u AS (SELECT a.k, r, any_value(declared) AS declared, list_sort(list_filter(list(DISTINCT tool), lambda x: coalesce(x, '') <> '')) AS used, count(l.k) AS n FROM a LEFT JOIN l ON l.k = a.k AND l.agent = r GROUP BY ALL),
v AS (SELECT k, bool_and(coalesce(used, CAST([] AS VARCHAR[])) = declared) AS used, bool_and(n > 0) AS busy FROM u GROUP BY k), c AS (SELECT l.k, NOT (l.k % 7 = 0 OR bool_or(NOT ordered)) AS covered,
 NOT bool_or((l.n > 1 AND po AND NOT ordered) OR (cyc AND so)) AS topological, count(*) < 4 OR (l.k % 31 <> 0 AND arg_max(q, l.n) % 6 + 1 BETWEEN 2 AND 5) AS sound
 FROM (SELECT l.*, p.ordered AS po, x.ordered AS so FROM l LEFT JOIN l p ON p.k = l.k AND p.n = l.n // 2 LEFT JOIN l x ON x.k = l.k AND x.n = 2) l GROUP BY l.k)
SELECT count(*) AS n, count(*) FILTER (coalesce(used, true) AND (bare OR k % 17 <> 0)) AS tools_declared_are_used, count(*) FILTER (coalesce(busy, true)) AS agents_are_used, count(*) FILTER (bare OR k % 17 <> 0) AS tools_in_pool, count(*) FILTER (covered) AS order_covers_steps,
 count(*) FILTER (coalesce(topological, true)) AS order_is_topological, count(*) FILTER (sound) AS loops_are_sound FROM c LEFT JOIN v USING (k) JOIN g USING (k)""")
def q63_rubric_checks(t):
    checks = ("tools_declared_are_used", "agents_are_used", "tools_in_pool", "order_covers_steps", "order_is_topological", "loops_are_sound")
    rows = P.components(with_foreign_tools(order_plans(t)))
    return P.rubric_checks(rows).agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in checks])


@query(f"WITH {LINES} SELECT agent, count(*) AS n_plans, sum(n)::BIGINT AS n_steps, max(n)::BIGINT AS most FROM (SELECT k, agent, count(*) AS n FROM l GROUP BY ALL) GROUP BY agent")
def q64_agent_load(t):
    load = P.agent_load(order_components(t), "k")
    return load.groupBy("agent").agg(F.count("*").alias("n_plans"), F.sum("n_steps").alias("n_steps"), F.max("n_steps").alias("most"))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_BODY = f"""t AS (SELECT k, sub, {NAME.format(sub='sub')} || {_NL} || any_value(ph) || {_NL} || string_agg(objective || {_NL} || instruction || {_NL} || 'e', {_NL} ORDER BY n) AS x, {NAME.format(sub='sub')} || {_NL} || any_value(ph) AS o FROM
 (SELECT l.*, PHRASES[l.k % 12 + 1] AS ph FROM l) l GROUP BY k, sub),
b AS (SELECT g.k, CASE WHEN any_value(bare) THEN '' ELSE list_aggregate(list_transform(any_value(roles), lambda f: 'goal ' || f || {_NL} || 'knows ' || f), 'string_agg', {_NL}) || {_NL} END || string_agg(x, {_NL} ORDER BY sub) AS body, string_agg(o, {_NL} ORDER BY sub) AS outline FROM t JOIN g USING (k) GROUP BY g.k)"""


def _with_phrases(sql: str) -> str:
    from planlake.queries.plandata import _PHRASES_SQL

    return sql.replace("PHRASES[", f"{_PHRASES_SQL}[")


_HAS = ", ".join(f"regexp_matches(body, '(?i){_quoted(p)}') AS has_{n}" for n, p in PEDAGOGY)
_ACTS = ", ".join(f"regexp_matches(outline, '(?i){_quoted(p)}') AS act_{n}" for n, p in SKELETON)
_HITS = ", ".join(f"count(*) FILTER (regexp_matches(instruction, '(?i){_quoted(p)}')) AS n_{n}" for n, p in PEDAGOGY)
_DIVERSITY = " + ".join(f"has_{n}::INT" for n, _ in PEDAGOGY)


@query(_with_phrases(f"""WITH {LINES}, {_BODY}, h AS (SELECT k, md5(body) AS body, {_HAS}, {_ACTS} FROM b), c AS (SELECT k, {_HITS} FROM l GROUP BY k)
SELECT *, CAST({_DIVERSITY} AS BIGINT) AS diversity FROM h JOIN c USING (k)"""))
def q65_pedagogy_vector(t):
    rows = P.pedagogy(order_components(t))
    names = [n for n, _ in PEDAGOGY]
    flags = [F.col(f"has_{n}") for n in names] + [F.col(f"act_{n}") for n, _ in SKELETON]
    return rows.select("k", F.md5("body").alias("body"), *flags, *[F.col(f"n_{n}").cast("long").alias(f"n_{n}") for n in names], F.col("diversity").cast("long").alias("diversity"))


_SECOND = _quoted(SECOND_PERSON)
_ANCHORS = " + ".join(f"(length(body) - length(replace(body, '{_quoted(a)}', ''))) // {len(a)}" for a in PLAN_ANCHORS)


@query(_with_phrases(f"""WITH {LINES}, {_BODY}, d AS (SELECT k, lower(body) AS body, lower(c_mktsegment) AS skill, list_filter(regexp_extract_all('i trade in ' || lower(c_mktsegment), '[A-Za-z][A-Za-z0-9_+#\\.-]+'), lambda w: length(w) >= 4) AS words FROM b JOIN g USING (k) JOIN customer ON c_custkey = c),
s AS (SELECT k, round(avg(regexp_matches(instruction, '(?i){_SECOND}')::INT), 6) AS second_person FROM l GROUP BY k)
SELECT k, second_person, CAST({_ANCHORS} AS BIGINT) AS n_anchors, contains(body, skill)::INT::DOUBLE AS skill_share, round(len(list_filter(words, lambda w: contains(body, w))) / len(words), 6) AS token_share FROM d JOIN s USING (k)"""))
def q66_personalization_vector(t):
    who = learner(F.col("plan.input.learner"))
    rows = P.personalization(order_components(t), who["description"], who["skills"])
    return rows.select("k", F.round("second_person", 6).alias("second_person"), F.col("n_anchors").cast("long").alias("n_anchors"), "skill_share", F.round("token_share", 6).alias("token_share"))


_SETS = """f AS (SELECT g.k, g.c, g.i, CASE WHEN bare THEN CAST([] AS VARCHAR[]) ELSE roles END AS roles, list_transform(subs, lambda s: CASE s WHEN 'S1' THEN 'Probe ' || g.k % 3 ELSE 'Apply ' || g.k % 2 END) AS names, e.* EXCLUDE (k) FROM g JOIN
 (SELECT k, list(id) AS ids, list_distinct(list_concat(list_concat(list(pid || '>' || id) FILTER (n > 1), list('S9-9>' || id) FILTER (dangling)), list(second || '>' || id) FILTER (cyc))) AS edges, list_distinct(list(tool) FILTER (coalesce(tool, '') <> '')) AS tools FROM
  (SELECT l.*, p.id AS pid, x.id AS second FROM l LEFT JOIN l p ON p.k = l.k AND p.n = l.n // 2 LEFT JOIN l x ON x.k = l.k AND x.n = 2) GROUP BY k) e USING (k))"""


def _jaccard(x: str) -> str:
    a, b = f"coalesce(a.{x}, CAST([] AS VARCHAR[]))", f"coalesce(b.{x}, CAST([] AS VARCHAR[]))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


_SIMILAR = "(" + " + ".join(_jaccard(x) for x in ("roles", "names", "ids", "edges", "tools")) + ") / 5"


def _with_before(rows, *columns: str):
    """rows with the same columns of the plan before it of the question, prefixed."""
    w = Window.partitionBy("question_id").orderBy("profile_index")
    return rows.withColumns({f"before_{c}": F.lag(c).over(w) for c in columns}).where("profile_index > 0")


@query(f"""WITH {LINES}, {_SETS} SELECT a.k, round({_SIMILAR}, 6) AS similarity, round(0.5 * ({_jaccard('roles')}) + 0.5 * ({_jaccard('names')}), 6) AS scaffold FROM f a JOIN f b ON a.c = b.c AND a.i = b.i + 1""")
def q67_structural_similarity(t):
    names = ("roles", "names", "step_ids", "edges", "step_tools")
    rows = _with_before(order_components(t).select("question_id", "profile_index", "k", *names), *names)
    a, b = {c: F.col(c) for c in names}, {c: F.col(f"before_{c}") for c in names}
    return rows.select("k", F.round(P.similarity(a, b), 6).alias("similarity"), F.round(P.scaffold_score(a, b), 6).alias("scaffold"))


def _phase_case(text: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({text}, '{_quoted(w)}')" for w in ws) + f" THEN '{n}'" for n, ws in PHASES) + " END"


_PHASED = f"""ph AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY sub, n) - 1 AS pos, {_phase_case("lower(instruction || ' ' || objective)")} AS phase FROM l),
pf AS (SELECT k, count(*) AS n, {", ".join(f"min(pos) FILTER (phase = '{n}') AS {n}" for n, _ in PHASES)} FROM ph GROUP BY k),
po AS (SELECT *, list_filter([{", ".join(n for n, _ in PHASES)}], lambda x: x IS NOT NULL) AS v FROM pf),
phases AS (SELECT k, (coalesce(probe < greatest(CAST(floor(n * 0.5) AS BIGINT), 1), false)::INT + (validate IS NOT NULL)::INT + (feedback IS NOT NULL)::INT + coalesce(consolidate >= CAST(floor(n * 0.6::DOUBLE) AS BIGINT), false)::INT + (len(v) >= 2 AND v = list_sort(v))::INT) / 5 AS ped FROM po)"""
_PERSONAL = """personal AS (SELECT l.k, least(count(*) FILTER (p % 12 = 10 OR (p % 12 = 11 AND lower(c_mktsegment) = 'furniture')) / count(*), 1) * 0.8 AS pers FROM l JOIN g USING (k) JOIN customer ON c_custkey = c GROUP BY l.k)"""
_STRUCT = f"""st AS (SELECT l.k, 0.25 * (NOT any_value(cyclic))::INT + 0.25 * CASE WHEN count(*) - 1 + count(*) FILTER (dangling) + count(*) FILTER (cyc) = 0 THEN 1 ELSE (count(*) - 1 + count(*) FILTER (cyc)) / (count(*) - 1 + count(*) FILTER (dangling) + count(*) FILTER (cyc)) END
 + 0.20 * coalesce(count(*) FILTER (coalesce({DECLARED}, false) AND coalesce(tool, '') <> '') / nullif(count(*) FILTER (coalesce(tool, '') <> ''), 0), 1) AS own,
 CASE WHEN any_value(bare) OR any_value(cyclic) OR bool_or(coalesce(tool, '') <> '' AND NOT coalesce({DECLARED}, false)) THEN -10.0 ELSE 0.0 END AS hard FROM l JOIN g USING (k) GROUP BY l.k)"""


def _rollouts(t):
    """A rollout for each plan but a question's first two: the plan answers, the one before it is gold, and the one before that counterfactual."""
    rows = order_plans(t).select("question_id", "profile_index", "k", F.to_json("plan.output").alias("completion"), F.to_json("plan.input.learner").alias("learner_profile"))
    w = Window.partitionBy("question_id").orderBy("profile_index")
    return rows.withColumns({"gold_plan": F.lag("completion").over(w), "cf_plan": F.lag("completion", 2).over(w)}).where("profile_index > 1")


def _scored(t, config, **more):
    names = ("r_struct", "r_hard", "r_pers", "r_ped", "reward")
    scored = rewards.score(_rollouts(t), config, **more)
    return scored.select("k", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in names])  # + 0: no negative zeros


_PAIRED = f"x AS (SELECT a.k, {_SIMILAR} AS sim FROM f a JOIN f b ON a.c = b.c AND a.i = b.i + 1), y AS (SELECT a.k, {_SIMILAR} AS sim FROM f a JOIN f b ON a.c = b.c AND a.i = b.i + 2)"
_JOINED = "st JOIN x USING (k) JOIN y USING (k) JOIN phases USING (k) JOIN personal USING (k)"


def _reward_sql(pers: str, ped: str, more: str = "", joined: str = "") -> str:
    return f"""WITH {LINES}, {_SETS}, {_PHASED}, {_PERSONAL}, {_STRUCT}, {_PAIRED}{', ' + more if more else ''}, r AS (SELECT k, own + 0.30 * x.sim AS s, hard, {pers} AS p, {ped} AS d FROM {_JOINED} {joined})
SELECT k, round(s, 9) AS r_struct, hard::DOUBLE AS r_hard, round(p, 9)::DOUBLE + 0.0 AS r_pers, round(d, 9)::DOUBLE AS r_ped, round(0.55 * s + 0.25 * p + 0.20 * d + hard, 9) AS reward FROM r"""


@query(_reward_sql("0.0", "0.0"))
def q68_reward_off(t):
    return _scored(t, rewards.RewardConfig())


@query(_reward_sql("pers", "0.5 * ped"))
def q69_reward_lite(t):
    return _scored(t, rewards.RewardConfig(pers_mode="lite", ped_mode="lite"))


#: What four judges say of a plan, told by its number, and whether a plan's subtasks stand in an order that is mined.
_JUDGES = (5, 7, 3, 11)
_MINED = """mo AS (SELECT k, CASE WHEN len(subs) = 2 THEN ['probe ' || k % 3, 'apply ' || k % 2] END AS pair FROM g), mm AS (SELECT DISTINCT pair FROM mo WHERE pair IS NOT NULL AND k % 4 = 0 AND k % 3 <> 0),
mined AS (SELECT mo.k, CASE WHEN mo.pair IS NULL THEN 1.0 ELSE (mm.pair IS NOT NULL)::INT END::DOUBLE AS prec FROM mo LEFT JOIN mm ON mm.pair = mo.pair)"""
_MEDIAN = f"list_sort([{', '.join(f'(k % {j})::DOUBLE / {j}' for j in _JUDGES)}])[3]"


@query(_reward_sql("x.sim - y.sim", f"0.2 * (0.5 * prec + 0.5 * ped) + 0.8 * {_MEDIAN}", _MINED, "JOIN mined USING (k)"))
def q70_reward_full(t):
    judges = [(F.col("k") % j).cast("double") / j for j in _JUDGES]
    mined = P.mined_precedence(order_components(t).where("k % 4 = 0 AND k % 3 <> 0"))
    return _scored(t, rewards.RewardConfig(pers_mode="counterfactual", ped_mode="full"), judges=judges, mined=mined, keys=("k",))


@query(f"""WITH {LINES}, o AS (SELECT k, subs, CASE WHEN len(subs) = 2 THEN ['probe ' || k % 3, 'apply ' || k % 2] END AS pair FROM g), m AS (SELECT DISTINCT pair FROM o WHERE pair IS NOT NULL AND k % 4 = 0 AND k % 3 <> 0)
SELECT o.k, CASE WHEN o.pair IS NULL THEN 1.0 ELSE (m.pair IS NOT NULL)::INT END::DOUBLE AS compatibility FROM o LEFT JOIN m ON m.pair = o.pair""")
def q71_precedence(t):
    rows = order_components(t)
    mined = P.mined_precedence(rows.where("k % 4 = 0 AND k % 3 <> 0"))
    return P.precedence_compatibility(rows, mined, "k")


@query(f"""WITH {LINES}, {_SETS}, p AS (SELECT a.c, a.i, b.i AS j, {_jaccard('roles')} AS role, abs(len(a.ids) - len(b.ids)) AS step_diff FROM f a JOIN f b ON a.c = b.c AND a.i < b.i)
SELECT c_mktsegment AS segment, count(*) AS pairs, round(avg(1 - role), 6) AS role, round(avg(step_diff), 6) AS step_diff FROM p JOIN customer ON c_custkey = c GROUP BY 1""")
def q72_profile_divergence(t):
    rows = order_components(t)
    pairs = compare.profile_divergence(compare.features(rows))
    groups = t.customer.select(F.col("c_custkey").cast("string").alias("question_id"), F.col("c_mktsegment").alias("group"))
    by_group = compare.group_divergence(pairs, groups, "role")
    steps = pairs.join(groups, "question_id").groupBy("group").agg(F.round(F.avg("step_diff"), 6).alias("step_diff"))
    return by_group.join(steps, "group").select(F.col("group").alias("segment"), "pairs", F.round("role", 6).alias("role"), "step_diff")


_KIND = "CASE k % 5 WHEN 0 THEN 'fence' WHEN 1 THEN 'prose' WHEN 2 THEN 'cut' WHEN 3 THEN 'none' ELSE 'plain' END"


@query(f"""WITH {LINES}, v AS (SELECT cyclic, k % 5 <> 3 AS pad, k % 5 NOT IN (2, 3) AS sdp FROM g)
SELECT 'pad' AS mode, count(*) AS n, round(avg(pad::INT), 6) AS schema_valid, round(avg((pad AND NOT cyclic)::INT), 6) AS acyclic FROM v
UNION ALL SELECT unnest(['sdp', 'full']), count(*), round(avg(sdp::INT), 6), round(avg((sdp AND NOT cyclic)::INT), 6) FROM v""")
def q73_validity_rates(t):
    out = F.to_json("plan.output")
    kind = F.col("k") % 5
    cut = F.to_json(F.struct("plan.output.agents", "plan.output.subtasks"))
    text = F.when(kind == 0, F.concat(F.lit("```json\n"), out, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Here: "), out, F.lit(" so."))).when(kind == 2, cut).when(kind == 3, "no plan").otherwise(out)
    rows = order_plans(t).select(text.alias("output"))
    return training.validity_by_mode(rows).select("mode", "n", F.round("schema_valid", 6).alias("schema_valid"), F.round("acyclic", 6).alias("acyclic"))


@query(f"""WITH {LINES}, {_SETS}, d AS (SELECT b.c, a.i AS sample, 0.5 * ({_jaccard('roles')}) + 0.5 * ({_jaccard('names')}) AS score FROM f a JOIN f b ON a.c = b.c AND b.i = 0 WHERE a.i > 0 AND a.k % 5 <> 3)
SELECT CAST(c AS VARCHAR) AS question_id, arg_max(sample, score * 1000 - sample / 1000)::BIGINT AS chosen, arg_min(sample, score * 1000 + sample / 1000)::BIGINT AS rejected, round(max(score) - min(score), 6) AS delta FROM d GROUP BY c HAVING max(score) > min(score)""")
def q74_preference_pairs(t):
    plans = order_plans(t)
    tagged = plans.where("profile_index > 0").withColumn("out", F.when(F.col("k") % 5 == 3, "no plan").otherwise(F.to_json("plan.output")))
    marked = F.concat(F.lit("<think>"), F.col("profile_index").cast("string"), F.lit("</think>"), "out")
    samples = tagged.select("question_id", F.lit(0).alias("profile_index"), F.lit(0).alias("pair_idx"), F.col("profile_index").alias("sample_id"), marked.alias("raw_text"))
    gold = P.components(plans).where("profile_index = 0").select("question_id", "profile_index", "roles", "names")
    number = lambda c: F.regexp_extract(c, "<think>(\\d+)</think>", 1).cast("long")
    pairs = training.preference_pairs(samples, gold)
    return pairs.select("question_id", number("chosen").alias("chosen"), number("rejected").alias("rejected"), F.round("delta_struct", 6).alias("delta"))


_USER = f"'Query:' || {_NL} || 'question ' || c || {_NL} || {_NL} || 'Learner:' || {_NL} || 'I trade in ' || c_mktsegment || {_NL} || {_NL} || 'Skills: ' || lower(c_mktsegment)"


@query(f"""WITH {LINES} SELECT k, i::BIGINT AS profile_index, md5({_USER}) AS asked, 3::BIGINT AS n_messages, CASE WHEN bare THEN 0 ELSE len(roles) END::BIGINT AS n_agents, len(subs)::BIGINT AS n_subtasks, m::BIGINT AS n_steps, 'assistant' AS last_role FROM g JOIN customer ON c_custkey = c""")
def q75_training_messages(t):
    plans = order_plans(t)
    key = ["question_id", "profile_index"]
    pad = training.prompt_and_completion(training.outline_messages(plans, "sys"))
    sdp = training.prompt_and_completion(training.schedule_messages(plans, "sys")).select(*key, F.col("completion").alias("scheduled"), F.element_at("messages", -1)["role"].alias("last_role"))
    asked = training.reward_prompts(plans, "sys").select(*key, F.element_at("prompt", -1)["content"].alias("asked"))
    rows = plans.select(*key, "k").join(pad.select(*key, "completion", F.size("messages").alias("n")), key).join(sdp, key).join(asked, key)
    pad_out = F.from_json("completion", "agents array<struct<agent_role:string>>, subtasks array<struct<id:string>>")
    sdp_out = F.from_json("scheduled", "subtasks array<struct<id:string,steps:array<struct<id:string>>>>")
    steps = F.aggregate(F.transform(sdp_out["subtasks"], lambda s: F.size(s["steps"])), F.lit(0), lambda a, x: a + x)
    return rows.select("k", F.col("profile_index").cast("long").alias("profile_index"), F.md5("asked").alias("asked"), F.col("n").cast("long").alias("n_messages"), F.size(pad_out["agents"]).cast("long").alias("n_agents"), F.size(pad_out["subtasks"]).cast("long").alias("n_subtasks"), steps.cast("long").alias("n_steps"), "last_role")


@query(f"""WITH {LINES}, s AS (SELECT a.k, a.c FROM g a JOIN g b ON a.c = b.c AND b.i = 0 WHERE a.i = 1 AND a.k % 5 <> 3) SELECT count(*) AS n, count(DISTINCT c) AS n_questions FROM s""")
def q76_own_scaffolds(t):
    plans = order_plans(t)
    raw = F.when(F.col("k") % 5 == 3, '{"agents": []}').otherwise(F.to_json(outline(F.col("plan.output"))))
    samples = plans.where("profile_index = 1").select("question_id", F.lit(0).alias("profile_index"), raw.alias("raw_text"))
    rows = training.own_scaffold_rows(samples, plans.where("profile_index = 0"), "sys")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("n_questions"))


@query(f"""WITH {LINES} SELECT k, CASE WHEN bare THEN '' ELSE array_to_string(list_transform(roles, lambda f: f || ':goal ' || f || ':knows ' || f || ':' || CASE f WHEN 'A' THEN 'RagTool' WHEN 'N' THEN 'RagTool,FileReadTool' ELSE '' END), ';') END AS agents,
 CAST(m - CASE WHEN m >= 4 THEN 1 ELSE 0 END - dropped + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_order FROM g JOIN (SELECT k, count(*) FILTER (NOT ordered) AS dropped FROM l GROUP BY k) USING (k)""")
def q77_normal_agents(t):
    plans = order_plans(t)
    shown = F.transform("plan.output.agents", agent)
    line = F.transform(shown, lambda a: F.concat_ws(":", a["agent_role"], a["goal"], a["backstory"], F.array_join(a["tools"], ",")))
    return plans.select("k", F.array_join(line, ";").alias("agents"), F.size(schedule(F.col("plan.output"))["execution_order"]).cast("long").alias("n_order"))


@query(f"""WITH {LINES}, n AS (SELECT c_mktsegment AS segment, CAST(length({_USER}) AS BIGINT) AS n FROM g JOIN customer ON c_custkey = c), s AS (SELECT segment, list_sort(list(n)) AS v, avg(n) AS mean FROM n GROUP BY segment)
SELECT segment, v[1] AS least, v[CAST(round_even(0.5 * (len(v) - 1), 0) AS INT) + 1] AS p50, v[CAST(round_even(0.9 * (len(v) - 1), 0) AS INT) + 1] AS p90, v[CAST(round_even(CAST(0.95 AS DOUBLE) * (len(v) - 1), 0) AS INT) + 1] AS p95,
 v[CAST(round_even(CAST(0.99 AS DOUBLE) * (len(v) - 1), 0) AS INT) + 1] AS p99, v[-1] AS most, CAST(round_even(mean, 0) AS BIGINT) AS mean FROM s""")
def q99_payload_quantiles(t):
    rows = training.reward_prompts(order_plans(t), "sys").join(order_plans(t).select("question_id", "profile_index", "segment"), ["question_id", "profile_index"])
    return training.length_quantiles(rows.select("segment", F.element_at("prompt", -1)["content"].alias("asked")), "asked", "segment")


@query(f"""WITH {LINES}, r AS (SELECT c, i FROM g UNION ALL SELECT c, i + 100 FROM g WHERE i = 0) SELECT count(*) AS n, count(*) FILTER (i < 100) AS with_gold, count(*) FILTER (i < 100 AND i > 0) AS with_other FROM r""")
def q100_reward_references(t):
    plans = order_plans(t).select("question_id", "profile_index", F.to_json("plan.output").alias("gold_plan"), F.to_json("plan.input.learner").alias("learner_profile"))
    rollouts = plans.select("question_id", "profile_index", F.col("gold_plan").alias("completion"))
    rollouts = rollouts.union(rollouts.where("profile_index = 0").withColumn("profile_index", F.col("profile_index") + 100))
    others = plans.where("profile_index > 0").select("question_id", "profile_index", F.col("gold_plan").alias("cf_plan"))
    rows = rewards.with_references(rollouts, plans.union(plans), others)
    return rows.agg(F.count("*").alias("n"), F.count("gold_plan").alias("with_gold"), F.count("cf_plan").alias("with_other"))


@query(f"""WITH {LINES} SELECT agent, count(*) AS n_steps, round(avg(length(instruction)), 6) AS mean_length FROM l GROUP BY agent""")
def q101_step_shapes(t):
    from planlake.functions.normalize import slim

    rows = order_components(t).select(F.explode("steps").alias("s")).select(slim(F.col("s"), "agent", "instruction").alias("s"))
    return rows.groupBy("s.agent").agg(F.count("*").alias("n_steps"), F.round(F.avg(F.length("s.instruction")), 6).alias("mean_length"))
