"""Plans parsed once into component columns, and the validators, graph measures and similarities over those.

Everything here stays within the row: a plan has a handful of agents and a few tens of steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlake import schemas
from planlake.functions.jsonx import object_variant
from planlake.functions.literals import matches_where_possible
from planlake.functions.nested import all_in, arrayed, let, multiset_jaccard, ratio, repeats, same_set, set_jaccard
from planlake.functions.normalize import filled
from planlake.functions.text import PEDAGOGY, SECOND_PERSON, anchor_count_lower, hit_ratio_lower, matches, pedagogy_flags, skeleton_flags, strip, tokens
from planlake.functions.typed import PLAN, faults, has_list

STRINGS = "array<string>"


def present(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def is_loop(entry: Column) -> Column:
    return F.ltrim(entry).startswith("{")


def loop_of(entry: Column) -> Column:
    """The loop object of an entry of the order of execution."""
    return F.from_json(entry, schemas.LOOP)["loop"]


def loop_steps(loop: Column) -> Column:
    return F.coalesce(loop["steps"], F.from_json(loop["step"], "array<string>"), F.when(loop["step"].isNotNull(), F.array(loop["step"])), F.array().cast(STRINGS))


def components(plans: DataFrame, output: str = "plan.output") -> DataFrame:
    """plans with the columns that all measures use: agents, subtasks, steps, step_ids, edges, roles, names, step_tools, agent_tools, order_ids, loops."""
    out = F.col(output)
    rows = plans.withColumns({"agents": arrayed(out["agents"]), "subtasks": arrayed(out["subtasks"]), "entries": arrayed(out["execution_order"])})
    steps = F.flatten(F.transform("subtasks", lambda s: arrayed(s["steps"])))
    rows = rows.withColumns({"steps": steps, "loops": F.transform(F.filter("entries", is_loop), loop_of)})
    edges = F.flatten(F.transform("steps", lambda s: F.transform(F.filter(arrayed(s["depends_on"]), present), lambda d: F.struct(d.alias("src"), s["id"].alias("dst")))))
    return rows.withColumns(
        {
            "step_ids": F.transform("steps", lambda s: s["id"]),
            "all_edges": edges,
            "edges": F.array_distinct(edges),
            "roles": F.transform("agents", lambda a: a["agent_role"]),
            "names": F.transform("subtasks", lambda s: s["name"]),
            "step_tools": F.filter(F.transform("steps", lambda s: s["tool"]), present),
            "agent_tools": F.flatten(F.transform("agents", lambda a: arrayed(a["tools"]))),
            "order_ids": F.flatten(F.transform("entries", lambda e: F.when(is_loop(e), loop_steps(loop_of(e))).otherwise(F.array(e)))),
        }
    )


def _declares(agents: Column, role: Column, tool: Column) -> Column:
    return F.exists(agents, lambda a: (a["agent_role"] == role) & F.array_contains(arrayed(a["tools"]), tool))


def _tool_pool() -> Column:
    return F.array(*[F.lit(t) for t in schemas.TOOLS])


def known_edges(edges: Column, ids: Column) -> Column:
    return F.filter(edges, lambda e: F.array_contains(ids, e["src"]))


def layers(step_ids: Column, edges: Column) -> Column:
    """struct<done, left, widths>: steps peeled layer by layer, a layer being the steps all of whose known parents are in earlier ones.

    left holds the steps on or behind a cycle; widths are the layers' sizes. Repeated and unknown ids count as the source counts them: an
    unknown parent constrains nothing.
    """

    def peel(known: Column) -> Column:
        start = F.struct(F.array().cast(STRINGS).alias("done"), F.array_distinct(step_ids).alias("left"), F.array().cast("array<int>").alias("widths"))

        def one(acc: Column, _: Column) -> Column:
            free = F.filter(acc["left"], lambda s: ~F.exists(known, lambda e: (e["dst"] == s) & F.array_contains(acc["left"], e["src"])))
            return let(free, lambda f: F.when(F.size(f) == 0, acc).otherwise(F.struct(F.concat(acc["done"], f).alias("done"), F.array_except(acc["left"], f).alias("left"), F.array_append(acc["widths"], F.size(f)).alias("widths"))))

        return F.aggregate(F.array_distinct(step_ids), start, one)

    return let(known_edges(edges, step_ids), peel)


def has_cycle(step_ids: Column, edges: Column) -> Column:
    return F.size(layers(step_ids, edges)["left"]) > 0


DAG_FIELDS = ("n_nodes", "n_edges", "longest", "width", "parallel")


def _graph_shape(step_ids: Column, edges: Column, all_edges: Column) -> Column:
    """struct of DAG_FIELDS and cyclic, from one peeling of the layers."""

    def measured(x: Column) -> Column:
        n, ok = F.size(F.array_distinct(step_ids)), F.size(x["left"]) == 0
        longest = F.when(ok, F.size(x["widths"])).otherwise(0)
        return F.struct(
            n.alias("n_nodes"),
            F.size(all_edges).alias("n_edges"),
            longest.alias("longest"),
            F.when(ok, F.coalesce(F.array_max(x["widths"]), F.lit(0))).otherwise(0).alias("width"),
            F.when(n > 0, 1 - ratio(longest, n)).otherwise(0.0).alias("parallel"),
            (~ok).alias("cyclic"),
        )

    return let(layers(step_ids, edges), measured)


def dag_metrics(step_ids: Column, edges: Column, all_edges: Column) -> Column:
    """struct<n_nodes, n_edges, longest, width, parallel>; zero path measures for plans with a cycle. Edges count with repeats and unknown parents."""
    return _graph_shape(step_ids, edges, all_edges).dropFields("cyclic")


def dependency_completeness(step_ids: Column, edges: Column) -> Column:
    return ratio(F.size(known_edges(edges, step_ids)), F.size(edges), 1.0)


def tool_relevance(steps: Column, agents: Column) -> Column:
    using = F.filter(steps, lambda s: present(s["tool"]))
    return ratio(F.size(F.filter(using, lambda s: _declares(agents, s["agent"], s["tool"]))), F.size(using), 1.0)


def graph_measures(rows: DataFrame) -> DataFrame:
    """rows of components with cyclic, dag, dependency_completeness, tool_relevance and the counts of bad references."""
    steps, agents, ids, edges = F.col("steps"), F.col("agents"), F.col("step_ids"), F.col("edges")
    rows = rows.withColumn("__shape", _graph_shape(ids, edges, F.col("all_edges")))
    return rows.withColumns(
        {
            "dag": F.col("__shape").dropFields("cyclic"),
            "cyclic": F.col("__shape.cyclic"),
            "dependency_completeness": dependency_completeness(ids, edges),
            "tool_relevance": tool_relevance(steps, agents),
            "invalid_tool_calls": F.size(F.filter(steps, lambda s: present(s["tool"]) & ~_declares(agents, s["agent"], s["tool"]))),
            "unknown_agents": F.size(F.filter(steps, lambda s: ~F.array_contains(F.col("roles"), s["agent"]))),
            "unknown_dependencies": F.size(edges) - F.size(known_edges(edges, ids)),
        }
    ).drop("__shape")


def order_respects_dependencies(order_ids: Column, edges: Column) -> Column:
    """Whether each known parent stands before its child in the flattened order of execution."""
    return F.forall(edges, lambda e: (F.array_position(order_ids, e["src"]) == 0) | (F.array_position(order_ids, e["src"]) < F.array_position(order_ids, e["dst"])))


def loop_condition(loop: Column) -> Column:
    """struct<step, outcome, value, ok> of a condition "step.outcome == value"; ok if the step is in the loop and 2 to 5 rounds are allowed."""
    form = r"^\s*(S\d+-\d+)\.(\w+)\s*==\s*(\w+)\s*$"
    step, outcome, value = (F.nullif(F.regexp_extract(loop["condition"], form, i), F.lit("")) for i in (1, 2, 3))
    rounds = loop["max_iterations"].try_cast("int")
    ok = step.isNotNull() & F.array_contains(loop_steps(loop), step) & rounds.between(2, 5)
    return F.struct(step.alias("step"), outcome.alias("outcome"), value.alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))


def bad_loop(loop: Column) -> Column:
    return (F.size(loop_steps(loop)) == 0) | ~present(loop["condition"]) | loop["max_iterations"].try_cast("int").isNull()


def strict_error(rows: DataFrame, output: str = "plan.output") -> DataFrame:
    """rows of components with error: the first violation of the strict schema, null if there is none."""
    out, agents, steps = F.col(output), F.col("agents"), F.col("steps")
    lacks = lambda x, *keys: F.exists(x, lambda v: F.greatest(*[v[k].isNull() for k in keys]))
    pool = _tool_pool()
    checks = [
        ("no output", out.isNull()),
        ("missing agents", out["agents"].isNull()),
        ("missing subtasks", out["subtasks"].isNull()),
        ("missing execution_order", out["execution_order"].isNull()),
        ("empty agents", F.size(agents) == 0),
        ("agent without a key", lacks(agents, "agent_role", "goal", "tools")),
        ("unknown tool of an agent", F.exists("agent_tools", lambda t: ~F.array_contains(pool, t))),
        ("subtask without a key", lacks(F.col("subtasks"), "id", "name", "steps")),
        ("step without a key", lacks(steps, "id", "agent", "objective", "instruction", "expected_output")),
        ("undeclared agent", F.exists(steps, lambda s: ~F.array_contains(F.col("roles"), s["agent"]))),
        ("tool outside the pool", F.exists(steps, lambda s: present(s["tool"]) & ~F.array_contains(pool, s["tool"]))),
        ("tool not declared by the agent", F.exists(steps, lambda s: present(s["tool"]) & ~_declares(agents, s["agent"], s["tool"]))),
        ("execution_order differs from the steps", ~same_set(F.col("order_ids"), F.col("step_ids"))),
    ]
    error = F.when(checks[0][1], checks[0][0])
    for message, broken in checks[1:]:
        error = error.when(F.coalesce(broken, F.lit(False)), message)
    return rows.withColumn("error", error)


def usable(agents: Column, subtasks: Column, steps: Column) -> Column:
    """The schema test of rewards: agents and subtasks are there, and their names, ids and instructions are filled."""
    return (
        (F.size(agents) > 0)
        & (F.size(subtasks) > 0)
        & F.forall(agents, lambda a: present(a["agent_role"]))
        & F.forall(subtasks, lambda s: present(s["id"]))
        & F.forall(steps, lambda s: present(s["id"]) & present(s["agent"]) & present(s["instruction"]))
    )


#: The lists that the weakest schema test wants, by mode.
MODES = {"pad": ("agents", "subtasks"), "sdp": ("subtasks", "execution_order"), "full": ("agents", "subtasks", "execution_order")}


def lists_in(value: Column, mode: str) -> Column:
    """The weakest schema test: the lists of mode pad, sdp or full of a parsed object are lists."""
    return F.least(*[has_list(value, k) for k in MODES[mode]])


def lists_present(text: Column, mode: str) -> Column:
    """lists_in of an object's text."""
    return let(F.try_parse_json(text), lambda v: lists_in(v, mode))


def type_faults(text: Column) -> Column:
    """array<string>: what a plan's output lacks or has of another type, by path; the text is parsed once, and one without an object is missing whole."""
    return let(object_variant(text), lambda v: faults(v, PLAN))


def integrity(rows: DataFrame) -> DataFrame:
    """rows of components with a flag for each kind of broken reference; a plan has a kind or not, however often."""
    ids, order, edges = F.col("step_ids"), F.col("order_ids"), F.col("edges")
    flags = {
        "unknown_agent": F.exists("steps", lambda s: ~F.array_contains(F.col("roles"), s["agent"])),
        "unknown_dependency": F.size(known_edges(edges, ids)) < F.size(edges),
        "order_unknown": ~all_in(order, ids),
        "order_missing": ~all_in(ids, order),
        "in_cycle": F.col("cyclic") if "cyclic" in rows.columns else has_cycle(ids, edges),
    }
    rows = rows.withColumns(flags)
    return rows.withColumn("any_issue", F.greatest(*[F.col(k) for k in flags]))


def complexity(rows: DataFrame) -> DataFrame:
    """rows of components with the counts that describe a plan's size."""
    human = F.size(F.filter("steps", lambda s: F.coalesce(s["requires_human_input"], F.lit(False))))
    return rows.withColumns(
        {
            "n_agents": F.size("agents"),
            "n_subtasks": F.size("subtasks"),
            "n_steps": F.size("steps"),
            "steps_per_subtask": ratio(F.size("steps"), F.size("subtasks")),
            "n_tools": F.size("agent_tools"),
            "n_distinct_tools": F.size(F.array_distinct("agent_tools")),
            "n_loops": F.size("loops"),
            "n_loop_steps": F.aggregate(F.transform("loops", lambda x: F.size(loop_steps(x))), F.lit(0), lambda a, x: a + x),
            "max_iterations": F.array_max(F.transform("loops", lambda x: x["max_iterations"].try_cast("int"))),
            "n_human": human,
            "human_ratio": ratio(human, F.size("steps")),
        }
    )


def agent_load(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, agent, n_steps): steps of each agent in a plan."""
    return rows.select(*keys, F.explode("steps").alias("s")).groupBy(*keys, F.col("s.agent").alias("agent")).agg(F.count("*").alias("n_steps"))


def full_text(agents: Column, subtasks: Column) -> Column:
    """All prose of a plan, line by line: agents, then subtasks with their steps. Missing texts are empty lines."""
    text = lambda x: F.coalesce(x, F.lit(""))
    of_agents = F.flatten(F.transform(agents, lambda a: F.array(text(a["goal"]), filled(a["backstory"], a["description"]))))
    of_steps = lambda s: F.flatten(F.transform(arrayed(s["steps"]), lambda t: F.array(text(t["objective"]), text(t["instruction"]), text(t["expected_output"]))))
    of_subtasks = F.flatten(F.transform(subtasks, lambda s: F.concat(F.array(text(s["name"]), text(s["subtask_objective"])), of_steps(s))))
    return F.array_join(F.concat(of_agents, of_subtasks), "\n")


def pedagogy(rows: DataFrame) -> DataFrame:
    """rows of components with a flag and a number of steps for each pattern, their diversity, and the three acts of the outline."""
    body = full_text(F.col("agents"), F.col("subtasks"))
    names = F.array_join(F.flatten(F.transform("subtasks", lambda s: F.array(F.coalesce(s["name"], F.lit("")), F.coalesce(s["subtask_objective"], F.lit(""))))), "\n")
    said = F.transform("steps", lambda s: let(F.coalesce(s["instruction"], F.lit("")), lambda t: F.struct(t.alias("text"), F.lower(t).alias("lowered"))))
    rows = rows.withColumns({"body": body, "outline_text": names, "__said": said}).withColumns({"__body": F.lower("body"), "__outline": F.lower("outline_text")})
    flags = {f"has_{k}": v for k, v in pedagogy_flags(F.col("body"), F.col("__body")).items()}

    def hits_of(pattern: str) -> Column:
        return F.size(F.filter("__said", lambda s: matches_where_possible(s["text"], s["lowered"], pattern)))

    hits = {f"n_{k}": hits_of(p) for k, p in PEDAGOGY}
    acts = {f"act_{k}": v for k, v in skeleton_flags(F.col("outline_text"), F.col("__outline")).items()}
    rows = rows.withColumns(flags | hits | acts).drop("__said", "__body", "__outline")
    return rows.withColumn("diversity", sum((F.col(k).cast("int") for k in list(flags)[1:]), F.col(next(iter(flags))).cast("int")))


def personalization(rows: DataFrame, description: Column, skills: Column) -> DataFrame:
    """rows of components with the signals of a learner (description, skills) in a plan.

    second_person: the share of steps whose instruction speaks to the learner; n_anchors: bridging phrases; skill_share and token_share: of the
    skills, and of the description's words of four letters and more, how many the plan mentions, null where there are none.
    """
    body = F.lower(full_text(F.col("agents"), F.col("subtasks")))
    spoken = F.size(F.filter("steps", lambda s: matches(F.coalesce(s["instruction"], F.lit("")), SECOND_PERSON)))
    words = F.filter(tokens(F.coalesce(description, F.lit(""))), lambda w: F.length(w) >= 4)
    return rows.withColumn("__body", body).withColumns(
        {
            "second_person": ratio(spoken, F.size("steps")),
            "n_anchors": anchor_count_lower(F.col("__body")),
            "skill_share": hit_ratio_lower(arrayed(skills), F.col("__body")),
            "token_share": hit_ratio_lower(words, F.col("__body")),
        }
    ).drop("__body")


def personalization_summary(rows: DataFrame) -> DataFrame:
    """One row: means over rows of personalization, those of shares over the plans that have one, and plans that mention a skill."""
    return rows.agg(
        *[F.coalesce(F.avg(k), F.lit(0.0)).alias(f"mean_{k}") for k in ("second_person", "n_anchors", "skill_share", "token_share")], F.count_if(F.col("skill_share") > 0).alias("n_with_skill")
    )


def similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Mean of five likenesses: roles as a bag; subtask names, step ids, edges and tools as sets. Keys: roles, names, step_ids, edges, step_tools."""
    parts = [multiset_jaccard(a["roles"], b["roles"]), *[set_jaccard(a[k], b[k]) for k in ("names", "step_ids", "edges", "step_tools")]]
    return sum(parts[1:], parts[0]) / F.lit(5.0)


def scaffold_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return F.lit(0.5) * multiset_jaccard(a["roles"], b["roles"]) + F.lit(0.5) * set_jaccard(a["names"], b["names"])


def name_pairs(subtasks: Column) -> Column:
    """Ordered pairs of normalized subtask names, by subtask id as text."""
    from planlake.functions.nested import ordered_pairs

    ordered = F.array_sort(F.transform(subtasks, lambda s: F.struct(s["id"].alias("id"), F.lower(strip(F.coalesce(s["name"], F.lit("")))).alias("name"))))
    return let(F.filter(F.transform(ordered, lambda s: s["name"]), lambda n: n != ""), ordered_pairs)


def mined_precedence(gold: DataFrame) -> DataFrame:
    """Distinct (a, b): subtask a stands before b in some plan of gold (rows of components)."""
    return gold.select(F.explode(name_pairs(F.col("subtasks"))).alias("p")).select("p.a", "p.b").distinct()


def precedence_compatibility(plans: DataFrame, mined: DataFrame, *keys: str) -> DataFrame:
    """(keys, compatibility): the share of a plan's ordered name pairs that are mined; 1 for fewer than two names."""
    pairs = plans.select(*keys, F.explode_outer(name_pairs(F.col("subtasks"))).alias("p"))
    known = mined.select(F.col("a").alias("ma"), F.col("b").alias("mb"))
    joined = pairs.join(known, (F.col("p.a") == F.col("ma")) & (F.col("p.b") == F.col("mb")), "left")
    share = ratio(F.count("ma"), F.count("p"), 1.0)
    return joined.groupBy(*keys).agg(share.alias("compatibility"))


def rubric_checks(rows: DataFrame) -> DataFrame:
    """rows of components with the rubric's checks that need no judge."""
    used = lambda a: F.array_distinct(F.filter(F.transform(F.filter("steps", lambda s: s["agent"] == a["agent_role"]), lambda s: s["tool"]), present))
    return rows.withColumns(
        {
            "tools_declared_are_used": F.forall("agents", lambda a: same_set(arrayed(a["tools"]), used(a))),
            "agents_are_used": F.forall("agents", lambda a: F.exists("steps", lambda s: s["agent"] == a["agent_role"])),
            "tools_in_pool": all_in(F.col("agent_tools"), _tool_pool()),
            "order_covers_steps": same_set(F.col("order_ids"), F.col("step_ids")),
            "order_is_topological": order_respects_dependencies(F.col("order_ids"), F.col("edges")),
            "loops_are_sound": F.forall("loops", lambda x: loop_condition(x)["ok"]),
        }
    )


def naming_audit(rows: DataFrame) -> DataFrame:
    """rows of components with the flags of the outline and schedule audits."""
    return rows.withColumns(
        {
            "repeated_roles": repeats(F.col("roles")),
            "empty_role": F.exists("roles", lambda r: ~present(r)),
            "repeated_ids": repeats(F.transform("subtasks", lambda s: s["id"])),
            "n_bad_prefix": F.aggregate(F.transform("subtasks", lambda s: F.size(F.filter(arrayed(s["steps"]), lambda t: ~t["id"].startswith(F.concat(s["id"], F.lit("-")))))), F.lit(0), lambda a, x: a + x),
            "n_bad_loops": F.size(F.filter("loops", bad_loop)),
        }
    )
