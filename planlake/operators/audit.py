"""Audits of plan records as reports: one row of shares and counts over rows of plan components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlake import schemas
from planlake.functions.nested import all_in, arrayed, ratio, repeats
from planlake.operators import plan as P


def _share(flag: Column) -> Column:
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def _spread(value: Column, name: str) -> list[Column]:
    return [F.avg(value).alias(f"mean_{name}"), F.median(value).alias(f"median_{name}"), F.min(value).alias(f"min_{name}"), F.max(value).alias(f"max_{name}")]


def mechanical(rows: DataFrame) -> DataFrame:
    """(n, schema_valid, no_cycle, no_invalid_tool, n_invalid_tool): shares of plans that pass each test, and plans with a tool their agent lacks."""
    bad_tool = F.exists("steps", lambda s: P.present(s["tool"]) & ~P._declares(F.col("agents"), s["agent"], s["tool"]))
    flags = rows.select(
        P.usable(F.col("agents"), F.col("subtasks"), F.col("steps")).alias("valid"), P.has_cycle(F.col("step_ids"), F.col("edges")).alias("cyclic"), F.coalesce(bad_tool, F.lit(False)).alias("bad_tool")
    )
    return flags.agg(F.count("*").alias("n"), _share(F.col("valid")).alias("schema_valid"), _share(~F.col("cyclic")).alias("no_cycle"), _share(~F.col("bad_tool")).alias("no_invalid_tool"), F.count_if("bad_tool").alias("n_invalid_tool"))


def outlines(rows: DataFrame) -> DataFrame:
    """Numbers of agents and subtasks, and shares of plans with repeated roles or ids, an empty role or an empty subtask name."""
    ids = F.transform("subtasks", lambda s: F.coalesce(s["id"], F.lit("")))
    roles = F.transform("roles", lambda r: F.coalesce(r, F.lit("")))
    return rows.agg(
        F.count("*").alias("n"),
        *_spread(F.size("agents"), "agents"),
        *_spread(F.size("subtasks"), "subtasks"),
        _share(repeats(roles)).alias("repeated_roles"),
        _share(repeats(ids)).alias("repeated_ids"),
        _share(F.exists("roles", lambda r: ~P.present(r))).alias("empty_role"),
        _share(F.exists("names", lambda x: ~P.present(x))).alias("empty_name"),
    )


def schedules(rows: DataFrame) -> DataFrame:
    """Violations over all steps, those of the order of execution over all plans, which may exceed 1, and the number of bad loops."""
    agents, pool = F.col("agents"), F.array(*[F.lit(t) for t in schemas.TOOLS])
    count = lambda xs, test: F.size(F.filter(xs, test)).cast("long")
    bad_tool = lambda s: s["tool"].isNotNull() & ~(F.array_contains(pool, s["tool"]) & P._declares(agents, s["agent"], s["tool"]))
    bad_prefix = F.transform("subtasks", lambda s: F.size(F.filter(arrayed(s["steps"]), lambda t: ~F.coalesce(t["id"], F.lit("")).startswith(F.concat(s["id"], F.lit("-"))))))
    known = rows.select(
        F.size("steps").cast("long").alias("steps"),
        count("steps", lambda s: ~F.array_contains(F.col("roles"), s["agent"])).alias("agent"),
        count("steps", bad_tool).alias("tool"),
        F.aggregate(bad_prefix, F.lit(0).cast("long"), lambda a, x: a + x).alias("prefix"),
        count("order_ids", lambda i: ~F.array_contains(F.col("step_ids"), i)).alias("order"),
        count("loops", P.bad_loop).alias("loops"),
    )
    over = lambda k: ratio(F.sum(k), F.greatest(F.sum("steps"), F.lit(1)))
    return known.agg(
        F.count("*").alias("n"),
        over("agent").alias("unknown_agent"),
        over("tool").alias("bad_tool"),
        over("prefix").alias("bad_prefix"),
        ratio(F.sum("order"), F.count("*")).alias("unknown_in_order"),
        F.sum("loops").alias("bad_loops"),
        *_spread(F.col("steps"), "steps"),
    )


def diversity(rows: DataFrame, k: int = 10) -> DataFrame:
    """(kind, n_distinct, n, top_share) of agent roles and subtask names: the share of the k commonest."""
    said = lambda column, kind: rows.select(F.lit(kind).alias("kind"), F.explode(F.transform(column, lambda x: F.coalesce(x, F.lit("")))).alias("value"))
    counts = said("roles", "role").union(said("names", "name")).groupBy("kind", "value").agg(F.count("*").alias("n"))
    # the k greatest counts of a kind: of equal counts it does not matter which
    tops = None
    for kind in ("role", "name"):
        top = counts.where(F.col("kind") == kind).orderBy(F.desc("n"), "value").limit(k).groupBy("kind").agg(F.sum("n").alias("top"))
        tops = top if tops is None else tops.union(top)
    totals = counts.groupBy("kind").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n"))
    return totals.join(tops, "kind").select("kind", "n_distinct", "n", ratio(F.col("top"), F.col("n")).alias("top_share"))


def rubric_rating(failed: Column, major: Column) -> Column:
    """Excellent without failed checks, Good with one or two and none of them major, Acceptable with up to four and at most one major, else Failing."""
    return F.when(failed == 0, "Excellent").when((failed <= 2) & (major == 0), "Good").when((failed <= 4) & (major <= 1), "Acceptable").otherwise("Failing")


def substantive(passed: Column, checks: Column, share: float = 0.7) -> Column:
    """Whether more than share of the checks pass."""
    return ratio(passed, checks) > share


def order_is_covered(order: Column, ids: Column) -> Column:
    return all_in(ids, order) & all_in(order, ids)
