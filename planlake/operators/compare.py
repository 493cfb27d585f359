"""Plans compared across profiles of a question, and across questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.functions.nested import set_jaccard
from planlake.functions.text import PEDAGOGY, matches, role_family, tokens
from planlake.operators import plan as P
from planlake.operators.ordering import ranked, shuffled


def features(rows: DataFrame) -> DataFrame:
    """rows of components with the sets that pairs are compared by."""
    body = P.full_text(F.col("agents"), F.col("subtasks"))
    shown = [F.when(matches(body, p), name) for name, p in PEDAGOGY]
    return rows.withColumns(
        {
            "families": F.array_distinct(F.transform("roles", role_family)),
            "tool_set": F.array_distinct("agent_tools"),
            "subtask_tokens": F.array_distinct(F.flatten(F.transform("names", tokens))),
            "patterns": F.array_compact(F.array(*shown)),
        }
    )


def same_question_pairs(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Pairs of plans of one question, the lesser profile_index first: an equi-join on the question, so a hot question can be split."""
    a = rows.select("question_id", F.col("profile_index").alias("i"), F.struct(*keep).alias("x"))
    b = rows.select("question_id", F.col("profile_index").alias("j"), F.struct(*keep).alias("y"))
    return a.join(b, "question_id").where("i < j")


def profile_divergence(rows: DataFrame) -> DataFrame:
    """(question_id, i, j, role, family, tools, subtask, pedagogy, step_diff) from rows of features; only the sets and the number of steps go through the join."""
    named = {"role": "roles", "family": "families", "tools": "tool_set", "subtask": "subtask_tokens", "pedagogy": "patterns"}
    small = rows.withColumn("n_steps", F.size("steps"))
    pairs = same_question_pairs(small, (*named.values(), "n_steps"))
    out = [set_jaccard(F.col(f"x.{c}"), F.col(f"y.{c}")).alias(n) for n, c in named.items()]
    return pairs.select("question_id", "i", "j", *out, F.abs(F.col("x.n_steps") - F.col("y.n_steps")).alias("step_diff"))


def group_divergence(pairs: DataFrame, groups: DataFrame, *measures: str) -> DataFrame:
    """(group, pairs, measures...): the mean of 1 - each measure over rows of profile_divergence, by the group of the question (question_id, group)."""
    joined = pairs.join(groups.select("question_id", "group"), "question_id", "left").na.fill("UNKNOWN", ["group"])
    return joined.groupBy("group").agg(F.count("*").alias("pairs"), *[F.avg(1 - F.col(m)).alias(m) for m in measures])


def random_pairs(rows: DataFrame, keep: tuple[str, ...], n: int = 2000, seed: int = 42) -> DataFrame:
    """n pairs of plans of different questions, or as many as there are by this draw: two shuffled orders joined on their places.

    Half as many again are drawn as are asked for, and a pair of one question is passed over, so that n are left.
    """
    key = F.concat_ws("|", F.col("question_id").cast("string"), F.col("profile_index").cast("string"))
    drawn = n + n // 2 + 16
    one = rows.select("question_id", F.struct(*keep).alias("x"), shuffled(key, seed).alias("d")).orderBy("d").limit(drawn)
    two = rows.select(F.col("question_id").alias("other_id"), F.struct(*keep).alias("y"), shuffled(key, seed + 1).alias("e")).orderBy("e").limit(drawn)
    left = one.withColumn("place", F.expr("row_number() OVER (ORDER BY d)"))  # 1.5 n rows at most
    right = two.withColumn("place", F.expr("row_number() OVER (ORDER BY e)"))
    return left.join(right, "place").where("question_id <> other_id").orderBy("place").limit(n)


def counterfactual_profiles(rows: DataFrame, seed: int = 42, tries: int = 6) -> DataFrame:
    """(question_id, profile_index, description, skills): for each plan the profile of another, drawn from those with a description or skills.

    rows: question_id, profile_index, learner (struct of description and skills). Up to tries draws are made until one differs from the plan's
    own profile; the last counts. The pool is numbered in shuffled order and drawn from by number.
    """
    key = F.concat_ws("|", F.col("question_id").cast("string"), F.col("profile_index").cast("string"))
    known = rows.select("question_id", "profile_index", F.col("learner.description").alias("own"), F.col("learner.skills").alias("own_skills"), key.alias("key"))
    pool = known.where("own <> '' OR size(own_skills) > 0")
    numbered = ranked(pool, shuffled(F.col("key"), seed), "key").select(F.col("place").alias("number"), F.struct(F.col("own").alias("description"), F.col("own_skills").alias("skills")).alias("profile"))
    size = pool.count()
    if not size:
        return known.select("question_id", "profile_index", F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("skills"))
    draws = F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda t: F.struct(t.alias("try"), (F.pmod(F.xxhash64(F.lit(seed), "key", t), F.lit(size)) + 1).alias("number")))
    drawn = known.select("question_id", "profile_index", "own", "own_skills", F.explode(draws).alias("draw")).select("*", "draw.try", "draw.number").join(numbered, "number")
    other = (F.col("profile.description") != F.col("own")) | (F.col("profile.skills") != F.col("own_skills"))
    best = F.min_by("profile", F.struct(F.when(other, 0).otherwise(1), F.when(other, F.col("try")).otherwise(-F.col("try"))))
    return drawn.groupBy("question_id", "profile_index").agg(best.alias("p")).select("question_id", "profile_index", "p.description", "p.skills")


def profile_sensitivity(rows: DataFrame, n: int = 2000, seed: int = 42) -> DataFrame:
    """(same, cross, gap): how much more alike plans of one question are than plans of two."""
    from planlake.operators.rewards import COLUMNS

    alike = P.similarity({k: F.col(f"x.{k}") for k in COLUMNS}, {k: F.col(f"y.{k}") for k in COLUMNS})
    same = same_question_pairs(rows, COLUMNS).agg(F.avg(alike).alias("same"))
    cross = random_pairs(rows, COLUMNS, n, seed).agg(F.avg(alike).alias("cross"))
    return same.join(cross).withColumn("gap", F.col("same") - F.col("cross"))  # one row each
