"""Training rows: messages for outlines and schedules, prompts with gold plans, preference pairs; and rates of structural validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlake import schemas
from planlake.functions.jsonx import object_text, object_variant
from planlake.functions.normalize import learner, outline, schedule
from planlake.operators import plan as P

NO_DESCRIPTION = "(no self-description provided)"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_prompt(query: Column, who: Column) -> Column:
    described = F.coalesce(F.nullif(who["description"], F.lit("")), F.lit(NO_DESCRIPTION))
    return F.concat(F.lit("Query:\n"), query, F.lit("\n\nLearner:\n"), described, F.lit("\n\nSkills: "), F.array_join(who["skills"], ", "))


def outline_messages(records: DataFrame, system: str) -> DataFrame:
    """(messages, question_id, profile_index): the learner asks, the outline answers."""
    user = user_prompt(F.col("plan.input.query"), learner(F.col("plan.input.learner")))
    rows = F.array(message("system", F.lit(system)), message("user", user), message("assistant", F.to_json(outline(F.col("plan.output")))))
    return records.select(rows.alias("messages"), "question_id", "profile_index")


def schedule_messages(records: DataFrame, system: str) -> DataFrame:
    """(messages, question_id, profile_index): the outline is given, the schedule answers."""
    asked = F.concat(user_prompt(F.col("plan.input.query"), learner(F.col("plan.input.learner"))), F.lit("\n\nScaffold:\n"), F.to_json(outline(F.col("plan.output"))))
    rows = F.array(message("system", F.lit(system)), message("user", asked), message("assistant", F.to_json(schedule(F.col("plan.output")))))
    return records.select(rows.alias("messages"), "question_id", "profile_index")


def reward_prompts(records: DataFrame, system: str) -> DataFrame:
    """(prompt, question_id, profile_index, gold_plan, learner_profile), plans and profiles as JSON text."""
    user = user_prompt(F.col("plan.input.query"), learner(F.col("plan.input.learner")))
    return records.select(F.array(message("system", F.lit(system)), message("user", user)).alias("prompt"), "question_id", "profile_index", F.to_json("plan.output").alias("gold_plan"), F.to_json("plan.input.learner").alias("learner_profile"))


def prompt_and_completion(rows: DataFrame) -> DataFrame:
    """messages split before the last, which must be an assistant's: another role raises."""
    last = F.element_at("messages", -1)
    checked = F.when(last["role"] == "assistant", last["content"]).otherwise(F.raise_error(F.lit("the last message is not an assistant's")).cast("string"))
    return rows.withColumns({"prompt": F.slice("messages", F.lit(1), F.size("messages") - 1), "completion": checked})


def preference_pairs(samples: DataFrame, gold: DataFrame) -> DataFrame:
    """(question_id, profile_index, pair_idx, chosen, rejected, delta_struct): best and worst parsed sample of each prompt; ties give none.

    samples: (question_id, profile_index, pair_idx, sample_id, raw_text); gold: (question_id, profile_index, roles, names).
    """
    out = F.col("__out")
    known = samples.withColumn("__parsed", object_variant(F.col("raw_text"))).where("__parsed IS NOT NULL").withColumn("__out", F.try_variant_get("__parsed", "$", schemas.OUTPUT)).drop("__parsed")
    known = known.withColumns({"s_roles": F.transform(F.coalesce(out["agents"], F.array()), lambda a: a["agent_role"]), "s_names": F.transform(F.coalesce(out["subtasks"], F.array()), lambda s: s["name"])}).drop("__out")
    scored = known.join(gold, ["question_id", "profile_index"]).withColumn("score", P.scaffold_score({"roles": F.col("s_roles"), "names": F.col("s_names")}, {"roles": F.col("roles"), "names": F.col("names")}))
    best = F.max(F.struct("score", (-F.col("sample_id")).alias("first"), "raw_text"))
    worst = F.min(F.struct("score", "sample_id", "raw_text"))
    sides = scored.groupBy("question_id", "profile_index", "pair_idx").agg(best.alias("best"), worst.alias("worst")).where("best.score > worst.score")
    return sides.select("question_id", "profile_index", "pair_idx", F.col("best.raw_text").alias("chosen"), F.col("worst.raw_text").alias("rejected"), (F.col("best.score") - F.col("worst.score")).alias("delta_struct"))


def own_scaffold_rows(samples: DataFrame, records: DataFrame, system: str) -> DataFrame:
    """Schedule messages whose scaffold is a sampled one; samples without agents or subtasks give none."""
    body = object_text(F.col("raw_text"))
    good = samples.withColumn("scaffold", body).where(P.lists_present(F.col("scaffold"), "pad"))
    joined = good.join(records, ["question_id", "profile_index"])
    asked = F.concat(user_prompt(F.col("plan.input.query"), learner(F.col("plan.input.learner"))), F.lit("\n\nScaffold:\n"), F.col("scaffold"))
    rows = F.array(message("system", F.lit(system)), message("user", asked), message("assistant", F.to_json(schedule(F.col("plan.output")))))
    return joined.select(rows.alias("messages"), "question_id", "profile_index")


def validity_by_mode(predictions: DataFrame, column: str = "output", modes: tuple[str, ...] = tuple(P.MODES)) -> DataFrame:
    """(mode, n, schema_valid, acyclic) for each of modes, in one pass that parses each text once; acyclic counts only where the schema is valid."""
    parsed = predictions.select(object_variant(F.col(column)).alias("__parsed"))
    known = parsed.select(F.try_variant_get("__parsed", "$", schemas.OUTPUT).alias("__out"), *[P.lists_in(F.col("__parsed"), m).alias(m) for m in modes])
    known = P.components(known, "__out").select(*modes, (~P.has_cycle(F.col("step_ids"), F.col("edges"))).alias("sound"))
    share = lambda flag: F.avg(flag.cast("double"))
    sums = known.agg(F.count("*").alias("n"), *[share(F.col(m)).alias(f"valid_{m}") for m in modes], *[share(F.col(m) & F.col("sound")).alias(f"acyclic_{m}") for m in modes])
    each = F.array(*[F.struct(F.lit(m).alias("mode"), F.col("n"), F.col(f"valid_{m}").alias("schema_valid"), F.col(f"acyclic_{m}").alias("acyclic")) for m in modes])
    return sums.select(F.explode(each).alias("m")).select("m.*")


def validity_rates(predictions: DataFrame, mode: str, column: str = "output") -> DataFrame:
    """(n, schema_valid, acyclic): acyclic counts only where the schema is valid."""
    return validity_by_mode(predictions, column, (mode,)).drop("mode")


def length_report(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    n = F.length(text)
    return rows.groupBy(*keys).agg(F.min(n).alias("least"), F.max(n).alias("most"), F.expr(f"sum(length({text})) div count(*)").alias("mean"))


def length_quantiles(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, least, p50, p90, p95, p99, most, mean) of text lengths by nearest rank; a length and its count stand for equal ones, so a hot group stays small."""
    sizes = rows.groupBy(*keys, F.length(text).cast("long").alias("n")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    ranked = sizes.withColumns({"upto": F.sum("c").over(w.orderBy("n")), "total": F.sum("c").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") > F.bround(F.lit(p) * (F.col("total") - 1)), F.col("n")))
    mean = F.bround(F.sum(F.col("n") * F.col("c")) / F.sum("c")).cast("long")
    return ranked.groupBy(*keys).agg(F.min("n").alias("least"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("n").alias("most"), mean.alias("mean"))
