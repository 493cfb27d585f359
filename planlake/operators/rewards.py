"""Rewards of a completion against its gold plan, as columns; each plan is parsed once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlake import schemas
from planlake.functions.jsonx import object_variant
from planlake.functions.nested import let, ratio, upper_median
from planlake.functions.text import PERSON_REFERENCE, matches, personal_sentence, phase_checks, phase_lower, profile_signals, sentences
from planlake.operators import plan as P

#: Where a plan may stand in an object, the first that is there first.
LAYOUTS = ("$.plan.output", "$.output", "$")
COLUMNS = ("roles", "names", "step_ids", "edges", "step_tools")
#: All that is told of a plan, and what scores read of a completion.
MADE = ("agents", "subtasks", "entries", "steps", "loops", "step_ids", "all_edges", "edges", "roles", "names", "step_tools", "agent_tools", "order_ids")
SCORED = ("agents", "subtasks", "steps", *COLUMNS)


@dataclass(frozen=True)
class RewardConfig:
    struct_weight: float = 0.55
    pers_weight: float = 0.25
    ped_weight: float = 0.20
    penalty: float = 10.0
    pers_mode: str = "off"
    ped_mode: str = "off"
    full_share: float = 0.8

    def __post_init__(self):
        if self.pers_mode not in ("off", "lite", "counterfactual"):
            raise ValueError(f"pers_mode {self.pers_mode}")
        if self.ped_mode not in ("off", "lite", "full"):
            raise ValueError(f"ped_mode {self.ped_mode}")


def parsed(rows: DataFrame, text: str, prefix: str, fields: tuple[str, ...] = MADE) -> DataFrame:
    """rows with a struct column named prefix of fields of a plan's components, null where text holds no object; the text is parsed once."""
    known = rows.withColumn("__parsed", object_variant(F.col(text)))
    out = F.coalesce(*[F.try_variant_get("__parsed", at, schemas.OUTPUT) for at in LAYOUTS])
    known = P.components(known.withColumn("__out", out), "__out")
    return known.withColumn(prefix, F.when(F.col("__out").isNotNull(), F.struct(*fields))).drop("__parsed", "__out", *MADE)


def _fields(c: Column) -> dict[str, Column]:
    return {k: c[k] for k in COLUMNS}


def similarity_or_zero(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), P.similarity(_fields(a), _fields(b))).otherwise(0.0)


def r_struct(c: Column, gold: Column, cyclic: Column | None = None) -> Column:
    cyclic = P.has_cycle(c["step_ids"], c["edges"]) if cyclic is None else cyclic
    score = 0.25 * (~cyclic).cast("double") + 0.25 * P.dependency_completeness(c["step_ids"], c["edges"]) + 0.20 * P.tool_relevance(c["steps"], c["agents"]) + 0.30 * similarity_or_zero(c, gold)
    return F.when(c.isNotNull(), score).otherwise(0.0)


def r_hard(c: Column, penalty: float, cyclic: Column | None = None) -> Column:
    cyclic = P.has_cycle(c["step_ids"], c["edges"]) if cyclic is None else cyclic
    bad_tool = F.exists(c["steps"], lambda s: P.present(s["tool"]) & ~P._declares(c["agents"], s["agent"], s["tool"]))
    fine = c.isNotNull() & P.usable(c["agents"], c["subtasks"], c["steps"]) & ~cyclic & ~bad_tool
    return F.when(F.coalesce(fine, F.lit(False)), 0.0).otherwise(-penalty)


def r_counterfactual(c: Column, gold: Column, other: Column) -> Column:
    return F.when(other.isNotNull(), similarity_or_zero(c, gold) - similarity_or_zero(c, other)).otherwise(0.0)


def r_pers_lite(c: Column, description: Column, skills: Column, long_step: int = 150) -> Column:
    """The share of steps that are long, speak to the learner, and do so in a sentence with a signal of the profile or an anchor; times 0.8."""

    def share(signals: Column) -> Column:
        text = lambda s: F.coalesce(s["instruction"], F.lit(""))
        good = F.filter(c["steps"], lambda s: (F.length(text(s)) >= long_step) & matches(text(s), PERSON_REFERENCE) & F.exists(sentences(text(s)), lambda x: personal_sentence(x, signals)))
        return F.least(ratio(F.size(good), F.size(c["steps"])), F.lit(1.0)) * 0.8

    return F.when(c.isNotNull(), let(profile_signals(description, skills), share)).otherwise(0.0)


def r_ped_phases(c: Column) -> Column:
    place = lambda at, i: F.coalesce(F.get(at, F.lit(i)).try_cast("int"), F.lit(10**9))
    text = lambda s: F.concat_ws(" ", F.coalesce(s["instruction"], F.lit("")), F.coalesce(s["objective"], F.lit("")))
    keyed = F.transform(c["steps"], lambda s: let(F.split(F.regexp_extract(s["id"], r"^S(\d+-\d+)$", 1), "-"), lambda at: F.struct(place(at, 0).alias("i"), place(at, 1).alias("j"), text(s).alias("text"))))
    phases = F.transform(F.array_sort(keyed), lambda s: let(F.lower(s["text"]), phase_lower))
    return F.when(c.isNotNull(), phase_checks(phases)).otherwise(0.0)


def compose(struct: Column, pers: Column, ped: Column, hard: Column, config: RewardConfig) -> Column:
    return config.struct_weight * struct + config.pers_weight * pers + config.ped_weight * ped + hard


def score(rows: DataFrame, config: RewardConfig | None = None, precedence: Column | None = None, judges: list[Column] | None = None, mined: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows (completion, gold_plan, learner_profile, cf_plan if counterfactual) with r_struct, r_hard, r_pers, r_ped and reward.

    mined: ordered pairs (a, b) of subtask names as plan.mined_precedence gives them, with which each completion's own order is compared, joined by keys, the
    columns that tell rows apart, with a second reading of completions for their names, so that no parsed plan is written or moved; precedence: or a column with that share, 0 without either, and for a completion that holds no plan; judges: columns
    of scores for ped_mode full.
    """
    config = config or RewardConfig()
    given = rows
    rows = parsed(parsed(rows, "completion", "__c", SCORED), "gold_plan", "__g", COLUMNS)
    rows = rows.withColumn("__cyclic", P.has_cycle(F.col("__c.step_ids"), F.col("__c.edges")))
    c, g = F.col("__c"), F.col("__g")
    pers = F.lit(0.0)
    if config.pers_mode == "counterfactual":
        rows = parsed(rows, "cf_plan", "__f", COLUMNS)
        pers = r_counterfactual(c, g, F.col("__f"))
    elif config.pers_mode == "lite":
        who = F.from_json("learner_profile", "self_description string, about_me string, skills array<string>, top_tags array<string>")
        from planlake.functions.normalize import filled, filled_list

        pers = r_pers_lite(c, filled(who["self_description"], who["about_me"]), filled_list(who["skills"], who["top_tags"]))
    joined = mined is not None and config.ped_mode != "off"
    if joined and not keys:
        raise ValueError("keys are needed to join what is mined")
    phases = r_ped_phases(c) if config.ped_mode != "off" else F.lit(0.0)
    own = {"r_struct": r_struct(c, g, F.col("__cyclic")), "r_hard": r_hard(c, config.penalty, F.col("__cyclic")), "r_pers": pers, "__phases": phases}
    rows = rows.withColumns(own).drop("__c", "__g", "__f", "__cyclic")
    if joined:
        told = parsed(given.select(*dict.fromkeys([*keys, "completion"])), "completion", "__c", ("subtasks",)).where("__c IS NOT NULL")
        shares = P.precedence_compatibility(told.select(*keys, F.col("__c.subtasks").alias("subtasks")), mined, *keys)
        shares = shares.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("compatibility").alias("__precedence"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
        rows = rows.join(shares, same, "left").drop(*[f"__of_{k}" for k in keys])
        precedence = F.coalesce(F.col("__precedence"), F.lit(0.0))
    ped = F.lit(0.0)
    if config.ped_mode != "off":
        ped = 0.5 * (precedence if precedence is not None else F.lit(0.0)) + 0.5 * F.col("__phases")
        if config.ped_mode == "full" and judges:
            ped = (1 - config.full_share) * ped + config.full_share * F.coalesce(upper_median(F.array(*judges)), F.lit(0.0))
    rows = rows.withColumn("r_ped", ped)
    return rows.withColumn("reward", compose(F.col("r_struct"), F.col("r_pers"), F.col("r_ped"), F.col("r_hard"), config)).drop("__phases", "__precedence")


def with_references(rollouts: DataFrame, gold: DataFrame, counterfactual: DataFrame | None = None) -> DataFrame:
    """rollouts (question_id, profile_index, completion) with gold_plan and learner_profile from gold and cf_plan from counterfactual, null where there is none.

    Both sides are looked up by question and profile; of several rows for one, the least counts.
    """
    key = ["question_id", "profile_index"]
    known = gold.groupBy(*key).agg(F.min("gold_plan").alias("gold_plan"), F.min("learner_profile").alias("learner_profile"))
    rows = rollouts.join(known, key, "left")
    if counterfactual is None:
        return rows.withColumn("cf_plan", F.lit(None).cast("string"))
    return rows.join(counterfactual.groupBy(*key).agg(F.min("cf_plan").alias("cf_plan")), key, "left")


def group_zscore(value: Column, *group: str, least: float = 1e-6) -> Column:
    """Deviation from the group's mean in population deviations; 0 where there is next to none. For groups that fit a task."""
    w = Window.partitionBy(*group)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > least, (value - F.avg(value).over(w)) / sd).otherwise(0.0)


def with_group_zscore(rows: DataFrame, value: str, *group: str, least: float = 1e-6) -> DataFrame:
    """rows with z: the deviation of value from its group's mean in population deviations, 0 where there is next to none.

    Means are pre-aggregated and joined back, so that a hot group's rows stay where they are.
    """
    means = rows.groupBy(*group).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"))
    of = means.select(*[F.col(c).alias(f"__of_{c}") for c in group], "__mean", "__sd")
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    z = F.when(F.col("__sd") > least, (F.col(value) - F.col("__mean")) / F.col("__sd")).otherwise(0.0)
    return rows.join(of, same).select(*rows.columns, z.alias("z"))


def batch_means(rows: DataFrame, *components: str) -> DataFrame:
    """One row: the mean of each reward component over the batch, 0 for a batch without rows."""
    return rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in components])


def moving_average(values: Column, decay: float) -> Column:
    """Exponential moving average over an ordered array, starting at its first value."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(decay * a + (1 - decay) * x))


def reweighted(weights: list[Column], gains: list[Column], rate: float, low: float, high: float) -> list[Column]:
    """Weights times exp(rate * gain), clipped, then scaled to sum to 1."""
    raised = [F.greatest(F.lit(low), F.least(F.lit(high), w * F.exp(rate * g))) for w, g in zip(weights, gains, strict=True)]
    total = sum(raised[1:], raised[0])
    return [r / total for r in raised]


def update_due(step: Column, warmup: int, every: int) -> Column:
    """Whether weights are to be updated: past the warm-up, at every so many steps."""
    return (step > warmup) & (step % every == 0)


def reward_values(spark, completions: list[str], config: RewardConfig | None = None, **columns: list) -> list[float]:
    """The rewards of a batch of completions, in their order; a shorter side column is filled up with nulls."""
    from itertools import zip_longest

    names = ("gold_plan", "learner_profile", "cf_plan")
    side = list(zip_longest(*[columns.get(n, []) for n in names]))[: len(completions)]
    side += [(None,) * len(names)] * (len(completions) - len(side))
    rows = spark.createDataFrame([(i, c, *s) for i, (c, s) in enumerate(zip(completions, side, strict=True))], "place int, completion string, " + ", ".join(f"{n} string" for n in names))
    return [r["reward"] for r in score(rows, config).select("place", "reward").orderBy("place").collect()]
