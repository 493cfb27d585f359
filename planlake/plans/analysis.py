"""The statistics document over plan records, and the construction and training lifecycles, as whole plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.functions.normalize import first_label
from planlake.operators import compare, curation
from planlake.operators import plan as P


def measured(plans: DataFrame) -> DataFrame:
    """All per-plan measures, from one parse."""
    return P.pedagogy(P.integrity(P.graph_measures(P.complexity(P.components(plans)))))


def by_variant(rows: DataFrame) -> DataFrame:
    """Plan size by profile_index."""
    return rows.groupBy("profile_index").agg(
        F.count("*").alias("n"), F.bround(F.avg("n_steps"), 2).alias("mean_steps"), F.bround(F.avg("n_agents"), 2).alias("mean_agents"), F.bround(F.avg("human_ratio"), 2).alias("mean_human_ratio")
    )


def by_intent(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Plan size by the question's first label; unlabelled questions are UNKNOWN."""
    intents = labels.select("question_id", first_label(F.col("labels")).alias("intent"))
    joined = rows.join(intents, "question_id", "left").na.fill("UNKNOWN", ["intent"])
    return joined.groupBy("intent").agg(F.count("*").alias("n"), F.bround(F.avg("n_steps"), 2).alias("mean_steps"), F.bround(F.avg("diversity"), 2).alias("mean_diversity"))


def overview(rows: DataFrame) -> DataFrame:
    """One row: sizes, graph shape, pedagogy coverage and integrity over all plans."""
    from planlake.functions.text import PEDAGOGY

    coverage = F.struct(*[F.avg(F.col(f"has_{k}").cast("double")).alias(k) for k, _ in PEDAGOGY])
    issues = F.struct(*[F.count_if(k).alias(k) for k in ("unknown_agent", "unknown_dependency", "order_unknown", "order_missing", "in_cycle", "any_issue")])
    sizes = [F.avg(k).alias(f"mean_{k}") for k in ("n_agents", "n_subtasks", "n_steps", "n_loops", "human_ratio")]
    shape = [F.avg(f"dag.{k}").alias(f"mean_{k}") for k in ("longest", "width", "parallel")]
    return rows.agg(F.count("*").alias("n_plans"), F.count_distinct("question_id").alias("n_questions"), *sizes, *shape, coverage.alias("pedagogy"), issues.alias("issues"))


def divergence(rows: DataFrame) -> DataFrame:
    pairs = compare.profile_divergence(compare.features(rows))
    return pairs.agg(F.count("*").alias("pairs"), *[F.avg(k).alias(k) for k in ("role", "family", "tools", "subtask", "pedagogy", "step_diff")])


def construction(selected: DataFrame, clusters: DataFrame, annotated: DataFrame, verdicts: DataFrame) -> dict[str, DataFrame]:
    """Raw clusters to filtered records: join, routing by judged profiles, and the keep rates."""
    records, missing = curation.question_records(selected, clusters)
    settled = curation.overwritten(annotated, verdicts)
    kept = curation.filtered_records(records, curation.verdict_of_keys(settled))
    return {"records": records, "missing": missing, "annotated": settled, "kept": kept, "rates": curation.keep_rates(records, kept)}
