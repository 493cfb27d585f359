"""The queries of the corpus operators, each over its whole table, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from planlake.llm import ann, debruijn, decontam, licenses, merkle, mixing, pii, preference, repeats, runs, simhash, tokens, toxicity
from planlake.llm.common import table


def _over(operator: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*[table(spark, sf_dir, n) for n in names])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_pivots": _over(simhash.op1_simhash_pivots, "documents"),
        "op2_additive_quantisation": _over(ann.op2_additive_quantisation, "embeddings"),
        "op3_token_orc": _over(tokens.op3_token_orc, "documents"),
        "op4_license_rules": _over(licenses.op4_license_rules, "documents"),
        "op5_suffix_radix": _over(repeats.op5_suffix_radix, "documents"),
        "op6_toxicity_ftrl": _over(toxicity.op6_toxicity_ftrl, "documents", "labels"),
        "op7_preference_format": _over(preference.op7_preference_format, "conversations"),
        "op8_fair_queueing": _over(mixing.op8_fair_queueing, "documents"),
        "op9_pii_spans": _over(pii.op9_pii_spans, "documents"),
        "op10_rare_seed_alignment": _over(decontam.op10_rare_seed_alignment, "documents", "benchmark"),
        "op11_debruijn_paths": _over(debruijn.op11_debruijn_paths, "documents"),
        "op12_lyndon_runs": _over(runs.op12_lyndon_runs, "documents"),
        "op13_merkle_manifest": _over(merkle.op13_merkle_manifest, "documents"),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_preference_format": preference.OP7_SQL, "op8_fair_queueing": mixing.OP8_SQL, "op11_debruijn_paths": debruijn.OP11_SQL, "op13_merkle_manifest": merkle.OP13_SQL}
