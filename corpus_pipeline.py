"""From raw documents to token ids in five stages, each on all that the one before it kept.

Every stage but the last returns the columns of its documents, under whatever names. Edge cases: rows without doc_id pass the filters by their text
like any other and are mixed and written with null; null and empty texts are no leak and have no words, so the mix never takes them; repeated rows
are one to the near-duplicate stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planlake.llm import decontam, mixing, simhash, tokens, toxicity
from planlake.llm.common import materialize, scratch, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic, by a model learnt from the labels of docs; without labels all stay."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one of least doc_id; rows without doc_id are in no group."""
    return simhash.keep_one_of_each(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, each row by its own text; an empty benchmark drops none."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"), keep_unnamed=False)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some of them twice, to the sources' target weights; a null source is a source."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids and returns each document's place and digest, read from the files; rows without doc_id come first."""
    return tokens.op3_token_orc(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_filter),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: Learnt weights, alignments and token ids are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage writes for itself goes when its documents are written
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
