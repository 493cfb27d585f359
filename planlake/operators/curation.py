"""From raw clusters to labelled questions: joins on profile keys, three-valued routing, multi-label statistics, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.functions.jsonx import LABELS
from planlake.functions.nested import ratio, unordered_pairs
from planlake.functions.normalize import accepted_body, first_accepted, profile_key, profile_of, question_text
from planlake.operators.ordering import ranked, shuffled
from planlake.sources.tables import last_of_each, with_position


def question_records(selected: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, ids without a cluster): canonical query and the profile and answer pairs of the selected clusters; of repeated ids the last counts."""
    known = with_position(clusters.where("canonical.question.question_id IS NOT NULL")).withColumn("question_id", F.col("canonical.question.question_id"))
    known = last_of_each(known, "question_id", "position")
    ids = selected.select("question_id").where("question_id IS NOT NULL").distinct()
    c = F.col("canonical")
    own = F.array(F.struct(profile_of(c["question_author"]).alias("profile"), accepted_body(c["accepted_answer"]).alias("answer")))
    others = F.transform(F.coalesce("duplicates", F.array()), lambda d: F.struct(profile_of(d["question_author"]).alias("profile"), first_accepted(d["answers"]).alias("answer")))
    rows = ids.join(known, "question_id").select("question_id", question_text(c["question"]["title"], c["question"]["body"]).alias("canonical_query"), F.concat(own, others).alias("profiles_answers"))
    return rows, ids.join(known, "question_id", "left_anti")


def pairs(records: DataFrame) -> DataFrame:
    """(question_id, profile_index, profile, answer)."""
    return records.select("question_id", F.posexplode("profiles_answers").alias("profile_index", "pa")).select("question_id", "profile_index", "pa.profile", "pa.answer")


def review_set(annotated: DataFrame) -> DataFrame:
    """(key, contradicted, unsure, missing) of the profiles that need another verdict."""
    keyed = annotated.withColumn("key", profile_key(F.col("profile"), stripped=False))
    flags = keyed.groupBy("key").agg(
        (F.count_distinct("is_meaningful") > 1).alias("contradicted"),
        F.coalesce(F.bool_or(F.col("meaningful_confidence").isin("low", "medium")), F.lit(False)).alias("unsure"),
        F.bool_or(F.col("is_meaningful").isNull()).alias("missing"),
    )
    return flags.where("contradicted OR unsure OR missing")


def representatives(annotated: DataFrame, review: DataFrame, position: str) -> DataFrame:
    """The first row of each key in review."""
    keyed = annotated.withColumn("key", profile_key(F.col("profile"), stripped=False)).join(review.select("key"), "key", "left_semi")
    first = F.min_by(F.struct(*annotated.columns), F.col(position)).alias("row")
    return keyed.groupBy("key").agg(first).select("key", "row.*")


def overwritten(annotated: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Both label columns replaced where a verdict has the row's key, even by null."""
    new = verdicts.select(F.col("profile_key").alias("v_key"), F.col("is_meaningful").alias("v_label"), F.col("meaningful_confidence").alias("v_confidence"))
    keyed = annotated.withColumn("v_own", profile_key(F.col("profile"), stripped=False))
    joined = keyed.join(new, keyed["v_own"] == new["v_key"], "left")
    hit = F.col("v_key").isNotNull()
    return joined.withColumns({"is_meaningful": F.when(hit, F.col("v_label")).otherwise(F.col("is_meaningful")), "meaningful_confidence": F.when(hit, F.col("v_confidence")).otherwise(F.col("meaningful_confidence"))}).select(*annotated.columns)


def verdict_of_keys(annotated: DataFrame) -> DataFrame:
    """(key, status): valid if any row says so, else invalid, else failed."""
    keyed = annotated.withColumn("key", profile_key(F.col("profile")))
    rank = F.max(F.when(F.col("is_meaningful"), 2).when(~F.col("is_meaningful"), 1).otherwise(0))
    return keyed.groupBy("key").agg(F.element_at(F.array(F.lit("failed"), F.lit("invalid"), F.lit("valid")), rank + 1).alias("status"))


def filtered_records(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Records whose profiles are valid or were never judged; records left without any go."""
    rows = pairs(records).withColumn("key", profile_key(F.col("profile")))
    kept = rows.join(verdicts, "key", "left").where("status = 'valid' OR status IS NULL")
    nested = kept.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("profile_index", "profile", "answer"))).alias("kept"))
    nested = nested.select("question_id", F.transform("kept", lambda x: F.struct(x["profile"].alias("profile"), x["answer"].alias("answer"))).alias("profiles_answers"))
    return records.drop("profiles_answers").join(nested, "question_id")


def keep_rates(before: DataFrame, after: DataFrame) -> DataFrame:
    n = before.agg(F.count("*").alias("questions"), F.sum(F.size("profiles_answers")).alias("pairs"))
    m = after.agg(F.count("*").alias("kept_questions"), F.sum(F.size("profiles_answers")).alias("kept_pairs"))
    return n.join(m).withColumn("dropped_share", 1 - ratio(F.col("kept_pairs"), F.col("pairs"), 1.0))  # one row each


def label_domain(spark, labels: tuple[str, ...] = LABELS) -> DataFrame:
    return spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, place int")


def label_shares(questions: DataFrame, domain: DataFrame) -> DataFrame:
    """(label, n, share_of_questions, share_of_labels) for every label of domain, by place."""
    counts = questions.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    total = questions.agg(F.count("*").alias("questions"), F.sum(F.size("labels")).alias("all_labels"))
    rows = domain.join(counts, "label", "left").na.fill(0, ["n"]).join(F.broadcast(total))  # broadcast: one row
    return rows.select("label", "n", ratio(F.col("n"), F.col("questions")).alias("share_of_questions"), ratio(F.col("n"), F.col("all_labels")).alias("share_of_labels"), "place").orderBy("place")


def label_sets(questions: DataFrame) -> DataFrame:
    return questions.groupBy(F.array_sort("labels").alias("labels")).agg(F.count("*").alias("n"))


def label_pairs(questions: DataFrame, labels: str = "labels") -> DataFrame:
    """(a, b, n) over unordered pairs."""
    return questions.select(F.explode(unordered_pairs(F.col(labels))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def set_sizes(questions: DataFrame) -> DataFrame:
    """(size, n) for every size from 1 to the largest."""
    counts = questions.groupBy(F.size("labels").alias("size")).agg(F.count("*").alias("n"))
    span = counts.agg(F.explode(F.sequence(F.lit(1), F.max("size"))).alias("size"))
    return span.join(counts, "size", "left").na.fill(0, ["n"])


def stratified_split(rows: DataFrame, group: str, variant: str, seed: int = 42, share: float = 0.1) -> DataFrame:
    """(group, stratum, split): groups dealt within the stratum of their number of variants; round-half-even(share * n) to test, as many to dev."""
    strata = rows.groupBy(group).agg(F.count_distinct(variant).alias("stratum"))
    placed = ranked(strata, shuffled(F.col(group), seed), group, "stratum")
    n = F.bround(F.col("n") * F.lit(share))
    split = F.when(F.col("place") <= n, "test").when(F.col("place") <= 2 * n, "dev").otherwise("train")
    return placed.select(group, "stratum", split.alias("split"))


def row_split(rows: DataFrame, key: str, seed: int = 42, share: float = 0.1) -> DataFrame:
    """rows with split: a row goes to test if its digest falls in the share. A digest decides alone, so no order over all rows is needed."""
    u = F.conv(F.substring(shuffled(F.col(key), seed), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return rows.withColumn("split", F.when(u < share, "test").otherwise("train"))


def sized_row_split(rows: DataFrame, key: str, seed: int = 42, share: float = 0.1) -> DataFrame:
    """rows with split: exactly max(1, round-half-even(share * n)) of them, first in shuffled order, are valid and the rest train."""
    placed = ranked(rows, shuffled(F.col(key), seed), key)
    first = F.col("place") <= F.greatest(F.lit(1.0), F.bround(F.col("n") * F.lit(share)))
    return placed.select(*rows.columns, F.when(first, "valid").otherwise("train").alias("split"))


def leakage(rows: DataFrame, group: str = "question_id") -> DataFrame:
    """(n_train, n_valid, train_groups, valid_groups, leaking, leaking_share) of rows with split: groups that stand on both sides, over the valid ones."""
    side = lambda s: F.col("split") == s
    groups = rows.groupBy(group).agg(F.count_if(side("train")).alias("t"), F.count_if(side("valid")).alias("v"))
    leaking = F.count_if((F.col("t") > 0) & (F.col("v") > 0))
    sums = groups.agg(F.sum("t").alias("n_train"), F.sum("v").alias("n_valid"), F.count_if(F.col("t") > 0).alias("train_groups"), F.count_if(F.col("v") > 0).alias("valid_groups"), leaking.alias("leaking"))
    return sums.withColumn("leaking_share", ratio(F.col("leaking"), F.greatest(F.col("valid_groups"), F.lit(1))))


def overlapping(rows: DataFrame, key: str = "question_id") -> DataFrame:
    """Keys that stand in more than one split."""
    return rows.groupBy(key).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def assigned(records: DataFrame, splits: DataFrame, strict: bool = True) -> DataFrame:
    """records with their split; strict raises on records without one, else they are left out."""
    known = splits.select("question_id", "split")
    if strict:
        fail = F.raise_error(F.concat(F.lit("record without a split: "), F.col("question_id").cast("string"))).cast("string")
        return records.join(known, "question_id", "left").withColumn("split", F.coalesce("split", fail))
    return records.join(known, "question_id")


def orphans(records: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records without a split, ids of splits without a record)."""
    return records.join(splits, "question_id", "left_anti"), splits.select("question_id").distinct().join(records, "question_id", "left_anti")


def in_file_order(rows: DataFrame) -> DataFrame:
    """rows by question_id as text, then profile_index as a number."""
    return rows.orderBy(F.col("question_id").cast("string"), F.col("profile_index").cast("int"))


def split_report(rows: DataFrame) -> DataFrame:
    """(split, n_rows, n_groups, n_two, n_three): rows (question_id, profile_index, split) and groups with two and three variants or more."""
    groups = rows.groupBy("split", "question_id").agg(F.count("*").alias("n"), F.count_distinct("profile_index").alias("variants"))
    return groups.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(F.col("variants") >= 2).alias("n_two"), F.count_if(F.col("variants") >= 3).alias("n_three"))


def split_distributions(rows: DataFrame) -> DataFrame:
    """(split, kind, value, n): groups by number of variants, rows by profile_index, and rows whose question stands in another split as well; split all is over all."""
    groups = rows.groupBy("question_id").agg(F.count_distinct("profile_index").alias("variants"), F.array_sort(F.collect_set("split")).alias("splits"))
    spread = lambda splits: F.explode(F.concat(splits, F.array(F.lit("all")))).alias("split")
    of_groups = groups.select(spread(F.col("splits")), F.lit("variants").alias("kind"), F.col("variants").cast("long").alias("value"))
    of_rows = rows.select(spread(F.array("split")), F.lit("profile_index").alias("kind"), F.col("profile_index").cast("long").alias("value"))
    leaking = rows.join(groups.where(F.size("splits") > 1).select("question_id"), "question_id", "left_semi").select("split", F.lit("leaking").alias("kind"), F.lit(None).cast("long").alias("value"))
    return of_groups.union(of_rows).union(leaking).groupBy("split", "kind", "value").agg(F.count("*").alias("n"))


def profile_counts(records: DataFrame) -> DataFrame:
    """One row: questions, profiles, answers that are there, and the mean, least and most profiles of a question."""
    n = F.size("profiles_answers").cast("long")
    answered = F.size(F.filter("profiles_answers", lambda x: x["answer"].isNotNull())).cast("long")
    sums = records.agg(F.count("*").alias("questions"), F.sum(n).alias("profiles"), F.sum(answered).alias("answers"), F.min(n).alias("least"), F.max(n).alias("most"))
    return sums.withColumn("mean", ratio(F.col("profiles"), F.col("questions")))


def selected(scores: DataFrame, dimensions: tuple[str, ...], total: int = 10) -> DataFrame:
    """Rows whose dimensions add up to total or more, none of them being 1."""
    summed = sum((F.col(d) for d in dimensions[1:]), F.col(dimensions[0]))
    return scores.where((summed >= total) & (F.least(*dimensions) > 1))
