"""Readers and sinks, round by round through files in the shared folder, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.operators import compare
from planlake.operators import plan as P
from planlake.plans import analysis
from planlake.queries.plandata import LINES, order_plans
from planlake.queries.plans import _SETS, _SIMILAR
from planlake.queries.registry import catalogue
from planlake.sources import tables
from planlake.sources.folders import passing_folder

query, QUERIES, SQL = catalogue()


@query("""SELECT c_custkey % 3 AS part, count(*) AS n, count(*) FILTER (c_custkey % 5 = 0) AS n_null, md5(string_agg(c_name || CASE WHEN c_custkey % 5 = 0 THEN '-' ELSE c_mktsegment END, ',' ORDER BY c_custkey)) AS digest FROM customer GROUP BY 1""")
def q115_json_lines(t):
    """Written as JSON lines by part, nulls and all, and read strictly."""
    told = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    path = passing_folder(t.spark, "json-lines")
    tables.write_jsonl(t.customer.select("c_custkey", "c_name", told.alias("c_mktsegment"), (F.col("c_custkey") % 3).alias("part")), path, by="part")
    rows = tables.jsonl(t.spark, path, "c_custkey long, c_name string, c_mktsegment string, part long")
    line = F.array_sort(F.collect_list(F.struct("c_custkey", F.concat("c_name", F.coalesce("c_mktsegment", F.lit("-"))).alias("x"))))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("c_mktsegment").isNull()).alias("n_null"), F.md5(F.array_join(F.transform(line, lambda s: s["x"]), ",")).alias("digest"))


@query("""SELECT 'good' AS kind, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'bad', count(*), 0 FROM customer WHERE c_custkey % 7 = 0""")
def q116_tolerant_lines(t):
    """Every seventh line is cut short, others are blank, and one file begins with a mark of byte order."""
    path = passing_folder(t.spark, "lines")
    said = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("question_id"), F.col("c_name").alias("canonical_query")))
    line = F.when(F.col("c_custkey") % 7 == 0, F.substring(said, 1, 12)).otherwise(said)
    t.customer.select(F.concat(F.when(F.col("c_custkey") == 1, "\ufeff").otherwise(""), line, F.when(F.col("c_custkey") % 11 == 0, "\n  ").otherwise("")).alias("value")).write.text(path)
    good, bad = tables.jsonl_tolerant(t.spark, path, "question_id string, canonical_query string")
    asked = tables.questions(t.spark, path)
    return asked.join(good.select("question_id"), "question_id").agg(F.lit("good").alias("kind"), F.count("*").alias("n"), F.sum(F.col("question_id").cast("long")).alias("total")).union(bad.agg(F.lit("bad"), F.count("*"), F.lit(0).cast("long")))


@query("""WITH r AS (SELECT CASE o_orderkey % 10 WHEN 8 THEN 'dev' WHEN 9 THEN 'test' ELSE 'train' END AS split, * FROM orders)
SELECT split, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, count(*) FILTER (o_orderkey % 4 <> 0) AS left_over FROM r GROUP BY 1""")
def q117_split_files(t):
    """Files by split, read split by split; results appended in two runs, of which the second does what the first left."""
    split = F.when(F.col("o_orderkey") % 10 == 8, "dev").when(F.col("o_orderkey") % 10 == 9, "test").otherwise("train")
    rows = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("said"), split.alias("split"))
    path = passing_folder(t.spark, "splits")
    tables.write_jsonl(rows, path, by="split")
    read = tables.split_files(t.spark, {s: f"{path}/split={s}" for s in ("train", "dev", "test")}, "key long, said string")
    out = passing_folder(t.spark, "results")
    kinds = "key long, said string, split string"
    tables.append_results(read.where("key % 4 = 0"), read.where("false"), out)
    rest = tables.not_done(read, tables.jsonl(t.spark, f"{out}/plans", kinds))
    counts = rest.groupBy("split").agg(F.count("*").alias("left_over"))
    tables.append_results(rest, read.where("false"), out)
    done = tables.jsonl(t.spark, f"{out}/plans", kinds).groupBy("split").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))
    return done.join(counts, "split").select("split", "n", "keys", "left_over")


@query(f"""WITH {LINES}, d AS (SELECT g.k, g.c, g.m, CASE c % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'API_USAGE' WHEN 2 THEN 'ERRORS' ELSE 'CONCEPTUAL' END AS intent FROM g)
SELECT intent, count(*) AS n, CAST(round_even(CAST(avg(m) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS mean_steps FROM d GROUP BY 1""")
def q118_by_intent(t):
    rows = analysis.measured(order_plans(t).where("question_id IS NOT NULL"))
    c = F.col("c_custkey")
    labels = t.customer.where("c_custkey % 4 > 0").select(c.cast("string").alias("question_id"), F.when(c % 4 == 1, F.array(F.lit("API_USAGE"), F.lit("ERRORS"))).when(c % 4 == 2, F.array(F.lit("ERRORS"))).otherwise(F.array(F.lit("CONCEPTUAL"), F.lit("REVIEW"))).alias("labels"))
    return analysis.by_intent(rows, labels).select("intent", "n", "mean_steps")


@query(f"""WITH {LINES}, {_SETS} SELECT count(*) AS n, round(avg({_SIMILAR}), 6) AS same FROM f a JOIN f b ON a.c = b.c AND a.i < b.i""")
def q119_same_question_likeness(t):
    """The likeness of plans of one question, which profile sensitivity holds against that of random pairs."""
    from planlake.operators.rewards import COLUMNS

    pairs = compare.same_question_pairs(P.components(order_plans(t)), COLUMNS)
    alike = P.similarity({k: F.col(f"x.{k}") for k in COLUMNS}, {k: F.col(f"y.{k}") for k in COLUMNS})
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg(alike), 6).alias("same"))
