"""Counts, quantiles, ratios, multi-label statistics and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planlake.functions.nested import let, ratio
from planlake.operators.curation import label_pairs, label_sets, label_shares, set_sizes
from planlake.queries.registry import catalogue

query, QUERIES, SQL = catalogue()

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
_LABELLED = "SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list(DISTINCT event_type)) AS labels FROM events GROUP BY ALL"


def labelled(t):
    """A multi-label record for each user and day: the distinct types of its events."""
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("labels"))


@query("""SELECT n_orders, count(*) AS n_customers FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) GROUP BY 1""")
def q01_rows_per_group_hist(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders")).groupBy("n_orders").agg(F.count("*").alias("n_customers"))


@query("""SELECT lang, CAST(min(length(text)) AS BIGINT) AS least, CAST(max(length(text)) AS BIGINT) AS most, round(avg(length(text)), 6) AS mean,
  CAST(median(length(text)) AS DOUBLE) AS median, quantile_cont(length(text), 0.25) AS p25, quantile_cont(length(text), 0.75) AS p75 FROM documents GROUP BY lang""")
def q02_len_stats(t):
    n = F.length("text").cast("long")
    return t.documents.groupBy("lang").agg(
        F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("median"), F.percentile(n, F.lit(0.25)).alias("p25"), F.percentile(n, F.lit(0.75)).alias("p75")
    )


@query("""WITH s AS (SELECT lang, list_sort(list(CAST(length(text) AS BIGINT))) AS v FROM documents GROUP BY lang)
SELECT lang, v[CAST(round_even(0.5 * (len(v) - 1), 0) AS INT) + 1] AS p50, v[CAST(round_even(0.9 * (len(v) - 1), 0) AS INT) + 1] AS p90,
  v[CAST(round_even(CAST(0.95 AS DOUBLE) * (len(v) - 1), 0) AS INT) + 1] AS p95, v[CAST(round_even(CAST(0.99 AS DOUBLE) * (len(v) - 1), 0) AS INT) + 1] AS p99 FROM s""")
def q03_nearest_rank(t):
    """A value and its count stand for equal lengths, so what is gathered for a language grows with distinct lengths only."""
    sizes = t.documents.groupBy("lang", F.length("text").cast("long").alias("n")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("lang").orderBy("n")
    ranked = sizes.withColumns({"upto": F.sum("c").over(w), "total": F.sum("c").over(Window.partitionBy("lang"))})
    at = lambda p: F.min(F.when(F.col("upto") > F.bround(F.lit(p) * (F.col("total") - 1)), F.col("n")))
    return ranked.groupBy("lang").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderpriority, count(*) AS n_orders, round(avg(n), 6) AS mean_lines, CAST(median(n) AS DOUBLE) AS median_lines FROM orders JOIN c ON l_orderkey = o_orderkey GROUP BY 1""")
def q04_step_complexity(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    joined = t.orders.select("o_orderkey", "o_orderpriority").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"), F.round(F.avg("n"), 6).alias("mean_lines"), F.median("n").alias("median_lines"))


@query("""WITH o AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS n FROM lineitem GROUP BY 1)
SELECT round(sum(r) / sum(n), 6) AS ratio_of_sums, round(avg(r / n), 6) AS mean_of_ratios FROM o""")
def q05_ratio_pair(t):
    orders = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n"))
    return orders.agg(F.round(ratio(F.sum("r"), F.sum("n")), 6).alias("ratio_of_sums"), F.round(F.avg(ratio(F.col("r"), F.col("n"))), 6).alias("mean_of_ratios"))


@query("""WITH k AS (SELECT c_mktsegment, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_mktsegment)
SELECT count(DISTINCT {'s': c_mktsegment, 'p': p}) AS n_profiles, count(*) AS n_customers FROM k""")
def q06_distinct_composite(t):
    joined = t.orders.select("o_custkey", "o_orderpriority").join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    keys = joined.groupBy("o_custkey", "c_mktsegment").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    return keys.agg(F.count_distinct(F.struct("c_mktsegment", "p")).alias("n_profiles"), F.count("*").alias("n_customers"))


@query("""SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 25""")
def q07_topk_tie(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(25)


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), top AS (SELECT n FROM c ORDER BY n DESC, l_suppkey LIMIT 10)
SELECT round((SELECT sum(n) FROM top) / (SELECT sum(n) FROM c), 6) AS top_share, (SELECT count(*) FROM c) AS n_suppliers""")
def q08_concentration(t):
    counts = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "l_suppkey").limit(10).agg(F.sum("n").alias("top"))
    both = top.join(counts.agg(F.sum("n").alias("total"), F.count("*").alias("n_suppliers")))  # one row each
    return both.select(F.round(ratio(F.col("top"), F.col("total")), 6).alias("top_share"), "n_suppliers")


@query(f"""WITH g AS ({_LABELLED}), s AS (SELECT len(labels) AS size, count(*) AS n FROM g GROUP BY 1), span AS (SELECT unnest(range(1, (SELECT max(size) FROM s) + 1)) AS size)
SELECT 'set' AS kind, array_to_string(labels, ' + ') AS name, count(*) AS n FROM g GROUP BY ALL
UNION ALL SELECT 'size', CAST(span.size AS VARCHAR), coalesce(n, 0) FROM span LEFT JOIN s USING (size)""")
def q09_label_combos(t):
    rows = labelled(t)
    sets = label_sets(rows).select(F.lit("set").alias("kind"), F.array_join("labels", " + ").alias("name"), "n")
    return sets.union(set_sizes(rows).select(F.lit("size"), F.col("size").cast("string"), "n"))


@query(f"""WITH g AS ({_LABELLED}), e AS (SELECT user_id, day, unnest(labels) AS l FROM g)
SELECT x.l AS a, y.l AS b, count(*) AS n FROM e x JOIN e y ON x.user_id = y.user_id AND x.day = y.day AND x.l < y.l GROUP BY ALL""")
def q10_pair_cooc(t):
    return label_pairs(labelled(t))


_MATRIX = ", ".join(f"coalesce(sum(n) FILTER (b = '{e}'), 0)::BIGINT AS \"{e}\"" for e in EVENT_TYPES)


@query(f"""WITH g AS ({_LABELLED}), e AS (SELECT user_id, day, unnest(labels) AS l FROM g),
c AS (SELECT x.l AS a, y.l AS b, count(*) AS n FROM e x JOIN e y ON x.user_id = y.user_id AND x.day = y.day GROUP BY ALL) SELECT a, {_MATRIX} FROM c GROUP BY a""")
def q11_cooc_matrix(t):
    rows = labelled(t)
    pairs = label_pairs(rows)
    single = rows.select(F.explode("labels").alias("a")).groupBy("a").agg(F.count("*").alias("n")).select("a", F.col("a").alias("b"), "n")
    both = pairs.union(pairs.select("b", "a", "n")).union(single)
    return both.groupBy("a").pivot("b", list(EVENT_TYPES)).agg(F.sum("n")).na.fill(0)


@query(f"""WITH g AS ({_LABELLED}), d AS (SELECT unnest({list(EVENT_TYPES) + ['refund']}) AS label), c AS (SELECT unnest(labels) AS label FROM g)
SELECT d.label, count(c.label) AS n, round(count(c.label) / (SELECT count(*) FROM g), 6) AS share_of_groups, round(count(c.label) / (SELECT count(*) FROM c), 6) AS share_of_labels
FROM d LEFT JOIN c USING (label) GROUP BY 1""")
def q12_multilabel_pct(t):
    domain = t.spark.createDataFrame([(x, i) for i, x in enumerate([*EVENT_TYPES, "refund"])], "label string, place int")
    return label_shares(labelled(t), domain).select("label", "n", F.round("share_of_questions", 6).alias("share_of_groups"), F.round("share_of_labels", 6).alias("share_of_labels"))


@query(f"""WITH g AS ({_LABELLED}), v AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS value FROM events GROUP BY ALL)
SELECT labels[1] AS first_label, count(*) AS n, round(avg(len(labels)), 6) AS mean_labels, round(avg(value), 4) AS mean_value,
  CAST(list_position({list(EVENT_TYPES)}, labels[1]) AS BIGINT) AS place FROM g JOIN v USING (user_id, day) GROUP BY ALL""")
def q13_first_label(t):
    rows = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("labels"), F.sum("value").alias("value"))
    order = F.array(*[F.lit(e) for e in EVENT_TYPES])
    out = rows.groupBy(F.array_min("labels").alias("first_label")).agg(F.count("*").alias("n"), F.round(F.avg(F.size("labels")), 6).alias("mean_labels"), F.round(F.avg("value"), 4).alias("mean_value"))
    return out.withColumn("place", F.array_position(order, F.col("first_label"))).orderBy("place")


@query("""SELECT i - 1 AS place, round(avg(embedding[i]), 5) AS mean, count(*) AS n FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE i <= len(embedding) GROUP BY i""")
def q42_explode_idx(t):
    rows = t.embeddings.select(F.posexplode("embedding").alias("place", "x"))
    return rows.groupBy(F.col("place").cast("long").alias("place")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT o_orderpriority, avg(o_totalprice) AS p, count(*)::DOUBLE AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, round((p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER () + 1e-9), 6) AS price, round((n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER () + 1e-9), 6) AS volume FROM m""")
def q43_minmax_norm(t):
    means = t.orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("p"), F.count("*").cast("double").alias("n"))
    bounds = means.agg(F.min("p").alias("p0"), F.max("p").alias("p1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    scaled = lambda x: F.round((F.col(x) - F.col(f"{x}0")) / (F.col(f"{x}1") - F.col(f"{x}0") + 1e-9), 6)
    return means.join(F.broadcast(bounds)).select("o_orderpriority", scaled("p").alias("price"), scaled("n").alias("volume"))  # broadcast: one row


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, v[len(v) // 2 + 1] AS judged FROM s""")
def q47_judge_median(t):
    scores = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("v"))
    return scores.select("l_orderkey", let(F.array_sort("v"), lambda v: F.element_at(v, (F.size(v) / 2).cast("int") + 1)).alias("judged"))


