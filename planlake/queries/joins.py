"""Joins, routing, splits and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planlake.functions.nested import multiset_jaccard, set_jaccard
from planlake.operators.curation import overlapping, row_split, stratified_split
from planlake.queries.registry import catalogue
from planlake.sources.tables import last_of_each, not_done

query, QUERIES, SQL = catalogue()


@query("""WITH last AS (SELECT arg_max(o_orderkey, o_orderkey) AS o_orderkey, o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey)
SELECT c_mktsegment, count(o_custkey) AS matched, count(*) - count(o_custkey) AS missing, round(sum(o_totalprice), 2) AS last_value FROM customer LEFT JOIN last ON o_custkey = c_custkey GROUP BY 1""")
def q14_selected_join(t):
    last = last_of_each(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_orderkey")
    joined = t.customer.select("c_custkey", "c_mktsegment").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_mktsegment").agg(F.count("o_custkey").alias("matched"), (F.count("*") - F.count("o_custkey")).alias("missing"), F.round(F.sum("o_totalprice"), 2).alias("last_value"))


_ROUTES = """WITH v AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2 WHEN 0 THEN 1 ELSE 0 END) AS s FROM labels GROUP BY doc_id),
r AS (SELECT lang, CASE WHEN s = 2 THEN 'keep' WHEN s IS NULL THEN 'unseen' ELSE 'drop' END AS route FROM documents LEFT JOIN v USING (doc_id))"""


@query(f"{_ROUTES} SELECT lang, route, count(*) AS n FROM r GROUP BY ALL")
def q15_three_way_route(t):
    verdicts = t.labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)).alias("s"))
    route = F.when(F.col("s") == 2, "keep").when(F.col("s").isNull(), "unseen").otherwise("drop")
    return t.documents.select("doc_id", "lang").join(verdicts, "doc_id", "left").groupBy("lang", route.alias("route")).agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT md5(text) AS k, count(DISTINCT quality) > 1 AS contradicted, bool_or(quality IS NULL) AS missing, count(*) AS n
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY md5(text))
SELECT count(*) AS n_keys, count(*) FILTER (contradicted) AS contradicted, count(*) FILTER (missing) AS missing, CAST(coalesce(sum(n) FILTER (contradicted), 0) AS BIGINT) AS rows_contradicted FROM k""")
def q16_contradiction(t):
    joined = t.documents.select("doc_id", F.md5("text").alias("k")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    keys = joined.groupBy("k").agg((F.count_distinct("quality") > 1).alias("contradicted"), F.bool_or(F.col("quality").isNull()).alias("missing"), F.count("*").alias("n"))
    return keys.agg(F.count("*").alias("n_keys"), F.count_if("contradicted").alias("contradicted"), F.count_if("missing").alias("missing"), F.coalesce(F.sum(F.when(F.col("contradicted"), F.col("n"))), F.lit(0)).alias("rows_contradicted"))


@query("""WITH v AS (SELECT DISTINCT md5(text) AS k FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
m AS (SELECT doc_id, lang, CASE WHEN v.k IS NOT NULL THEN 0 ELSE quality END AS q FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN v ON v.k = md5(text))
SELECT lang, count(*) FILTER (q = 1) AS good, count(*) FILTER (q = 0) AS bad, count(*) FILTER (q IS NULL) AS unknown FROM m GROUP BY lang""")
def q17_overwrite_join(t):
    rows = t.documents.select("doc_id", "lang", F.md5("text").alias("k")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    verdicts = rows.where("quality = 0").select(F.col("k").alias("v")).distinct()
    q = F.when(F.col("v").isNotNull(), 0).otherwise(F.col("quality"))
    merged = rows.join(verdicts, rows["k"] == verdicts["v"], "left").withColumn("q", q)
    return merged.groupBy("lang").agg(F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") == 0).alias("bad"), F.count_if(F.col("q").isNull()).alias("unknown"))


@query("""WITH k AS (SELECT l_orderkey, count(*) AS n_kept, min(l_linenumber) AS first_line FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT o_orderpriority, count(*) AS n_orders, CAST(sum(n_kept) AS BIGINT) AS n_lines, CAST(sum(first_line) AS BIGINT) AS first_lines FROM orders JOIN k ON l_orderkey = o_orderkey GROUP BY 1""")
def q18_renest_filter(t):
    nested = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("lines"))
    kept = nested.withColumn("lines", F.filter("lines", lambda x: x["l_returnflag"] != "N")).where(F.size("lines") > 0)
    joined = t.orders.select("o_orderkey", "o_orderpriority").join(kept, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"), F.sum(F.size("lines")).alias("n_lines"), F.sum(F.col("lines")[0]["l_linenumber"]).alias("first_lines"))


_SPLIT = """WITH s AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS stratum FROM orders GROUP BY 1),
p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || o_custkey), o_custkey) AS place, round_even(CAST(count(*) OVER (PARTITION BY stratum) AS DOUBLE) * 0.1, 0) AS n FROM s),
sp AS (SELECT o_custkey, stratum, CASE WHEN place <= n THEN 'test' WHEN place <= 2 * n THEN 'dev' ELSE 'train' END AS split FROM p)"""


@query(f"{_SPLIT} SELECT split, stratum, count(*) AS n, min(o_custkey) AS least FROM sp GROUP BY ALL")
def q19_strat_split(t):
    split = stratified_split(t.orders, "o_custkey", "o_orderkey")
    return split.groupBy("split", "stratum").agg(F.count("*").alias("n"), F.min("o_custkey").alias("least"))


@query("""WITH r AS (SELECT o_custkey, CASE WHEN CAST('0x' || substr(md5('42:' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 < 0.1 THEN 'test' ELSE 'train' END AS split FROM orders),
k AS (SELECT o_custkey, count(DISTINCT split) AS s FROM r GROUP BY 1) SELECT count(*) AS n_customers, count(*) FILTER (s > 1) AS n_leaking FROM k""")
def q20_split_leakage(t):
    rows = row_split(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    leaking = overlapping(rows, "o_custkey").agg(F.count("*").alias("n_leaking"))
    return rows.agg(F.count_distinct("o_custkey").alias("n_customers")).join(leaking)  # one row each


@query(f"""{_SPLIT} SELECT (SELECT count(*) FROM (SELECT o_custkey FROM sp WHERE split = 'train' INTERSECT SELECT o_custkey FROM sp WHERE split = 'dev')) AS train_dev,
 (SELECT count(*) FROM (SELECT o_custkey FROM sp WHERE split = 'train' INTERSECT SELECT o_custkey FROM sp WHERE split = 'test')) AS train_test,
 (SELECT count(*) FROM (SELECT o_custkey FROM sp WHERE split = 'dev' INTERSECT SELECT o_custkey FROM sp WHERE split = 'test')) AS dev_test""")
def q21_split_disjoint(t):
    split = stratified_split(t.orders, "o_custkey", "o_orderkey")
    of = lambda s: split.where(F.col("split") == s).select("o_custkey")
    shared = lambda a, b: of(a).intersect(of(b)).agg(F.count("*").alias(f"{a}_{b}"))
    return shared("train", "dev").join(shared("train", "test")).join(shared("dev", "test"))  # one row each


@query("""SELECT o_orderkey, len(list_filter([1, 2, 3], lambda x: NOT list_contains(ls, x)))::BIGINT AS missing, len(list_filter(ls, lambda x: x > 3))::BIGINT AS unknown
FROM (SELECT l_orderkey AS o_orderkey, list(DISTINCT l_linenumber) AS ls FROM lineitem GROUP BY 1)""")
def q22_missing_refs(t):
    orders = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_linenumber").alias("have"))
    want = F.array(F.lit(1), F.lit(2), F.lit(3))
    return orders.select("o_orderkey", F.size(F.array_except(want, F.col("have"))).cast("long").alias("missing"), F.size(F.array_except("have", want)).cast("long").alias("unknown"))


@query("""SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without_orders FROM customer GROUP BY 1""")
def q23_semi_anti(t):
    customers, orders = t.customer.select("c_custkey", "c_mktsegment"), t.orders.select(F.col("o_custkey").alias("c_custkey"))
    semi = customers.join(orders, "c_custkey", "left_semi").withColumn("w", F.lit(1))
    anti = customers.join(orders, "c_custkey", "left_anti").withColumn("w", F.lit(0))
    return semi.union(anti).groupBy("c_mktsegment").agg(F.count_if(F.col("w") == 1).alias("with_orders"), F.count_if(F.col("w") == 0).alias("without_orders"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n, list_sort(list(DISTINCT role)) AS roles FROM conversations GROUP BY 1),
p AS (SELECT a.n, len(list_intersect(a.roles, b.roles)) / len(list_distinct(list_concat(a.roles, b.roles))) AS j FROM c a JOIN c b ON a.n = b.n AND a.conv_id < b.conv_id)
SELECT n AS n_turns, count(*) AS n_pairs, round(avg(j), 6) AS mean_jaccard FROM p GROUP BY 1""")
def q24_same_group_pairs(t):
    """Conversations with equal role sets are one class, so pairs are counted between classes, not made one by one."""
    convs = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("role")).alias("roles"))
    classes = convs.groupBy("n", "roles").agg(F.count("*").alias("c"))
    a, b = classes.select("n", F.col("roles").alias("x"), F.col("c").alias("cx")), classes.select("n", F.col("roles").alias("y"), F.col("c").alias("cy"))
    text = lambda r: F.array_join(r, ",")
    met = a.join(b, "n").where(text("x") <= text("y"))
    pairs = F.when(F.col("x") == F.col("y"), F.col("cx") * (F.col("cx") - 1) / 2).otherwise(F.col("cx") * F.col("cy")).cast("long")
    met = met.withColumns({"k": pairs, "j": set_jaccard(F.col("x"), F.col("y"))}).where("k > 0")
    return met.groupBy(F.col("n").alias("n_turns")).agg(F.sum("k").alias("n_pairs"), F.round(F.sum(F.col("j") * F.col("k")) / F.sum("k"), 6).alias("mean_jaccard"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, o_orderkey, n FROM orders JOIN c ON l_orderkey = o_orderkey)
SELECT abs(a.n - b.n) AS step_diff, count(*) AS n_pairs FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY 1""")
def q25_step_diff_pairs(t):
    """Orders of a customer with equal line counts are one class; pairs are counted between classes."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = t.orders.select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "n").agg(F.count("*").alias("c"))
    a, b = orders.select("o_custkey", F.col("n").alias("x"), F.col("c").alias("cx")), orders.select("o_custkey", F.col("n").alias("y"), F.col("c").alias("cy"))
    met = a.join(b, "o_custkey").where("x <= y").withColumn("k", F.when(F.col("x") == F.col("y"), (F.col("cx") * (F.col("cx") - 1) / 2).cast("long")).otherwise(F.col("cx") * F.col("cy")))
    return met.where("k > 0").groupBy((F.col("y") - F.col("x")).alias("step_diff")).agg(F.sum("k").alias("n_pairs"))


def _consecutive(t, column: str, distinct: bool):
    gather = F.collect_set if distinct else F.collect_list
    bags = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(gather(column)).alias("bag"))
    own = t.orders.select("o_orderkey", "o_custkey").join(bags, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return own.withColumn("before", F.lag("bag").over(w)).where("before IS NOT NULL")


@query("""WITH b AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, s, lag(s) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders JOIN b ON l_orderkey = o_orderkey)
SELECT o_orderkey, round(len(list_intersect(s, p)) / len(list_distinct(list_concat(s, p))), 6) AS jaccard FROM o WHERE p IS NOT NULL""")
def q26_set_jaccard(t):
    return _consecutive(t, "l_suppkey", True).select("o_orderkey", F.round(set_jaccard(F.col("bag"), F.col("before")), 6).alias("jaccard"))


@query("""WITH b AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, a, n, r, lag(a) OVER w AS pa, lag(n) OVER w AS pn, lag(r) OVER w AS pr FROM orders JOIN b ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey, round((least(a, pa) + least(n, pn) + least(r, pr)) / (greatest(a, pa) + greatest(n, pn) + greatest(r, pr)), 6) AS jaccard FROM o WHERE pa IS NOT NULL""")
def q27_multiset_jaccard(t):
    return _consecutive(t, "l_returnflag", False).select("o_orderkey", F.round(multiset_jaccard(F.col("bag"), F.col("before")), 6).alias("jaccard"))


@query("""SELECT event_type, count(*) AS n FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0) GROUP BY 1""")
def q50_resume_antijoin(t):
    done = t.events.where("event_id % 3 = 0").select("event_id")
    return not_done(t.events.select("event_id", "event_type"), done, "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


