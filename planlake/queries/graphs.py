"""Turn graphs of conversations: depth, references, ordered pairs, precedence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planlake.functions.nested import let, ordered_pairs, ratio
from planlake.operators.plan import dag_metrics
from planlake.queries.registry import catalogue

query, QUERIES, SQL = catalogue()


def turn_graphs(t):
    """(conv_id, ids, edges): turns as steps, each depending on the turn before it."""
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    ids = F.transform("turns", lambda x: x.cast("string"))
    edges = F.transform(F.filter("turns", lambda x: x > 0), lambda x: F.struct((x - 1).cast("string").alias("src"), x.cast("string").alias("dst")))
    return turns.select("conv_id", ids.alias("ids"), edges.alias("edges"))


@query("""WITH RECURSIVE d AS (
  SELECT conv_id, turn, 0 AS depth FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)
  UNION ALL SELECT c.conv_id, c.turn, depth + 1 FROM d JOIN conversations c ON c.conv_id = d.conv_id AND c.turn = d.turn + 1),
l AS (SELECT conv_id, depth, count(*) AS w FROM d GROUP BY ALL)
SELECT conv_id, CAST(sum(w) AS BIGINT) AS n_nodes, max(depth)::BIGINT + 1 AS longest, max(w) AS width, round(1 - (max(depth) + 1) / sum(w), 6) AS parallel FROM l GROUP BY conv_id""")
def q29_turn_dag_depth(t):
    m = turn_graphs(t).select("conv_id", dag_metrics(F.col("ids"), F.col("edges"), F.col("edges")).alias("m"))
    return m.select("conv_id", F.col("m.n_nodes").cast("long").alias("n_nodes"), F.col("m.longest").cast("long").alias("longest"), F.col("m.width").cast("long").alias("width"), F.round("m.parallel", 6).alias("parallel"))


@query("""WITH e AS (SELECT c.conv_id, c.turn, p.turn IS NOT NULL AS known FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 WHERE c.turn > 0)
SELECT conv_id, count(*) AS n_edges, count(*) FILTER (NOT known) AS n_missing, round(count(*) FILTER (known) / count(*), 6) AS completeness FROM e GROUP BY conv_id""")
def q30_dangling_edges(t):
    turns = t.conversations.select("conv_id", "turn")
    parents = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("known")).distinct()
    edges = turns.where("turn > 0").join(parents, ["conv_id", "turn"], "left")
    return edges.groupBy("conv_id").agg(F.count("*").alias("n_edges"), F.count_if(F.col("known").isNull()).alias("n_missing"), F.round(ratio(F.count("known"), F.count("*")), 6).alias("completeness"))


@query("""SELECT DISTINCT a.role AS a, b.role AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn""")
def q31_ordered_pairs(t):
    """Of each role, only its first and last turn can matter to which roles stand before it."""
    ends = t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    a = ends.select("conv_id", F.col("role").alias("a"), "first")
    b = ends.select("conv_id", F.col("role").alias("b"), "last")
    return a.join(b, "conv_id").where("first < last").select("a", "b").distinct()


@query("""WITH s AS (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
m AS (SELECT DISTINCT a.role AS a, b.role AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE a.conv_id % 2 = 0),
p AS (SELECT a.conv_id, count(*) AS n, count(m.a) AS k FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn LEFT JOIN m ON m.a = a.role AND m.b = b.role GROUP BY 1)
SELECT c.conv_id, round(coalesce(k / n, 1), 6) AS compatibility FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN p USING (conv_id)""")
def q32_precedence_compat(t):
    convs = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    pairs = convs.select("conv_id", F.explode_outer(let(F.col("roles"), ordered_pairs)).alias("p")).groupBy("conv_id", "p").agg(F.count("p").alias("n"))
    mined = pairs.where("conv_id % 2 = 0 AND p IS NOT NULL").select(F.col("p").alias("m")).distinct()
    joined = pairs.join(mined, pairs["p"] == mined["m"], "left")
    share = ratio(F.sum(F.when(F.col("m").isNotNull(), F.col("n"))), F.sum("n"), 0.0)
    return joined.groupBy("conv_id").agg(F.round(F.when(F.sum("n") == 0, 1.0).otherwise(share), 6).alias("compatibility"))


@query("""WITH RECURSIVE w AS (SELECT role, CAST(turn AS BIGINT) AS step, avg(length(text)) AS x FROM conversations GROUP BY ALL),
r AS (SELECT role, step, x, row_number() OVER (PARTITION BY role ORDER BY step) AS k FROM w),
e AS (SELECT role, k, x AS ema FROM r WHERE k = 1 UNION ALL SELECT r.role, r.k, 0.9 * ema + 0.1 * r.x FROM e JOIN r ON r.role = e.role AND r.k = e.k + 1)
SELECT role, round(arg_max(ema, k), 4) AS ema, count(*) AS n FROM e GROUP BY role""")
def q48_ema_fold(t):
    from planlake.operators.scan import moving_averages

    means = t.conversations.groupBy("role", "turn").agg(F.avg(F.length("text")).alias("x"))
    averages = moving_averages(means, "x", ["turn"], "role", decay=0.9)
    return averages.groupBy("role").agg(F.round(F.max_by("average", "turn"), 4).alias("ema"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY 1)
SELECT conv_id, len(m) AS n_messages, m[1].role AS first_role, m[-1].role AS last_role, CAST(list_sum(list_transform(m, lambda x: length(x.content))) AS BIGINT) AS n_chars,
 CASE WHEN m[-1].role = 'assistant' THEN length(m[-1].content) END AS completion_chars FROM c""")
def q49_message_build(t):
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    rows = t.conversations.groupBy("conv_id").agg(messages.alias("m"))
    last = F.element_at("m", -1)
    return rows.select(
        "conv_id",
        F.size("m").cast("long").alias("n_messages"),
        F.col("m")[0]["role"].alias("first_role"),
        last["role"].alias("last_role"),
        F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"])).alias("n_chars"),
        F.when(last["role"] == "assistant", F.length(last["content"]).cast("long")).alias("completion_chars"),
    )


@query("""WITH x AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
s AS (SELECT conv_id, turn, list_filter(list_distinct(string_split_regex(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+')), lambda w: w <> '') AS a,
 list_filter(list_distinct(string_split_regex(regexp_replace(lower(before), '^\\s+|\\s+$', '', 'g'), '\\s+')), lambda w: w <> '') AS b FROM x WHERE before IS NOT NULL)
SELECT conv_id, turn, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS jaccard FROM s""")
def q28_word_jaccard(t):
    from planlake.functions.text import word_jaccard

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", "text", F.lag("text").over(w).alias("before")).where("before IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(word_jaccard(F.col("text"), F.col("before")), 6).alias("jaccard"))
