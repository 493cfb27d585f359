"""Long series, large groups, faulty texts and restartable runs: the operators that never hold a group in one task, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.functions.jsonx import last_object, object_variant
from planlake.operators import plan as P
from planlake.operators import quantiles, scan
from planlake.queries.plandata import LINES, order_plans
from planlake.queries.registry import catalogue
from planlake.sources.folders import passing_folder
from planlake.streaming.commitlog import CommitLog, flush_every

query, QUERIES, SQL = catalogue()

def _spoilt(k):
    """The text of a plan's output with a fault for each of some remainders of its number."""
    out = F.to_json("plan.output")
    first = lambda field, value: F.regexp_replace(out, f'"{field}":"[^"]*"', f'"{field}":{value}')
    every = F.when(k % 9 == 0, F.to_json(F.struct("plan.output.agents", "plan.output.subtasks")))
    every = every.when(k % 9 == 1, F.regexp_replace(out, '"execution_order":\\[.*\\]\\}$', '"execution_order":"S1-1"}'))
    every = every.when(k % 9 == 2, first("instruction", "7")).when(k % 9 == 3, F.regexp_replace(out, '"requires_human_input":(true|false)', '"requires_human_input":"$1"'))
    return every.when(k % 9 == 4, "[1, 2]").when(k % 9 == 5, F.regexp_replace(out, '"name":"[^"]*"', '"name":null')).otherwise(out)


@query(f"""WITH {LINES}, s AS (SELECT l.*, dense_rank() OVER (PARTITION BY k ORDER BY sub) - 1 AS i, row_number() OVER (PARTITION BY k, sub ORDER BY n) - 1 AS j FROM l),
f AS (SELECT k, '$.execution_order: missing' AS fault FROM g WHERE k % 9 = 0 UNION ALL SELECT k, '$.execution_order: STRING for ARRAY' FROM g WHERE k % 9 = 1
 UNION ALL SELECT k, '$.subtasks[' || i || '].steps[' || j || '].instruction: NUMBER for STRING' FROM s WHERE k % 9 = 2 UNION ALL SELECT k, '$.subtasks[' || i || '].steps[' || j || '].requires_human_input: STRING for BOOLEAN' FROM s WHERE k % 9 = 3
 UNION ALL SELECT k, '$: missing' FROM g WHERE k % 9 = 4 UNION ALL SELECT DISTINCT k, '$.subtasks[' || i || '].name: NULL for STRING' FROM s WHERE k % 9 = 5)
SELECT fault, count(*) AS n, min(k) AS first FROM f GROUP BY fault""")
def q107_type_faults(t):
    rows = order_plans(t).select("k", F.explode(P.type_faults(_spoilt(F.col("k")))).alias("fault"))
    return rows.groupBy("fault").agg(F.count("*").alias("n"), F.min("k").alias("first"))


@query("""WITH s AS (SELECT l_returnflag AS flag, list(l_extendedprice::DOUBLE ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax) AS xs FROM lineitem GROUP BY 1)
SELECT flag, len(xs)::BIGINT AS n, round(list_reduce(xs, lambda a, x: 0.9 * a + 0.1 * x), 4) AS average, round(list_reduce(xs[1:len(xs) // 2], lambda a, x: 0.9 * a + 0.1 * x), 4) AS halfway FROM s""")
def q108_prefix_scan_average(t):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax"]
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), *order).withColumn("price", F.col("l_extendedprice").cast("double")).withColumn("row", F.monotonically_increasing_id())
    rows = scan.placed(rows, [*order, "row"], "flag").withColumnRenamed("__place", "place")
    averages = scan.moving_averages(rows.select("flag", "place", "price"), "price", ["place"], "flag", decay=0.9)
    sizes = rows.groupBy("flag").agg(F.count("*").alias("n"))
    at = lambda place: F.max(F.when(F.col("place") == place, F.col("average")))
    ends = averages.join(sizes, "flag").groupBy("flag", "n").agg(at(F.col("n") - 1).alias("average"), at(F.floor(F.col("n") / 2) - 1).alias("halfway"))
    return ends.select("flag", "n", F.round("average", 4).alias("average"), F.round("halfway", 4).alias("halfway"))


@query("""WITH s AS (SELECT l_returnflag AS flag, l_extendedprice::DOUBLE AS x FROM lineitem UNION ALL SELECT 'all', l_extendedprice::DOUBLE FROM lineitem), v AS (SELECT flag, list_sort(list(x)) AS v FROM s GROUP BY 1)
SELECT flag, round(quantile_cont(x, 0.25), 6) AS p25, round(median(x), 6) AS p50, round(quantile_cont(x, 0.99), 6) AS p99, any_value(v[CAST(round_even(0.9::DOUBLE * (len(v) - 1), 0) AS INT) + 1]) AS r90 FROM s JOIN v USING (flag) GROUP BY flag""")
def q109_group_quantiles(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("x"))
    rows = rows.union(rows.select(F.lit("all"), "x"))
    between = quantiles.percentiles(rows, "x", {"p25": 0.25, "p50": 0.5, "p99": 0.99}, "flag")
    nearest = quantiles.nearest_ranks(rows, "x", {"r90": 0.9}, "flag")
    return between.join(nearest, "flag").select("flag", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p99")], "r90")


@query("SELECT o_orderpriority AS priority, count(*) AS n, sum(CAST(o_totalprice * 100 AS BIGINT))::BIGINT AS cents FROM orders GROUP BY 1")
def q110_committed_slices(t):
    """A run that is broken off in its third slice, with files written that were not committed, and a run that goes on from there."""
    orders = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.rint(F.col("o_totalprice") * 100).cast("long").alias("cents"))  # a cast alone cuts
    log = CommitLog(t.spark, passing_folder(t.spark, "slices"), "o_orderkey long, priority string, cents long")
    seen = []

    def broken(rows):
        seen.append(1)
        if len(seen) == 3:
            log.stage(rows)
            raise InterruptedError
        return rows

    every = max(1, orders.count() // 6)
    try:
        flush_every(orders, log, "o_orderkey", broken, every)
    except InterruptedError:
        pass
    flush_every(orders, log, "o_orderkey", lambda rows: rows, every)
    return log.read().groupBy("priority").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("""SELECT o_orderkey AS k, 'the "' || o_orderpriority || '" one' AS said, o_custkey AS c, '{"k": "}' || o_orderkey || '{"}' AS last FROM orders""")
def q111_mended_objects(t):
    """Answers with stray quotes in a string, and the last of two objects whose strings hold braces."""
    answer = F.concat(F.lit('Sure: {"said": "the "'), "o_orderpriority", F.lit('" one", "c": '), F.col("o_custkey").cast("string"), F.lit(",} done"))
    objects = F.concat(F.lit('{"a": {"b": 1}} and {"k": "}'), F.col("o_orderkey").cast("string"), F.lit('{"} {'))
    rows = t.orders.select(F.col("o_orderkey").alias("k"), object_variant(answer).alias("v"), last_object(objects).alias("last"))
    return rows.select("k", F.try_variant_get("v", "$.said", "string").alias("said"), F.try_variant_get("v", "$.c", "long").alias("c"), "last")
