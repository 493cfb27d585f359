"""Group scores, composed rewards, best and worst samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.operators.rewards import RewardConfig, compose, with_group_zscore
from planlake.queries.registry import catalogue

query, QUERIES, SQL = catalogue()


@query("""WITH s AS (SELECT event_id, user_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id))
SELECT event_id, round(CASE WHEN d > 1e-6 THEN (value - m) / d ELSE 0 END, 6) AS z FROM s""")
def q44_group_zscore(t):
    return with_group_zscore(t.events.select("event_id", "user_id", "value"), "value", "user_id").select("event_id", F.round("z", 6).alias("z"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') / count(*) AS s, count(*) FILTER (event_type = 'click') / count(*) AS p, count(*) FILTER (event_type = 'view') / count(*) AS q,
 count(*) FILTER (event_type = 'error') > 0.25 * count(*) AS bad FROM events GROUP BY 1)
SELECT user_id, round(0.55 * s + 0.25 * p + 0.20 * q + CASE WHEN bad THEN -10 ELSE 0 END, 6) AS reward FROM u""")
def q45_weighted_reward(t):
    share = lambda e: F.count_if(F.col("event_type") == e) / F.count("*")
    users = t.events.groupBy("user_id").agg(share("purchase").alias("s"), share("click").alias("p"), share("view").alias("q"), share("error").alias("e"))
    config = RewardConfig()
    hard = F.when(F.col("e") > 0.25, -config.penalty).otherwise(0.0)
    return users.select("user_id", F.round(compose(F.col("s"), F.col("p"), F.col("q"), hard, config), 6).alias("reward"))


@query("""SELECT l_orderkey, arg_min(l_linenumber, {'a': -l_extendedprice, 'b': l_linenumber})::BIGINT AS chosen, arg_min(l_linenumber, {'a': l_extendedprice, 'b': l_linenumber})::BIGINT AS rejected,
 round(max(l_extendedprice) - min(l_extendedprice), 2) AS delta FROM lineitem GROUP BY 1 HAVING max(l_extendedprice) > min(l_extendedprice)""")
def q46_dpo_pairs(t):
    price, line = F.col("l_extendedprice"), F.col("l_linenumber")
    sides = t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct((-price).alias("a"), line.alias("b"))).alias("best"), F.min(F.struct(price.alias("a"), line.alias("b"))).alias("worst"))
    gap = -F.col("best.a") - F.col("worst.a")
    return sides.where(gap > 0).select("l_orderkey", F.col("best.b").cast("long").alias("chosen"), F.col("worst.b").cast("long").alias("rejected"), F.round(gap, 2).alias("delta"))
