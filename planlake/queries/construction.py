"""From raw clusters to labelled questions and splits: the curation operators over clusters made from customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.functions.normalize import cut_text, with_input
from planlake.functions.text import ability_levels, ability_profile, describe_learner
from planlake.operators import batch, curation, rewards
from planlake.operators.ordering import ranked, shuffled
from planlake.queries.plandata import LINES, order_plans
from planlake.queries.registry import catalogue
from planlake.sources.tables import first_rows

query, QUERIES, SQL = catalogue()

#: A question for each customer, a duplicate for each of its orders; an order's author is known by its priority and status.
_CLUSTERS = """o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, ' ' || o_orderpriority || ' ' AS about, [o_orderstatus, substr(o_orderpriority, 1, 1)] AS skills, o_orderkey % 3 = 0 AS accepted,
 'answer ' || o_orderkey AS body FROM orders),
q AS (SELECT c_custkey AS c, 'Title ' || c_custkey || chr(10) || chr(10) || c_mktsegment AS query, c_mktsegment AS about, CASE WHEN c_nationkey % 2 = 0 THEN 'own ' || c_custkey END AS answer FROM customer WHERE c_custkey % 10 < 8),
pa AS (SELECT c, 0 AS i, about, CAST([] AS VARCHAR[]) AS skills, answer FROM q UNION ALL SELECT c, i, about, skills, CASE WHEN accepted THEN body END FROM o WHERE c IN (SELECT c FROM q))"""


def clusters(t):
    """Raw clusters, every fourth of them twice: the second copy, which counts, has another title."""
    tag = "struct<tag_name:string>"
    answer = F.struct(F.struct((F.col("o_orderkey") % 3 == 0).alias("is_accepted"), F.concat(F.lit("answer "), F.col("o_orderkey").cast("string")).alias("body")).alias("answer"))
    author = F.struct(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("about_me"), F.array(F.struct(F.col("o_orderstatus").alias("tag_name")), F.struct(F.lit(None).cast("string").alias("tag_name")), F.struct(F.substring("o_orderpriority", 1, 1).alias("tag_name"))).alias("top_tags"))
    duplicates = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.struct(author.alias("question_author"), F.array(answer).alias("answers")).alias("d")))).alias("ds"))
    rows = t.customer.join(duplicates, F.col("c_custkey") == F.col("o_custkey"), "left")
    own = F.struct(F.struct((F.col("c_nationkey") % 2 == 0).alias("is_accepted"), F.concat(F.lit("own "), F.col("c_custkey").cast("string")).alias("body")).alias("answer"))
    copies = F.explode(F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("Old "), F.lit("Title "))).otherwise(F.array(F.lit("Title "))))
    rows = rows.select("*", copies.alias("word"))
    question = F.struct(F.col("c_custkey").cast("string").alias("question_id"), F.concat("word", F.col("c_custkey").cast("string")).alias("title"), F.col("c_mktsegment").alias("body"))
    asker = F.struct(F.col("c_mktsegment").alias("about_me"), F.array().cast(f"array<{tag}>").alias("top_tags"))
    canonical = F.struct(question.alias("question"), asker.alias("question_author"), own.alias("accepted_answer"))
    return rows.select(canonical.alias("canonical"), F.transform(F.coalesce("ds", F.array()), lambda x: x["d"]).alias("duplicates"))


def records(t):
    wanted = t.customer.where("c_custkey % 10 < 8").select(F.col("c_custkey").cast("string").alias("question_id"))
    wanted = wanted.union(wanted.select(F.concat(F.lit("absent "), "question_id")).where("question_id LIKE '%7'"))
    return curation.question_records(wanted, clusters(t))


@query(f"""WITH {_CLUSTERS} SELECT CAST(c AS VARCHAR) AS question_id, any_value(query) AS canonical_query, count(*) AS n_profiles, count(answer) AS n_answers, max(answer) AS last_answer, string_agg(trim(about) || ':' || array_to_string(skills, '+'), ',' ORDER BY i) AS profiles
 FROM pa JOIN (SELECT c, query FROM q) USING (c) GROUP BY c""")
def q78_question_records(t):
    rows, _ = records(t)
    told = F.transform("profiles_answers", lambda x: F.concat(F.trim(x["profile"]["self_description"]), F.lit(":"), F.array_join(x["profile"]["skills"], "+")))
    answers = F.array_compact(F.transform("profiles_answers", lambda x: x["answer"]))
    return rows.select("question_id", "canonical_query", F.size("profiles_answers").cast("long").alias("n_profiles"), F.size(answers).cast("long").alias("n_answers"), F.array_max(answers).alias("last_answer"), F.array_join(told, ",").alias("profiles"))


@query(f"""WITH {_CLUSTERS}, n AS (SELECT c, count(*) AS n, count(answer) AS a FROM pa GROUP BY c) SELECT count(*) AS questions, sum(n)::BIGINT AS profiles, sum(a)::BIGINT AS answers, min(n) AS least, max(n) AS most, round(sum(n) / count(*), 6) AS mean,
 (SELECT count(*) FROM customer WHERE c_custkey % 10 = 7) AS missing FROM n""")
def q79_profile_counts(t):
    rows, missing = records(t)
    return curation.profile_counts(rows).withColumn("mean", F.round("mean", 6)).join(missing.agg(F.count("*").alias("missing")))  # one row each


#: Labels of pairs: three-valued, with a confidence; a profile's key is its text and sorted skills.
_ANNOTATED = f"""{_CLUSTERS}, an AS (SELECT c, i, about, list_sort(skills) AS skills, CASE (c + i) % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE (c * 31 + i) % 11 <> 0 END AS ok, CASE (c * 3 + i) % 9 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS conf FROM pa)"""


def annotated(t):
    c, i = F.col("question_id").try_cast("long"), F.col("profile_index")
    ok = F.when((c + i) % 7 == 0, False).when((c + i) % 7 == 1, None).otherwise((c * 31 + i) % 11 != 0)
    sure = F.when((c * 3 + i) % 9 == 0, "low").when((c * 3 + i) % 9 == 1, "medium").otherwise("high")
    return curation.pairs(records(t)[0]).select("question_id", "profile_index", "profile", "answer", ok.alias("is_meaningful"), sure.alias("meaningful_confidence"))


_REVIEW = """rv AS (SELECT about, skills, count(DISTINCT ok) > 1 AS contradicted, bool_or(conf IN ('low', 'medium')) AS unsure, bool_or(ok IS NULL) AS missing FROM an GROUP BY ALL)"""


@query(f"""WITH {_ANNOTATED}, {_REVIEW} SELECT about || array_to_string(skills, '+') AS profile, contradicted, unsure, missing FROM rv WHERE contradicted OR unsure OR missing""")
def q80_review_set(t):
    return curation.review_set(annotated(t)).select(F.concat("key.description", F.array_join("key.skills", "+")).alias("profile"), "contradicted", "unsure", "missing")


@query(f"""WITH {_ANNOTATED}, {_REVIEW}, f AS (SELECT about, skills, arg_min(c || '.' || i, c * 1000 + i) AS first FROM an GROUP BY ALL) SELECT about || array_to_string(skills, '+') AS profile, first FROM f JOIN rv USING (about, skills) WHERE contradicted OR unsure OR missing""")
def q81_representatives(t):
    rows = annotated(t).withColumn("position", F.col("question_id").try_cast("long") * 1000 + F.col("profile_index"))
    found = curation.representatives(rows, curation.review_set(rows), "position")
    return found.select(F.concat("key.description", F.array_join("key.skills", "+")).alias("profile"), F.concat_ws(".", "question_id", F.col("profile_index").cast("string")).alias("first"))


_SETTLED = """st AS (SELECT c, i, about, skills, CASE WHEN len(skills) = 2 AND skills[1] = '1' THEN NULL WHEN len(skills) = 2 AND skills[1] = '2' THEN true ELSE ok END AS ok, CASE WHEN len(skills) = 2 AND skills[1] IN ('1', '2') THEN 'judged' ELSE conf END AS conf FROM an)"""


def settled(t):
    """Profiles whose first skill is 1 or 2 have been judged again: no verdict for the former, meaningful the latter."""
    rows = annotated(t)
    first = F.try_element_at(F.array_sort("profile.skills"), F.lit(1))
    judged = rows.where(first.isin("1", "2")).select(curation.profile_key(F.col("profile"), stripped=False).alias("profile_key"), F.when(first == "2", True).alias("is_meaningful"), F.lit("judged").alias("meaningful_confidence")).distinct()
    return curation.overwritten(rows, judged)


@query(f"""WITH {_ANNOTATED}, {_SETTLED} SELECT conf, CASE ok WHEN true THEN 'yes' WHEN false THEN 'no' ELSE 'none' END AS label, count(*) AS n FROM st GROUP BY ALL""")
def q82_overwritten(t):
    label = F.when(F.col("is_meaningful"), "yes").when(~F.col("is_meaningful"), "no").otherwise("none")
    return settled(t).groupBy(F.col("meaningful_confidence").alias("conf"), label.alias("label")).agg(F.count("*").alias("n"))


_STATUS = """ks AS (SELECT trim(about) AS about, skills, max(CASE ok WHEN true THEN 2 WHEN false THEN 1 ELSE 0 END) AS s FROM st WHERE c % 3 = 0 GROUP BY ALL)"""


@query(f"""WITH {_ANNOTATED}, {_SETTLED}, {_STATUS} SELECT about || array_to_string(skills, '+') AS profile, ['failed', 'invalid', 'valid'][s + 1] AS status FROM ks""")
def q83_verdict_of_keys(t):
    found = curation.verdict_of_keys(settled(t).where("try_cast(question_id AS BIGINT) % 3 = 0"))
    return found.select(F.concat("key.description", F.array_join("key.skills", "+")).alias("profile"), "status")


_KEPT = """kept AS (SELECT an.c, an.i, pa.answer FROM an JOIN pa ON pa.c = an.c AND pa.i = an.i LEFT JOIN ks ON ks.about = trim(an.about) AND ks.skills = an.skills WHERE s IS NULL OR s = 2)"""


def _filtered(t):
    rows = records(t)[0]
    return rows, curation.filtered_records(rows, curation.verdict_of_keys(settled(t).where("try_cast(question_id AS BIGINT) % 3 = 0")))


@query(f"""WITH {_ANNOTATED}, {_SETTLED}, {_STATUS}, {_KEPT} SELECT CAST(c AS VARCHAR) AS question_id, count(*) AS n_profiles, coalesce(string_agg(answer, ',' ORDER BY i), '') AS answers FROM kept GROUP BY c""")
def q84_filtered_records(t):
    rows = _filtered(t)[1]
    return rows.select("question_id", F.size("profiles_answers").cast("long").alias("n_profiles"), F.array_join(F.transform("profiles_answers", lambda x: x["answer"]), ",").alias("answers"))


@query(f"""WITH {_ANNOTATED}, {_SETTLED}, {_STATUS}, {_KEPT} SELECT (SELECT count(*) FROM q) AS questions, (SELECT count(*) FROM pa) AS pairs, count(DISTINCT c) AS kept_questions, count(*) AS kept_pairs, round(1 - count(*) / (SELECT count(*) FROM pa), 6) AS dropped_share FROM kept""")
def q85_keep_rates(t):
    return curation.keep_rates(*_filtered(t)).withColumn("dropped_share", F.round("dropped_share", 6))


_ROWS = "r AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)"
_SPLIT = f"""{_ROWS}, s AS (SELECT c, count(DISTINCT i) AS stratum FROM r GROUP BY 1),
p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || c), CAST(c AS VARCHAR)) AS place, round_even(CAST(count(*) OVER (PARTITION BY stratum) AS DOUBLE) * 0.1, 0) AS n FROM s),
sp AS (SELECT c, stratum, CASE WHEN place <= n THEN 'test' WHEN place <= 2 * n THEN 'dev' ELSE 'train' END AS split FROM p)"""


def variants(t):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return t.orders.select(F.col("o_custkey").cast("string").alias("question_id"), "o_orderkey", place.alias("profile_index"))


def assigned(t):
    rows = variants(t)
    return curation.assigned(rows, curation.stratified_split(rows, "question_id", "profile_index"))


@query(f"""WITH {_SPLIT} SELECT split, sum(stratum)::BIGINT AS n_rows, count(*) AS n_groups, count(*) FILTER (stratum >= 2) AS n_two, count(*) FILTER (stratum >= 3) AS n_three FROM sp GROUP BY split""")
def q86_split_report(t):
    return curation.split_report(assigned(t))


@query(f"""WITH {_SPLIT}, b AS (SELECT split, 'variants' AS kind, stratum AS value FROM sp UNION ALL SELECT split, 'profile_index', i FROM r JOIN sp USING (c)) SELECT split, kind, CAST(value AS BIGINT) AS value, count(*) AS n FROM (SELECT * FROM b UNION ALL SELECT 'all', kind, value FROM b) GROUP BY ALL""")
def q87_split_distributions(t):
    return curation.split_distributions(assigned(t))


_SIZED = f"""{_ROWS}, z AS (SELECT c, CASE WHEN row_number() OVER (ORDER BY md5('42:' || k), k) <= greatest(1, round_even(count(*) OVER ()::DOUBLE * 0.1, 0)) THEN 'valid' ELSE 'train' END AS split FROM r)"""


@query(f"""WITH {_SIZED}, g AS (SELECT c, count(*) FILTER (split = 'train') AS t, count(*) FILTER (split = 'valid') AS v FROM z GROUP BY c)
SELECT sum(t)::BIGINT AS n_train, sum(v)::BIGINT AS n_valid, count(*) FILTER (t > 0) AS train_groups, count(*) FILTER (v > 0) AS valid_groups, count(*) FILTER (t > 0 AND v > 0) AS leaking, round(count(*) FILTER (t > 0 AND v > 0) / greatest(count(*) FILTER (v > 0), 1), 6) AS leaking_share FROM g""")
def q88_sized_split_leakage(t):
    return curation.leakage(curation.sized_row_split(variants(t), "o_orderkey")).withColumn("leaking_share", F.round("leaking_share", 6))


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey), c_custkey) AS place, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer""")
def q89_shuffled_places(t):
    rows = t.customer.select("c_custkey", "c_mktsegment")
    return ranked(rows, shuffled(F.col("c_custkey"), 7), "c_custkey", "c_mktsegment", bucket_rows=64).select("c_custkey", F.col("place").cast("long").alias("place"), "n")


@query("""SELECT o_orderpriority, least(round(avg(o_totalprice), 4), 1e12) AS mean, count(*) AS n_selected FROM orders WHERE (o_orderkey % 4) + (o_custkey % 4) + (o_orderkey // 7 % 4) >= 7 AND least(o_orderkey % 4, o_custkey % 4, o_orderkey // 7 % 4) > 1 GROUP BY 1""")
def q90_selected_scores(t):
    scores = t.orders.select("o_orderpriority", "o_totalprice", (F.col("o_orderkey") % 4).alias("value"), (F.col("o_custkey") % 4).alias("clarity"), (F.floor(F.col("o_orderkey") / 7) % 4).alias("depth"))
    chosen = curation.selected(scores, ("value", "clarity", "depth"), 7)
    return chosen.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count("*").alias("n_selected"))


_WEAK = f"WITH {LINES}, w AS (SELECT l.*, row_number() OVER (PARTITION BY k, sub ORDER BY n) - 1 AS j, dense_rank() OVER (PARTITION BY k ORDER BY sub) - 1 AS si, CASE WHEN p % 4 <> 0 THEN (u % 10) / 10 END AS score FROM l)"


@query(f"""{_WEAK} SELECT CAST(k AS VARCHAR) AS plan_key, string_agg(si || '.' || j, ',' ORDER BY si || '.' || j) AS places FROM w WHERE score < 0.5 GROUP BY k""")
def q91_weak_steps(t):
    from planlake.queries.plandata import order_components

    rows = order_components(t).select(F.col("k").cast("string").alias("plan_key"), "subtasks")
    lines = rows.select("plan_key", F.posexplode("subtasks").alias("subtask_idx", "s")).select("plan_key", "subtask_idx", F.posexplode("s.steps").alias("step_idx", "x"))
    raw = _raw_scores(t)
    scores = lines.select("plan_key", "subtask_idx", "step_idx", F.col("x.id").alias("id")).join(raw, ["plan_key", "id"]).select("plan_key", "subtask_idx", "step_idx", "score")
    return batch.weak_steps(rows, scores).select("plan_key", F.array_join("places", ",").alias("places"))


def _raw_scores(t):
    """(plan_key, id, score): a judge's score of three in four steps."""
    from pyspark.sql import Window

    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus"]
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*key))
    step = F.concat(F.when(F.col("l_linestatus") == "F", "S1-").otherwise("S2-"), n.cast("string"))
    return t.lineitem.select(F.col("l_orderkey").cast("string").alias("plan_key"), step.alias("id"), F.when(F.col("l_partkey") % 4 != 0, (F.col("l_suppkey") % 10) / 10).alias("score"))


@query(f"""WITH {LINES} SELECT count(*) AS n, sum(length('question ' || c))::BIGINT AS n_query, count(*) FILTER (k % 2 = 0) AS n_kept, sum(length(CASE WHEN k % 2 = 0 THEN 'question ' || c ELSE 'forced' END))::BIGINT AS n_filled FROM g""")
def q92_input_forcing(t):
    rows = order_plans(t)
    bare = rows.withColumn("plan", F.when(F.col("k") % 2 == 1, F.col("plan").withField("input", F.lit(None).cast(rows.schema["plan"].dataType["input"].dataType))).otherwise(F.col("plan")))
    query_, who = F.col("plan.input.query"), F.col("plan.input.learner")
    forced = rows.select("k", with_input(F.col("plan"), query_, who).alias("forced"))
    filled = bare.select("k", with_input(F.col("plan"), F.lit("forced"), F.lit(None).cast(rows.schema["plan"].dataType["input"].dataType["learner"].dataType), keep=True).alias("filled"), (F.col("plan.input").isNotNull()).alias("had"))
    joined = forced.join(filled, "k")
    return joined.agg(F.count("*").alias("n"), F.sum(F.length("forced.input.query")).alias("n_query"), F.count_if("had").alias("n_kept"), F.sum(F.length("filled.input.query")).alias("n_filled"))


#: A parameter of the query: abilities by tags and phrases, and what their levels mean.
ABILITIES = [
    {"name": "metal", "intermediate": ["brass", "tin"], "advanced": ["steel", "copper"], "senior": ["senior"]},
    {"name": "size", "intermediate": ["small", "medium"], "advanced": ["large"], "senior": ["lead"]},
]
DESCRIPTIONS = [("metal", ["none", "some", "much", "all"]), ("size", ["tiny", "small", "big", "huge"])]


def _level(a: dict) -> str:
    has = lambda names: f"len(list_intersect(string_split(lower(p_type), ' '), {names})) > 0"
    raw = f"greatest(1, CASE WHEN {has(a['intermediate'])} THEN 2 ELSE 1 END, CASE WHEN {has(a['advanced'])} THEN 3 ELSE 1 END, CASE WHEN contains(about, '{a['senior'][0]}') THEN 4 ELSE 1 END)"
    return f"CASE WHEN contains(about, 'novice') THEN {raw} ELSE greatest(2, {raw}) END"


_ABOUT = "CASE p_size % 5 WHEN 0 THEN 'a senior' WHEN 1 THEN 'to lead' WHEN 2 THEN 'a novice' WHEN 3 THEN '' END"


@query(f"""WITH a AS (SELECT p_type, coalesce({_ABOUT}, '') AS about FROM part), v AS (SELECT {_level(ABILITIES[0])} AS x, {_level(ABILITIES[1])} AS y FROM a)
SELECT 'Student ability profile:' || chr(10) || '- metal (level ' || x || '/4): ' || ['none', 'some', 'much', 'all'][x] || chr(10) || '- size (level ' || y || '/4): ' || ['tiny', 'small', 'big', 'huge'][y] AS profile, count(*) AS n FROM v GROUP BY 1""")
def q93_ability_profiles(t):
    size = F.col("p_size") % 5
    about = F.when(size == 0, "a senior").when(size == 1, "to lead").when(size == 2, "a novice").when(size == 3, "")
    levels = ability_levels(F.split("p_type", " "), about, ABILITIES, ["novice"])
    return t.part.groupBy(ability_profile(levels, DESCRIPTIONS).alias("profile")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, concat_ws(chr(10), 'name: ' || c_name, CASE WHEN c_nationkey % 3 <> 0 THEN 'segment: ' || c_mktsegment END) AS told, substr(c_name, 1, 12) || CASE WHEN length(c_name) > 12 THEN '...' ELSE '' END AS cut FROM customer""")
def q94_learner_text(t):
    fields = {"name": F.col("c_name"), "segment": F.when(F.col("c_nationkey") % 3 == 1, F.col("c_mktsegment")).when(F.col("c_nationkey") % 3 == 2, F.col("c_mktsegment")).otherwise("")}
    return t.customer.select("c_custkey", describe_learner(fields).alias("told"), cut_text(F.col("c_name"), 12, "...").alias("cut"))


@query("""WITH m AS (SELECT user_id, avg(value) AS struct, avg(value) FILTER (event_type = 'click') AS pers, avg(value * value) AS ped FROM events GROUP BY 1)
SELECT round(avg(struct), 6) AS struct, round(avg(pers), 6) AS pers, round(avg(ped), 6) AS ped FROM m""")
def q95_batch_means(t):
    users = t.events.groupBy("user_id").agg(F.avg("value").alias("struct"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("pers"), F.avg(F.col("value") * F.col("value")).alias("ped"))
    return rewards.batch_means(users, "struct", "pers", "ped").select(*[F.round(c, 6).alias(c) for c in ("struct", "pers", "ped")])


@query("""WITH g AS (SELECT user_id, avg(value) / 100 AS a, stddev_pop(value) / 100 AS b, count(*) AS n FROM events GROUP BY 1), w AS (SELECT user_id, n, least(0.8, greatest(0.1, 0.55 * exp(0.5 * a))) AS x, least(0.8, greatest(0.1, 0.25 * exp(0.5 * b))) AS y FROM g)
SELECT user_id, round(x / (x + y), 6) AS struct, round(y / (x + y), 6) AS pers, n > 60 AND n % 5 = 0 AS due FROM w""")
def q96_reweighted(t):
    g = t.events.groupBy("user_id").agg((F.avg("value") / 100).alias("a"), (F.stddev_pop("value") / 100).alias("b"), F.count("*").alias("n"))
    x, y = rewards.reweighted([F.lit(0.55), F.lit(0.25)], [F.col("a"), F.col("b")], 0.5, 0.1, 0.8)
    return g.select("user_id", F.round(x, 6).alias("struct"), F.round(y, 6).alias("pers"), rewards.update_due(F.col("n"), 60, 5).alias("due"))


@query("""SELECT doc_id, lang FROM documents ORDER BY CAST(doc_id AS VARCHAR), doc_id LIMIT 100""")
def q97_first_rows(t):
    return first_rows(t.documents.select("doc_id", "lang").withColumn("named", F.col("doc_id").cast("string")), 100, "named", "doc_id").drop("named")


@query("""WITH j AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN 'kept' ELSE 'void' END AS id FROM conversations) SELECT conv_id, count(*) FILTER (turn % 3 = 0) > 0 AS answered, max(CASE WHEN turn % 3 = 0 THEN turn END) IS NOT NULL AS said FROM j GROUP BY conv_id""")
def q98_joined_responses(t):
    said = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.col("turn").cast("string").alias("answer")))).otherwise("no line")
    responses = t.conversations.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(said)), "\n").alias("text"))
    requests = t.conversations.select(F.col("conv_id").cast("string").alias("id")).distinct()
    out = batch.joined_responses(requests, responses, "answer string")
    return out.select(F.col("id").cast("long").alias("conv_id"), F.col("response").isNotNull().alias("answered"), F.col("response.answer").isNotNull().alias("said"))


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
a AS (SELECT c, k, row_number() OVER (ORDER BY md5('42:' || c || '|' || i)) AS place FROM o), b AS (SELECT c, k, row_number() OVER (ORDER BY md5('43:' || c || '|' || i)) AS place FROM o)
SELECT a.k, b.k AS other FROM a JOIN b USING (place) WHERE a.c <> b.c AND place <= 466 ORDER BY place LIMIT 300""")
def q102_random_pairs(t):
    from planlake.operators.compare import random_pairs

    return random_pairs(variants(t), ("o_orderkey",), 300).select(F.col("x.o_orderkey").alias("k"), F.col("y.o_orderkey").alias("other"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"""WITH a AS (SELECT event_id, upper(event_type) AS e, event_id % 6 AS kind FROM events) SELECT kind, CASE kind WHEN 0 THEN CASE e WHEN 'VIEW' THEN 'VIEW' ELSE e || '+VIEW' END WHEN 3 THEN CASE e WHEN 'VIEW' THEN 'VIEW' ELSE e || '+VIEW' END WHEN 4 THEN '' ELSE e END AS labels,
 kind IN (3, 4) AS parse_warning, CASE kind WHEN 0 THEN 'r' ELSE '' END AS reasoning, count(*) AS n FROM a GROUP BY ALL""")
def q103_label_responses(t):
    from planlake.functions.jsonx import label_response

    kind = F.col("event_id") % 6
    e = F.col("event_type")
    answer = (
        F.when(kind == 0, F.concat(F.lit('{"labels": ["'), F.upper(e), F.lit('", "view", "nonsense", "'), e, F.lit('"], "reasoning": "r"}')))
        .when(kind == 1, F.concat(F.lit('```json\n{"labels": "'), e, F.lit(' "}\n```')))
        .when(kind == 2, F.concat(F.lit('It is: {"labels": ["'), e, F.lit('"],}')))
        .when(kind == 3, F.concat(F.lit("I say "), e, F.lit(" or View")))
        .when(kind == 4, "nothing")
        .otherwise(F.concat(F.lit('<think>{"labels": []}</think>{"labels": ["'), e, F.lit('"]}')))
    )
    read = label_response(F.col("answer"), tuple(x.upper() for x in _TYPES))
    rows = t.events.select(kind.alias("kind"), answer.alias("answer")).select("kind", read.alias("r"))
    return rows.groupBy("kind", F.array_join("r.labels", "+").alias("labels"), F.col("r.parse_warning").alias("parse_warning"), F.col("r.reasoning").alias("reasoning")).agg(F.count("*").alias("n"))


@query("""SELECT role, min(length(text))::BIGINT AS least, max(length(text))::BIGINT AS most, (sum(length(text)) // count(*))::BIGINT AS mean FROM conversations GROUP BY role""")
def q104_length_report(t):
    from planlake.operators.training import length_report

    rows = length_report(t.conversations, "text", "role")
    return rows.select("role", *[F.col(c).cast("long").alias(c) for c in ("least", "most", "mean")])


@query("""WITH w AS (SELECT p_partkey, list_distinct(list_transform(regexp_extract_all(p_name || ' with the ' || p_type || ' ' || p_brand, '\\b([A-Za-z][A-Za-z0-9+#\\-]{2,})\\b', 1), lambda x: lower(x))) AS ws, lower(p_brand) AS own FROM part),
k AS (SELECT p_partkey, own, list_filter(ws, lambda x: length(x) >= 4 AND NOT list_contains(['with', 'the', 'from', 'this', 'that'], x) AND x <> own) AS ws FROM w) SELECT p_partkey, array_to_string(list_sort(list_concat([own], ws)), ',') AS signals FROM k""")
def q105_profile_signals(t):
    from planlake.functions.text import profile_signals

    said = F.concat("p_name", F.lit(" with the "), "p_type", F.lit(" "), "p_brand")
    return t.part.select("p_partkey", F.array_join(F.array_sort(profile_signals(said, F.array(F.concat(F.lit(" "), "p_brand", F.lit(" "))))), ",").alias("signals"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT props) AS kinds, min(sha256(props)) AS least_digest FROM events GROUP BY 1""")
def q106_fences_and_digests(t):
    from planlake.functions.text import without_fences

    wrapped = F.concat(F.lit("<think>hm { </think>\n```json\n"), "props", F.lit("\n```\n"))
    rows = t.events.select("event_type", without_fences(wrapped).alias("props"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("props").alias("kinds"), F.min(F.sha2("props", 256)).alias("least_digest"))
