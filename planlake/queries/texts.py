"""Patterns, keyword families, phases, token hits, JSON tiers, truncation."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.functions.nested import first_match, let, ordered_pairs, ratio
from planlake.functions.normalize import cut_text
from planlake.functions.text import phase_checks, sentences, tokens
from planlake.queries.registry import catalogue

query, QUERIES, SQL = catalogue()

#: Fixed values of the catalogue: patterns with explicit ASCII bounds, which both engines read alike, and keyword tables.
PATTERNS = (
    ("licensed", "(^|[^A-Za-z])(license|licensed|licence)([^A-Za-z]|$)"),
    ("article", "(^|[^A-Za-z])(the|der|le|el)([^A-Za-z]|$)"),
    ("secret", "(^|[^A-Za-z])(password|token|key)([^A-Za-z]|$)"),
    ("address", "[A-Za-z0-9]@[A-Za-z0-9]"),
    ("digits", "[0-9]{4}"),
    ("question", "[?]"),
)
PART_FAMILIES = (("plated", ("plated",)), ("metal", ("brass", "steel", "copper", "tin", "nickel")), ("sized", ("small", "medium", "large")), ("promo", ("promo", "standard", "economy")))
ROLE_PHASES = (("probe", ("what ", "the")), ("apply", ("and ", "to ")), ("validate", ("of ",)), ("consolidate", ("with",)))
ANCHORS = ("the ", "and", "of th", "aa", "ing")
LEVELS = (("intermediate", ("small", "medium", "standard")), ("advanced", ("large", "economy")))


def _flag_sql() -> str:
    return ", ".join(f"regexp_matches(lower(text), '{p.lower().replace('a-za-z', 'a-z')}') AS {n}" for n, p in PATTERNS)


def _flags(t):
    lowered = F.lower("text")
    return t.documents.select("doc_id", "lang", *[lowered.rlike(p.lower().replace("a-za-z", "a-z")).alias(n) for n, p in PATTERNS])


@query(f"WITH f AS (SELECT lang, {_flag_sql()} FROM documents) SELECT lang, count(*) AS n, " + ", ".join(f"round(avg({n}::INT), 6) AS {n}" for n, _ in PATTERNS) + " FROM f GROUP BY lang")
def q33_regex_flags(t):
    return _flags(t).groupBy("lang").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(n).cast("int")), 6).alias(n) for n, _ in PATTERNS])


@query(
    f"WITH f AS (SELECT doc_id, lang, {_flag_sql()} FROM documents), u AS ("
    + " UNION ALL ".join(f"SELECT doc_id, lang, '{n}' AS p FROM f WHERE {n}" for n, _ in PATTERNS)
    + ") SELECT lang, a.p AS a, b.p AS b, count(*) AS n FROM u a JOIN u b USING (doc_id, lang) WHERE a.p <= b.p GROUP BY ALL"
)
def q34_pattern_cooc(t):
    shown = F.array_sort(F.array_compact(F.array(*[F.when(F.col(n), n) for n, _ in PATTERNS])))
    own = lambda xs: F.transform(xs, lambda x: F.struct(x.alias("a"), x.alias("b")))
    rows = _flags(t).select("lang", F.explode(let(shown, lambda xs: F.concat(ordered_pairs(xs), own(xs)))).alias("p"))
    return rows.groupBy("lang", "p.a", "p.b").agg(F.count("*").alias("n"))


def _case(table, column: str, default: str | None) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in table)
    return f"CASE {arms} ELSE {'NULL' if default is None else repr(default)} END"


@query(f"SELECT {_case(PART_FAMILIES, 'lower(p_type)', 'other')} AS family, count(*) AS n, round(avg(p_retailprice), 4) AS mean_price FROM part GROUP BY 1")
def q35_first_match_family(t):
    family = first_match(F.lower("p_type"), PART_FAMILIES, F.lit("other"))
    return t.part.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))


_ORDER = ", ".join(f"min(pos) FILTER (phase = '{n}') AS {n}" for n, _ in ROLE_PHASES)


@query(
    f"""WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, {_case(ROLE_PHASES, 'lower(text)', None)} AS phase FROM conversations),
f AS (SELECT conv_id, count(*) AS n, {_ORDER}, min(pos) FILTER (phase = 'retrieve_demonstrate') AS retrieve, min(pos) FILTER (phase = 'feedback') AS feedback FROM s GROUP BY 1),
o AS (SELECT *, list_filter([probe, retrieve, apply, validate, feedback, consolidate], lambda x: x IS NOT NULL) AS v FROM f)
SELECT conv_id, round((coalesce(probe < greatest(CAST(floor(n * 0.5) AS BIGINT), 1), false)::INT + (validate IS NOT NULL)::INT + (feedback IS NOT NULL)::INT
 + coalesce(consolidate >= CAST(floor(n * 0.6::DOUBLE) AS BIGINT), false)::INT + (len(v) >= 2 AND v = list_sort(v))::INT) / 5, 6) AS score FROM o"""
)
def q36_phase_order(t):
    steps = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("steps"))
    phases = F.transform("steps", lambda s: first_match(F.lower(s["text"]), ROLE_PHASES))
    return steps.select("conv_id", F.round(phase_checks(phases), 6).alias("score"))


_TOKENS = "list_filter(list_distinct(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_+#\\.-]+')), lambda x: length(x) >= 4)"


@query(
    f"""WITH d AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents), i AS (SELECT item_id, unnest({_TOKENS}) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS total FROM i GROUP BY 1),
h AS (SELECT doc_id, item_id, count(*) AS hits FROM d JOIN i USING (w) GROUP BY ALL)
SELECT item_id, max(hits)::BIGINT AS best_hits, round(max(hits / total), 6) AS best_share, count(*) FILTER (hits = total) AS n_full FROM h JOIN n USING (item_id) GROUP BY 1"""
)
def q37_token_hits(t):
    """The benchmark is one row for each word, with the items that hold it: small enough to be broadcast by its size, so that documents are counted where they are read."""
    distinct = lambda: F.filter(F.array_distinct(tokens(F.col("text"))), lambda x: F.length(x) >= 4)
    items = t.benchmark.select("item_id", distinct().alias("ws")).select("item_id", F.size("ws").alias("total"), F.explode("ws").alias("w"))
    listed = items.groupBy("w").agg(F.collect_list(F.struct("item_id", "total")).alias("items"))
    words = t.documents.select("doc_id", F.explode(distinct()).alias("w"))
    hits = words.join(listed, "w").select("doc_id", F.explode("items").alias("i")).groupBy("doc_id", "i.item_id", "i.total").agg(F.count("*").alias("hits"))
    return hits.groupBy("item_id").agg(F.max("hits").alias("best_hits"), F.round(F.max(ratio(F.col("hits"), F.col("total"))), 6).alias("best_share"), F.count_if(F.col("hits") == F.col("total")).alias("n_full"))


@query("SELECT doc_id, CAST(" + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{a}', ''))) // {len(a)}" for a in ANCHORS) + " AS BIGINT) AS n_anchors FROM documents")
def q38_anchor_count(t):
    from planlake.functions.text import anchor_count

    return t.documents.select("doc_id", anchor_count(F.col("text"), ANCHORS).cast("long").alias("n_anchors"))


@query("""WITH p AS (SELECT event_type, TRY_CAST(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, count(*) AS n, count(k) AS n_k, min(k) AS least, max(k) AS most, round(avg(k), 6) AS mean FROM p GROUP BY 1""")
def q39_json_extract(t):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    rows = t.events.select("event_type", k.alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("n_k"), F.min("k").alias("least"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"))


@query("""WITH r AS (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'so: ' || props || ' end' WHEN 2 THEN 'type ' || upper(event_type) ELSE 'nothing' END AS t FROM events),
x AS (SELECT event_id, event_type, t, CASE WHEN t LIKE '{%' AND json_valid(t) THEN t ELSE nullif(regexp_extract(t, '(?s)(\\{.*\\})', 1), '') END AS body FROM r),
y AS (SELECT event_id, CASE WHEN body IS NOT NULL THEN json_extract_string(body, '$.k') WHEN contains(t, upper(event_type)) THEN upper(event_type) END AS answer, body IS NULL AS warning FROM x)
SELECT warning, answer IS NULL AS nothing, count(*) AS n, count(DISTINCT answer) AS answers FROM y GROUP BY ALL""")
def q40_json_tiers(t):
    from planlake.functions.jsonx import object_text

    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("so: "), "props", F.lit(" end"))).when(kind == 2, F.concat(F.lit("type "), F.upper("event_type"))).otherwise("nothing")
    rows = t.events.select("event_type", text.alias("t")).withColumn("body", object_text(F.col("t")))
    answer = F.when(F.col("body").isNotNull(), F.get_json_object("body", "$.k")).when(F.contains("t", F.upper("event_type")), F.upper("event_type"))
    rows = rows.select(answer.alias("answer"), F.col("body").isNull().alias("warning"))
    return rows.groupBy("warning", F.col("answer").isNull().alias("nothing")).agg(F.count("*").alias("n"), F.count_distinct("answer").alias("answers"))


@query("""SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[.!?]\\s+[A-Z"'']')) + 1 AS BIGINT) AS n_sentences FROM conversations""")
def q41_sentence_split(t):
    """A boundary's mark, space and capital are matched whole in SQL: the capital is never a mark, so none is taken from the next boundary."""
    return t.conversations.select("conv_id", "turn", F.size(sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("""SELECT doc_id, length(substr(text, 1, 1500)) AS n_kept, length(text) > 1500 AS cut, CAST(doc_id // 30 AS BIGINT) AS batch FROM documents""")
def q51_truncate_batch(t):
    from planlake.sources.tables import batches

    cut = cut_text(F.col("text"), 1500)
    rows = t.documents.select("doc_id", F.length(cut).cast("long").alias("n_kept"), (F.length("text") > 1500).alias("cut"))
    return batches(rows, 30, "doc_id")


_LEVEL = "greatest(1, " + ", ".join(f"CASE WHEN len(list_intersect(string_split(lower(p_type), ' '), {list(ws)})) > 0 THEN {i} ELSE 1 END" for i, (_, ws) in enumerate(LEVELS, 2)) + ", CASE WHEN p_size >= 40 THEN 4 ELSE 1 END)"


@query(f"SELECT CASE WHEN contains(lower(p_brand), '5') THEN {_LEVEL} ELSE greatest(2, {_LEVEL}) END::BIGINT AS level, count(*) AS n FROM part GROUP BY 1")
def q52_ability_levels(t):
    from planlake.functions.text import ability_level

    about = F.concat(F.lower("p_brand"), F.when(F.col("p_size") >= 40, " senior").otherwise(""))
    level = ability_level(F.split("p_type", " "), about, list(LEVELS[0][1]), list(LEVELS[1][1]), ["senior"], ["5"])
    return t.part.groupBy(level.cast("long").alias("level")).agg(F.count("*").alias("n"))
