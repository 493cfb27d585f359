"""Preference formatting: a shared prompt, rendered once, and the two masked completions that follow it.

Conversations are long tables of turns. For each pair, the turns before the first in which chosen and rejected differ are
the prompt; the rest of either side is its completion. ``format_preferences`` gives a row for each rendered turn, with a header that is never
learnt and a body that is learnt where an assistant speaks in a completion, and their place in the part. ``preference_records`` gives
a row for each pair with its prompt, both completions and the spans of each that are learnt.

Turns are gathered into blocks of ``BLOCK_TURNS`` once, and all else happens within a block's row, but for what blocks of one pair must know of each
other, which is numbers: the first differing turn, a minimum that is pre-aggregated, and the characters in the blocks before. So no
task and no row holds a whole conversation, however long: the records of one with more turns than a block are several rows.

Edge cases: rows without pair or turn belong to no conversation and are left out; null roles and texts are empty; repeated
rows count once, and of unlike rows for one turn the least (role, text) counts; a pair whose sides are equal, or one of whose sides has
no turns at all, expresses no preference and is left out; a prompt or a completion may be empty; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlake.llm.common import joinable, materialize

#: The chat template: what opens and closes a turn.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNT_ROLE = "assistant"
#: Turns, by their number, that are held together.
BLOCK_TURNS = 256

_TURNS = "array<struct<turn:long,role:string,text:string>>"


def turns(rows: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, turn, role, text), one row for each turn."""
    clean = rows.where(F.col(pair).isNotNull() & F.col("turn").isNotNull())
    one = clean.groupBy(F.col(pair).cast("long").alias("pair"), F.col("turn").cast("long").alias("turn")).agg(
        F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("said")
    )
    return one.select("pair", "turn", "said.role", "said.text")


def blocks(rows: DataFrame) -> DataFrame:
    """(pair, block, turns) of (pair, turn, role, text): the turns of each block in order, BLOCK_TURNS at most."""
    block = F.floor(F.col("turn") / F.lit(BLOCK_TURNS)).alias("block")
    return rows.groupBy("pair", block).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair, part, turn, role, header, body, learnt, at) with part in prompt, chosen, rejected, from turns (pair, turn, role, text).

    at: the characters of the part that stand before the turn.
    """
    return rendered_turns(sides_of(chosen, rejected))


def sides_of(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair, block, chosen, rejected): the turns of either side, block by block."""
    none = F.array().cast(_TURNS)
    both = blocks(chosen).withColumnRenamed("turns", "chosen").join(blocks(rejected).withColumnRenamed("turns", "rejected"), ["pair", "block"], "full")
    return both.select("pair", "block", F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))


def _drawn(turns: Column, learn: bool) -> Column:
    """Turns with header, body and whether the body is learnt."""
    return F.transform(
        turns,
        lambda t: F.struct(
            t["turn"].alias("turn"),
            t["role"].alias("role"),
            F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE)).alias("header"),
            F.concat(t["text"], F.lit(CLOSE)).alias("body"),
            ((t["role"] == LEARNT_ROLE) & F.lit(learn)).alias("learnt"),
        ),
    )


def _total(drawn: Column) -> Column:
    return F.aggregate(drawn, F.lit(0).cast("long"), lambda a, t: a + F.length(t["header"]) + F.length(t["body"]))


def _placed(drawn: str, before: Column) -> Column:
    """Turns with the characters that stand before each in its part."""
    return F.transform(drawn, lambda t, i: t.withField("at", before + _total(F.slice(F.col(drawn), F.lit(1), i))))


def rendered(sides: DataFrame) -> DataFrame:
    """(pair, block, prompt, chosen, rejected) of the pairs that express a preference: arrays of rendered turns with their places.

    sides: (pair, block, chosen, rejected), written or cheap, as it is read for the first differences and again for the rest.
    """
    unlike = F.concat(F.array_except("chosen", "rejected"), F.array_except("rejected", "chosen"))
    first = F.array_min(F.transform(unlike, lambda t: t["turn"]))
    cuts = sides.groupBy("pair").agg(F.min(first).alias("first"), F.sum(F.size("chosen")).alias("n_chosen"), F.sum(F.size("rejected")).alias("n_rejected"))
    cuts = cuts.where("first IS NOT NULL AND n_chosen > 0 AND n_rejected > 0").select("pair", "first")
    cut = sides.join(joinable(cuts, "first-differences"), "pair")
    shared = F.filter("chosen", lambda t: t["turn"] < F.col("first"))
    own = lambda side: F.filter(side, lambda t: t["turn"] >= F.col("first"))
    drawn = cut.select("pair", "block", _drawn(shared, False).alias("prompt"), _drawn(own("chosen"), True).alias("chosen"), _drawn(own("rejected"), True).alias("rejected"))
    parts = ("prompt", "chosen", "rejected")
    before = Window.partitionBy("pair").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = drawn.select("pair", "block", *[_total(F.col(p)).alias(p) for p in parts])
    offsets = sizes.select("pair", "block", *[F.sum(p).over(before).alias(f"before_{p}") for p in parts]).where("before_prompt + before_chosen + before_rejected > 0")
    joined = drawn.join(joinable(offsets, "block-offsets"), ["pair", "block"], "left")
    return joined.select("pair", "block", *[_placed(p, F.coalesce(f"before_{p}", F.lit(0).cast("long"))).alias(p) for p in parts])


def rendered_turns(sides: DataFrame) -> DataFrame:
    """The rows of format_preferences."""
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("turns")) for p in ("prompt", "chosen", "rejected")])
    rows = rendered(sides).select("pair", F.explode(parts).alias("p")).select("pair", "p.part", F.explode("p.turns").alias("t"))
    return rows.select("pair", "part", "t.turn", "t.role", "t.header", "t.body", "t.learnt", "t.at")


def preference_records(sides: DataFrame) -> DataFrame:
    """(pair, block, prompt, chosen, rejected, chosen_learnt, rejected_learnt) of (pair, block, chosen, rejected).

    The last two columns are spans "start:end" of the whole completion, in characters, ends exclusive, joined by commas. A pair whose turns lie in
    several blocks has a row for each.
    """

    def span(t: Column) -> Column:
        start = t["at"] + F.length(t["header"])
        return F.concat_ws(":", start.cast("string"), (start + F.length(t["body"])).cast("string"))

    text = lambda p: F.array_join(F.transform(p, lambda t: F.concat(t["header"], t["body"])), "").alias(p)
    spans = lambda p: F.array_join(F.transform(F.filter(p, lambda t: t["learnt"]), span), ",").alias(f"{p}_learnt")
    return rendered(sides).select("pair", "block", *[text(p) for p in ("prompt", "chosen", "rejected")], spans("chosen"), spans("rejected"))


def stale_reply_sides(conversations: DataFrame) -> DataFrame:
    """(pair, block, chosen, rejected) made from single conversations (conv_id, turn, role, text).

    chosen is a conversation up to its last assistant turn. rejected is the same, but its last reply repeats the assistant turn before
    it or, where there is none, the last turn before it. Conversations without an assistant turn that follows another turn give no pair.
    Only a repeated turn that lies in another block than the last reply moves again.
    """
    held = materialize(blocks(turns(conversations, "conv_id")), "turn-blocks")
    reply = lambda t: t["role"] == LEARNT_ROLE
    latest = lambda xs: F.array_max(F.transform(xs, lambda t: t["turn"]))
    last = held.groupBy("pair").agg(F.max(latest(F.filter("turns", reply))).alias("last")).where("last IS NOT NULL")
    ended = held.join(joinable(last, "last-replies"), "pair").where(F.col("block") * BLOCK_TURNS <= F.col("last"))
    before = F.filter("turns", lambda t: t["turn"] < F.col("last"))
    known = ended.groupBy("pair").agg(F.max("last").alias("till"), F.coalesce(F.max(latest(F.filter(before, reply))), F.max(latest(before))).alias("stale"))
    known = known.where("stale IS NOT NULL").select("pair", F.col("till").alias("last"), "stale")
    placed = held.join(joinable(known, "stale-replies"), "pair").where(F.col("block") * BLOCK_TURNS <= F.col("last"))
    at = lambda n: F.try_element_at(F.filter("turns", lambda t: t["turn"] == n), F.lit(1))["text"]
    far = placed.where(at(F.col("stale")).isNotNull() & (F.floor(F.col("stale") / BLOCK_TURNS) < F.floor(F.col("last") / BLOCK_TURNS))).select("pair", at(F.col("stale")).alias("far_text"))
    ends = placed.join(far.select(F.col("pair").alias("far_pair"), "far_text"), (F.col("pair") == F.col("far_pair")) & (F.col("block") == F.floor(F.col("last") / BLOCK_TURNS)), "left") if _any(far) else placed.withColumn("far_text", F.lit(None).cast("string"))
    chosen = F.filter("turns", lambda t: t["turn"] <= F.col("last"))
    said = F.coalesce(at(F.col("stale")), F.col("far_text"))
    rejected = F.transform("chosen", lambda t: F.when(t["turn"] == F.col("last"), t.withField("text", F.col("said"))).otherwise(t))
    return ends.select("pair", "block", "last", chosen.alias("chosen"), said.alias("said")).select("pair", "block", "chosen", rejected.alias("rejected"))


def _any(rows: DataFrame) -> bool:
    return rows.select("pair").limit(1).count() > 0


def stale_reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) turns (pair, turn, role, text) of stale_reply_sides."""
    both = stale_reply_sides(conversations)
    flat = lambda side: both.select("pair", F.explode(side).alias("t")).select("pair", "t.turn", "t.role", "t.text")
    return flat("chosen"), flat("rejected")


def op7_preference_format(conversations: DataFrame) -> DataFrame:
    """The records of all pairs that stale_reply_sides makes."""
    return preference_records(stale_reply_sides(conversations)).withColumnRenamed("pair", "conv_id")


OP7_SQL = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS pair, CAST(turn AS BIGINT) AS turn,
             min({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}) AS said
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
rows AS (SELECT pair, turn, said.role AS role, said.text AS text FROM t),
last AS (SELECT pair, max(turn) AS last FROM rows WHERE role = 'assistant' GROUP BY pair),
known AS (SELECT rows.*, last FROM rows JOIN last USING (pair) WHERE turn <= last),
stale AS (SELECT pair, coalesce(arg_max(text, turn) FILTER (turn < last AND role = 'assistant'), arg_max(text, turn) FILTER (turn < last)) AS stale
          FROM known GROUP BY pair HAVING count(*) FILTER (turn < last) > 0),
sides AS (SELECT pair, turn, role, text AS chosen, CASE WHEN turn = last THEN stale ELSE text END AS rejected FROM known JOIN stale USING (pair)),
cuts AS (SELECT pair, min(turn) AS first FROM sides WHERE chosen <> rejected GROUP BY pair),
parts AS (SELECT pair, 'prompt' AS part, turn, role, chosen AS text FROM sides JOIN cuts USING (pair) WHERE turn < first
  UNION ALL SELECT pair, 'chosen', turn, role, chosen FROM sides JOIN cuts USING (pair) WHERE turn >= first
  UNION ALL SELECT pair, 'rejected', turn, role, rejected FROM sides JOIN cuts USING (pair) WHERE turn >= first),
r AS (SELECT pair, part, turn, role, '<|' || role || '|>' || chr(10) AS header, text || '<|end|>' || chr(10) AS body FROM parts),
p AS (SELECT *, length(header) + length(body) AS size, sum(length(header) + length(body)) OVER (PARTITION BY pair, part ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(header) - length(body) AS place FROM r),
s AS (SELECT *, CAST(turn // {BLOCK_TURNS} AS BIGINT) AS block, CASE WHEN part <> 'prompt' AND role = 'assistant' THEN CAST(place + length(header) AS BIGINT) || ':' || CAST(place + size AS BIGINT) END AS span FROM p)
SELECT pair AS conv_id, block, coalesce(string_agg(header || body, '' ORDER BY turn) FILTER (part = 'prompt'), '') AS prompt,
  coalesce(string_agg(header || body, '' ORDER BY turn) FILTER (part = 'chosen'), '') AS chosen, coalesce(string_agg(header || body, '' ORDER BY turn) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY turn) FILTER (part = 'chosen'), '') AS chosen_learnt, coalesce(string_agg(span, ',' ORDER BY turn) FILTER (part = 'rejected'), '') AS rejected_learnt
FROM s GROUP BY pair, block
"""
