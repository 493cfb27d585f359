"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is shuffled by a digest of its doc_ids and offered ``MAX_REPEATS`` times over. A copy's virtual finish time is the
words its source has offered up to and with it, divided by the source's target. The copies of all sources are ordered by
finish time (then source, shuffle key and repeat), and the order is truncated where the budget, the sum of the
targets, is spent.

Running sums are two-level: the shuffle key's leading bits deal a source into buckets, about as many as rows in a bucket, buckets are summed
before any shuffle of their offsets, and rows are only ordered within a bucket. A hot source is thus spread over as many tasks as its
rows need. The key digests doc_id and size; rows that it cannot part, which are as long as each other, are told by their number among them, and stretches of
them counted before, so that no crowd of them is in one task. Rows of size 0 count for nothing and stay out of the sums. The truncation point is found by histograms of fixed width over ever shorter ranges of finish times. Targets are computed
over one row a source, in one task.

Edge cases: null text has size 0; a document of size 0 is never taken; null doc_ids and repeated rows are documents
of their own; a null source is a source, last in order; an empty table gives
no rows; columns of other names are ignored by ``mix_sizes`` and kept by ``mixed``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlake.llm.common import columns_of, joinable, materialize, spare

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
SEED = "mix-1"
#: Rows a bucket of a hot source holds at least, if it has as many.
BUCKET_ROWS = 512
#: Bins of a histogram of finish times, and the copies below which they are ordered outright.
BINS, FEW_COPIES = 1024, 20_000


def word_count(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target): shares of share * total by weight, none above max_repeats times its source's size.

    Water-filling in closed form: sources are capped in order of size / weight. With the first k capped, the level is what is left of
    the budget over what is left of the weight; k is the least number for which the next source stays below its cap.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    which = (F.row_number().over(order) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), which + 1))
    weighed = weighed.withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = weighed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap")).withColumn("place", F.row_number().over(by_cap))
    fitting = F.when(F.col("fits"), F.struct("place", "level"))
    filled = levels.withColumn("water", F.min(fitting).over(everything)["level"])
    return filled.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def _bucket(key: Column, buckets: int) -> Column:
    """The leading 32 bits of a hexadecimal key, dealt evenly and in order into buckets."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") * F.lit(buckets / 2.0**32)).cast("long")


def offered(sizes: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """sizes (doc_id, source, size, more) above 0 with key, source_size, target and upto: its source's words up to and with it, in shuffled order."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string"))
    keyed = sizes.where("size > 0").withColumn("key", F.md5(told))
    n = sizes.count()
    keyed = keyed.withColumn("bucket", _bucket(F.col("key"), max(1, n // max(BUCKET_ROWS, math.isqrt(n)))))
    alike = [F.col("source"), F.col("key"), F.col("size")]
    crowds = keyed.groupBy(*alike, "bucket").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS)
    crowds = materialize(crowds, "mix-crowds")
    crowded = not crowds.isEmpty()
    if crowded:  # rows alike in key and size, which a bucket cannot part: one stands for all of them there
        hot = crowds.select(*[c.alias(f"of_{c_}") for c, c_ in zip(alike, ("source", "key", "size"), strict=True)], "n")
        same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("key") == F.col("of_key")) & (F.col("size") == F.col("of_size"))
        crowd = keyed.join(joinable(hot.drop("n"), "mix-crowded"), same, "left_semi")
        keyed = keyed.join(joinable(hot.drop("n"), "mix-crowded"), same, "left_anti").withColumn("n", F.lit(1))
        keyed = keyed.unionByName(crowds.withColumn("stands", F.lit(True)), allowMissingColumns=True)
    else:
        keyed = keyed.withColumns({"n": F.lit(1), "stands": F.lit(None).cast("boolean")})
    words = F.col("size") * F.col("n")
    sums = keyed.groupBy("source", "bucket").agg(F.sum(words).alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
    offsets = offsets.select(F.col("o.source").alias("of_source"), F.col("bucket").alias("of_bucket"), "offset", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = keyed.withColumn("in_bucket", F.sum(words).over(within))
    joined = ranked.join(offsets, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")))
    joined = joined.withColumn("upto", F.col("in_bucket") + F.col("offset")).drop("of_source", "of_bucket", "offset", "in_bucket", "bucket")
    if not crowded:
        return joined.drop("n", "stands")
    joined = materialize(joined, "mix-places")
    stand = joined.where("stands").select(F.col("source").alias("of_source"), F.col("key").alias("of_key"), F.col("size").alias("of_size"), "source_size", "target", (F.col("upto") - words).alias("offset"))
    spread = _numbered(crowd.drop("bucket")).join(joinable(stand, "mix-stands"), same)
    spread = spread.withColumn("upto", F.col("offset") + F.col("nth") * F.col("size")).drop("of_source", "of_key", "of_size", "offset", "nth")
    return joined.where("stands IS NULL").drop("n", "stands").unionByName(spread)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with nth, from 1 among those alike in source, key and size: stretches of the written rows are counted, and rows only numbered inside one."""
    part = F.col("row").bitwiseAND(F.lit(~0xFFF))  # 4096 rows of a written part at most
    known = materialize(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("part", part), "mix-crowd")
    alike = ["source", "key", "size"]
    counts = known.groupBy(*alike, "part").agg(F.count("*").alias("in_part"))
    before = Window.partitionBy(*alike).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"n_{c}") for c in alike], F.col("part").alias("n_part"), F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("before"))
    inside = known.withColumn("inside", F.row_number().over(Window.partitionBy(*alike, "part").orderBy("row")))
    same = F.col("source").eqNullSafe(F.col("n_source")) & (F.col("key") == F.col("n_key")) & (F.col("size") == F.col("n_size")) & (F.col("part") == F.col("n_part"))
    return inside.join(joinable(offsets, "mix-crowd-offsets"), same).withColumn("nth", F.col("inside") + F.col("before")).select(*rows.columns, "nth")


def copies(queue: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row for each offer of a document, with its repeat (from 0) and virtual finish time."""
    repeat = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("repeat")
    rows = queue.where("target > 0").select("*", repeat)
    return rows.withColumn("finish", (F.col("upto") + F.col("repeat") * F.col("source_size")).cast("double") / F.col("target"))


def truncation(queue: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame | None:
    """One row (finish, source, key, repeat) of the last copy that the budget pays for, or None if it pays for none.

    The search narrows a range of finish times that holds the truncation point, by histograms of BINS bins, until
    few copies are left, and orders those. The driver gets BINS sums at a time.
    """
    rows = copies(queue, max_repeats).select("finish", "source", "key", "repeat", "size")
    top = rows.agg(F.max("finish")).first()[0]
    budget = queue.groupBy("source").agg(F.first("target").alias("target")).agg(F.sum("target")).first()[0]
    if top is None:
        return None
    lo, hi, paid = 0.0, top, 0
    while True:
        width = (hi - lo) / BINS
        inside = rows.where((F.col("finish") > lo) & (F.col("finish") <= hi)) if lo else rows.where(F.col("finish") <= hi)
        if width <= 0 or lo + width == lo:
            break
        bins = inside.groupBy(F.least(F.lit(BINS - 1), F.floor((F.col("finish") - lo) / width)).alias("bin")).agg(
            F.sum("size").alias("size"), F.count("*").alias("n"), F.min("finish").alias("least"), F.max("finish").alias("most"))
        last, crossed = None, None
        for b in sorted(bins.collect(), key=lambda r: r["bin"]):
            if paid + b["size"] > budget:
                crossed = b
                break
            paid, last = paid + b["size"], b["most"]
        if crossed is None:
            lo = hi
            break
        if last is not None:
            lo = last
        hi = crossed["most"]
        if crossed["n"] <= FEW_COPIES or crossed["least"] == hi:
            break
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("key"), F.col("size"), F.col("repeat")]
    inside = rows.where((F.col("finish") > lo) & (F.col("finish") <= hi)) if lo else rows.where(F.col("finish") <= hi)
    spent = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(paid)
    backwards = [F.col("source").desc_nulls_first() if i == 1 else c.desc() for i, c in enumerate(order)]
    found = inside.withColumn("spent", spent).where(F.col("spent") <= F.lit(budget)).orderBy(*backwards).limit(1).first()
    if found is None and lo:
        found = rows.where(F.col("finish") <= lo).orderBy(*backwards).limit(1).first()
    return found


def mix_sizes(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, copies_taken, taken, first_finish, keep...) for each row of docs (doc_id, source, text)."""
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *[k for k in keep if k != "source"]), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, share, max_repeats), "mix-targets")
    queue = materialize(offered(sizes, targets, seed), "mix-queue")
    edge = truncation(queue, max_repeats)
    if edge is None:
        taken = F.lit(0)
    else:
        cutoff = F.struct(F.lit(edge["finish"]).alias("finish"), F.lit(edge["source"] is None).alias("null_last"), F.lit(edge["source"] or "").alias("name"), F.lit(edge["key"]).alias("key"), F.lit(edge["size"]).alias("size"), F.lit(edge["repeat"]).alias("repeat"))
        def within(r: int) -> Column:
            finish = (F.col("upto") + F.lit(r) * F.col("source_size")).cast("double") / F.col("target")
            own = F.struct(finish.alias("finish"), F.col("source").isNull().alias("null_last"), F.coalesce("source", F.lit("")).alias("name"), F.col("key").alias("key"), F.col("size").alias("size"), F.lit(r).alias("repeat"))
            return F.when(F.col("target") > 0, (own <= cutoff).cast("int")).otherwise(0)
        taken = sum((within(r) for r in range(1, max_repeats)), within(0))
    first = F.when(F.col("target") > 0, F.col("upto").cast("double") / F.col("target"))
    names = ["doc_id", "size", "source_size", "target"]
    offers = queue.select(*names, taken.alias("copies_taken"), (F.col("size") * taken).alias("taken"), first.alias("first_finish"), *keep)
    own = targets.select(F.col("source").alias("of_source"), "source_size", "target")
    none = sizes.where("size = 0").join(own, F.col("source").eqNullSafe(F.col("of_source")))
    return offers.union(none.select(*names, F.lit(0).alias("copies_taken"), F.col("size").alias("taken"), F.lit(None).cast("double").alias("first_finish"), *keep))


def op8_fair_queueing(docs: DataFrame) -> DataFrame:
    return mix_sizes(docs).select("doc_id", "size", "source_size", "target", "taken", F.col("copies_taken").alias("n_copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, with the columns of docs.

    Rows are matched by doc_id and a digest of text and source, and rows that repeat in both share what was taken of them: of n alike rows the
    k-th comes out floor or ceil of taken / n times, together exactly taken times. Texts move once, to meet what is taken of them; rows that repeat in
    all columns are counted before they move on, so that what alike rows share is told apart among unlike ones only.
    """
    doc, tag = spare(docs, "of_doc"), spare(docs, "of_text")
    told = F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")), F.col("text").isNull(), F.col("source").isNull(), F.col("doc_id").isNull())
    tagged = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), tag: told})
    kept = tagged.select(F.col(doc).alias("doc_id"), "source", "text", F.col(tag).alias("tag"))
    sizes = mix_sizes(kept, keep=("tag",), **options)
    got = sizes.groupBy("doc_id", "tag").agg(F.sum("copies_taken").cast("int").alias("n_taken"), F.count("*").alias("n_rows")).where("n_taken > 0")
    got = materialize(got, "mix-taken")
    several = got.where("n_rows > 1").limit(1).count() > 0
    right = got.select(F.struct("doc_id", "tag", "n_taken", "n_rows").alias(spare(docs, "got")))
    taken = F.col(right.columns[0])
    joined = tagged.join(right, (F.col(doc) == taken["doc_id"]) & (F.col(tag) == taken["tag"]))
    again = spare(docs, "times")
    rows = joined.withColumn(again, F.when(taken["n_rows"] == 1, taken["n_taken"]))
    if several:
        rows = rows.where(F.col(again).isNotNull()).unionByName(_shared(joined.where(taken["n_rows"] > 1), docs, [doc, tag], taken, again))
    rows = rows.where(F.col(again) > 0)
    return rows.select(*columns_of(docs), F.explode(F.sequence(F.lit(1), F.col(again))).alias(spare(docs, "copy"))).select(*columns_of(docs))


def _shared(rows: DataFrame, docs: DataFrame, alike: list[str], taken: Column, times: str) -> DataFrame:
    """rows with times, their shares of what is taken of rows alike; those that repeat in all columns become one row, whose share is that of all of them."""
    several, sums = spare(rows, "alike_rows"), spare(rows, "rows_before")
    folded = rows.groupBy(*rows.columns).agg(F.count("*").alias(several))
    w = Window.partitionBy(*alike).orderBy(F.xxhash64(*columns_of(docs))).rowsBetween(Window.unboundedPreceding, -1)
    known = folded.withColumn(sums, F.coalesce(F.sum(several).over(w), F.lit(0)))
    whole, rest = F.floor(taken["n_taken"] / taken["n_rows"]), taken["n_taken"] % taken["n_rows"]
    share = whole * F.col(several) + F.least(rest, F.col(sums) + F.col(several)) - F.least(rest, F.col(sums))
    return known.withColumn(times, share.cast("int")).select(*columns_of(rows), times)


OP8_SQL = f"""
WITH z AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT *, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || size) AS key FROM z),
b AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size::DOUBLE * {MAX_REPEATS} AS cap FROM b),
l AS (SELECT *, row_number() OVER o AS place, (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level FROM w
  WINDOW o AS (ORDER BY cap / weight, source NULLS LAST), p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, place) FILTER (level * weight <= cap) AS water FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(water * weight, cap)) AS target FROM l, water),
q AS (SELECT s.*, source_size, target, sum(size) OVER (PARTITION BY s.source ORDER BY key, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (upto + r * source_size)::DOUBLE / target AS finish FROM q, (SELECT unnest(range({MAX_REPEATS})) AS r) WHERE size > 0 AND target > 0),
d AS (SELECT doc_id, key, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, size, r ROWS UNBOUNDED PRECEDING) <= (SELECT sum(target) FROM t) AS paid FROM c),
n AS (SELECT doc_id, count(*) FILTER (paid)::INTEGER AS n_copies FROM d GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, size * coalesce(n_copies, 0) AS taken, coalesce(n_copies, 0) AS n_copies FROM q LEFT JOIN n USING (doc_id)
"""
