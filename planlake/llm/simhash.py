"""SimHash near-duplicates through pivot distance tables.

A document's fingerprint holds 64 majority bits over the XXH64 hashes of its word shingles. Two
fingerprints link if they differ in at most ``LINK_BITS`` bits.

Pivot tables: the 64 bits are dealt into blocks, and for each block the Hamming distances to
``REFERENCES`` reference fingerprints are computed once per fingerprint. For a linked pair the distances of the
blocks add up to at most LINK_BITS, and by the triangle inequality a block's coordinates differ by no more than
the block itself does. Hence

* at least (blocks - LINK_BITS) blocks have all coordinates equal. Fingerprints therefore meet only in the buckets
  keyed by the coordinates of each such choice of blocks, never all against all;
* a pair is discarded when its maximum coordinate differences, added over the blocks, exceed LINK_BITS;
* the survivors are verified by counting the differing bits.

Both tests only ever drop pairs that are not linked, so no link is lost. The number of blocks follows the
number of fingerprints, so that buckets of unlike fingerprints keep a handful of members. A block's coordinates tell a little less than its
bits, 9.6 bits of collision entropy for 10, which ``blocks_for`` counts in.

The corpus pipeline's near copies have a contract of their own: five-word shingles and a Jaccard similarity of 0.8 or more, at which
fingerprints differ in a dozen bits and more, too many for buckets of equal blocks. ``near_copies`` takes as candidates what the pivot tables
link, adds texts that share a band of least hashes, and verifies all of them by their exact shingle sets.

Edge cases: text that is null, empty or without words has fingerprint zero and is linked like any other; fewer words
than a shingle make one shingle of the whole sequence; a row without doc_id gets its fingerprint, component_id null,
and takes no part in links; repeated rows come out as often as they came in; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from planlake.llm.common import columns_of, joinable, materialize, scratch, spare
from planlake.llm.components import connected_components

SHINGLE_WORDS = 4
HASH_SEED = 42
LINK_BITS = 4
REFERENCES = 8
#: Buckets above this size are compared tile by tile, in tasks of their own.
TILE = 4096
#: Rows of buckets that a task compares at a time.
HELD_ROWS = 100_000

#: The corpus pipeline's near copies: words in a shingle, and the Jaccard similarity of shingle sets from which texts are copies.
COPY_WORDS = 5
COPY_SIMILARITY = 0.8
#: Texts of similarity s share none of the bands with probability (1 - s ** BAND_ROWS) ** BANDS: 1.3e-7 at 0.8.
BANDS, BAND_ROWS = 40, 5
#: Candidates of more characters than this are compared tile by tile.
TILE_CHARS = 4_000_000

_MULTIPLIERS = np.random.default_rng(HASH_SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_AT = 256 * np.arange(8)


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased words (A-Z only), repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths) + np.arange(n)
    starts = ends - lengths
    digest, m = xxhash.xxh64_intdigest, n - width + 1
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:m].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, m)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as an unsigned 64-bit integer."""
    if not len(hashes):
        return 0
    at = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE_AT
    counts = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits((2 * counts.ravel() > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    out = np.fromiter((majority(shingle_hashes(t)) for t in texts), np.uint64, len(texts))
    return pd.Series(out.view(np.int64))


def _references(n: int) -> list[int]:
    """Reference fingerprints: digests of 0..n-1, as signed 64-bit integers."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), HASH_SEED) for i in range(n)], np.uint64).view(np.int64).tolist()


def _masks(blocks: int) -> list[int]:
    """Bit masks that deal the 64 bits into blocks of near equal width, as signed integers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return np.array([((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)], np.uint64).view(np.int64).tolist()


def blocks_for(fingerprints: int) -> int:
    """The least number of blocks whose keys, which tell apart about 61 * (1 - LINK_BITS / blocks) bits, leave unlike fingerprints a few to a bucket."""
    blocks = LINK_BITS + 2
    while blocks < 4 * LINK_BITS and 2.0 ** (61 * (blocks - LINK_BITS) / blocks) * 8 < fingerprints:
        blocks += 1
    return blocks


def pivot_code(fp: Column, mask: int) -> Column:
    """A block's distances to the references, four bits each."""
    code = F.lit(0).cast("long")
    for i, ref in enumerate(_references(REFERENCES)):
        code = code.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(ref)).bitwiseAND(F.lit(mask))).cast("long"), 4 * i))
    return code


def bucket_keys(fp: Column, blocks: int) -> Column:
    """One key for each choice of blocks that a linked pair may have in common."""
    codes = [pivot_code(fp, m) for m in _masks(blocks)]
    return F.array(*[F.xxhash64(F.lit(t), *[codes[i] for i in chosen]) for t, chosen in enumerate(combinations(range(blocks), blocks - LINK_BITS))])


def pivot_table(fps: np.ndarray, blocks: int) -> np.ndarray:
    """Coordinates (fingerprint, block, reference)."""
    refs, masks = np.array(_references(REFERENCES)).view(np.uint64), np.array(_masks(blocks)).view(np.uint64)
    return np.bitwise_count((fps[:, None, None] ^ refs[None, None, :]) & masks[None, :, None]).astype(np.int8)


def _verified(fps: np.ndarray, pivots: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs among (i, j): discarded by coordinates, then counted bit by bit."""
    bound = np.abs(pivots[i] - pivots[j]).max(axis=2).sum(axis=1, dtype=np.int16)
    i, j = i[bound <= LINK_BITS], j[bound <= LINK_BITS]
    near = np.bitwise_count(fps[i] ^ fps[j]) <= LINK_BITS
    return i[near], j[near]


def _flood(fps: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[int, int]]:
    """(root, member) by breadth-first search; a fingerprint once reached is compared no more, so crowds of copies cost little."""
    left = np.arange(len(fps))
    while len(left) > 1:
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            some, frontier = frontier[:16], frontier[16:]
            reached = np.zeros(len(left), bool)
            for k in some:
                i, j = _verified(fps, pivots, np.full(len(left), k), left)
                reached[np.searchsorted(left, j)] = True
            new, left = left[reached], left[~reached]
            frontier = np.concatenate([frontier, new])
            yield from ((root, k) for k in new)


def _links(blocks: int):
    """mapInPandas function over rows (bucket, fp, node) sorted by bucket: a spanning forest of the links in each bucket.

    Holds whole buckets of together HELD_ROWS rows, or one bucket more.
    """

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= HELD_ROWS:
                rows = pd.concat(held, ignore_index=True)
                last = rows["bucket"].to_numpy()
                cut = int(np.flatnonzero(last != last[-1])[-1]) + 1 if last[0] != last[-1] else 0  # the last bucket may go on
                yield from found(rows.iloc[:cut])
                held, n = [rows.iloc[cut:]], len(rows) - cut
        if held:
            yield from found(pd.concat(held, ignore_index=True))

    def found(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(rows):
            return
        keys, nodes = rows["bucket"].to_numpy(), rows["node"].to_numpy()
        fps = rows["fp"].to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        of = np.repeat(np.arange(len(starts)), sizes)
        small = np.flatnonzero((sizes <= 64)[of])
        edges = []
        pivots = pivot_table(fps[small], blocks)
        for step in range(1, 64):
            i = np.arange(0, len(small) - step)
            i = i[of[small[i]] == of[small[i + step]]]
            if not len(i):
                break
            a, b = _verified(fps[small], pivots, i, i + step)
            edges.append(np.stack([nodes[small[a]], nodes[small[b]]]))
        for g in np.flatnonzero(sizes > 64):
            at = slice(starts[g], starts[g] + sizes[g])
            pairs = list(_flood(fps[at], pivot_table(fps[at], blocks)))
            if pairs:
                edges.append(nodes[at][np.array(pairs).T])
        if edges:
            a, b = np.concatenate(edges, axis=1)
            yield pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()

    return links


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes whose fingerprints are linked, enough to connect all that links connect.

    distinct: long columns fp and node, each fp once. A bucket of more than TILE members is dealt into tiles, and each
    two tiles meet in a task of their own.
    """
    blocks = blocks_for(distinct.count())
    rows = distinct.select("fp", "node", F.explode(bucket_keys(F.col("fp"), blocks)).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sized = materialize(rows.join(joinable(sizes, "bucket-sizes"), "bucket"), "shared-buckets")
    schema = "a long, b long"
    few = sized.where(f"n <= {TILE}").select("bucket", "fp", "node").repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_links(blocks), schema)
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    hot = (
        sized.where(f"n > {TILE}")
        .select("bucket", "fp", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
        .select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp", "node")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInPandas(_links(blocks), schema)
    )
    return few.union(hot)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (columns doc_id, text)."""
    known = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint("text").alias("fp")), "fingerprints")
    distinct = known.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"))
    distinct = materialize(distinct, "distinct-fingerprints")
    with scratch(docs.sparkSession):
        components = connected_components(fingerprint_links(distinct))
    of = distinct.join(components, "node", "left").select(F.col("fp").alias("of_fp"), F.coalesce("component", "node").alias("component"))
    joined = known.join(of, known["fp"] == of["of_fp"], "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def op1_simhash_pivots(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _signature(hashes: np.ndarray) -> np.ndarray:
    """The least product of the shingles' hashes with each multiplier."""
    out = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 256):
        out = np.minimum(out, (_MULTIPLIERS[:, None] * hashes[None, lo : lo + 256]).min(axis=1))
    return out


@F.pandas_udf(StructType().add("fp", LongType()).add("bands", ArrayType(LongType())))
def sketch(texts: pd.Series) -> pd.DataFrame:
    """The fingerprint of five-word shingles, and one key for each band of the signature; texts without words share all of theirs."""
    fps, rows = np.zeros(len(texts), np.uint64), np.zeros((len(texts), BANDS * BAND_ROWS), np.uint64)
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, COPY_WORDS)
        fps[i], rows[i] = majority(hashes), _signature(hashes)
    rows = rows.reshape(len(texts), BANDS, BAND_ROWS)
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], len(texts), axis=0)
    for i in range(BAND_ROWS):
        keys = (keys ^ rows[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return pd.DataFrame({"fp": fps.view(np.int64), "bands": list(keys.view(np.int64))})


def similar(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(root, member) over sets of hashes by breadth-first search along the pairs whose Jaccard similarity is COPY_SIMILARITY or more.

    A set is held against those not yet reached only: an inverted list of their hashes is built anew whenever half of them have been reached, so
    a crowd of copies beside a few strangers costs little.
    """
    sizes = np.array([len(s) for s in sets])
    left = np.arange(len(sets))

    def listed(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate([sets[i] for i in of]) if len(of) else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        return values[order], np.repeat(np.arange(len(of)), sizes[of])[order]

    hashes, holders = listed(left)
    there = np.ones(len(left), bool)

    def near(k: int) -> np.ndarray:
        first, end = np.searchsorted(hashes, sets[k]), np.searchsorted(hashes, sets[k], "right")
        n = end - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(holders[at], minlength=len(left))
        of = sizes[left]
        # two empty sets are alike
        return there & (shared >= COPY_SIMILARITY * (of + sizes[k] - shared) - 1e-9 if sizes[k] else of == 0)

    while there.any():
        place = int(there.argmax())
        root = int(left[place])
        there[place], frontier = False, [root]
        while frontier and there.any():
            new = np.flatnonzero(near(frontier.pop()))
            there[new] = False
            members = left[new].tolist()
            frontier.extend(members)
            yield from ((root, k) for k in members)
            if 2 * there.sum() < len(left):
                left = left[there]
                hashes, holders = listed(left)
                there = np.ones(len(left), bool)


def _similar_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas function over rows (bucket, node, text) sorted by bucket; holds one bucket at a time."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node")
        nodes = rows["node"].to_numpy()
        pairs = np.array(list(similar([np.unique(shingle_hashes(t, COPY_WORDS)) for t in rows["text"]])), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": nodes[pairs[:, 0]], "b": nodes[pairs[:, 1]]})

    held: list[pd.DataFrame] = []
    for batch in batches:
        for bucket, rows in batch.groupby("bucket", sort=False):
            if held and held[-1]["bucket"].iloc[0] != bucket:
                yield links(pd.concat(held))
                held = []
            held.append(rows)
    if held:
        yield links(pd.concat(held))
    pa.default_memory_pool().release_unused()


def text_tag() -> Column:
    """MD5 of the text, as bytes; null is empty."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _similar_texts(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes of distinct (tag, chars, fp, bands, node) whose texts are similar, enough to connect all that similarity connects."""
    alike = materialize(distinct.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    linked = fingerprint_links(alike.select("fp", F.col("least").alias("node")))
    same = distinct.select("fp", "node").join(joinable(alike.where("n > 1").select("fp", "least"), "shared-fingerprints"), "fp")
    rows = distinct.select("node", F.explode("bands").alias("band"))
    least = rows.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least")
    banded = rows.join(joinable(least, "shared-bands"), "band")
    stars = same.select("node", "least").union(banded.select("node", "least")).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = connected_components(linked.union(stars))
    groups = groups.union(groups.select(F.col("component").alias("node"), "component").distinct())
    members = materialize(distinct.select("tag", "chars", "node").join(groups, "node"), "candidate-groups")
    sizes = members.groupBy("component").agg(F.ceil(F.sum("chars") / TILE_CHARS).cast("int").alias("tiles"))
    tiles = F.greatest(F.col("tiles"), F.lit(1))
    dealt = members.join(joinable(sizes, "group-sizes"), "component")
    dealt = dealt.select("tag", "node", "component", tiles.alias("tiles"), F.pmod(F.xxhash64("node"), tiles).cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = dealt.select("tag", "node", F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
    texts = docs.select(text_tag().alias("tag"), F.coalesce("text", F.lit("")).alias("text")).join(members.select("tag"), "tag", "left_semi")
    # written before copies are dropped: the join can then be split at a text that many rows hold, and the copies go before the next shuffle
    texts = materialize(texts, "candidate-texts").dropDuplicates(["tag"])
    held = texts.join(met, "tag").select("bucket", "node", "text").repartition("bucket").sortWithinPartitions("bucket")
    return materialize(held.mapInPandas(_similar_nodes, "a long, b long"), "similar-texts")


def near_copies(docs: DataFrame) -> DataFrame:
    """(tag, component) for each distinct text of docs: texts joined by similarities of COPY_SIMILARITY or more share a component.

    Texts whose fingerprints the pivot tables link, and texts that share a band, are candidates. What candidates connect meets in one task, or
    tile by tile where it is more than TILE_CHARS characters, and there all pairs are held against each other by their exact shingle sets.
    """
    keyed = docs.select(text_tag().alias("tag"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), sketch("text").alias("sketch"))
    distinct = keyed.groupBy("tag").agg(F.min("chars").alias("chars"), F.min("sketch").alias("sketch"))
    distinct = materialize(distinct.select("tag", "chars", "sketch.fp", "sketch.bands", F.monotonically_increasing_id().alias("node")), "distinct-texts")
    with scratch(docs.sparkSession):
        components = connected_components(_similar_texts(docs, distinct))
    return distinct.select("tag", "node").join(components, "node", "left").select("tag", F.coalesce("component", "node").alias("component"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the near copies: of each component of ``near_copies`` the row of least doc_id stays, and rows without doc_id stay.

    Rows are told apart by doc_id and text, so unlike texts that share a doc_id are judged each by itself; of rows alike in both the one of
    the least digest of the other columns stays. What stays is decided on ids and digests, and texts move once, to meet the decision. Null and empty texts are one text; an empty table stays empty; columns keep their names.
    """
    others = columns_of(docs, "doc_id", "text")
    tag, rest = spare(docs, "of_text"), spare(docs, "of_rest")
    told = F.xxhash64(F.col("text").isNull(), *[x for c in others for x in (c, c.isNull())])
    known = docs.where("doc_id IS NOT NULL").withColumns({tag: text_tag(), rest: told})
    rows = known.select("doc_id", F.col(tag).alias("own_tag"), F.col(rest).alias("own_rest"))
    counted = materialize(rows.groupBy("doc_id", "own_tag", "own_rest").agg(F.count("*").alias("n")), "distinct-rows")
    judged = counted.join(near_copies(docs.where("doc_id IS NOT NULL")), F.col("own_tag") == F.col("tag"))
    least = judged.groupBy("component").agg(F.min(F.struct("doc_id", "own_tag", "own_rest", "n")).alias("row"))
    kept = joinable(least.select(F.struct("row.*").alias(spare(docs, "kept"))), "kept-rows")
    row = F.col(kept.columns[0])
    stay = known.join(kept, (F.col("doc_id") == row["doc_id"]) & (F.col(tag) == row["own_tag"]) & (F.col(rest) == row["own_rest"]), "left_semi")
    if counted.where("n > 1").limit(1).count():
        stay = stay.dropDuplicates(["doc_id", tag, rest])
    return stay.select(*columns_of(docs)).union(docs.where("doc_id IS NULL"))
