"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A first pass counts, over all documents, how many hold each word n-gram of the benchmark. An item's seeds are its n-grams that are rare
beside its own others: those in no more documents than ``RARE_FACTOR`` times its median. A leaked passage
raises all of its counts alike, so it never loses its seeds, while stock phrases do. A second pass finds the seeds in the
documents, with a word or none put in between their words, and aligns each item with the words around its seeds; the best local alignment's score over the item's length, in words, decides.

The benchmark goes to the tasks in blocks of at most ``BLOCK_WORDS`` words, one pass over the documents for each block, so that what is
broadcast stays bounded. Documents never cross the network.

Edge cases: null and empty texts and items match nothing; an item shorter than an n-gram is one seed of all its words;
rows without doc_id or item_id are matched and come out with null; a document that repeats an item gives one row, its
best alignment; repeated benchmark rows give repeated rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlake.llm.common import columns_of, joinable, spare

GRAM = 3
#: Where a seed's words stand in a document that has a word put in between them.
SPACED = ((0, 1, 3), (0, 2, 3))
RARE_FACTOR = 4
BLOCK_WORDS = 1_000_000
#: Alignment: points for a match, a mismatch and a gap, and the share of an item's length that makes a leak.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
THRESHOLD = 0.6

_PUNCTUATION = b".,;:!?\"'()[]"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NAMES = ["doc_id", "item_id", "score", "first_word", "end_word", "n_seeds"]
_TAGGED = ["doc_id", "text_tag", *_NAMES[2:]]
_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
_SCHEMA = "doc_id long, text_tag long, score double, first_word long, end_word long, n_seeds long"


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the width-grams, or of all words where there are fewer."""
    width = min(width, len(words))
    if not width:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ words[i : len(words) - width + 1 + i]) * _A
        out ^= out >> np.uint64(31)
    return out * _B


def spaced_grams(words: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Hashes, equal to those of grams, of the words at places from each word on."""
    n = len(words) - places[-1]
    out = np.full(max(0, n), len(places), np.uint64)
    for i in places if n > 0 else ():
        out = (out ^ words[i : n + i]) * _A
        out ^= out >> np.uint64(31)
    return out * _B


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of item in words: score over the item's length, and its end and latest start in words.

    A row of the matrix is one vector step: gaps along the row are a running maximum of scores less the gaps' ramp.
    """
    n = len(words)
    ramp = np.arange(n + 1) * -GAP
    row, best, end = np.zeros(n + 1), 0.0, 0
    begin, ids = np.arange(n + 1), np.arange(n + 1)
    for w in item:
        new = np.zeros(n + 1)
        diagonal = row[:-1] + np.where(words == w, MATCH, MISMATCH)
        new[1:] = np.maximum(diagonal, 0)
        origin = ids.copy()
        origin[1:] = np.where(diagonal > 0, begin[:-1], ids[1:])
        up = row + GAP
        origin = np.where(up > new, begin, origin)
        new = np.maximum(new, up)
        raised = new + ramp
        along = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised >= along, ids, 0))
        begin = origin[source]
        row = along - ramp
        k = int(row.argmax())
        if row[k] > best:
            best, end, first = float(row[k]), k, int(begin[k])
    return (best / (MATCH * len(item)), first, end) if best else (0.0, 0, 0)


class Seeds:
    """Sorted gram hashes with the items and offsets where each stands."""

    def __init__(self, items: list[np.ndarray], keep: list[np.ndarray] | None = None):
        self.items = items
        found = [grams(it, GRAM) for it in items]
        hashes = np.concatenate([np.zeros(0, np.uint64), *found])
        item = np.repeat(np.arange(len(items)), [len(g) for g in found])
        offset = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in found]])
        kept = np.concatenate([np.zeros(0, bool), *keep]) if keep is not None else np.ones(len(hashes), bool)
        order = np.flatnonzero(kept)[np.argsort(hashes[kept], kind="stable")]
        self.grams, self.item, self.offset = hashes[order], item[order], offset[order]
        self.short = sorted({len(it) for it in items if 0 < len(it) < GRAM})
        self.bits = np.zeros(1 << 16, bool)
        self.bits[self.grams >> np.uint64(48)] = True

    def hits(self, words: np.ndarray, spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(position in words, row of the table) of every seed found; spaced: those too between whose words one word more stands."""
        at, row = [], []
        shapes = [tuple(range(width)) for width in [GRAM, *self.short]] + (list(SPACED) if spaced else [])
        for places in shapes:
            if len(words) <= places[-1] or not len(self.grams):
                continue
            g = spaced_grams(words, places)
            some = np.flatnonzero(self.bits[g >> np.uint64(48)])
            g = g[some]
            lo, hi = np.searchsorted(self.grams, g), np.searchsorted(self.grams, g, "right")
            found = np.flatnonzero(hi > lo)
            for k in range(int((hi - lo).max(initial=0))):
                more = found[(hi - lo)[found] > k]
                at.append(some[more])
                row.append(lo[more] + k)
        return (np.concatenate(at), np.concatenate(row)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _frequencies(seeds: Seeds):
    """The number of documents in which each gram of the block stands."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(seeds.grams), np.int64)
        for b in batches:
            for text in b["text"]:
                _, row = seeds.hits(word_hashes(text))
                n[np.unique(row)] += 1
        at = np.flatnonzero(n)
        yield pd.DataFrame({"row": at, "n": n[at]})

    return count


def rare(seeds: Seeds, n_docs: np.ndarray) -> list[np.ndarray]:
    """For each item, which of its grams are seeds."""
    keep = []
    by_item = np.argsort(seeds.item, kind="stable")
    bounds = np.searchsorted(seeds.item[by_item], np.arange(len(seeds.items) + 1))
    for i, item in enumerate(seeds.items):
        mine = by_item[bounds[i] : bounds[i + 1]]
        counts = np.zeros(len(grams(item, GRAM)), np.int64)
        counts[seeds.offset[mine]] = n_docs[mine]
        keep.append(counts <= RARE_FACTOR * max(1.0, float(np.median(counts)) if len(counts) else 1.0))
    return keep


def aligned(words: np.ndarray, seeds: Seeds, threshold: float = THRESHOLD) -> list[tuple[int, float, int, int, int]]:
    """(item, score, first word, end word, seeds) of each item that has seeds in words: its best alignment, or one below threshold if none reaches it.

    An alignment that reaches threshold has at most (MATCH - threshold) / -GAP gaps to a word of the item, which bounds how far it
    goes from a seed, and matches no word of the item that its surroundings lack, which spares most alignments that can't reach it.
    """
    at, row = seeds.hits(words, spaced=True)
    out = []
    for i in np.unique(seeds.item[row]):
        mine = np.sort(at[seeds.item[row] == i])
        item, best = seeds.items[i], (0.0, 0, 0)
        reach = len(item) + math.ceil(len(item) * max(0.0, MATCH - threshold) / -GAP)
        for part in np.split(mine, np.flatnonzero(np.diff(mine) > 2 * reach) + 1):
            lo, hi = max(0, part[0] - reach), min(len(words), part[-1] + reach)
            if np.isin(item, words[lo:hi]).sum() < threshold * len(item):
                continue
            score, first, end = align(item, words[lo:hi])
            if score > best[0]:
                best = (score, lo + first, lo + end)
        out.append((int(i), *best, len(mine)))
    return out


def _matches(seeds: Seeds, tags: list, threshold: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (doc_id, tags[i], score, first, end, n)
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
                for i, score, first, end, n in aligned(word_hashes(text), seeds, threshold)
                if score >= threshold
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _TAGGED)

    return match


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word, n_seeds) of each document and item whose alignment reaches threshold.

    Each text of the benchmark is counted and aligned once, however many items hold it, and its items are joined to what it finds.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = items.select("text").distinct()
    n_words = texts.agg(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0
    blocks = max(1, -(-n_words // BLOCK_WORDS))
    found = spark.createDataFrame([], _SCHEMA)
    for k in range(blocks):
        # a block holds about BLOCK_WORDS words, whatever the benchmark's size
        block = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).select(_tag().alias("tag"), "text").orderBy("text").collect()
        hashed = [word_hashes(r["text"]) for r in block]
        every = Seeds(hashed)
        counted = rows.select("text").mapInPandas(_frequencies(every), "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).toPandas()  # a row for a gram of the block
        n_docs = np.zeros(len(every.grams), np.int64)
        n_docs[counted["row"].to_numpy()] = counted["n"].to_numpy()
        seeds = Seeds(hashed, rare(every, n_docs))
        found = found.union(rows.mapInArrow(_matches(seeds, [r["tag"] for r in block], threshold), _SCHEMA))
    named = joinable(items.select("item_id", _tag().alias("of_text")), "benchmark-items")
    return found.join(named, F.col("text_tag") == F.col("of_text")).select(*_NAMES)


def _tag() -> Column:
    return F.xxhash64("text")


def op10_rare_seed_alignment(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, keep_unnamed: bool = True) -> DataFrame:
    """The rows of docs in which no item is found, each judged by its own text; keep_unnamed: rows without doc_id stay in any case.

    docs' columns come out as they are, whatever their names; null and empty texts hold no item; an empty benchmark drops nothing.
    """
    tag = spare(docs, "of_text")
    tagged = docs.withColumn(tag, F.xxhash64(F.coalesce("text", F.lit(""))))
    hit = leaks(tagged.select(F.col(tag).alias("doc_id"), "text"), benchmark, threshold).select(F.struct("doc_id").alias(spare(docs, "leaked"))).distinct()
    hit = joinable(hit, "leaked-texts")
    same = F.col(tag) == F.col(hit.columns[0])["doc_id"]
    if keep_unnamed:
        same = same & F.col("doc_id").isNotNull()
    return tagged.join(hit, same, "left_anti").select(*columns_of(docs))
