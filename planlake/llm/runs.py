"""Maximal periodic stretches of words, by Lyndon arrays over an ordered alphabet, with neither suffix structures nor hashes.

Every run is told by a Lyndon root: for one of two orders of the words, the natural one and its reverse, the longest Lyndon word that starts at the first
root inside a run is as long as the run's period. A Lyndon array holds where these words end, the next smaller suffix of each place. One pass over a text keeps
the places whose next smaller suffix is still open; a new place is compared with the last of them, then with the one before it, and so on. How far two
suffixes match is hardly ever counted word by word:

* If a matches b in x words and b matches c in y, then a and c match in the smaller of x and y, unless these are equal.
* The match that reaches furthest to the right makes the text after its second place a copy of that after its first, so that what was
  matched in the original holds in the copy, as far as the copy goes. Words are only compared beyond it.

So the pass is linear in the words. Runs of at least ``MIN_POWER`` periods are reported, from the first root of each, which is then carried to the left.

Before it, what cannot be in such a run is cut away: each of its words occurs in the document as often as there are whole periods, and each pair
of neighbours nearly so. On prose little is left, and a stretch that is left is examined whole; the cuts lose nothing.

Words stay where they are on the JVM; a task gets arrays of words in Arrow batches and returns spans. Rows do not meet, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from planlake.llm.common import spare

WORD = "[^\\x20\\x09-\\x0D]+"
#: A run has at least so many periods, and so many words.
MIN_POWER, MIN_WORDS = 4, 6
#: Words that are examined at a time.
SLICE = 1 << 21



def _spans(*names: str) -> ArrayType:
    return ArrayType(StructType([StructField(n, LongType()) for n in names]))


_FOUND = StructType([StructField("runs", _spans("start", "length", "period")), StructField("kept", _spans("first", "n"))])
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_KEPT = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))


def _by_roots(s: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs of s whose first Lyndon root in the order of its numbers starts them off, with MIN_POWER periods at least."""
    n = len(s)
    smaller, before = [n] * n, [-1] * n  # the next smaller suffix, and the last smaller one before
    to_smaller, to_before = [0] * n, [0] * n  # words that a suffix shares with these
    alike = [0] * (n + 1)  # words that neighbours share: what is left of a stretch of one word
    for i in range(n - 1, 0, -1):
        if s[i - 1] == s[i]:
            alike[i] = alike[i + 1] + 1
    original = copy = reach = 0  # s[original:] and s[copy:reach] match
    for right in range(1, n):
        left, shared = right - 1, alike[right]
        if right + shared > reach:
            original, copy, reach = left, right, right + shared
        while True:
            end = right + shared
            if end < n and s[left + shared] < s[end]:
                before[right], to_before[right] = left, shared
                break
            smaller[left], to_smaller[left] = right, shared
            period = right - left
            earlier = left - period  # a root that starts there has told of the run
            if shared >= (MIN_POWER - 2) * period and (earlier < 0 or smaller[earlier] != left or to_smaller[earlier] < period):
                start = left
                while start and s[start - 1] == s[start - 1 + period]:
                    start -= 1
                if end - start >= max(MIN_WORDS, MIN_POWER * period):
                    yield start, end - start, period
            further, known = before[left], to_before[left]
            if further < 0:
                break
            if known != shared:
                shared = min(known, shared)
            else:
                if further >= copy and right < reach:
                    a, b = further - (copy - original), right - (copy - original)
                    told = to_smaller[a] if smaller[a] == b else to_before[b] if before[b] == a else shared
                    shared = max(shared, min(told, reach - right))
                    counted = right + told < reach and (smaller[a] == b or before[b] == a)
                else:
                    counted = False
                if not counted:
                    while right + shared < n and s[further + shared] == s[right + shared]:
                        shared += 1
                    if right + shared >= reach:
                        original, copy, reach = further, right, right + shared
            left = further


def runs_of(s: list[int]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of s, by start and period."""
    return sorted({*_by_roots(s), *_by_roots([-x for x in s])}, key=lambda r: (r[0], r[2]))


def _stretches(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end places of the stretches that may hold runs: neighbours in a row whose words and pairs recur in it often enough."""

    def often(keys: np.ndarray, least: int) -> np.ndarray:
        _, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return counts[where] >= least

    size = int(ids.max()) + 1 if len(ids) else 1
    good = np.flatnonzero(often(row * size + ids, MIN_POWER)) if len(ids) else np.zeros(0, np.int64)
    linked = good[:-1][(good[1:] == good[:-1] + 1) & (row[good[1:]] == row[good[:-1]])]
    if not len(linked):
        return linked, linked
    number = np.unique(row[linked] * size + ids[linked], return_inverse=True)[1]
    linked = linked[often(number * size + ids[linked + 1], MIN_POWER - 1)]
    if not len(linked):
        return linked, linked
    fresh = np.flatnonzero(np.r_[True, (linked[1:] != linked[:-1] + 1) | (row[linked[1:]] != row[linked[:-1]])])
    first, end = linked[fresh], linked[np.r_[fresh[1:] - 1, len(linked) - 1]] + 2
    long = end - first >= MIN_WORDS
    return first[long], end[long]


def _kept(n: int, runs: list[tuple[int, int, int]]) -> list[dict]:
    """What stays of n words when each run keeps its first period."""
    out, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        if a > at:
            out.append({"first": at, "n": a - at})
        at = max(at, b)
    if at < n:
        out.append({"first": at, "n": n - at})
    return out


def _examined(words: pa.Array) -> pa.Array:
    wide = pa.types.is_large_list(words.type)
    offsets = np.frombuffer(words.buffers()[1], np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    ids = np.asarray(words.flatten().dictionary_encode().indices).astype(np.int64)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    runs: list[list[dict]] = [[] for _ in range(len(words))]
    kept = [[{"first": 0, "n": n}] if n else [] for n in np.diff(offsets).tolist()]
    i = 0
    while i < len(words):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        part = ids[offsets[i] : offsets[j]]
        row = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for first, end in zip(*_stretches(part, row), strict=True):
            at = int(row[first])
            base = int(first + offsets[i] - offsets[i + at])
            found.setdefault(i + at, []).extend((base + start, length, period) for start, length, period in runs_of(part[first:end].tolist()))
        for at, some in found.items():
            runs[at] = [{"start": s, "length": n, "period": p} for s, n, p in some]
            kept[at] = _kept(int(offsets[at + 1] - offsets[at]), some)
        i = j
    return pa.StructArray.from_arrays([pa.array(runs, _RUNS), pa.array(kept, _KEPT)], names=["runs", "kept"])


@F.arrow_udf(_FOUND)
def find_runs(words: pa.Array) -> pa.Array:
    """struct<runs, kept> of arrays of words without nulls: the runs by start and period, and the spans of words that stay when each run keeps one period."""
    return _examined(words)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def with_runs(rows: DataFrame, words: str, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """rows with runs, array<struct<start, length, period>> by start and period, and collapsed, the words that stay joined by blanks.

    words is an array<string> column, none of whose elements is null. Edge cases: a null array has null runs and collapsed, an empty one none and empty
    text; rows of any kind stay, repeated ones and those without ids too; columns named runs or collapsed are replaced; an empty table stays empty.
    """
    found = spare(rows, "found")
    none = F.lit(None).cast(_FOUND)
    known = rows.withColumn(found, F.when(F.col(words).isNotNull(), find_runs(F.coalesce(words, F.array().cast("array<string>")))).otherwise(none))
    staying = F.flatten(F.transform(F.col(f"{found}.kept"), lambda k: F.slice(F.col(words), (k["first"] + 1).cast("int"), k["n"].cast("int"))))
    return known.withColumns({runs: F.col(f"{found}.runs"), collapsed: F.array_join(staying, " ")}).drop(found)


def looped(words: Column, doc_id: Column) -> Column:
    """The words of the query's contract: a tenth of the documents, told by the checksum of their id, loop from some word on. Without an id, or words, as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10).cast("long"), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    changed = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p)))
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(words)


def op12_lyndon_runs(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of docs (doc_id, text); null text has no words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("original"))
    rows = with_runs(rows.select("doc_id", looped(F.col("original"), F.col("doc_id")).alias("words")), "words")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))
    rows = rows.withColumns({"best": best, "told": F.array_join(F.transform("runs", line), "")})
    length = -F.col("best.less")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.less div best.period").alias("exponent_milli"),
        F.sha2("told", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


