"""Exact removal of repeated passages of words, by a compacted De Bruijn graph of token k-mers.

An edge of the graph is a stretch of ``WINDOW`` words, from the node of its first WINDOW - 1 words to that of its last; a document is a walk. An edge that is
walked twice is a repeated passage. The graph is never spelled out edge by edge:

* Walks are cut into runs of edges that share a minimizer, of an edge's ``GRAM``-word strings that of least digest, the leftmost of equals. Equal edges
  have equal minimizers at equal offsets, so that a run, which is one record for a dozen edges, holds edges that another run has only if the minimizer is shared. Runs
  whose minimizer is unique go.
* Runs of equal words are one class. Where a minimizer has one class only, it is a nonbranching path that is walked several times, whole. Where it has
  several, one run of each class fetches its words by its source coordinates, its edges are counted by their words, each as often as its class is walked,
  and those walked more than once make the class's repeated paths.
* Repeated paths that always follow each other are one: where every walk over the first goes on to the second, and every walk over the second comes from the
  first, the node between does not branch. Joins of the paths with their followers double the length that is known of a path, until each
  knows its end. A document then holds one span for each whole path it walks, from the coordinate where it enters.

Edges are equal where two 64-bit digests are, that of the minimizer and that of the run's or the edge's words. Counts are pre-aggregated and written before
they are joined back, which leaves hot minimizers and hot paths to AQE's splitting.

Edge cases: null text has no words; documents of fewer words than the window lose nothing; windows never cross documents, and a document may repeat
itself, overlapping or not; rows are told apart by doc_id and text, so a repeated row counts as a copy and both lose alike; null doc_ids are one more
value; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planlake.llm.common import cut, joinable, materialize, scratch

WINDOW = 35
GRAM = 10
#: Bytes that are split into words at a time, and words whose edges are made at a time.
CHUNK, PIECE = 1 << 20, 1 << 18

_WIDTH = WINDOW - GRAM + 1
_LOW = np.uint64((1 << 20) - 1)
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A digest for each byte; blanks add nothing to the word before them.
_LETTERS = np.where(_SPACE, np.uint64(0), np.array([xxhash.xxh64_intdigest(bytes([i]), 7) | 1 for i in range(256)], np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(0, n - 1), base, np.uint64))])


_UP, _DOWN = _powers(_BASE, PIECE + 4 * WINDOW), _powers(pow(_BASE, -1, 1 << 64), PIECE + 4 * WINDOW)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_digests(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests of the words of data, the first word of each document and the end of the last), of documents data[bounds[i]:bounds[i + 1]]."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    blank = _SPACE[data]
    fresh = np.r_[True, blank[:-1]]
    fresh[bounds[(bounds > 0) & (bounds < len(data))]] = True
    starts = np.flatnonzero(fresh & ~blank)
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    sizes = np.diff(np.r_[starts, len(data)])
    place = np.arange(starts[0], len(data)) - np.repeat(starts, sizes)
    powers = _UP if place.max() < len(_UP) else _powers(_BASE, int(place.max()) + 1)
    return _mixed(np.add.reduceat(_LETTERS[data[starts[0] :]] * powers[place], starts - starts[0])), first


def _long_digests(data: np.ndarray) -> np.ndarray:
    """Digests of the words of one long document, split at blanks."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):
            blanks = np.flatnonzero(_SPACE[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:  # a word longer than that
                end = next((i + int(found[0]) + 1 for i in range(end, len(data), CHUNK) if len(found := np.flatnonzero(_SPACE[data[i : i + CHUNK]]))), len(data))
        out.append(word_digests(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _prefix(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _UP[: len(words)], out=out[1:])
    return out


def _between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * _DOWN[start]


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of width, by running minima to and from the bounds of blocks of width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def super_kmers(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, lo, rel, len, key, cls) of the runs of edges that share a minimizer, in the segments words[first:last].

    A run's edges start at lo..lo+len, its minimizer at lo+rel. key stands for the minimizer's words, cls for the run's words and shape.
    """
    prefix, n = _prefix(words), len(words)
    grams = _mixed((prefix[GRAM:] - prefix[:-GRAM]) * _DOWN[: n - GRAM + 1])
    least = _sliding_minimum((grams & ~_LOW) | np.arange(n - GRAM + 1, dtype=np.uint64), _WIDTH)
    long = last - first >= WINDOW
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, first[long], 1)
    np.add.at(marks, last[long] - WINDOW + 1, -1)
    starts = np.flatnonzero(np.cumsum(marks[: n - WINDOW + 1]))
    chosen = (least[starts] & _LOW).astype(np.int64)
    segment = np.searchsorted(first, starts, "right") - 1
    begins = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (segment[1:] != segment[:-1])]) if len(starts) else starts
    lo, hi, chosen, segment = starts[begins], starts[np.r_[begins[1:] - 1, len(starts) - 1]] if len(starts) else starts, chosen[begins], segment[begins]
    key = grams[chosen]
    rel, length = chosen - lo, hi - lo
    cls = _mixed(_mixed(_between(prefix, lo, hi + WINDOW) + (rel * 64 + length).astype(np.uint64) * _MIX) ^ key)
    return segment, lo - first[segment], rel, length, key.view(np.int64), cls.view(np.int64)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and its offsets in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _in_pieces(words: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """super_kmers of one long document."""
    for part in range(0, len(words), PIECE):
        piece = words[part : part + PIECE + WINDOW - 1]
        if len(piece) >= WINDOW:
            segment, lo, *rest = super_kmers(piece, np.zeros(1, np.int64), np.array([len(piece)]))
            yield (segment, lo + part, *rest)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _bytes(batch.column("text"))
        out, i, rows = [], 0, batch.num_rows
        while i < rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
            if offsets[j] - offsets[i] > CHUNK:  # one long document
                out += [(segment + i, *rest) for segment, *rest in _in_pieces(_long_digests(data[offsets[i] : offsets[j]]))]
            else:
                words, first = word_digests(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if len(words) > PIECE + WINDOW - 1:
                    out += [(segment + i + k, *rest) for k in range(j - i) for segment, *rest in _in_pieces(words[first[k] : first[k + 1]])]
                elif len(words) >= WINDOW:
                    segment, *rest = super_kmers(words, first[:-1], first[1:])
                    out.append((segment + i, *rest))
            i = j
        if out:
            row, lo, rel, length, key, cls = (np.concatenate(c) for c in zip(*out, strict=True))
            take = pa.array(row)
            columns = [batch.column("did").take(take), batch.column("th").take(take), pa.array(lo * 4096 + rel * 64 + length), pa.array(key), pa.array(cls)]
            yield pa.RecordBatch.from_arrays(columns, ["did", "th", "pos", "key", "cls"])


_RUNS = "did long, th long, pos long, key long, cls long"
_EDGES = "key long, cls long, start int, edge long, n long"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of the wanted runs of each document: (key, cls, start, edge, n), start counting from the run's first edge."""
    for batch in batches:
        data, offsets = _bytes(batch.column("text"))
        key, cls, start, edge, n = [], [], [], [], []
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            words = _long_digests(data[offsets[i] : offsets[i + 1]])
            pos = np.array([w["pos"] for w in wanted], np.int64)
            lo, rel, length = pos >> 12, pos >> 6 & 63, pos & 63
            of = np.repeat(np.arange(len(wanted)), length + 1)
            offset = np.arange(len(of)) - np.repeat(np.cumsum(length + 1) - length - 1, length + 1)
            code = np.zeros(len(of), np.uint64)
            for k in range(WINDOW):
                code = _mixed(code + words[lo[of] + offset + k])
            key.append(np.array([w["key"] for w in wanted], np.int64)[of])
            cls.append(np.array([w["cls"] for w in wanted], np.int64)[of])
            start.append(offset.astype(np.int32))
            edge.append(code.view(np.int64) ^ (rel[of] - offset))
            n.append(np.array([w["n"] for w in wanted], np.int64)[of])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (key, cls, start, edge, n)], ["key", "cls", "start", "edge", "n"])


def repeated_paths(docs: DataFrame) -> DataFrame:
    """(did, th, enter, leave, path): the walks of docs (did, th, text) over repeated paths, from their first edge to their last, each walk once."""
    with scratch(docs.sparkSession):
        found = materialize(docs.mapInArrow(_scan, _RUNS), "super-kmers")
        keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("a"), F.max("cls").alias("b"))
        shared = keys.where("n > 1").select(F.col("key").alias("of_key"), (F.col("a") == F.col("b")).alias("alike"))
        members = materialize(found.join(joinable(shared, "shared-minimizers"), F.col("key") == F.col("of_key")).drop("of_key"), "shared-runs", keep=True)
    with scratch(docs.sparkSession):
        branching = members.where("NOT alike")
        classes = materialize(branching.groupBy("key", "cls").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "pos")).alias("source")), "run-classes")
        wanted = classes.groupBy(F.col("source.did").alias("w_did"), F.col("source.th").alias("w_th")).agg(F.collect_list(F.struct("key", "cls", "n", "source.pos")).alias("wanted"))
        fetched = docs.join(wanted, (F.col("did") == F.col("w_did")) & (F.col("th") == F.col("w_th"))).select("text", "wanted")
        # of rows that repeat in both doc_id and text, each gives the same edges
        edges = materialize(fetched.mapInArrow(_edges, _EDGES).dropDuplicates(["key", "cls", "start"]), "edges")
        again = edges.groupBy("key", "edge").agg(F.sum("n").alias("walks")).where("walks > 1").select(F.col("key").alias("of_key"), F.col("edge").alias("again"))
        repeated = edges.join(joinable(again, "repeated-edges"), (F.col("key") == F.col("of_key")) & (F.col("edge") == F.col("again")), "left_semi")
        island = F.col("start") - F.row_number().over(Window.partitionBy("key", "cls").orderBy("start"))
        stretches = repeated.withColumn("island", island).groupBy(F.col("key").alias("p_key"), F.col("cls").alias("p_cls"), "island")
        # ends that overlap tell all words between them
        ends = F.xxhash64("p_key", F.min_by("edge", "start"), F.max_by("edge", "start")).alias("path")
        stretches = materialize(stretches.agg(F.min("start").alias("first"), F.max("start").alias("last"), ends).drop("island"), "repeated-stretches", keep=True)
    lo, length = F.shiftright("pos", 12), F.col("pos").bitwiseAND(F.lit(63))
    alike = members.where("alike").select("did", "th", lo.alias("enter"), (lo + length).alias("leave"), F.xxhash64("key", "cls").alias("path"))
    others = members.where("NOT alike").join(stretches, (F.col("key") == F.col("p_key")) & (F.col("cls") == F.col("p_cls")))
    others = others.select("did", "th", (lo + F.col("first")).alias("enter"), (lo + F.col("last")).alias("leave"), "path")
    return alike.union(others).groupBy("did", "th", "enter").agg(F.first("leave").alias("leave"), F.first("path").alias("path"))


def _followers(walks: DataFrame) -> DataFrame:
    """(path, edges, follower): follower is the path that every walk over path goes on to, if all walks over that come from path; else null."""
    by_place = Window.partitionBy("did", "th").orderBy("enter")
    ahead = walks.withColumns({"next": F.lead("path").over(by_place), "at": F.lead("enter").over(by_place)})
    steps = ahead.select("path", (F.col("leave") - F.col("enter") + 1).alias("edges"), F.when(F.col("at") == F.col("leave") + 1, F.col("next")).alias("next"))
    steps = materialize(steps.groupBy("path", "next").agg(F.count("*").alias("n"), F.first("edges").alias("edges")), "steps")
    paths = steps.groupBy("path").agg(F.sum("n").alias("n"), F.count("*").alias("ways"), F.first("edges").alias("edges"), F.max("next").alias("next"))
    paths = materialize(paths, "paths")
    walked = paths.select(F.col("path").alias("follower"), F.col("n").alias("walked"))
    always = paths.withColumn("only", F.when(F.col("ways") == 1, F.col("next")))
    joined = always.join(walked, (F.col("only") == F.col("follower")) & (F.col("n") == F.col("walked")), "left")
    return joined.select("path", "edges", "follower")


def compacted(walks: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(did, th, enter, edges): walks with paths that always follow each other made one; edges counts those of the whole path.

    Each round joins what is known of a path's way with what is known at the place where that ends, so that the known lengths double; ways do not circle, as every
    walk ends.
    """
    spark = walks.sparkSession
    with scratch(spark):
        walks = materialize(walks, "walks", keep=True)
        paths = materialize(_followers(walks), "followers")
        led = paths.where("follower IS NOT NULL").select(F.col("follower").alias("inner"))
        linked = paths.join(led, F.col("path") == F.col("inner"), "left").withColumn("inside", F.col("inner").isNotNull()).where("inside OR follower IS NOT NULL")
        ways = cut(linked.select("path", "edges", "follower", "inside"))
        for _ in range(max_rounds):
            open_ = ways.where("follower IS NOT NULL")
            if open_.isEmpty():
                break
            on = ways.select(F.col("path").alias("at"), F.col("edges").alias("more"), F.col("follower").alias("on"))
            longer = open_.join(on, F.col("follower") == F.col("at")).select("path", (F.col("edges") + F.col("more")).alias("edges"), F.col("on").alias("follower"), "inside")
            ways = cut(longer.union(ways.where("follower IS NULL")))
        else:
            raise RuntimeError(f"paths did not end in {max_rounds} rounds")
        known = materialize(ways.select(F.col("path").alias("k_path"), F.col("edges").alias("k_edges"), "inside"), "compacted-paths", keep=True)
    joined = walks.join(known, F.col("path") == F.col("k_path"), "left").where("inside IS NULL OR NOT inside")
    return joined.select("did", "th", "enter", F.coalesce("k_edges", F.col("leave") - F.col("enter") + 1).alias("edges"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, kept, cuts = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            words = memoryview(text.as_buffer()).tobytes().split() if text.as_buffer() is not None else []
            merged: list[dict] = []
            for s in sorted(spans or [], key=lambda s: s["first"]):
                if merged and s["first"] <= merged[-1]["last"]:
                    merged[-1]["last"] = max(merged[-1]["last"], s["last"])
                else:
                    merged.append(s)
            stays, at = [], 0
            for s in merged:
                stays += words[at : s["first"]]
                at = s["last"]
            n.append(len(words))
            kept.append(b" ".join(stays + words[at:] if merged else words))
            cuts.append(merged)
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(cuts, _CUTS)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "kept", "cuts"])


_CUTS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, kept, cuts) for each row of docs (doc_id, text): the words that stay, joined by blanks, and the spans of those that go, ends exclusive."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("did"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th"), "text")
    walks = compacted(repeated_paths(rows.select("did", "th", "text")))
    span = F.struct(F.col("enter").alias("first"), (F.col("enter") + F.col("edges") + (WINDOW - 1)).alias("last"))
    spans = walks.groupBy(F.col("did").alias("s_did"), F.col("th").alias("s_th")).agg(F.collect_list(span).alias("spans"))
    joined = rows.join(spans, (F.col("did") == F.col("s_did")) & (F.col("th") == F.col("s_th")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_removed, "doc_id long, n_words long, kept string, cuts array<struct<first:long,last:long>>")


def op11_debruijn_paths(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("cuts", F.lit(0).cast("long"), lambda n, c: n + c["last"] - c["first"])
    return remove_repeated_passages(docs).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
e AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}), h AS (SELECT r, i, md5_number(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM e),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d) p ANTI JOIN gone USING (r, i) GROUP BY r), n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)"""
