"""Exact removal of repeated passages: every byte covered by a string of ``WINDOW`` bytes that also starts elsewhere.

Suffixes are ordered only as deep as the window, by most-significant-digit passes, and groups that stay equal through the last digit are
exactly the repeated windows. Three things keep that small and spread out:

* The first digit is a window's anchor: of its substrings of ``GRAM`` bytes the one of least hash, the leftmost of equals. Equal windows have equal
  anchors at equal offsets. Neighbouring windows share an anchor, so one record stands for the run of windows
  around an anchor position, about 180 of them. Records whose anchor is unique hold no repeated window and go.
* Records of equal bytes are one class. Where an anchor has one class only, all its windows are repeated, and no bytes are compared.
* Only where an anchor has several classes, one record of each fetches its bytes, and the remaining digits, of ``DIGIT`` bytes each, order its windows
  within the anchor, group by group; singletons leave after each digit. An anchor with more than ``CROWD`` classes is not gathered: its
  windows are counted by their whole digests instead, in a distributed aggregate.

Bytes are equal where two 64-bit digests are, that of the anchor and that of a run's or a window's bytes, so that unlike passages pass for equal with a
probability of about their number within one anchor over 2 ** 64. Counts are pre-aggregated and written before they are joined back, which leaves
hot anchors to AQE's splitting. What a document gathers is a few numbers for each of its anchors, about a tenth of its own length at most.

Edge cases: null text is empty; texts shorter than the window lose nothing; windows never cross documents, and a document may
repeat itself, overlapping or not; rows are told apart by doc_id and text, so a repeated row counts as a copy and both lose alike; null
doc_ids are one more value; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.llm.common import joinable, materialize, scratch

WINDOW = 400
GRAM = 40
DIGIT = 100
#: Classes of an anchor that are compared in one task.
CROWD = 2048
#: Bytes scanned at a time, and classes compared at a time.
CHUNK, SLICE = 1 << 18, 2000

_WIDTH = WINDOW - GRAM + 1
_SPAN = CHUNK + WINDOW + 1
_LOW = np.uint64((1 << 20) - 1)
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_LETTERS = np.array([xxhash.xxh64_intdigest(bytes([i]), 5) for i in range(256)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64))])


_UP, _DOWN = _powers(_BASE, _SPAN), _powers(pow(_BASE, -1, 1 << 64), _SPAN)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def prefix_digests(data: np.ndarray) -> np.ndarray:
    """Polynomial digests of all prefixes of at most _SPAN - 1 bytes; see digest_of."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _UP[: len(data)], out=out[1:])
    return out


def digest_of(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
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


def records(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, lo, rel, len, key, cls) of the runs of windows that share an anchor, in data's segments [first, last).

    A run's windows start at lo..lo+len, its anchor at lo+rel. key stands for the anchor's bytes, cls for the run's bytes and shape.
    """
    prefix = prefix_digests(data)
    n = len(data)
    grams = _mixed((prefix[GRAM:] - prefix[:-GRAM]) * _DOWN[: n - GRAM + 1])
    least = _sliding_minimum((grams & ~_LOW) | np.arange(n - GRAM + 1, dtype=np.uint64), _WIDTH)
    long = last - first >= WINDOW
    marks = np.zeros(n + 1, np.int8)
    marks[first[long]] += 1
    marks[last[long] - WINDOW + 1] -= 1
    starts = np.flatnonzero(np.cumsum(marks[: n - WINDOW + 1], dtype=np.int8))
    anchor = (least[starts] & _LOW).astype(np.int64)
    begins = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(starts) else np.zeros(0, np.int64)
    lo, hi, anchor = starts[begins], starts[np.r_[begins[1:] - 1, len(starts) - 1]] if len(starts) else starts, anchor[begins]
    key = grams[anchor]
    rel, length = anchor - lo, hi - lo
    shape = (rel * 512 + length).astype(np.uint64)
    cls = _mixed(_mixed(digest_of(prefix, lo, hi + WINDOW) + shape * _MIX) ^ key)
    segment = np.searchsorted(first, lo, "right") - 1
    return segment, lo - first[segment], rel, length, key.view(np.int64), cls.view(np.int64)


def _texts(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and its offsets in them."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _texts(batch.column("text"))
        out, i, rows = [], 0, batch.num_rows
        while i < rows:
            j = int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1
            if j > i:  # whole documents
                at, first, last = offsets[i], offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]
                if (last - first).max() >= WINDOW:
                    seg, lo, *rest = records(data[at : offsets[j]], first, last)
                    out.append((seg + i, lo, *rest))
                i = j
                continue
            for part in range(0, int(offsets[i + 1] - offsets[i]), CHUNK):  # one long document, piece by piece
                end = min(offsets[i + 1], offsets[i] + part + CHUNK + WINDOW - 1)
                piece = data[offsets[i] + part : end]
                if len(piece) >= WINDOW:
                    seg, lo, *rest = records(piece, np.zeros(1, np.int64), np.array([len(piece)]))
                    out.append((seg + i, lo + part, *rest))
            i += 1
        if out:
            row, lo, rel, length, key, cls = (np.concatenate(c) for c in zip(*out, strict=True))
            take = pa.array(row)
            columns = [batch.column("did").take(take), batch.column("th").take(take), pa.array(lo * (1 << 18) + rel * 512 + length), pa.array(key), pa.array(cls)]
            yield pa.RecordBatch.from_arrays(columns, ["did", "th", "pos", "key", "cls"])


_RECORDS = "did long, th long, pos long, key long, cls long"
_CONTEXTS = "key long, cls long, rel int, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted records of each document."""
    for batch in batches:
        rows = []
        for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
            data = memoryview(text.as_buffer())
            for w in wanted:
                lo, rel, length = w["pos"] >> 18, w["pos"] >> 9 & 511, w["pos"] & 511
                rows.append((w["key"], w["cls"], rel, bytes(data[lo : lo + length + WINDOW])))
        if rows:
            k, c, r, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(r, pa.int32()), pa.array(b, pa.binary())], ["key", "cls", "rel", "bytes"])


def _windows(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digests of all WINDOW // DIGIT digits for each window, its context, its start in the context, prefix) over a list of contexts."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    counts = sizes - WINDOW + 1
    of = np.repeat(np.arange(len(contexts)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    digits = np.empty((len(of), WINDOW // DIGIT), np.uint64)
    step = max(1, CHUNK // (WINDOW + 512))
    for i in range(0, len(contexts), step):
        j = min(len(contexts), i + step)
        base = begin[i]
        prefix = prefix_digests(data[base : begin[j - 1] + sizes[j - 1]])
        lo, hi = np.searchsorted(of, [i, j])
        at = begin[of[lo:hi]] - base + offset[lo:hi]
        for d in range(digits.shape[1]):
            digits[lo:hi, d] = digest_of(prefix, at + d * DIGIT, at + (d + 1) * DIGIT)
    return digits, of, offset, counts


def repeated_windows(group: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Rows whose group and digits another row has too: a most-significant-digit pass for each digit, singletons leaving after each."""
    left, group = np.arange(len(group)), group.astype(np.uint64)
    for d in range(digits.shape[1]):
        code = _mixed(_mixed(group) + digits[left, d])
        order = np.argsort(code, kind="stable")
        ranked = code[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, bool)
        rank = np.cumsum(new) - 1
        size = np.bincount(rank, minlength=1)
        keep = size[rank] > 1
        left, group = left[order[keep]], rank[keep].astype(np.uint64)
    return np.sort(left)


def _runs(of: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, list[int], list[int]]]:
    """(context, first bytes, end bytes) covered by windows, sorted by context and start."""
    if not len(of):
        return
    fresh = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (start[1:] > start[:-1] + WINDOW)])
    ends = start[np.r_[fresh[1:] - 1, len(of) - 1]] + WINDOW
    cuts = np.flatnonzero(np.r_[True, of[fresh][1:] != of[fresh][:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(fresh)], strict=True):
        yield int(of[fresh[a]]), start[fresh[a:b]].tolist(), ends[a:b].tolist()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by key: the bytes of each that repeated windows cover."""

    def compared(rows: list[tuple]) -> pa.RecordBatch | None:
        keys, cls, rel, contexts = (list(c) for c in zip(*rows, strict=True))
        digits, of, offset, _ = _windows(contexts)
        number = np.unique(np.array(keys, np.int64), return_inverse=True)[1]
        group = number[of] * 2048 + (offset - np.array(rel)[of] + 1024)
        found = repeated_windows(group, digits)
        out = [(keys[c], cls[c], a, b) for c, a, b in _runs(of[found], offset[found])]
        if not out:
            return None
        k, c, a, b = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32()))], ["key", "cls", "first", "last"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("key", "cls", "rel", "bytes")), strict=True):
            if len(held) >= SLICE and row[0] != held[-1][0]:
                if (out := compared(held)) is not None:
                    yield out
                held = []
            held.append(row)
    if held and (out := compared(held)) is not None:
        yield out


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cls, start, digest) of every window of the contexts; the digest also stands for the anchor and the offset to it."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            digits, of, offset, _ = _windows(part.column("bytes").to_pylist())
            code = part.column("key").to_numpy().view(np.uint64)[of] + (offset - part.column("rel").to_numpy()[of]).astype(np.uint64) * _MIX
            for d in range(digits.shape[1]):
                code = _mixed(code + digits[:, d])
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([part.column("key").take(take), part.column("cls").take(take), pa.array(offset.astype(np.int32)), pa.array(code.view(np.int64))], ["key", "cls", "start", "digest"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(did, th, spans array<struct<first, last>>) of documents with repeated windows, from docs (did, th, text)."""
    spark = docs.sparkSession
    with scratch(spark):
        found = materialize(docs.mapInArrow(_scan, _RECORDS), "anchors")
        keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("a"), F.max("cls").alias("b"))
        shared = keys.where("n > 1").select(F.col("key").alias("of_key"), (F.col("a") == F.col("b")).alias("alike"))
        members = found.join(joinable(shared, "shared-keys"), F.col("key") == F.col("of_key")).drop("of_key")
        members = materialize(members, "shared-anchors", keep=True)
    lo, length = F.shiftright("pos", 18), F.col("pos").bitwiseAND(F.lit(511))
    whole = F.struct(lo.alias("first"), (lo + length + WINDOW).alias("last"))

    mixed = members.where("NOT alike")
    classes = mixed.groupBy("key", "cls").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "pos")).alias("rep"))
    classes = materialize(classes, "anchor-classes")
    with scratch(spark):
        wanted = classes.groupBy(F.col("rep.did").alias("w_did"), F.col("rep.th").alias("w_th")).agg(F.collect_list(F.struct("key", "cls", "rep.pos")).alias("wanted"))
        fetched = docs.join(wanted, (F.col("did") == F.col("w_did")) & (F.col("th") == F.col("w_th"))).select("did", "th", "text", "wanted")
        # of rows that repeat in both doc_id and text, each gives the same contexts
        contexts = fetched.select("text", "wanted").mapInArrow(_contexts, _CONTEXTS)
        crowds = classes.groupBy("key").count().where(F.col("count") > CROWD).select(F.col("key").alias("crowded"))
        contexts = materialize(contexts.join(joinable(crowds, "crowded-anchors"), F.col("key") == F.col("crowded"), "left"), "anchor-contexts")
        few = contexts.where("crowded IS NULL").select("key", "cls", "rel", "bytes").dropDuplicates(["key", "cls"])
        spans_of = "key long, cls long, first array<int>, last array<int>"
        by_digits = few.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, spans_of)
        many = contexts.where("crowded IS NOT NULL").select("key", "cls", "rel", "bytes").dropDuplicates(["key", "cls"]).mapInArrow(_window_digests, "key long, cls long, start int, digest long")
        again = many.groupBy("key", "digest").count().where("count > 1").select(F.col("key").alias("of_key"), F.col("digest").alias("again"))
        repeated = many.join(joinable(again, "repeated-windows"), (F.col("key") == F.col("of_key")) & (F.col("digest") == F.col("again")), "left_semi")
        starts = repeated.groupBy("key", "cls").agg(F.collect_set("start").alias("first"))  # 360 numbers at most
        by_counts = starts.select("key", "cls", "first", F.transform("first", lambda s: s + WINDOW).alias("last"))
        covered = materialize(by_digits.union(by_counts), "covered", keep=True)
    covered = covered.select(F.col("key").alias("c_key"), F.col("cls").alias("c_cls"), F.arrays_zip("first", "last").alias("covered"))
    copied = classes.where("n > 1").select(F.col("key").alias("c_key"), F.col("cls").alias("c_cls"))

    same = (F.col("key") == F.col("c_key")) & (F.col("cls") == F.col("c_cls"))
    alike = members.where("alike").select("did", "th", F.array(whole).alias("spans"))
    copies = mixed.join(copied, same, "left_semi").select("did", "th", F.array(whole).alias("spans"))
    shifted = F.transform("covered", lambda c: F.struct((lo + c["first"]).alias("first"), (lo + c["last"]).alias("last")))
    others = mixed.join(covered, same).select("did", "th", shifted.alias("spans"))
    return alike.union(copies).union(others).groupBy("did", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that overlap or touch."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    fresh = np.flatnonzero(np.r_[True, first[1:] > reach[:-1]])
    return first[fresh], reach[np.r_[fresh[1:] - 1, len(first) - 1]]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data = memoryview(text.as_buffer()) if len(text.as_py() if text.as_buffer() is None else text.as_buffer()) else memoryview(b"")
            cut, kept, at, n = [], hashlib.sha256(), 0, len(data)
            if spans.is_valid and len(spans):
                flat = spans.values
                first, last = merged(flat.field(0).to_numpy(), flat.field(1).to_numpy())
                cut = list(zip(first.tolist(), last.tolist(), strict=True))
            for a, b in cut:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            rows.append((n, sum(b - a for a, b in cut), len(cut), kept.hexdigest(), [{"first": a, "last": b} for a, b in cut]))
        n, removed, spans, digest, cuts = zip(*rows, strict=True)
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest), pa.array(cuts, _CUTS)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "cuts"])


_CUTS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, cuts) for each row of docs (doc_id, text); cuts are byte spans, ends exclusive."""
    id_ = F.col("doc_id").cast("long")
    rows = docs.select(id_.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("did"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th"), "text")
    spans = repeated_spans(rows.select("did", "th", "text")).select(F.col("did").alias("s_did"), F.col("th").alias("s_th"), "spans")
    joined = rows.join(spans, (F.col("did") == F.col("s_did")) & (F.col("th") == F.col("s_th")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, cuts array<struct<first:long,last:long>>")


def op5_suffix_radix(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("cuts")
