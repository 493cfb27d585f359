"""Token ids in ORC: one row per document, ids in ascending doc_id order over the files of a folder.

Integers go through ORC's run-length encoding, rows are indexed by stride, and a Bloom filter on doc_id stands beside the index, so a reader
takes stripes in parallel and skips those whose bounds or filter rule a document out.

Every text is encoded with the tokenizers library. A byte-level BPE vocabulary splits a text before every blank and about every line end between
non-blanks, and between a word and the marks after it. So texts are cut there, some megabytes at a time, each distinct piece of them is encoded once
and remembered, and a text's ids are its pieces' ids in order. A text with a special token, or in which white space stands beside white space, is
encoded in one call instead.

Edge cases: null text is empty and holds the end id only; rows without doc_id come first; rows that repeat a doc_id stand next to each
other, shortest first, each with its own start, over several files if they are many; an empty table gives empty files; columns other than doc_id and text are not written.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlake.llm.common import fresh_path, materialize, remove_at_exit

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Documents in a file, about; files at most, so that the order over files stays a small table; pieces that a worker remembers; bytes of text cut up at a time.
FILE_ROWS, MAX_FILES = 8192, 65_536
REMEMBERED, CUT_BYTES = 400_000, 4 << 20
SCHEMA = "doc_id bigint, n_tokens int, ids array<int>"

#: White space other than blanks and line ends, and a text with white space beside white space, a blank at an end, or a rare space in front.
_RARE_SPACES = r"\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_AWKWARD = rf"^[ {_RARE_SPACES}]| $|[ \n{_RARE_SPACES}]{{2}}"
#: Marks that, one or several, are a piece of their own to the vocabulary at a piece's end after a letter or digit.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKED = rf"[\pL\pN][{re.escape(_MARKS)}]+$"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others, in order, from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """A byte-level BPE tokenizer that remembers the ids of pieces between blanks, as little-endian 32-bit integers.

    A piece stands for itself after a blank, or, if it begins with a line end, at the start of a line. Marks at its end are remembered on their own.
    Pieces are remembered in two generations: when the younger is full the older goes, and what is met again is young again.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core of its own
        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        form = json.loads(self.tokenizer.to_str())
        kind = form["pre_tokenizer"] or {}
        if form["normalizer"] or form["post_processor"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        self.spelt = Tokenizer(self.tokenizer.model)  # of words spelt in byte letters, between blanks
        self.spelt.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = _byte_letters()
        self.blank, self.line_end = letters[32], letters[10]
        self.spelling = letters | {32: " "}
        self.awkward = "|".join([_AWKWARD, *(re.escape(t["content"]) for t in form["added_tokens"])])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        known = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(known.values()) + 1, bool)  # by id: whether a blank or line end begins it
        self.begins[[i for t, i in known.items() if t[0] == self.blank or t == self.line_end]] = True
        self.marks: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str], before: str) -> list[bytes]:
        """The ids of each of words, which are one to the vocabulary, and of before, in byte letters, ahead of it: straight to the library's merges, some at a time."""
        found: list[bytes] = []
        for at in range(0, len(words), 1000):
            text = " ".join(words[at : at + 1000])
            spelt = text if text.isascii() else text.encode().decode("latin-1").translate(self.spelling)
            encoding = self.spelt.encode_batch_fast([before + spelt.replace(" ", " " + before)], add_special_tokens=False)[0]
            ids = np.array(encoding.ids, "<u4")
            starts = (4 * np.flatnonzero(self.begins[ids])).tolist()
            joined = ids.tobytes()
            found += [joined[a:b] for a, b in zip(starts, [*starts[1:], len(joined)], strict=True)]
        return found

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of pieces, which the young generation then holds."""
        young, old = self.young, self.old
        ascii_words, words, line_words = [], [], []
        for piece in pieces:
            if piece in young:
                continue
            ids = old.get(piece)
            if ids is not None:
                young[piece] = ids
            elif piece.isalpha():
                (ascii_words if piece.isascii() else words).append(piece)
            elif piece[:1] != "\n":
                young[piece] = self._whole(" " + piece) if piece else b""
            elif piece[1:].isalpha():
                line_words.append(piece[1:])
            else:
                young[piece] = self._whole(piece)
        for some in (ascii_words, words):
            young.update(zip(some, self._words(some, self.blank), strict=True))
        young.update(zip(["\n" + w for w in line_words], self._words(line_words, self.line_end + " "), strict=True))
        return list(map(young.__getitem__, pieces))

    def _after_word(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            if len(self.marks) > 10_000:
                self.marks.clear()
            ids = self.marks[marks] = self._whole(marks)
        return ids

    def _ids_of(self, pieces: pa.Array) -> pa.Array:
        """The ids of each of pieces, distinct ones, as binary values."""
        marked = pc.match_substring_regex(pieces, _MARKED)
        bare = pc.if_else(marked, pc.ascii_rtrim(pieces, _MARKS), pieces).dictionary_encode()
        ids = pa.array(self._pieces(_strings(bare.dictionary)), pa.binary()).take(bare.indices)
        marks = pc.replace_substring_regex(pieces.filter(marked), r"(?s)^.*[\pL\pN]", "").dictionary_encode()
        after = pa.array([self._after_word(m) for m in _strings(marks.dictionary)], pa.binary()).take(marks.indices)
        return pc.replace_with_mask(ids, marked, pc.binary_join_element_wise(ids.filter(marked), after, b""))

    def rest(self) -> None:
        """Lets go of the older generation, between tasks."""
        self.old = {}

    def encode(self, text: str) -> bytes:
        """The ids of text."""
        return self.encode_all(pa.array([text]), 0).flatten().to_numpy()[:-1].tobytes()

    def encode_all(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """The ids of each text, then end_id.

        A line end is put before every text, so that its first piece is one at the start of a line. Its own id is then dropped, by moving ids
        one place down, with end_id in the places of the line ends.
        """
        awkward = pc.match_substring_regex(texts, self.awkward)
        some_awkward = pc.any(awkward).as_py()
        plain = pc.if_else(awkward, pa.scalar("", texts.type), texts) if some_awkward else texts
        pieces = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n", texts.type), plain, pa.scalar("", texts.type)), "\n", " \n"), " ")
        at_piece, coded = pieces.offsets.to_numpy(), pieces.flatten().dictionary_encode()
        del plain, pieces  # as large as the texts
        if len(self.young) > self.remembered:
            self.young, self.old = {}, self.young
        ids = self._ids_of(coded.dictionary).take(coded.indices)
        starts = np.frombuffer(ids.buffers()[1], np.int32)[at_piece] // 4
        moved = np.append(np.frombuffer(ids.buffers()[2], "<i4", starts[-1])[1:], np.int32(end_id))
        moved[starts[1:] - 1] = end_id
        del ids, coded
        lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(moved))
        if not some_awkward:
            return lists
        at = np.flatnonzero(awkward.to_numpy(zero_copy_only=False))
        whole = [np.append(np.frombuffer(self._whole(t), "<i4"), np.int32(end_id)) for t in texts.take(pa.array(at)).to_pylist()]
        order = np.arange(len(texts))
        order[at] = len(texts) + np.arange(len(at))
        return pa.concat_arrays([lists, pa.array(whole, lists.type)]).take(pa.array(order))


def _strings(found: pa.Array) -> list[str]:
    return found.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for whole in batches:
            sizes = pc.binary_length(whole.column("text")).to_numpy()
            if not len(sizes):
                continue
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // CUT_BYTES)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows], strict=True):
                batch = whole.slice(a, b - a)
                ids = encoder.encode_all(batch.column("text"), end_id)
                coded = pa.RecordBatch.from_arrays([batch.column("doc_id"), ids.value_lengths(), ids], ["doc_id", "n_tokens", "ids"])
                for at in range(0, coded.num_rows, 256):  # the executor holds each batch as a whole
                    yield coded.slice(at, 256)
                del ids, coded
        encoder.rest()  # the worker lives on, perhaps for other work
        pa.default_memory_pool().release_unused()

    return encode


def write_token_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, files: int | None = None, stripe_bytes: int = 8 << 20) -> None:
    """Writes the ids of docs (doc_id, text) as ORC files under path, whose name order is doc_id order.

    The range partitioner samples doc_ids and, to spread unlike texts of one doc_id, lengths and digests; texts cross the network once and are
    encoded where they are written.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if files is None:
        files = max(docs.sparkSession.sparkContext.defaultParallelism, min(MAX_FILES, docs.count() // FILE_ROWS))
    order = [F.col("doc_id"), F.octet_length("text"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    encoded = ranged.mapInArrow(_encode(vocabulary or vocabulary_path(), end_id), SCHEMA)
    options = {"compression": "lz4", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    encoded.write.options(**options).orc(path)


def read_token_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) from the files, stripe by stripe; with doc_ids, stripes that can't hold them are skipped."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        n = pa.array(np.diff(at).astype(np.int64))
        names = ["doc_id", "n_tokens", "ids_crc32", "file", "block", "row"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(sums, pa.int64()), batch.column("file"), batch.column("block"), batch.column("row")], names)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files: ids before it, its ids, and the crc32 of those.

    Lengths add up within a file in row order, and over the files in name order, of which there are few.
    """
    rows = read_token_ids(spark, path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    known = rows.mapInArrow(_digest, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file string, block bigint, row bigint")
    known = materialize(known, "token-digests")  # else the ids would be read once for the totals and once for the places
    totals = known.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("file").alias("of_file"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("file").orderBy("doc_id", "block", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("in_file", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    joined = placed.join(offsets, placed["file"] == offsets["of_file"])
    return joined.select("doc_id", (F.col("in_file") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_orc(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = fresh_path(spark, "token-ids")
    write_token_ids(docs, path)
    remove_at_exit(spark, path)
    return digests(spark, path)
