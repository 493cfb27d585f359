"""Approximate nearest neighbours by additive quantisation.

Unit vectors are approximated by sums of codewords, one from each of ``books_for`` codebooks over the full dimension. Codebooks
are fitted to a bounded sample, residual by residual with Lloyd steps, and then jointly by least squares, one codebook after the other. Encoding is a beam search over
the codebooks. The norm of each sum is stored beside its codes. A query's products with all codewords make a lookup table; a code's score is the sum of its
entries over the stored norm, and the rows of the best distinct codes, ``rerank_for`` of them as the sample shows, are ranked by cosine on the original vectors. Scores and norms are
doubles, as the cosines in a tight cluster differ by less than a float tells. What the sample shows is then held against the search itself: ``shown`` finds the nearest rows of ``ASKED``
of the actual queries in the whole table by brute force, and where more codes or cells are needed to reach these, more are taken. The number of
codebooks follows the dimension, so that an estimate's error is small beside the gap between the nearest rows and the last ones reranked, which
narrows slowly with the number of rows. Of equal vectors only those ids are indexed that can be among a query's nearest.

Queries and codes meet block by block. From ``QUERY_ROWS`` queries on, both are dealt into coarse cells, the queries of a cell to a block or several, and a
query block is held only against the codes of the cells that its cell probes. How many that are is measured: so many that of the sample's own
nearest neighbours ``PROBE_RECALL`` lie in them. Vectors in clusters need few cells, unit vectors without any structure nearly all. The codes
that a query block is held against stream through its task, which keeps the best so far of each query and nothing else.

Edge cases: vectors that are null, zero, hold a null or non-finite component, or differ in length from the commonest length, and rows
without vec_id, take no part; fewer candidates than asked for are all returned; ties go to the smaller vec_id; of rows that repeat a vec_id
the least vector counts; empty tables give no rows; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.llm.common import materialize

#: Codebooks at least, and the dimensions that each may have to describe.
BOOKS, BOOK_DIMENSIONS = 8, 4
WORDS, BEAM = 256, 4
#: Rows, of least vec_id digest, to which codebooks are fitted.
SAMPLE_ROWS = 16_384
LLOYD_STEPS, JOINT_STEPS, SWEEPS = 8, 1, 8
#: Rows of the best estimates that are ranked by their vectors, at least, and the share of a sample's neighbours that they must hold.
RERANK, RERANK_RECALL = 200, 0.99
#: Queries at most whose nearest rows are found by brute force, to see how many codes and cells it takes to reach them.
ASKED = 256
#: Rows of codes and queries in a block, at most, about; rows of codes for which a task of their own is worth it.
CODE_ROWS, QUERY_ROWS, LEAST_ROWS = 65_536, 2048, 32_768
#: Coarse cells at most, sampled queries by which their probes are measured, and the share of these queries' neighbours that the probes must hold.
CELLS, PROBE_QUERIES, PROBE_RECALL = 256, 1024, 0.995
QUERY_EVERY, NEAREST = 50, 5
_SEED = 7


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) with v as doubles, of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).select("length")
    return rows.join(F.broadcast(lengths), F.size("v") == F.col("length"), "left_semi")  # broadcast: one row


def _units(vectors: np.ndarray, kind: type = np.float32) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(kind)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    half = (book * book).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ book.T - half).argmax(1) for i in range(0, len(x), 4096)])


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norms of the sums). Beam search: each codebook in turn extends the beam best partial sums by every codeword."""
    n, (m, k, d) = len(x), books.shape
    codes, rest = np.zeros((n, 1, 0), np.uint8), x[:, None, :]
    for j in range(m):
        b = rest.shape[1]
        error = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ books[j].T).reshape(n, b, k) + (books[j] ** 2).sum(1)
        flat = error.reshape(n, -1)
        width = min(beam, flat.shape[1])
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        source, word = best // k, best % k
        rest = np.take_along_axis(rest, source[:, :, None], 1) - books[j][word]
        codes = np.concatenate([np.take_along_axis(codes, source[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        if j == m - 1:
            pick = np.take_along_axis(flat, best, 1).argmin(1)
    rows = np.arange(n)
    codes = codes[rows, pick]
    return codes, np.linalg.norm(sum(books[j][codes[:, j]].astype(np.float64) for j in range(m)), axis=1)


def tables(units: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(queries, books, words): the products of queries, as doubles, with all codewords."""
    return np.tensordot(units.astype(np.float64), books.astype(np.float64), ([1], [2]))


def estimates(table: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The scores of codes (books, rows) for one query's table."""
    score = table[0][codes[0]]
    for j in range(1, len(table)):
        score += table[j][codes[j]]
    return score / np.maximum(norms, 1e-9)


def books_for(dimension: int) -> int:
    return max(BOOKS, -(-dimension // BOOK_DIMENSIONS))


def _sums(rows: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(the sum of the rows at each of k places, how many there are)."""
    order, count = np.argsort(at, kind="stable"), np.bincount(at, minlength=k)
    total, filled = np.zeros((k, rows.shape[1])), np.flatnonzero(count)
    if len(filled):
        total[filled] = np.add.reduceat(rows[order], (np.cumsum(count) - count)[filled], axis=0, dtype=np.float64)
    return total, count


def _means(rows: np.ndarray, at: np.ndarray, old: np.ndarray) -> np.ndarray:
    total, count = _sums(rows, at, len(old))
    return np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], old).astype(np.float32)


def refit(x: np.ndarray, books: np.ndarray, codes: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """The codebooks whose sums of codewords come nearest to x for given codes: least squares, one codebook after the other with all others held.

    Each step solves its codebook exactly, so the error never grows, and the sweeps near what all at once would give. What is held is the sample, its residual and the
    codebooks, where the normal equations of all codewords would grow with the square of their number.
    """
    books, ridge = books.copy(), 1e-2
    rest = x - sum(books[j][codes[:, j]] for j in range(len(books)))
    for _ in range(sweeps):
        for j in range(len(books)):
            at = codes[:, j]
            rest += books[j][at]
            total, count = _sums(rest, at, books.shape[1])
            books[j] = (total + ridge * books[j]) / (count + ridge)[:, None]
            rest -= books[j][at]
    return books


def fit(x: np.ndarray, m: int | None = None, k: int = WORDS) -> np.ndarray:
    """Codebooks (m, k, d) for unit vectors x."""
    rng, d = np.random.default_rng(_SEED), x.shape[1]
    m = m or books_for(d)
    books, rest = np.zeros((m, k, d), np.float32), x.copy()
    for j in range(m):
        books[j] = rest[rng.choice(len(rest), k, replace=len(rest) < k)]
        for _ in range(LLOYD_STEPS):
            books[j] = _means(rest, _nearest(rest, books[j]), books[j])
        rest -= books[j][_nearest(rest, books[j])]
    for _ in range(JOINT_STEPS):
        books = refit(x, books, np.concatenate([encode(x[i : i + 2048], books)[0] for i in range(0, len(x), 2048)]))
    return books


def _ranks(x: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray, nearest: int) -> np.ndarray:
    """Of queries among unit vectors x, for each of their nearest others: how many rows are estimated to be as near as it, itself included."""
    out, by_book = [], np.ascontiguousarray(codes.T)
    for q in range(min(len(x), PROBE_QUERIES)):
        exact = x @ x[q]
        estimate = estimates(tables(x[q : q + 1], books)[0], by_book, norms)
        exact[q] = estimate[q] = -np.inf
        found = np.argpartition(-exact, min(nearest, len(x) - 1) - 1)[:nearest]
        out.append((estimate[:, None] >= estimate[found]).sum(0))
    return np.sort(np.concatenate(out))


def rerank_for(x: np.ndarray, books: np.ndarray, rows: int, nearest: int = NEAREST) -> int:
    """How many of the best estimates to rank by their vectors in a table of rows, of which x is a sample: RERANK at least.

    So many as hold RERANK_RECALL of the sample's own neighbours, carried on to the table at the growth that a quarter of the sample and the whole show; no
    less than in proportion to the table's square root, as a sample's growth is known roughly.
    """
    if len(x) < 4 * nearest + 4 or rows <= len(x):
        return RERANK
    codes, norms = (np.concatenate(c) for c in zip(*[encode(x[i : i + 2048], books) for i in range(0, len(x), 2048)], strict=True))
    part = len(x) // 4
    at = lambda ranks: float(ranks[min(len(ranks) - 1, int(RERANK_RECALL * len(ranks)))])
    fewer, all_ = (at(_ranks(x[:n], books, codes[:n], norms[:n], nearest)) for n in (part, len(x)))
    power = min(1.0, max(0.5, np.log(max(all_, 1) / max(fewer, 1)) / np.log(4)))
    return max(RERANK, int(np.ceil(all_ * (rows / len(x)) ** power)))


def coarse_cells(x: np.ndarray, k: int) -> np.ndarray:
    """k centres of unit vectors x, by Lloyd steps."""
    rng = np.random.default_rng(_SEED + 1)
    cells = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(LLOYD_STEPS):
        cells = _means(x, _nearest(x, cells), cells)
    return cells


def _from_each(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, cells) twice: all cells in the order in which each probes them, and the place of each in that order."""
    k = len(cells)
    half = (cells * cells).sum(1) / 2
    order = np.argsort(-(cells @ cells.T - half), axis=1, kind="stable")
    own = np.arange(k)[:, None]
    order = np.concatenate([own, order[order != own].reshape(k, k - 1)], axis=1)  # a cell probes itself first
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(k), order.shape), axis=1)
    return order, place


def _at_share(values: np.ndarray, share: float) -> int:
    """The least of values that so large a share of them does not exceed."""
    return int(np.sort(values, axis=None)[max(0, int(np.ceil(share * values.size)) - 1)])


def probes_for(x: np.ndarray, cells: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """(cells, n): for each cell the n cells that its queries probe, nearest first; n is the least that holds PROBE_RECALL of the sample's neighbours."""
    order, place = _from_each(cells)
    at, asked = _nearest(x, cells), np.arange(min(len(x), PROBE_QUERIES))
    likeness = x[asked] @ x.T
    likeness[asked, asked] = -np.inf
    found = np.argpartition(-likeness, min(nearest, len(x) - 1) - 1, axis=1)[:, :nearest] if len(x) > 1 else np.zeros((0, 1), int)
    needed = place[at[asked][: len(found), None], at[found]] if len(found) else np.zeros(1, int)
    return order[:, : _at_share(needed, PROBE_RECALL) + 1]


def _encoder(books: np.ndarray, cells: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                units = _units(np.stack(part["v"].to_numpy()))
                codes, norms = encode(units, books)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "code": [c.tobytes() for c in codes], "norm": norms, "cell": _nearest(units, cells)})

    return run


def _cell_of(cells: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=_nearest(_units(np.stack(b["v"].to_numpy())), cells))

    return run


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest scores, and of all equal to the least of these."""
    if len(score) <= n:
        return np.arange(len(score))
    return np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])


class _Asked:
    """The queries of a block and the rows of the best distinct codes so far of each."""

    def __init__(self, ids: list[int], vectors: list[list[float]], books: np.ndarray, rerank: int):
        self.ids, self.books, self.rerank = ids, books, rerank
        self.units = _units(np.array(vectors, np.float64), np.float64)
        self.found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]

    def meet(self, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> None:
        _, first, code_of = np.unique(codes.view(f"V{codes.shape[1]}").ravel(), return_index=True, return_inverse=True)
        by_code = np.argsort(code_of, kind="stable")
        n_rows = np.bincount(code_of)
        starts = np.cumsum(n_rows) - n_rows
        codes, norms = np.ascontiguousarray(codes[first].T), norms[first]
        for lo in range(0, len(self.ids), 256):
            for i, table in enumerate(tables(self.units[lo : lo + 256], self.books), lo):
                score = estimates(table, codes, norms)
                best = _best(score, self.rerank + 1)  # one may be the query's own
                n = n_rows[best]
                at = by_code[np.repeat(starts[best] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                v = np.concatenate([self.found[i][0], ids[at]])
                s = np.concatenate([self.found[i][1], np.repeat(score[best], n)])
                distinct = np.unique(s)
                keep = (v != self.ids[i]) & (s >= distinct[max(0, len(distinct) - self.rerank - 1)])
                self.found[i] = (v[keep], s[keep])

    def candidates(self) -> pa.RecordBatch:
        q = np.repeat(np.array(self.ids, np.int64), [len(v) for v, _ in self.found])
        v, s = (np.concatenate(c) for c in zip(*self.found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "estimate"])


def _scan(books: np.ndarray, rerank: int):
    """Rows sorted by task: one with the queries of a block, then the blocks of codes that they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asked = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["task"] != task:
                    if asked:
                        yield asked.candidates()
                    task, asked = row["task"], None
                if row["vs"] is not None:
                    asked = _Asked(row["ids"], row["vs"], books, rerank)
                elif asked:
                    codes = np.frombuffer(b"".join(row["codes"]), np.uint8).reshape(len(row["ids"]), -1)
                    asked.meet(np.array(row["ids"], np.int64), codes, np.array(row["norms"], np.float64))
        if asked:
            yield asked.candidates()

    return run


def _blocks(df: DataFrame, rows: int, *columns: str) -> tuple[DataFrame, dict[int, int]]:
    """(cell, block, ids, columns...): the rows of each cell dealt by digest into blocks of about that many, and the number of blocks of each cell."""
    counts = {r["cell"]: -(-r["count"] // rows) for r in df.groupBy("cell").count().collect()}  # a row a cell
    per_cell = F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("cell"))
    block = F.pmod(F.xxhash64(F.lit(_SEED), "vec_id"), per_cell).cast("int")
    packed = df.groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct("vec_id", *columns)).alias("rows"))
    return packed.select("cell", "block", F.col("rows.vec_id").alias("ids"), *[F.col(f"rows.{c}").alias(c) for c in columns]), counts


def index(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, n_cells: int = 1, nearest: int = NEAREST) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, DataFrame]:
    """The codebooks, the cells, the cells that each probes, how many estimates to rank, and (vec_id, code, norm, cell) of each of rows (vec_id, v)."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()  # at most sample_rows vectors
    if sample.empty:
        return np.zeros((0, 0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros((0, 0), int), 0, rows.select("vec_id", F.lit(b"").alias("code"), F.lit(0.0).alias("norm"), F.lit(0).alias("cell"))
    units = _units(np.stack(sample["v"].to_numpy()))
    books, cells = fit(units), coarse_cells(units, n_cells)
    codes = rows.mapInPandas(_encoder(books, cells), "vec_id long, code binary, norm double, cell int")
    codes = materialize(codes, "aq-codes")
    return books, cells, probes_for(units, cells), rerank_for(units, books, codes.count(), nearest), codes


def _nearest_of(asked: np.ndarray, ids: np.ndarray, nearest: int):
    """(place, vec_id, score) of the rows of each batch that are nearest to each of asked, unit vectors with these ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 8192):
                part = b.iloc[at : at + 8192]
                own = part["vec_id"].to_numpy()
                likeness = asked @ _units(np.stack(part["v"].to_numpy()), np.float64).T
                likeness[ids[:, None] == own] = -np.inf
                n = min(nearest, len(part))
                best = np.argpartition(-likeness, n - 1, axis=1)[:, :n]
                score = np.take_along_axis(likeness, best, 1).ravel()
                yield pd.DataFrame({"place": np.repeat(np.arange(len(asked), dtype=np.int32), n), "vec_id": own[best].ravel(), "score": score})[np.isfinite(score)]

    return run


def _as_near(units: np.ndarray, books: np.ndarray, least: np.ndarray):
    """One row a task, what (asked, nearest) least estimates its distinct codes reach: how many of them, row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, by_query = np.zeros(least.shape, np.int64), tables(units, books)
        for b in batches:
            if len(b):
                codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
                _, first = np.unique(codes.view(f"V{codes.shape[1]}").ravel(), return_index=True)
                codes, norms = np.ascontiguousarray(codes[first].T), b["norm"].to_numpy()[first]
                for q, table in enumerate(by_query):
                    score = np.sort(estimates(table, codes, norms))
                    counts[q] += len(score) - np.searchsorted(score, least[q])
        yield pd.DataFrame({"nth": np.arange(counts.size), "n": counts.ravel()})

    return run


def shown(queries: DataFrame, rows: DataFrame, codes: DataFrame, books: np.ndarray, cells: np.ndarray, nearest: int = NEAREST) -> tuple[int, int]:
    """(codes to rank, cells to probe) that hold RERANK_RECALL and PROBE_RECALL of the nearest rows of ASKED queries, found in the whole table by brute force."""
    asked = queries.orderBy(F.xxhash64(F.lit(_SEED + 2), "vec_id"), "vec_id").limit(ASKED).select("vec_id", "v").collect()  # at most ASKED vectors
    units = _units(np.array([r.v for r in asked], np.float64), np.float64)
    met = rows.select("vec_id", "v").mapInPandas(_nearest_of(units, np.array([r.vec_id for r in asked], np.int64), nearest), "place int, vec_id long, score double")
    found = met.withColumn("nth", F.row_number().over(_by("place", F.desc("score"), "vec_id"))).where(F.col("nth") <= nearest)
    found = codes.join(F.broadcast(found), "vec_id").select("place", "nth", "code", "norm", "cell").collect()  # broadcast and told: `nearest` rows of ASKED queries
    if not found:
        return 0, 1
    at, (_, place) = _nearest(units.astype(np.float32), cells), _from_each(cells)
    probes = np.array([place[at[r.place], r.cell] for r in found]) + 1
    by_query, least = tables(units, books), np.full((len(asked), nearest), np.inf)
    for r in found:
        least[r.place, r.nth - 1] = estimates(by_query[r.place], np.frombuffer(r.code, np.uint8)[:, None], np.array([r.norm]))[0]
    reached = codes.select("code", "norm").mapInPandas(_as_near(units, books, least), "nth long, n long").groupBy("nth").agg(F.sum("n").alias("n")).collect()
    needed = np.zeros(least.size, np.int64)
    needed[[r.nth for r in reached]] = [r.n for r in reached]
    return _at_share(needed[np.isfinite(least.ravel())], RERANK_RECALL), _at_share(probes, PROBE_RECALL)


def _dot(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(queries: DataFrame, rows: DataFrame, nearest: int = NEAREST, rerank: int | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of queries, the nearest other rows; both tables have (vec_id, v). rerank: as measured if not given."""
    spark = rows.sparkSession
    # ties go to the smaller id: behind `nearest` others and the query itself, a copy of theirs never comes in; of each vector, every task sends so many rows only
    nth = F.row_number().over(_by("v", "vec_id"))
    rows = materialize(rows.withColumn("nth", nth).where(F.col("nth") <= nearest + 1).select("vec_id", "v", F.sqrt(_dot("v", "v")).alias("length")), "unlike-vectors")
    asking = queries.count()
    books, cells, probes, measured, codes = index(rows, sample_rows, min(CELLS, max(1, -(-asking // QUERY_ROWS))), nearest)
    if not len(books) or not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not rerank or len(cells) > 1:
        to_rank, to_probe = shown(queries, rows, codes, books, cells, nearest)
        rerank, probes = rerank or max(measured, to_rank), _from_each(cells)[0][:, : max(probes.shape[1], to_probe)]
    placed = queries.select("vec_id", "v").mapInPandas(_cell_of(cells), "vec_id long, v array<double>, cell int")
    query_blocks, asked = _blocks(materialize(placed, "placed-queries"), QUERY_ROWS, "v")
    groups = sum(asked.values())
    stripes = max(1, min(-(-2 * spark.sparkContext.defaultParallelism // groups), codes.count() // LEAST_ROWS))
    code_rows = max(LEAST_ROWS, min(CODE_ROWS, codes.count() // stripes))
    code_blocks, _ = _blocks(codes, code_rows, "code", "norm")
    pairs = [(c, q, asked[q]) for q in asked for c in probes[q].tolist()]  # at most CELLS ** 2
    meets = F.broadcast(spark.createDataFrame(pairs, "of_cell int, to_cell int, n int"))
    stripe = F.pmod(F.xxhash64(F.lit(_SEED + 1), "cell", "block"), F.lit(stripes)).cast("string")
    told = code_blocks.join(meets, F.col("cell") == F.col("of_cell")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("to_block"))
    of_codes = told.select(F.concat_ws("-", "to_cell", "to_block").alias("to"), stripe.alias("stripe"), "ids", F.col("code").alias("codes"), F.col("norm").alias("norms"), F.lit(None).cast("array<array<double>>").alias("vs"))
    every = F.explode(F.array(*[F.lit(str(s)) for s in range(stripes)])).alias("stripe")
    of_queries = query_blocks.select(F.concat_ws("-", "cell", "block").alias("to"), every, "ids", F.lit(None).cast("array<binary>").alias("codes"), F.lit(None).cast("array<double>").alias("norms"), F.col("v").alias("vs"))
    met = of_queries.union(of_codes).withColumn("task", F.concat_ws("/", "to", "stripe"))
    met = met.repartition("task").sortWithinPartitions("task", F.col("vs").isNull())
    candidates = met.select("task", "ids", "codes", "norms", "vs").mapInArrow(_scan(books, rerank), "query_id long, vec_id long, estimate double")
    place = F.dense_rank().over(_by("query_id", F.desc("estimate")))
    short = candidates.withColumn("place", place).where(F.col("place") <= rerank).select("query_id", "vec_id")
    asked_for = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.sqrt(_dot("v", "v")).alias("query_length"))
    exact = short.join(asked_for, "query_id").join(rows.select("vec_id", "v", "length"), "vec_id")
    scored = exact.select("query_id", "vec_id", (_dot("q", "v") / (F.col("query_length") * F.col("length"))).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(_by("query_id", F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def _by(key: str, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def op2_additive_quantisation(embeddings: DataFrame) -> DataFrame:
    rows = materialize(usable(embeddings), "vectors")
    return search(rows.where(F.col("vec_id") % QUERY_EVERY == 0), rows)
