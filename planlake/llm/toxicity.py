"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct indices, of ``BITS`` bits, of a text's words, word pairs and pairs that skip a word. Learning goes over the
training rows one by one: each coordinate has its own rate, falling with its squared gradients, and L1 keeps it at zero until
its evidence exceeds ``L1``. What is left are some thousand weights, which go to the scoring tasks as a broadcast of at most 2**BITS pairs.

The rows learnt from are at most ``MAX_TRAINING_ROWS`` labelled ones, those of least doc_id digest; they
stream through one task in digest order, once for each epoch, and are never all in memory. Every document is scored whole.

Edge cases: null and empty texts score by the bias alone; rows without label only get scores; a document with several labels counts as
toxic if one says so; labels without a document count for nothing; without any training row, every score is 0; other columns
stay as they are, one named toxicity as well.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlake.llm.common import columns_of, spare

BITS = 20
MAX_TRAINING_ROWS = 20_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1.5, 0.5
THRESHOLD = 0.3

_PUNCTUATION = b".,;:!?\"'()[]"
_SHIFT = np.uint64(64 - BITS)
#: Odd multipliers of words, of the second words of pairs and of those of skip-grams.
_WORD, _PAIR, _SKIP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def feature_indices(text: str | None) -> np.ndarray:
    """Indices of all words, pairs and skip-grams, repeats included. Index 0 is left to the bias."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    first = h * _WORD
    mixed = np.concatenate([first, (first[:-1] + h[1:]) * _PAIR, (first[:-2] + h[2:]) * _SKIP])
    index = ((mixed ^ (mixed >> np.uint64(29))) * _WORD) >> _SHIFT
    return np.maximum(index, 1).astype(np.int32)


class Ftrl:
    """FTRL-proximal with per-coordinate rates, L1 and L2."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        strong = np.abs(z) > self.l1
        return np.where(strong, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, label: float) -> None:
        """at: distinct coordinates, each of value 1."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"place": b["place"], "toxic": b["toxic"], "features": [np.unique(np.append(feature_indices(t), 0)) for t in b["text"]]})


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    model = Ftrl(1 << BITS)
    for b in batches:
        for at, y in zip(b["features"], b["toxic"], strict=True):
            model.learn(at, float(y))
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    yield pd.DataFrame({"feature": at, "weight": w[at]})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """The features of nonzero weight and their weights, learnt from rows of labels (doc_id, toxic) that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("labelled")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    place = F.xxhash64("labelled")
    sample = known.select("labelled", "toxic", place.alias("place")).orderBy("place", "labelled").limit(max_rows)
    # broadcast: at most max_rows rows of 20 bytes
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"))
    features = rows.select("place", "toxic", "text").mapInPandas(_features, "place long, toxic int, features array<int>")
    passes = features.select("*", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    in_order = passes.repartition(1).sortWithinPartitions("epoch", "place", "features").select("toxic", "features")
    found = in_order.mapInPandas(_train, "feature int, weight double").toPandas()
    return found["feature"].to_numpy(np.int32), found["weight"].to_numpy(np.float64)


def scores(text: Column, model: tuple[np.ndarray, np.ndarray]) -> Column:
    """The probability that a text is toxic. A text's sum is taken over its distinct features of nonzero weight."""
    features, weights = model

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros(1 << BITS)
        dense[features] = weights
        bias = dense[0]
        for texts in batches:
            out = np.zeros(len(texts))
            if len(features):
                for i, t in enumerate(texts):
                    at = feature_indices(t)
                    out[i] = 1 / (1 + np.exp(-(bias + dense[np.unique(at[dense[at] != 0])].sum())))
            yield pd.Series(out)

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, name: str = "toxicity", **options) -> DataFrame:
    """docs with one more column, named name, or with underscores before that if docs has such a column."""
    return docs.select(*columns_of(docs), scores(F.col("text"), train(docs, labels, **options)).alias(spare(docs, name)))


def op6_toxicity_ftrl(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold."""
    return docs.where(scores(F.col("text"), train(docs, labels)) < threshold)
