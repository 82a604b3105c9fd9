"""Quality by logistic regression over hashed word n-grams, learned with follow-the-regularised-leader updates.

Words are runs of letters and digits and runs of other signs, A-Z as a-z; a word that repeats the one before it counts
as a repeat mark. Features, hashed to 20 bits: words, pairs and triples of words. A feature's value is its share of
the document's n-grams, so the score is the mean of the weights met: a sparse dot product in one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from . import text as tx
from .shared import crc_mod, release

#: Most labelled rows to learn from; a bound for any corpus.
TRAIN_ROWS = 8_192
BITS, EPOCHS, SCALE = 20, 3, 16.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.2, 0.2
THRESHOLD = 0.3
#: The hash of the repeat mark.
AGAIN = np.uint64(0xA24BAED4963EE407)


def _ngrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): three ids for each word, of the n-grams that end with it."""
    starts, ends, first = tx.tokens(data, offs, "both")
    if not len(starts):
        return np.empty(0, np.int64), first
    h = tx.hashes(data, starts, ends)
    own = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))  # place in its document
    again = np.append(False, h[1:] == h[:-1]) & (own > 0)
    h[again] = AGAIN
    back = lambda k: np.where(own >= k, np.append(np.zeros(k, np.uint64), h[:-k])[: len(h)], np.uint64(0))
    two = h * np.uint64(3) + back(1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    three = h * np.uint64(5) + back(1) * np.uint64(0xC2B2AE3D27D4EB4F) + back(2) * np.uint64(0x165667B19E3779F9) + np.uint64(2)
    ids = np.stack([(tx.mix(g) >> np.uint64(64 - BITS)).astype(np.int64) for g in (h, two, three)], 1).ravel()
    return ids, first * 3


def featurise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offs = tx.column_bytes(texts)
    ids, first = _ngrams(data, offs)
    pairs, counts = np.unique((tx.doc_index(first).astype(np.int64) << BITS) | ids, return_counts=True)
    cut = np.searchsorted(pairs >> BITS, np.arange(len(first)))
    return pairs & ((1 << BITS) - 1), counts, cut


class Model:
    """Bias and the weights of all hashed n-grams."""

    def __init__(self, bias: float, weights: np.ndarray):
        self.bias, self.weights = bias, weights

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """A score from 0 to 1 for each text; null and empty ones have that of no n-gram."""

        def one(data, offs):
            ids, first = _ngrams(data, offs)
            sums = tx.per_doc(self.weights[ids].astype(np.float64), first)
            return labelled.sigmoid(self.bias + SCALE * sums / np.maximum(np.diff(first), 1))

        return labelled.over_blocks(texts, one)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """FTRL-proximal, one row at a time. Without rows of both labels the score is the labels' mean (0 without rows)."""
    y = np.array([r[0] > 0 for r in rows], float)
    weights = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(35.0 if len(y) and y[0] else -35.0, weights)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    rng = np.random.default_rng(0)

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)).tolist():
            _, ids, counts = rows[k]
            x = SCALE * counts / max(1, counts.sum(dtype=np.int64))
            w = weight(z[ids], n[ids])
            bias = -bias_z / ((BETA + bias_n**0.5) / ALPHA)
            err = float(labelled.sigmoid(np.array(bias + w @ x))) - y[k]
            g = err * x
            grown = n[ids] + g * g
            z[ids] += g - (np.sqrt(grown) - np.sqrt(n[ids])) / ALPHA * w
            n[ids] = grown
            bias_z += err - ((bias_n + err * err) ** 0.5 - bias_n**0.5) / ALPHA * bias
            bias_n += err * err
    return Model(-bias_z / ((BETA + bias_n**0.5) / ALPHA), weight(z, n).astype(np.float32))


def learn(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = (5, 0), rows: int = TRAIN_ROWS, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The model from a bounded sample of labelled documents; those in the fold (n, k) are not seen."""
    try:
        return fit(labelled.sample(docs, labels, label, featurise, fold, rows, id_col, text))
    finally:
        release()


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, score) for every document, a map. Null and empty texts are scored too; other columns are not read."""
    return labelled.scored(docs, model, id_col, text)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
