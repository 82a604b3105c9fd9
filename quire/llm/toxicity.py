"""Toxicity by a factorization machine over hashed words.

A document's features are the hashed words it holds (20 bits, presence). Its score is the logistic of
w0 + sum w_i + (sum over pairs <v_i, v_j>) / number of words: the factors v learn what words mean together, each pair
weighing less the more words stand beside it. Every word has parameters; what tells nothing is held down: weights
by follow-the-regularised-leader with an L1 term, factors by steps that stay small until gradients agree, and factors
that never left their random start are dropped. A quarter of the sample, not seen by first fits, chooses the L1 term and sets
the bias.
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
TRAIN_ROWS = 16_384
BITS, FACTORS, BATCH = 20, 8, 64
#: Passes over the rows, and more of them where they make fewer steps than this.
EPOCHS, UPDATES = 4, 500
#: Weights: step, its damping, and the gradients, as shares of the square root of the rows, of which one is what it takes to leave 0.
ALPHA, BETA, L1 = 0.5, 1.0, (1 / 6, 1 / 2, 3 / 2)
#: Factors: step, spread at the start, and the multiple of it under which they count as unmoved.
STEP, START, MOVED = 0.2, 0.02, 2.0
#: A clean row above the cut counts as so many toxic ones below.
CLEAN_WEIGHT = 3.0
#: Of the sample, one row of so many chooses the L1 term and sets the bias.
INNER = 4
THRESHOLD = 0.3


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = tx.tokens(data, offs, "alnum")
    return (tx.hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64), first


def featurise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offs = tx.column_bytes(texts)
    ids, first = _words(data, offs)
    pairs, counts = np.unique((tx.doc_index(first).astype(np.int64) << BITS) | ids, return_counts=True)
    cut = np.searchsorted(pairs >> BITS, np.arange(len(first)))
    return pairs & ((1 << BITS) - 1), counts, cut


class Machine:
    """A fitted model: ``keys`` (ascending feature ids), bias, weights and factors."""

    def __init__(self, keys: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.keys, self.bias, self.weights, self.factors = keys, bias, weights, factors

    def margin(self, doc: np.ndarray, feature: np.ndarray, size: np.ndarray) -> np.ndarray:
        """doc, feature: distinct pairs; size: the number of words of each document."""
        n = len(size)
        out, both = self.bias + np.bincount(doc, self.weights[feature], n), np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[feature, f]
            both += np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n)
        return out + 0.5 * both / np.maximum(size, 1)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """A score from 0 to 1 for each text; null and empty ones have that of no word."""

        def one(data, offs):
            ids, first = _words(data, offs)
            if not len(self.keys):
                return labelled.sigmoid(np.full(len(offs) - 1, self.bias))
            at = np.minimum(np.searchsorted(self.keys, ids), len(self.keys) - 1)
            known = np.flatnonzero(self.keys[at] == ids)
            doc = np.searchsorted(first, known, "right") - 1
            pairs = np.unique(doc * len(self.keys) + at[known])
            return labelled.sigmoid(self.margin(pairs // len(self.keys), pairs % len(self.keys), np.diff(first)))

        return labelled.over_blocks(texts, one)


class Batch:
    """Some rows: their features in row order and, for gradients, in feature order."""

    def __init__(self, rows: np.ndarray, first: np.ndarray, at: np.ndarray, size: np.ndarray):
        n = first[rows + 1] - first[rows]
        upto = np.cumsum(n) - n
        doc = np.repeat(np.arange(len(rows), dtype=np.uint8 if len(rows) <= 256 else np.int32), n)
        self.feature = at[np.arange(n.sum()) + np.repeat(first[rows] - upto, n)]
        self.rows, self.share = rows, (1 / np.maximum(size[rows], 1)).astype(np.float32)
        self.filled = np.flatnonzero(n)
        self.from_ = upto[self.filled]
        order = np.argsort(self.feature, kind="stable")
        own = self.feature[order]
        self.cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])).astype(np.int32) if len(own) else upto[:0]
        self.touched, self.by_feature = own[self.cut], doc[order]

    def forward(self, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margins, sums of factors of each row)."""
        sums, out = np.zeros((len(self.rows), v.shape[1]), v.dtype), np.full(len(self.rows), bias, v.dtype)
        if len(self.feature):
            own = v[self.feature]
            sums[self.filled] = np.add.reduceat(own, self.from_, axis=0)
            both = (sums[self.filled] ** 2).sum(1) - np.add.reduceat((own * own).sum(1), self.from_)
            out[self.filled] += np.add.reduceat(w[self.feature], self.from_) + 0.5 * self.share[self.filled] * both
        return out, sums

    def gradients(self, err: np.ndarray, sums: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the weights and factors of the touched features, from the loss's slopes by margin."""
        shared = (err * self.share)[self.by_feature]
        gv = np.add.reduceat(shared[:, None] * sums[self.by_feature], self.cut, axis=0)
        return np.add.reduceat(err[self.by_feature], self.cut), gv - np.add.reduceat(shared, self.cut)[:, None] * v[self.touched]


def _fitted(y: np.ndarray, size: np.ndarray, first: np.ndarray, ids: np.ndarray, share: float) -> Machine:
    there = np.zeros(1 << BITS, bool)
    there[ids] = True
    keys, at = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[ids]
    n, m, least = len(y), len(keys), share * len(y) ** 0.5
    rng = np.random.default_rng(0)
    bias, bias_n = float(np.log(y.mean() / (1 - y.mean()))), 0.0
    w, z, w_n = (np.zeros(m, np.float32) for _ in range(3))
    v, v_n = rng.normal(0, START, (m, FACTORS)).astype(np.float32), np.zeros((m, FACTORS), np.float32)
    batches = [Batch(np.sort(own), first, at, size) for own in np.array_split(rng.permutation(n), max(1, n // BATCH))]
    del at, ids
    for _ in range(max(EPOCHS, -(-UPDATES // len(batches)))):
        for k in rng.permutation(len(batches)).tolist():
            b = batches[k]
            margin, sums = b.forward(bias, w, v)
            err = (labelled.sigmoid(margin) - y[b.rows]).astype(np.float32)
            bias_n += float(err.sum()) ** 2
            bias -= ALPHA * float(err.sum()) / (BETA + bias_n**0.5)
            if not len(b.feature):
                continue
            t = b.touched
            g, gv = b.gradients(err, sums, v)
            grown = w_n[t] + g * g
            z[t] += g - (np.sqrt(grown) - np.sqrt(w_n[t])) / ALPHA * w[t]
            w_n[t] = grown
            w[t] = np.where(np.abs(z[t]) <= least, 0, -(z[t] - np.sign(z[t]) * least) * ALPHA / (BETA + np.sqrt(grown)))
            v_n[t] += gv * gv
            v[t] -= STEP * gv / (BETA + np.sqrt(v_n[t]))
    v[np.sqrt((v * v).sum(1)) < MOVED * START * FACTORS**0.5] = 0
    kept = np.flatnonzero((w != 0) | v.any(1))
    return Machine(keys[kept].astype(np.int64), bias, w[kept].astype(np.float64), v[kept].astype(np.float64))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Machine:
    """From (label, ids, counts). Without rows of both labels the score is the labels' mean (0 without rows)."""
    y = np.array([r[0] > 0 for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Machine(np.empty(0, np.int64), 35.0 if len(y) and y[0] else -35.0, np.empty(0), np.empty((0, FACTORS)))
    size = np.array([r[2].sum(dtype=np.int64) for r in rows])

    def some(which: np.ndarray, share: float) -> Machine:
        first = np.append(0, np.cumsum([len(rows[k][1]) for k in which]))
        return _fitted(y[which], size[which], first, np.concatenate([rows[k][1] for k in which]).astype(np.uint32), share)

    every = np.arange(len(y))
    # toxic and clean rows in turn, so that both parts have both where they can
    place = np.empty(len(y), np.int64)
    place[np.argsort(y, kind="stable")] = every
    outer, inner = np.flatnonzero(place % INNER), np.flatnonzero(place % INNER == 0)
    level = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    best = (0.0, L1[-1], level)
    if 0 < y[outer].sum() < len(outer) and 0 < y[inner].sum() < len(inner):
        tried = []
        for share in L1:
            cut, lost = _cut(_margins(some(outer, share), [rows[k][1] for k in inner], size[inner]), y[inner])
            tried.append((lost, share, cut))
        best = min(tried)
    machine = some(every, best[1])
    machine.bias += max(0.0, level - best[2])
    return machine


def _margins(machine: Machine, ids: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    known = [np.flatnonzero(np.isin(machine.keys, i)) for i in ids]
    return machine.margin(np.repeat(np.arange(len(ids)), [len(k) for k in known]), np.concatenate(known), size)


def _cut(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The margin that parts the labels best, and what is on the wrong side of it, a clean row above it counting as ``CLEAN_WEIGHT`` toxic ones below: amid its gap.

    The bias is raised until this scores ``THRESHOLD``: weights of few examples stay small, so single words score low.
    """
    by = np.argsort(margins, kind="stable")
    m, toxic = margins[by], y[by] > 0
    lost = np.append(0, np.cumsum(toxic)) + CLEAN_WEIGHT * np.append(np.cumsum(~toxic[::-1])[::-1], 0)
    gap = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
    open_ = np.concatenate([[True], m[1:] > m[:-1], [True]])
    best = np.flatnonzero(open_ & (lost == lost[open_].min()))
    wide = np.concatenate([[0.0], m[1:] - m[:-1], [0.0]])
    return float(gap[best[np.argmax(wide[best])]]), float(lost[best[0]])


def learn(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = (4, 2), rows: int = TRAIN_ROWS, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """The model from a bounded sample of labelled documents; those in the fold (n, k) are not seen."""
    try:
        return fit(labelled.sample(docs, labels, label, featurise, fold, rows, id_col, text))
    finally:
        release()


def toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, score) for every document, a map. Null and empty texts are scored too; other columns are not read."""
    return labelled.scored(docs, machine, id_col, text)


def reject_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs, all columns, without the documents that score threshold or more."""
    return labelled.kept(docs, lambda texts: machine(texts) < threshold, text)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity(docs, machine)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
