"""A bounded sample of labelled documents as hashed features, and the scoring pass; shared by the two classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import TEXT_ROWS, arrow_rows, batches_of, crc_mod, keep_rows, released

#: texts -> (ids, counts, first): hashed features of each text with first as offsets, ids distinct in each text.
Featurise = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def sample(docs: DataFrame, labels: DataFrame, label: str, featurise: Featurise, fold: tuple[int, int] | None, rows: int, id_col: str = "doc_id", text: str = "text") -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, ids, counts) of up to ``rows`` labelled documents, in id order: those with the least hash of their id.

    Rows without id or label are left out; an id labelled more than once has its largest label. fold (n, k) leaves
    out ids whose crc32 as text is k mod n. A document that is there more than once counts once.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label is not null")
    own = own.groupBy("_id").agg(F.max("_label").alias("_label"))
    if fold:
        own = own.where(crc_mod("_id", fold[0]) != fold[1])
    # labels of other documents do not use up the bound
    own = own.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi")
    # at most ``rows`` rows: small enough for every executor
    own = own.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    joined = docs.select(F.col(id_col).alias("_did"), F.col(text).alias("_text")).join(F.broadcast(own), F.col("_did") == F.col("_id")).select("_id", "_label", "_text")

    def run(batches):
        for batch in batches:
            ids, counts, first = featurise(batch.column(2))
            cut = first.tolist()
            raw = [[narrow(x[a:b]).tobytes() for a, b in zip(cut, cut[1:])] for x, narrow in ((ids, _ids), (counts, _counts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(r, pa.binary()) for r in raw)], names=["_id", "_label", "ids", "counts"])

    kind = joined.schema["_id"].dataType.simpleString()
    got = joined.mapInArrow(released(run), f"_id {kind}, _label int, ids binary, counts binary").groupBy("_id").agg(F.min(F.struct("_label", "ids", "counts")).alias("r"))
    with batches_of(docs.sparkSession, TEXT_ROWS):
        found = sorted(((i, r) for i, r in got.collect()), key=lambda x: x[0])
    return [(int(r["_label"]), (ids := np.frombuffer(r["ids"], "<u4")), np.frombuffer(r["counts"], f"<u{len(r['counts']) // max(1, len(ids))}" if len(ids) else "u1")) for _, r in found]


def _ids(x: np.ndarray) -> np.ndarray:
    return x.astype("<u4")


def _counts(x: np.ndarray) -> np.ndarray:
    """In the smallest width that holds them all."""
    most = x.max(initial=0)
    return x.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, score): one row per document; an id column named score is score_in."""
    return arrow_rows(docs, lambda texts: [pa.array(score(texts), pa.float64())], "score double", id_col, text)


def kept(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], text: str = "text") -> DataFrame:
    """docs, all columns, where keep is true."""
    return keep_rows(docs, keep, text)


def over_blocks(texts: pa.Array, one: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """one(bytes, offsets) over blocks of texts, joined."""
    data, offs = tx.column_bytes(texts)
    parts = [one(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in tx.blocks(offs)]
    return np.concatenate(parts) if parts else np.empty(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
