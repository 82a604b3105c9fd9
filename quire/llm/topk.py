"""Exact top-k inner products by block-at-a-time pruning.

Documents are put in ranges by dominant term and id, and each range is cut into blocks that keep the largest and
smallest value of each term beside a forward index (the rows themselves). A task holds one range and takes the
queries, which lie in files of the shared folder, a chunk at a time: ranges never travel. A query takes a range's
blocks in the order of their summed term maxima, an upper bound of any score in the block, scores each through its
forward index, and stops where the bound falls below its kth score. Ranges share nothing; their k best rows of each
query meet in one last ranking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Saving, Stored, new_path, released

#: Rows in a block of a small range, the most in a range and the most in one that is made smaller for more tasks, and queries in a chunk.
BLOCK, RANGE, SMALL, CHUNK = 128, 1 << 16, 8192, 2048


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows padded with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = column.flatten().to_numpy()
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them all."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _gathered(batches) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rows) of all batches of (id, vector)."""
    ids, rows = [np.empty(0, np.int64)], []
    for batch in batches:
        ids.append(batch.column(0).to_numpy())
        rows.append(_narrow(_matrix(batch.column(1))))
    width = max((r.shape[1] for r in rows), default=0)
    return np.concatenate(ids), np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows]) if rows else np.empty((0, 0), np.int8)


def _blocks(ids: np.ndarray, rows: np.ndarray) -> list:
    """(ids, rows, term maxima, term minima) of each block; a large range has larger blocks."""
    size = max(BLOCK, -(-len(ids) * BLOCK // SMALL))
    cut = range(0, len(ids), size)
    return [(ids[a : a + size], (m := rows[a : a + size]), m.max(0).astype(np.int64), m.min(0).astype(np.int64)) for a in cut]


def _asked(folder: str):
    """A mapper that writes a partition's queries as a chunk: (name, dims, width of a number)."""

    def run(batches):
        ids, rows = _gathered(batches)
        if len(ids):
            saving = Saving(folder, "queries")
            saving.add(ids=ids, rows=rows)
            yield pa.RecordBatch.from_arrays([pa.array([saving.close()]), pa.array([rows.shape[1]], pa.int32()), pa.array([rows.itemsize], pa.int32())], names=["name", "dims", "width"])

    return released(run)


def _largest(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers over the terms both have: by floats where every partial sum is exact, else by Python's integers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = float(_largest(a)) * float(_largest(b)) * max(d, 1)
    if most < 2**53:
        kind = np.float32 if most < 2**24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def search_tile(query_ids: np.ndarray, queries: np.ndarray, blocks: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query index, id, score) of each query's k best rows of the blocks, and how many block scorings that took."""
    n, least = len(query_ids), np.iinfo(np.int64).min
    best_s, best_i = np.full((n, k), least), np.full((n, k), np.iinfo(np.int64).max)
    filled = np.zeros((n, k), bool)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = np.stack([_exact(up, hi[None, :])[:, 0] + _exact(down, lo[None, :])[:, 0] for _, _, hi, lo in blocks], 1)
    order = np.argsort(-bound, axis=1, kind="stable")
    live, scored = np.arange(n), 0
    for r in range(len(blocks)):
        mine = order[live, r]
        # at an equal bound a smaller id may still win
        go = ~filled[live, -1] | (bound[live, mine] >= best_s[live, -1])
        live, mine = live[go], mine[go]
        if not len(live):
            break
        scored += len(live)
        by = np.argsort(mine, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(mine[by])) + 1):
            q, (ids, rows, _, _) = live[own], blocks[mine[own[0]]]
            s = _exact(queries[q], rows)
            valid = ids[None, :] != query_ids[q][:, None]
            useful = (valid & (~filled[q, -1][:, None] | (s >= best_s[q, -1][:, None]))).any(1)
            q, s, valid = q[useful], s[useful], valid[useful]
            if not len(q):
                continue
            all_s, all_i = np.concatenate([best_s[q], s], 1), np.concatenate([best_i[q], np.broadcast_to(ids, s.shape)], 1)
            ok = np.concatenate([filled[q], valid], 1)
            top = np.lexsort((all_i, -np.maximum(all_s, least + 1), ~ok), axis=1)[:, :k]
            best_s[q], best_i[q], filled[q] = (np.take_along_axis(x, top, 1) for x in (all_s, all_i, ok))
    i, j = np.nonzero(filled)
    return i, best_i[i, j], best_s[i, j], scored


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): each query's k rows of highest inner product, ties to the smaller id.

    Vectors are arrays of long; a term that one of two vectors lacks counts 0. A row with a query's id is not its
    candidate. Rows without id or vector, or with a null term, take no part. Of query rows with one id the least
    vector is the query; candidate rows that repeat are candidates each. Empty tables give an empty result. Other
    columns are not read. Scores are exact integers.
    """
    spark = rows.sparkSession
    whole = F.col("_id").isNotNull() & F.col("_v").isNotNull() & F.forall(F.col("_v"), lambda x: x.isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(vector).cast("array<bigint>").alias("_v")).where(whole)
    queries = queries.select(F.col(id_col).cast("long").alias("_id"), F.col(vector).cast("array<bigint>").alias("_v")).where(whole)
    queries = queries.groupBy("_id").agg(F.min("_v").alias("_v"))
    n, n_queries = rows.count(), queries.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-n // RANGE), min(-(-n // SMALL), tasks))
    size = F.transform("_v", lambda x: F.abs(x))
    rows = rows.withColumn("_term", F.array_position(size, F.array_max(size)))
    ranged = rows.repartitionByRange(ranges, "_term", "_id").sortWithinPartitions("_term", "_id").select("_id", "_v")
    folder = new_path(spark, "queries")
    # one row for each chunk of queries
    asked = queries.repartition(max(1, -(-n_queries // CHUNK))).mapInArrow(_asked(folder), "name string, dims int, width int").collect()
    chunks, stored = [tuple(r) for r in asked], Stored(folder)

    def search(batches):
        blocks = _blocks(*_gathered(batches))
        for name, dims, width in chunks if blocks else ():
            ids = stored.array(f"{name}.ids", np.int64)
            asked = stored.array(f"{name}.rows", f"i{width}").reshape(len(ids), dims).astype(np.int64)
            i, found, score, _ = search_tile(ids, asked, blocks, k)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[i], found, score)], names=["query_id", "_id", "score"])

    got = ranged.mapInArrow(released(search), "query_id bigint, _id bigint, score bigint")
    ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("_id").alias(id_col), "score")


def quantised(rows: DataFrame, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id_col, vector) with floor(scale * x) for each component; a vector with a null or non-finite one is null."""
    finite = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    whole = F.transform(F.col(vector), lambda x: F.floor(scale * x.cast("double")).cast("long"))
    return rows.select(id_col, F.when(finite, whole).alias(vector))


def op1(spark, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows.where(F.col("vec_id") % 20 == 0), rows)


ORACLE = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
    from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 20
"""
