"""Near-duplicates by BagMinHash signatures, banding and exact multiset overlap.

A text is the multiset of its shingles of five words (digits, letters, non-ASCII; A-Z as a-z; a shorter text is one
shingle). BagMinHash: a shingle met c times runs Poisson processes over the weight levels [0,1), [1,2), [2,4), [4,8)...
up to c, each as wide as its rate; every point falls on a register and a level, and counts if its level is below
c. A register keeps its earliest point, so two texts agree in a register with the chance of their weighted Jaccard
similarity. Points are drawn in time order only up to the time by which all registers are full.

Texts that share a band of registers are candidates. Exact copies are one node. In a bucket every node is compared with
three of it; components are formed; then only nodes of one bucket that are still in different components are
compared, in tiles of bounded size. So large groups never make all their pairs, and no pair in a shared bucket that
could join two components goes untested: a pair is ruled out only by an upper bound of its overlap, which is exact: of
2,048 bins of shingles, those of different parity are counted. All others are verified on their shingle multisets. A
pair at the threshold misses all 32 bands with a chance of 5e-8, and nothing else loses it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import released, written

SHINGLE, SIMILAR = 5, 0.8
REGISTERS, BAND = 128, 4
#: Nodes on one side of a tile, about, and bins of the parities that bound an overlap from above.
TILE, BINS = 4096, 2048
#: Text bytes and texts that are hashed at a time.
BLOCK, ROWS = 2 << 20, 1024
_U = np.uint64
_FACTORS = tx.mix(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | _U(1)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): all shingles of each text in order, and n+1 offsets."""
    starts, ends, first = tx.tokens(data, offs, "alnum")
    h = tx.hashes(data, starts, ends)
    n = np.diff(first)
    own = np.arange(len(h)) - np.repeat(first[:-1], n)
    size = np.repeat(n, n)
    at = np.flatnonzero((own <= size - SHINGLE) | (own == 0))
    out = np.minimum(size[at], SHINGLE).astype(np.uint64)
    h = np.append(h, np.zeros(SHINGLE, np.uint64))
    for k in range(SHINGLE):
        out += np.where(size[at] > k, h[at + k] * _FACTORS[k], _U(0))
    return tx.mix(out), np.append(0, np.cumsum(np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))))


def signatures(sh: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, REGISTERS) of 32-bit values; rows of texts without shingles are 0."""
    docs = len(first) - 1
    n = np.diff(first)
    key = np.sort((tx.doc_index(first).astype(np.uint64) << _U(44)) | (sh >> _U(20)))
    key, count = np.unique(key, return_counts=True)
    doc, element = (key >> _U(44)).astype(np.int64), key & _U((1 << 44) - 1)
    out = np.zeros((docs, REGISTERS), np.uint32)
    late = (np.log(REGISTERS) + 6) / np.maximum(n, 1)
    todo = n > 0
    while todo.any():
        time = np.full(docs * REGISTERS, np.inf)
        mark = np.zeros(docs * REGISTERS, np.uint32)
        use = todo[doc]
        d, e, c = doc[use], element[use], count[use]
        low, width = 0, 1
        while len(d):
            _run(d, e, c, low, width, late, time, mark)
            low, width = low + width, max(1, low + width)
            more = c > low
            d, e, c = d[more], e[more], c[more]
        time = time.reshape(docs, REGISTERS)
        full = todo & (time <= late[:, None]).all(1)
        out[full] = mark.reshape(docs, REGISTERS)[full]
        todo &= ~full
        late = late * 2.5
    return out


def _run(doc, element, count, low, width, late, time, mark) -> None:
    """The points of all elements' processes over levels [low, low + width) up to each text's time."""
    state = tx.mix(element * _U(0x9E3779B97F4A7C15) + _U(2 * low + 1))
    t = np.zeros(len(doc))
    limit, top, slot = late[doc], count, doc * REGISTERS
    step, r = 1.0 / (width * REGISTERS), 0
    while len(t):
        r += 1
        x = tx.mix(state + _U(r * 0xA0761D6478BD642F & (1 << 64) - 1))
        t = t - np.log(((x >> _U(24)).astype(np.float64) + 0.5) * 2.0**-40) * step
        go = t <= limit
        if not go.all():
            state, t, limit, top, slot, x = state[go], t[go], limit[go], top[go], slot[go], x[go]
        level = low + ((((x >> _U(7)) & _U(0xFFFF)) * _U(width)) >> _U(16)).astype(np.int64)
        valid = level < top
        at, when = (slot + (x & _U(REGISTERS - 1)).astype(np.int64))[valid], t[valid]
        np.minimum.at(time, at, when)
        won = time[at] == when
        mark[at[won]] = (tx.mix(x[valid][won]) >> _U(32)).astype(np.uint32)


def parities(sh: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, BINS / 8 + 8) bytes: whether the number of shingles in each bin is odd, and the number of all."""
    packed = []
    for i in range(0, len(first) - 1, 128):  # a few megabytes of counts at a time
        own = first[i : i + 129]
        at = tx.doc_index(own) * BINS + (sh[own[0] : own[-1]] >> _U(12) & _U(BINS - 1)).astype(np.int64)
        odd = np.bincount(at, minlength=(len(own) - 1) * BINS).astype(np.uint8) & 1
        packed.append(np.packbits(odd.reshape(-1, BINS), axis=1))
    return np.concatenate([np.concatenate(packed), np.diff(first).astype("<u8").view(np.uint8).reshape(-1, 8)], 1)


def possible(short_a: np.ndarray, short_b: np.ndarray, similar: float) -> np.ndarray:
    """Whether rows of parities beside each other may be similar; one side may be a single row.

    Two texts differ in at least as many shingles as they have bins of different parity, so this bounds what they share.
    """
    a, b = (np.ascontiguousarray(x).view("<u8") for x in (short_a, short_b))
    both = (a[..., -1] + b[..., -1]).astype(np.int64)
    common = (both - np.bitwise_count(a[..., :-1] ^ b[..., :-1]).sum(-1, dtype=np.int64)) / 2
    return common >= similar * (both - common) - 1e-9


def multiset(sh: np.ndarray) -> np.ndarray:
    """Shingle hashes as a sorted set: the k-th of equal ones gets a hash of its own."""
    sh = np.sort(sh)
    new = np.append(True, sh[1:] != sh[:-1])[: len(sh)]
    again = np.arange(len(sh)) - np.maximum.accumulate(np.where(new, np.arange(len(sh)), 0)) if len(sh) else sh.astype(np.int64)
    return np.sort(np.where(again > 0, tx.mix(sh + again.astype(np.uint64) * _U(0xE7037ED1A0B428DB)), sh))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets from ``multiset``."""
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(both) - common)


def _node(text: str):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _sign(batches):
    for batch in batches:
        data, offs = tx.column_bytes(batch.column(2))
        for i, j in tx.blocks(offs, BLOCK, ROWS):
            sh, first = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            sig = signatures(sh, first)
            raw = pa.array([s.tobytes() for s in sig], pa.binary())
            short = pa.array([s.tobytes() for s in parities(sh, first)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(first), pa.int64()), raw, short], names=["_node", "_id", "_n", "_sig", "_short"])


def _shingled(batches):
    for batch in batches:
        data, offs = tx.column_bytes(batch.column(1))
        for i, j in tx.blocks(offs, BLOCK, ROWS):
            sh, first = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            raw = [multiset(sh[a:b]).tobytes() for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(raw, pa.binary())], names=["_nid", "_set"])


def _shorts(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS // 8 + 8)


def _alike(similar: float):
    """Pairs that may be similar by their parities."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                yield part.select(["_a", "_b"]).filter(pa.array(possible(_shorts(part.column(2)), _shorts(part.column(3)), similar)))

    return run


def _verified(similar: float):
    def run(batches):
        for batch in batches:
            got = [overlap(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= similar for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["_a", "_b"]).filter(pa.array(got, pa.bool_()))

    return run


def _tiles(similar: float):
    return lambda batches: _tile_pairs(batches, similar)


def _tile_pairs(batches, similar: float):
    """Rows (_bucket, _i, _j, _block, _nid, _c, _short, _bands), a tile's rows together: pairs of the two blocks in
    different components that may be similar, each in the first bucket that they share only."""
    held, key = None, None

    def pairs(tile: pa.RecordBatch):
        block, nid, c = (tile.column(k).to_numpy() for k in ("_block", "_nid", "_c"))
        short = _shorts(tile.column("_short"))
        bands = tile.column("_bands").flatten().to_numpy().reshape(len(nid), -1)
        bucket = tile.column("_bucket")[0].as_py()
        i, j = tile.column(1)[0].as_py(), tile.column(2)[0].as_py()
        n = np.ascontiguousarray(short[:, -8:]).view("<u8").ravel().astype(np.int64)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        right = right[np.argsort(n[right], kind="stable")]
        # texts that are similar differ little in length
        low, high = np.searchsorted(n[right], np.ceil(n[left] * similar - 1e-9)), np.searchsorted(n[right], n[left] / similar + 1e-9, "right")
        for a, b0, b1 in zip(left.tolist(), low.tolist(), high.tolist(), strict=True):
            other = right[b0:b1]
            other = other[(c[other] != c[a]) & ((nid[other] > nid[a]) if i == j else True)]
            other = other[bands[a, (bands[other] == bands[a]).argmax(1)] == bucket] if len(other) else other
            other = other[possible(short[other], short[a], similar)] if len(other) else other
            for b in nid[other].tolist():
                yield min(int(nid[a]), b), max(int(nid[a]), b)

    def packed(found):
        found = list(found)
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["_a", "_b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
        cut = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]]).tolist()
        for a, b in zip(cut, cut[1:], strict=False):
            own, piece = tuple(keys[a].tolist()), batch.slice(a, b - a)
            if own == key:
                held.append(piece)
            else:
                if held:
                    yield packed(pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0]))
                held, key = [piece], own
    if held:
        yield packed(pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0]))


def components(edges: DataFrame) -> DataFrame:
    """(_nid, _c): for each end of an edge (_a, _b) the least node it reaches.

    Rounds of contraction: each node goes to its least neighbour's least neighbour, edges are drawn between what is
    left, and equal ones fall together. So a round has a fraction of the edges of the one before.
    """
    edges = written(edges.where("_a <> _b").select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct(), "edges")
    labels = edges.select(F.col("_a").alias("_nid"), F.col("_b").alias("_c"))
    first = True
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        step = both.groupBy("_a").agg(F.min("_b").alias("_m")).select(F.col("_a").alias("_n"), F.least("_a", "_m").alias("_to"))
        step = step.join(step.select(F.col("_n").alias("_to"), F.col("_to").alias("_far")), "_to").select("_n", F.col("_far").alias("_to"))
        step = written(step, "step")
        if first:
            labels, first = step.withColumnsRenamed({"_n": "_nid", "_to": "_c"}), False
        else:
            labels = written(labels.join(step, F.col("_c") == F.col("_n"), "left").select("_nid", F.coalesce("_to", "_c").alias("_c")), "labels")
        near, far = step.withColumnsRenamed({"_n": "_a", "_to": "_x"}), step.withColumnsRenamed({"_n": "_b", "_to": "_y"})
        edges = edges.join(near, "_a").join(far, "_b").where("_x <> _y").select(F.least("_x", "_y").alias("_a"), F.greatest("_x", "_y").alias("_b")).distinct()
        edges = written(edges, "edges")
    return labels


def _merged(comps: DataFrame, more: DataFrame) -> DataFrame:
    """comps with the components that further links join: only links between two of them count."""
    end = lambda n, out: comps.withColumnsRenamed({"_nid": n, "_c": out})
    between = more.join(end("_a", "_x"), "_a", "left").join(end("_b", "_y"), "_b", "left").select(F.coalesce("_x", "_a").alias("_a"), F.coalesce("_y", "_b").alias("_b"))
    joined = components(between).withColumnsRenamed({"_nid": "_old", "_c": "_new"})
    known = comps.join(joined, F.col("_c") == F.col("_old"), "left").select("_nid", F.coalesce("_new", "_c").alias("_c"))
    # ends that were in no link before are components of their own
    single = joined.join(comps.select("_nid"), F.col("_old") == F.col("_nid"), "left_anti").select(F.col("_old").alias("_nid"), F.col("_new").alias("_c"))
    return written(known.unionByName(single), "labels")


def _buckets():
    """The bucket of each band of a signature."""
    width = BAND * 4
    return F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda k: F.xxhash64(k, F.substring(F.col("_sig"), k * width + 1, F.lit(width))))


def _bands(nodes: DataFrame) -> DataFrame:
    return nodes.where("_n > 0").select("_nid", F.explode(_buckets()).alias("_bucket"))


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text: str, similar: float) -> DataFrame:
    """The pairs (_a, _b) whose texts are similar, as a written table."""
    need = pairs.select(F.col("_a").alias("_nid")).union(pairs.select("_b")).distinct()
    need = need.join(nodes.select("_nid", "_node", F.col("_id").alias("_first")), "_nid")
    rows = docs.select(_node(text).alias("_key"), F.col(id_col).alias("_did"), F.col(text).alias("_text"))
    rows = rows.join(need, (F.col("_key") == F.col("_node")) & F.col("_did").eqNullSafe(F.col("_first"))).select("_nid", "_text")
    sets = rows.mapInArrow(released(_shingled), "_nid bigint, _set binary").dropDuplicates(["_nid"])
    sets = written(sets, "sets")
    both = pairs.join(sets.withColumnsRenamed({"_nid": "_a", "_set": "_x"}), "_a").join(sets.withColumnsRenamed({"_nid": "_b", "_set": "_y"}), "_b").select("_a", "_b", "_x", "_y")
    return written(both.mapInArrow(released(_verified(similar)), "_a bigint, _b bigint"), "links")


_TILED = ("_bucket", "_i", "_j", "_block", "_nid", "_c", "_short", "_bands")
#: Blocks that one class of lengths may have, as a factor of block numbers.
_CLASS = 1 << 24


def _by_length(member: DataFrame, similar: float) -> DataFrame:
    """Rows of large buckets as _TILED. Similar texts are of one class of lengths or of neighbouring ones, so a node goes
    only to the tiles of its block with the blocks of these; a block has about TILE nodes."""
    rows = member.withColumn("_k", F.floor(F.log("_n") / F.log(F.lit(1 / similar))))
    sizes = rows.groupBy("_bucket", "_k").agg(F.ceil(F.count("*") / TILE).alias("_b"))
    blocks = lambda shift: F.when(F.col(f"_b{shift}") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(f"_b{shift}") - 1), lambda j: (F.col("_k") + shift) * _CLASS + j)).otherwise(F.array().cast("array<bigint>"))
    for shift in (-1, 0, 1):
        rows = rows.join(sizes.select("_bucket", (F.col("_k") - shift).alias("_k"), F.col("_b").alias(f"_b{shift}")), ["_bucket", "_k"], "left")
    rows = rows.withColumn("_block", F.col("_k") * _CLASS + F.pmod(F.xxhash64("_nid"), F.col("_b0")))
    rows = rows.withColumn("_other", F.explode(F.concat(*map(blocks, (-1, 0, 1)))))
    return rows.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")}).select(*_TILED)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per different text that is not null: _node (md5), _id (its least id), _rows, _repeats, class_id, class_size.

    ``_repeats``: rows that have the text and ``_id``. Classes are the components of texts of similarity ``similar``
    or more; class_id is the least id in a class, null if all its ids are null. Texts without words are alike only
    to equal texts. Other columns are not read; an empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(text).isNotNull()).select(_node(text).alias("_node"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    signed = rows.mapInArrow(released(_sign), f"_node binary, _id {kind}, _n bigint, _sig binary, _short binary")
    # equal texts have equal signatures
    nodes = signed.groupBy("_node").agg(F.min("_id").alias("_id"), F.count("*").alias("_rows"), F.first("_n").alias("_n"), F.first("_sig").alias("_sig"), F.first("_short").alias("_short"))
    # ids are fixed by being written
    nodes = written(nodes.withColumn("_nid", F.monotonically_increasing_id()), "nodes")
    bands = _bands(nodes)
    odd = 0x5DEECE66D5A5A5
    heads = bands.groupBy("_bucket").agg(F.count("*").alias("_size"), F.min("_nid").alias("_p"), F.max("_nid").alias("_q"), F.min(F.col("_nid").bitwiseXOR(F.lit(odd))).bitwiseXOR(F.lit(odd)).alias("_r")).where("_size > 1")
    heads = written(heads, "buckets")
    stars = bands.join(heads, "_bucket").select("_nid", F.explode(F.array_distinct(F.array("_p", "_q", "_r"))).alias("_head")).where("_nid <> _head")
    stars = stars.select(F.least("_nid", "_head").alias("_a"), F.greatest("_nid", "_head").alias("_b")).distinct()
    short = nodes.select("_nid", "_short")
    alike = stars.join(short.withColumnsRenamed({"_nid": "_a", "_short": "_x"}), "_a").join(short.withColumnsRenamed({"_nid": "_b", "_short": "_y"}), "_b")
    tested = written(alike.select("_a", "_b", "_x", "_y").mapInArrow(released(_alike(similar)), "_a bigint, _b bigint"), "stars")
    links = _verify(tested, nodes, docs, id_col, text, similar)
    comps = components(links)
    # buckets of three or more that still hold several components
    member = bands.join(heads.where("_size > 2").select("_bucket", "_size"), "_bucket")
    member = member.join(comps, "_nid", "left").withColumn("_c", F.coalesce("_c", "_nid"))
    split = member.groupBy("_bucket").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).where("_lo <> _hi").select("_bucket")
    member = member.join(split, "_bucket").join(nodes.select("_nid", "_n", "_short", _buckets().alias("_bands")), "_nid")
    tiles = member.where(F.col("_size") <= TILE).withColumns({"_i": F.lit(0).cast("long"), "_j": F.lit(0).cast("long"), "_block": F.lit(0).cast("long")}).select(*_TILED)
    if (heads.agg(F.max("_size")).first()[0] or 0) > TILE:
        tiles = tiles.unionByName(_by_length(member.where(F.col("_size") > TILE), similar))
    rest = tiles.repartition("_bucket", "_i", "_j").sortWithinPartitions("_bucket", "_i", "_j").mapInArrow(released(_tiles(similar)), "_a bigint, _b bigint").distinct()
    rest = written(rest.join(tested, ["_a", "_b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = _verify(rest, nodes, docs, id_col, text, similar)
        if not more.isEmpty():
            comps = _merged(comps, more)
    named = nodes.select("_nid", "_node", "_id", "_rows").join(comps, "_nid", "left").withColumn("_c", F.coalesce("_c", "_nid"))
    classes = named.groupBy("_c").agg(F.min("_id").alias("class_id"), F.sum("_rows").alias("class_size"))
    return named.join(classes, "_c").select("_node", "_id", "_rows", "class_id", "class_size", "_c")


def classify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per document: id_col, class_id, class_size. A null text is a class of its own, with its own id."""
    found = near_duplicates(docs, id_col, text, similar).select("_node", "class_id", "class_size")
    out = docs.select(F.col(id_col), _node(text).alias("_key")).join(found, F.col("_key") == F.col("_node"), "left")
    return out.select(id_col, F.when(F.col("_key").isNull(), F.col(id_col)).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """docs, all columns, with one document of each class: that of the least id (nulls last; then the least md5). Null texts all stay."""
    found = near_duplicates(docs, id_col, text, similar)
    order = F.struct(F.col("_id").isNull(), "_id", "_node")
    best = found.groupBy("_c").agg(F.min(order).alias("_m")).select(F.col("_m._node").alias("_node"), F.col("_m._id").alias("_id"))
    # a row that repeats its id and text is kept once
    repeats = docs.where(F.col(text).isNotNull()).groupBy(_node(text).alias("_rn"), F.col(id_col).alias("_ri")).count().where("count > 1").select("_rn", "_ri")
    best = written(best.join(repeats, (F.col("_node") == F.col("_rn")) & F.col("_id").eqNullSafe(F.col("_ri")), "left").select("_node", "_id", F.col("_rn").isNotNull().alias("_again")), "kept")
    rows = docs.withColumn("_key", _node(text))
    kept = rows.join(best, (F.col("_key") == F.col("_node")) & F.col(id_col).eqNullSafe(F.col("_id")))
    out = kept.where("not _again").select(*docs.columns)
    if not best.where("_again").isEmpty():
        out = out.unionByName(kept.where("_again").dropDuplicates(["_key"]).select(*docs.columns))
    return out.unionByName(docs.where(F.col(text).isNull()))


def op7(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with recursive t as (select distinct text, md5(text) as node, {_WORDS} as w from documents where text is not null),
s as (select node, s, count(*) as c from (select node, array_to_string(w[k:k + 4], ' ') as s
    from (select node, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as k from t)) group by all),
n as (select node, sum(c) as n from s group by node),
p as (select a.node as a, b.node as b, sum(least(a.c, b.c)) as common from s a join s b on a.s = b.s and a.node < b.node group by all),
e as (select a, b from p join n x on x.node = a join n y on y.node = b where common >= 0.8 * (x.n + y.n - common)),
both_ways as (select a, b from e union all select b, a from e),
reach as (select node, node as c from t union select r.node, x.b from reach r join both_ways x on r.c = x.a),
g as (select node, min(c) as c from reach group by node),
m as (select g.c, min(doc_id) as class_id, count(*) as class_size from documents d join g on md5(d.text) = g.node group by g.c)
select d.doc_id, case when d.text is null then d.doc_id else m.class_id end as class_id, coalesce(m.class_size, 1) as class_size
from documents d left join g on md5(d.text) = g.node left join m on m.c = g.c
"""
