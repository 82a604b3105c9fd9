"""An interpolated modified Kneser-Ney language model of any order from 2 up, and text scores from it.

Counting: a task counts the n-grams of its texts, each different one once, and deals them by the n-gram's own hash,
so a hot word's n-grams lie in all shards. A row holds one shard's n-grams of one task, its words by place in a small
vocabulary; rows never outnumber n-grams. One exchange brings the shards to tasks, each a run of shards in order; a task
merges shard by shard, of bounded size as their number grows with the corpus, and writes one file of sorted hashes with
counts. It sends on sums by context and by last word, and for an order over 2 the shorter n-grams, whose count is the
number of different words before them. So there are as many files as shuffle partitions. Scoring is a map: workers
memory-map the files and look up each different n-gram of a block once.

A model's files lie in ``spark.checkpoint.dir``; where executors can't mount that, they fetch them (``shared.Stored``).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import TEXT_ROWS, Saving, Stored, arrow_rows, batches_of, crc_mod, new_path, released, written

#: Text bytes counted or scored at a time, those of the corpus for each shard, and n-grams that a task keeps before it deals them.
BLOCK, SHARD, KEPT = 8 << 20, 20 << 20, 2_400_000
#: Words whose sums a merging task keeps, and packed rows that it is handed at a time.
SUMS, PACKED_ROWS = 1_000_000, 64
#: Hashes of the marks before and after a text.
BEGIN, END = (int(x) for x in tx.mix(np.array([1, 2], np.uint64)))
_U = np.uint64


def sequences(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, slots, first): order - 1 begin marks, the words' hashes and the end mark of each text; the places of
    words and end marks, which are the tokens; and n+1 offsets of the texts' tokens."""
    starts, ends, first = tx.tokens(data, offs, "space")
    n = np.diff(first) + 1
    first = np.append(0, np.cumsum(n))
    slots = np.arange(first[-1]) + np.repeat((order - 1) * np.arange(1, len(n) + 1), n)
    words = np.full(first[-1] + (order - 1) * len(n), BEGIN, np.uint64)
    words[slots] = END
    own = np.ones(len(slots), bool)
    own[first[1:] - 1] = False
    words[slots[own]] = tx.hashes(data, starts, ends)
    return words, slots, first


def extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of all but its last word; one word's hash is the word's."""
    return tx.mix(prefix * _U(0x9E3779B97F4A7C15) + word)


def gram_hashes(words: np.ndarray, slots: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, n-grams) that end at each slot."""
    h = words[slots - order + 1]
    for k in range(order - 2, 0, -1):
        h = extended(h, words[slots - k])
    return h, extended(h, words[slots])


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash as a signed number, so sorted hashes are sorted by shard."""
    return ((((hashes.view(np.int64) >> 32) + (1 << 31)).astype(np.uint64) * _U(shards)) >> _U(32)).astype(np.int64)


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, places) of the different hashes, ascending as signed numbers."""
    by = np.argsort(hashes.view(np.int64), kind="stable")
    own = hashes[by]
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else by
    return own[start], np.add.reduceat(counts[by], start) if len(own) else counts, by[start]


# packed n-grams

_HEAD = struct.Struct("<IIIII")


def pack(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """N-grams by the places of their words in a vocabulary, sorted by the first word; counts over 254 stand apart."""
    vocabulary, place = np.unique(np.concatenate(columns), return_inverse=True)
    place = place.reshape(len(columns), -1)
    by = np.argsort(place[0], kind="stable")
    place, counts = place[:, by], counts[by]
    place[0, 1:] = np.diff(place[0])
    width = 2 if len(vocabulary) <= 1 << 16 else 4
    large = np.flatnonzero(counts > 254)
    head = _HEAD.pack(len(counts), len(columns), len(vocabulary), width, len(large))
    return b"".join([head, _planes(vocabulary), counts[large].astype("<u8").tobytes(), large.astype("<u4").tobytes(), _planes(place.astype(f"<u{width}")), np.minimum(counts, 255).astype(np.uint8).tobytes()])


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: the high bytes of ascending numbers repeat, and the exchange compresses them."""
    return np.ascontiguousarray(x.ravel().view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unpack(raw) -> tuple[list[np.ndarray], np.ndarray]:
    n, order, words, width, many = _HEAD.unpack_from(raw, 0)
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    def planes(size: int, count: int) -> np.ndarray:
        return np.ascontiguousarray(take("u1", size * count).reshape(size, count).T).view(f"<u{size}").ravel()

    vocabulary, large, where = planes(8, words), take("<u8", many), take("<u4", many)
    place = planes(width, n * order).reshape(order, n).astype(np.int64)
    counts = take("u1", n).astype(np.int64)
    counts[where] = large
    place[0] = np.cumsum(place[0])
    return [vocabulary[p] for p in place], counts


_DEALT = "shard int, grams binary"


def _dealt(hashes: np.ndarray, columns: list[np.ndarray], counts: np.ndarray, shards: int):
    """Rows of _DEALT; hashes ascend."""
    shard = shard_of(hashes, shards)
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else shard
    ends = np.append(cut[1:], len(shard)).tolist() if len(shard) else []
    rows, held = [], 0
    for a, b in zip(cut.tolist(), ends, strict=True):
        rows.append((int(shard[a]), pack([c[a:b] for c in columns], counts[a:b])))
        held += len(rows[-1][1])
        if held > 16 << 20:
            yield rows
            rows, held = [], 0
    yield rows


def _counted(order: int, shards: int):
    """A mapper of texts to rows of _DEALT."""

    def blocks(batches):
        for batch in batches:
            data, offs = tx.column_bytes(batch.column(0))
            for i, j in tx.blocks(offs, BLOCK):
                words, slots, _ = sequences(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], order)
                hashes, counts, at = _summed(gram_hashes(words, slots, order)[1], np.ones(len(slots), np.int32))
                yield hashes, counts, [words[slots[at] - k] for k in range(order - 1, -1, -1)]

    def flush(held):
        hashes, counts, at = _summed(np.concatenate([h for h, _, _ in held]), np.concatenate([c for _, c, _ in held]))
        columns = [np.concatenate([x.pop(0) for _, _, x in held])[at] for _ in range(order)]
        held.clear()
        for rows in _dealt(hashes, columns, counts, shards):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "grams"])

    def run(batches):
        held, size = [], 0
        for block in blocks(batches):
            if size and size + len(block[0]) > KEPT:
                yield from flush(held)
                held, size = [], 0
            held.append(block)
            size += len(block[0])
        if held:
            yield from flush(held)

    return released(run)


# merging

#: What a merging task gives: a file (name, its least hash, n-grams, of count 1 to 4), a shorter n-gram shard, or sums by word or context.
FILE, GRAMS, WORD, CONTEXT = range(4)
#: Columns of sums: count as a token, different words before it; as a context its total and words met once, twice, more.
SUMMED = ("tokens", "before", "total", "once", "twice", "more")
_MERGED = "kind int, name string, shard int, grams binary, key bigint, " + ", ".join(f"{c} bigint" for c in SUMMED)


class _Sums:
    """Sums by key, given out as rows of _MERGED in bounded numbers."""

    def __init__(self, kind: int):
        self.kind, self.keys, self.rows, self.size = kind, [], [], 0

    def add(self, keys: np.ndarray, **sums: np.ndarray):
        keys, back = np.unique(keys, return_inverse=True)
        table = np.zeros((len(keys), len(SUMMED)), np.int64)
        for name, x in sums.items():
            np.add.at(table[:, SUMMED.index(name)], back, x)
        self.keys.append(keys)
        self.rows.append(table)
        self.size += len(keys)
        if self.size > SUMS:
            self._fold()
            if self.size > SUMS // 2:
                yield from self.flush()

    def _fold(self) -> None:
        keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        table = np.zeros((len(keys), len(SUMMED)), np.int64)
        np.add.at(table, back, np.concatenate(self.rows))
        self.keys, self.rows, self.size = [keys], [table], len(keys)

    def flush(self):
        if self.keys:
            self._fold()
            yield _row(self.size, kind=self.kind, key=self.keys[0].view(np.int64), **{c: self.rows[0][:, k] for k, c in enumerate(SUMMED)})
        self.keys, self.rows, self.size = [], [], 0


_KINDS = {"kind": pa.int32(), "name": pa.string(), "shard": pa.int32(), "grams": pa.binary()} | {c: pa.int64() for c in ("key", *SUMMED)}


def _row(n: int, kind: int, **columns) -> pa.RecordBatch:
    columns = {"kind": [kind] * n} | columns
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _KINDS.items()], names=list(_KINDS))


def _merged(folder: str, level: int, order: int, shards: int):
    """A mapper of rows (shard, grams), ascending by shard, to rows of _MERGED."""

    def merge(blobs):
        got = [unpack(b) for b in blobs]
        columns = [np.concatenate([g[0][k] for g in got]) for k in range(level)]
        counts = np.concatenate([g[1] for g in got])
        del got
        prefix = columns[0]
        for c in columns[1:-1]:
            prefix = extended(prefix, c)
        hashes, counts, at = _summed(extended(prefix, columns[-1]), counts)
        return hashes, counts, prefix[at], [c[at] for c in columns]

    def run(batches):
        writer, words = Saving(folder, f"grams{level}"), _Sums(WORD)
        contexts = words if level == 2 else _Sums(CONTEXT)
        numbers, least = np.zeros(5, np.int64), None

        def done(blobs):
            nonlocal least
            hashes, counts, prefix, columns = merge(blobs)
            least = int(hashes[0].view(np.int64)) if least is None else least
            large = np.flatnonzero(counts > 254)
            writer.add(hashes=hashes, counts=np.minimum(counts, 255).astype(np.uint8), large=hashes[large], large_counts=counts[large])
            numbers[:4] += np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
            numbers[4] += len(hashes)
            yield from contexts.add(prefix, total=counts, once=counts == 1, twice=counts == 2, more=counts > 2)
            last = {"tokens": counts} if level == order else {}
            if level == 2:
                last["before"] = np.ones(len(counts), np.int64)
            if last:
                yield from words.add(columns[-1], **last)
            if level > 2:
                suffix = columns[1]
                for c in columns[2:]:
                    suffix = extended(suffix, c)
                suffix, number, at = _summed(suffix, np.ones(len(suffix), np.int64))
                for rows in _dealt(suffix, [c[at] for c in columns[1:]], number, shards):
                    if rows:
                        yield _row(len(rows), GRAMS, shard=[r[0] for r in rows], grams=[r[1] for r in rows])

        held, shard = [], None
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != shard and held:
                    yield from done(held)
                    held = []
                shard = s
                held.append(blob.as_py())
        if held:
            yield from done(held)
        yield from words.flush()
        yield from contexts.flush()  # for pairs the same, and empty by now
        if name := writer.close():
            sums = dict(zip(SUMMED, ([int(x)] for x in numbers), strict=False))
            yield _row(1, FILE, name=[name], key=[least], **sums)

    return released(run)


_FILES = "name string, key bigint, keys bigint, tokens_of bigint, words bigint, before_of bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, over2 bigint"


#: A sum from here on stands in a list of its own.
LARGE = (1 << 32) - 1


def _tabled(folder: str, prefix: str):
    """A mapper of rows (key, SUMMED), ascending by key, to a file of different keys with their sums, and what they come to."""

    def run(batches):
        writer, least, totals, carry, done = Saving(folder, prefix), None, np.zeros(9, np.int64), None, 0

        def put(keys, table):
            nonlocal least, done
            least = int(keys[0]) if least is None else least
            large = np.flatnonzero(table.ravel() >= LARGE)
            writer.add(hashes=keys, table=np.minimum(table, LARGE).astype("<u4"), large=large + done, large_sums=table.ravel()[large])
            done += table.size
            before = table[:, 1]
            totals[:] += [len(keys), table[:, 0].sum(), (table[:, 0] > 0).sum(), before.sum(), *np.bincount(np.minimum(before, 5), minlength=6)[1:5], (before > 2).sum()]

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, table = batch.column(0).to_numpy(), np.stack([c.fill_null(0).to_numpy() for c in batch.columns[1:]], 1)
            if carry is not None:
                keys, table = np.append(carry[0], keys), np.concatenate([carry[1], table])
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, table = keys[start], np.add.reduceat(table, start, axis=0)
            carry = (keys[-1:], table[-1:])
            if len(keys) > 1:
                put(keys[:-1], table[:-1])
        if carry is not None:
            put(*carry)
            values = [[writer.close()], *([int(x)] for x in (least, *totals))]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k else pa.string()) for k, v in enumerate(values)], names=[x.split()[0] for x in _FILES.split(", ")])

    return released(run)


class Files:
    """Files of sorted hashes that follow each other: (name, least hash), ascending."""

    def __init__(self, folder: str, files: list[tuple[str, int]]):
        self.stored, self.files = Stored(folder), sorted(files, key=lambda f: f[1])
        self.least = np.array([f[1] for f in self.files[1:]], np.int64)

    def found(self, keys: np.ndarray):
        """(file, places of known keys, places in the file) for ascending keys."""
        cut = [0, *np.searchsorted(keys, self.least).tolist(), len(keys)]
        for (name, _), a, b in zip(self.files, cut, cut[1:], strict=False):
            if a < b:
                known = self.stored.array(f"{name}.hashes", np.int64)
                at = np.minimum(np.searchsorted(known, keys[a:b]), len(known) - 1)
                same = np.flatnonzero(known[at] == keys[a:b])
                yield name, a + same, at[same]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for name, place, at in self.found(keys):
            c = self.stored.array(f"{name}.counts", np.uint8)[at].astype(np.int64)
            if len(large := np.flatnonzero(c == 255)):
                c[large] = self.stored.array(f"{name}.large_counts", np.int64)[np.searchsorted(self.stored.array(f"{name}.large", np.int64), keys[place[large]])]
            out[place] = c
        return out

    def sums(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), len(SUMMED)), np.int64)
        for name, place, at in self.found(keys):
            rows = self.stored.array(f"{name}.table", np.uint32, len(SUMMED))[at].astype(np.int64)
            r, c = np.nonzero(rows == LARGE)
            if len(r):
                own = np.searchsorted(self.stored.array(f"{name}.large", np.int64), at[r] * len(SUMMED) + c)
                rows[r, c] = self.stored.array(f"{name}.large_sums", np.int64)[own]
            out[place] = rows
        return out


def discounts(n: list[int]) -> tuple[float, float, float, float]:
    """0 and the discounts for counts 1, 2 and over, from the numbers of counts 1 to 4; fixed ones where a number is 0."""
    n1, n2, n3, n4 = n
    if not min(n):
        return 0.0, 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    return 0.0, *(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


@dataclass
class Model:
    """Where the arrays are, and the few numbers of the whole corpus."""

    order: int
    grams: dict[int, Files]  # by level from 2
    contexts: dict[int, Files]  # by level from 3
    words: Files
    tokens: int
    different: int  # different tokens, the end mark among them
    pairs: int  # different pairs
    discounts: dict[int, tuple]  # by level from 1
    classes: tuple  # words with 1, 2, more words before them

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(n_tokens, n_known, base_score, score) of each text."""
        data, offs = tx.column_bytes(texts)
        parts = [self._block(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in tx.blocks(offs, BLOCK // 2)]
        return tuple(np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k in range(4))

    def _block(self, data, offs):
        words, slots, first = sequences(data, offs, self.order)
        vocabulary, back = np.unique(words.view(np.int64), return_inverse=True)
        rows = self.words.sums(vocabulary)
        token = back[slots]
        known = rows[:, 0] > 0
        base = np.log10((rows[:, 0] + 1) / (self.tokens + self.different + 1))
        uniform, d = 1 / (self.different + 1), np.array(self.discounts[1])
        before = rows[:, 1]
        if self.pairs:
            left = float(d[1:] @ np.array(self.classes, float)) / self.pairs
            p = (np.maximum(before - d[np.minimum(before, 3)], 0) / self.pairs + left * uniform)[token]
        else:
            p = np.full(len(token), uniform)
        for level in range(2, self.order + 1):
            context, gram = gram_hashes(words, slots, level)
            keys, back_c = np.unique(context.view(np.int64), return_inverse=True)
            sums = (self.words if level == 2 else self.contexts[level]).sums(keys)
            d = np.array(self.discounts[level])
            total = np.maximum(sums[:, 2], 1)
            left = sums[:, 3:6] @ d[1:] / total
            grams, back_g = np.unique(gram.view(np.int64), return_inverse=True)
            c = self.grams[level].counts(grams)
            c = np.maximum(c - d[np.minimum(c, 3)], 0)[back_g]
            p = np.where(sums[back_c, 2] > 0, c / total[back_c] + left[back_c] * p, p)
        return np.diff(first), tx.per_doc(known[token].astype(np.int64), first), tx.per_doc(base[token], first), tx.per_doc(np.log10(p), first)


def train(docs: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Counts all whole texts of docs; null and empty ones count as an end mark. An empty table gives a model that knows nothing."""
    if order < 2:
        raise ValueError(f"order {order}")
    spark = docs.sparkSession
    folder = new_path(spark, "lm")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    shards = max(8, -(-size // SHARD))
    parts = min(shards, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select(F.col(text).alias("_text")).mapInArrow(_counted(order, shards), _DEALT)
    grams, contexts, merged, found = {}, {}, {}, {}
    for level in range(order, 1, -1):
        dealt = rows.repartitionById(parts, (F.col("shard").cast("long") * parts / shards).cast("int")).sortWithinPartitions("shard")
        merged[level] = written(dealt.mapInArrow(_merged(folder, level, order, shards), _MERGED), f"lm-merged{level}", PACKED_ROWS)
        # one row for each shuffle partition
        files = merged[level].where(F.col("kind") == FILE).collect()
        grams[level] = Files(folder, [(f["name"], f["key"]) for f in files])
        found[level] = [sum(f[c] for f in files) for c in SUMMED[:5]]
        rows = merged[level].where(F.col("kind") == GRAMS).select("shard", "grams")

    def table(df: DataFrame, name: str) -> list:
        part = ((F.shiftright("key", 32) + (1 << 31)) * parts / float(1 << 32)).cast("int")
        dealt = df.select("key", *SUMMED).repartitionById(parts, part).sortWithinPartitions("key")
        with batches_of(spark, 16 * TEXT_ROWS):
            return dealt.mapInArrow(_tabled(folder, name), _FILES).collect()

    for level in range(3, order + 1):
        contexts[level] = Files(folder, [(f["name"], f["key"]) for f in table(merged[level].where(F.col("kind") == CONTEXT), f"contexts{level}")])
    words = merged[2]
    if order > 2:
        words = words.unionByName(merged[order])
    files = table(words.where(F.col("kind") == WORD), "words")
    total = lambda c: sum(f[c] for f in files)
    d = {level: discounts(n[:4]) for level, n in found.items()} | {1: discounts([total(c) for c in ("n1", "n2", "n3", "n4")])}
    return Model(order, grams, contexts, Files(folder, [(f["name"], f["key"]) for f in files]), total("tokens_of"), total("words"), total("before_of"), d, (total("n1"), total("n2"), total("over2")))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score) of every whole text, the end mark a token; scores are sums of log10.

    Null and empty texts are the end mark alone. Other columns are not read; an id column that has the name of another
    output column gets "_in" behind its own.
    """

    def made(texts):
        return [pa.array(x, t) for x, t in zip(model.score(texts), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]

    return arrow_rows(docs, made, "n_tokens bigint, n_known bigint, base_score double, score double", id_col, text)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod("doc_id", 7) == 2
    model = train(docs.where(~held_out))
    out = score(docs, model)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
