"""Benchmark decontamination with suffix arrays over the training text.

A task takes its documents in shards of a few megabytes. For each shard it builds a suffix array over words:
word positions in the lexicographic order of their next 12 words, by prefix tripling and doubling, a position's
words ending with its document. Every benchmark suffix is then binary-searched in it, equal ones once: a window is
10 words (or all words of a shorter item), and the slots found are compared word by word in full 64-bit hashes.
Where windows of an item follow each other in a document, the item's suffix automaton gives the longest verbatim
matches. The pass is a map: no shuffle.

The benchmark is encoded by tasks into parts of bounded size, files in the shared folder that workers map; neither
the driver nor a broadcast ever holds its texts.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import Saving, Stored, arrow_rows, keep_rows, new_path

WINDOW = 10
#: Bytes of text in a shard, and of benchmark text in one part.
SHARD, PART = 2 << 20, 1 << 20
#: Windows that are searched at a time, and parts that a worker keeps.
CHUNK, KEPT = 1 << 16, 8
_CODE = 44  # a word's code for sorting: the top 20 bits of its hash, plus 1; 0 is past the document's end


class Suffixes:
    """The suffix array of one shard; ``order`` holds word positions, ``keys`` their first three codes."""

    def __init__(self, h: np.ndarray, first: np.ndarray):
        n = len(h)
        self.h, self.end = h, np.repeat(first[1:], np.diff(first))
        self.code = np.zeros(n + 2, np.uint64)
        self.code[:n] = (h >> np.uint64(_CODE)) + np.uint64(1)
        left = self.end - np.arange(n)
        second, third = self.code[1 : n + 1].copy(), self.code[2 : n + 2].copy()
        second[left < 2] = 0
        third[left < 3] = 0
        key = (self.code[:n] << np.uint64(42)) | (second << np.uint64(21)) | third
        self.order = np.argsort(key)
        self.keys = key[self.order]
        new = np.ones(n, bool)
        np.not_equal(self.keys[1:], self.keys[:-1], out=new[1:])
        for depth in (3, 6):
            head = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # group of each slot, named by its first slot
            rank = np.zeros(n + depth, np.int64)
            rank[self.order] = head + 1
            alone = new & np.append(new[1:], True)
            slots = np.flatnonzero(~alone)
            at = self.order[slots]
            after = rank[at + depth]
            after[left[at] <= depth] = 0
            key = (head[slots].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
            by = np.argsort(key)
            self.order[slots] = at[by]
            key = key[by]
            new[slots[1:]] |= key[1:] != key[:-1]

    def ranges(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots [lo, hi) whose first sizes[i] codes equal those of words[i]; words is (q, WINDOW) of hashes."""
        code = (words >> np.uint64(_CODE)) + np.uint64(1)
        code[np.arange(words.shape[1])[None, :] >= sizes[:, None]] = 0
        low = (code[:, 0] << np.uint64(42)) | (code[:, 1] << np.uint64(21)) | code[:, 2]
        step = np.uint64(1) << np.uint64(21) * (np.uint64(3) - np.minimum(sizes, 3).astype(np.uint64))
        lo, hi = np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, low + step, "left")
        more = np.flatnonzero((hi > lo) & (sizes > 3))
        if len(more):
            lo[more], hi[more] = self._bound(code[more], sizes[more], lo[more], hi[more], False), self._bound(code[more], sizes[more], lo[more], hi[more], True)
        return lo, hi

    def _bound(self, code, sizes, lo, hi, upper: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        k = np.arange(code.shape[1])
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            at = self.order[mid]
            there = self.code[np.minimum(at[:, None] + k, len(self.code) - 1)]
            there[at[:, None] + k >= self.end[at][:, None]] = 0
            there[k >= sizes[live][:, None]] = 0
            differ = there != code[live]
            place = differ.argmax(1)
            rows = np.arange(len(live))
            same = ~differ[rows, place]
            less = there[rows, place] < code[live][rows, place]
            right = less | same if upper else less
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
            live = live[lo[live] < hi[live]]
        return lo


class Items:
    """A part of the benchmark: ``ids`` of its items, its different windows as hashes (q, WINDOW) with their sizes, the
    windows of each item in order, and the items of each window."""

    def __init__(self, ids: list[str | None], words: np.ndarray, sizes: np.ndarray, windows: np.ndarray, first: np.ndarray):
        self.ids, self.words, self.sizes, self.windows, self.first = ids, words, sizes, windows, first
        pairs = np.unique((windows.astype(np.int64) << 32) | tx.doc_index(first))
        self.items = pairs & 0xFFFFFFFF
        self.items_from = np.searchsorted(pairs >> 32, np.arange(len(sizes) + 1))
        self._automata: dict[int, Automaton] = {}

    @classmethod
    def of(cls, ids: list[str | None], texts: list[str]) -> Items:
        data, offs = tx.column_bytes(pa.array(texts, pa.large_string()))
        starts, ends, first = tx.tokens(data, offs, "alnum")
        h = tx.hashes(data, starts, ends)
        n = np.diff(first)
        count = np.where(n >= WINDOW, n - WINDOW + 1, np.minimum(n, 1))
        upto = np.append(0, np.cumsum(count))
        at = np.repeat(first[:-1] - upto[:-1], count) + np.arange(upto[-1])
        size = np.repeat(np.minimum(n, WINDOW), count)
        h = np.append(h, np.zeros(WINDOW, np.uint64))
        words = h[at[:, None] + np.arange(WINDOW)]
        words[np.arange(WINDOW) >= size[:, None]] = 0
        _, where, windows = np.unique(np.ascontiguousarray(words).view(f"V{8 * WINDOW}").ravel(), return_index=True, return_inverse=True)
        return cls(ids, words[where], size[where], windows.ravel(), upto)

    def arrays(self) -> dict[str, np.ndarray]:
        raw = [b"" if i is None else b"=" + i.encode() for i in self.ids]
        upto = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
        return {"words": self.words, "sizes": self.sizes.astype(np.int64), "windows": self.windows.astype(np.int64), "first": self.first.astype(np.int64), "ids": np.frombuffer(b"".join(raw), np.uint8), "ids_from": upto}

    @classmethod
    def load(cls, stored: Stored, name: str) -> Items:
        raw, upto = stored.array(f"{name}.ids", np.uint8).tobytes(), stored.array(f"{name}.ids_from", np.int64).tolist()
        ids = [raw[a + 1 : b].decode() if b > a else None for a, b in zip(upto, upto[1:], strict=False)]
        sizes, windows, first = (stored.array(f"{name}.{k}", np.int64) for k in ("sizes", "windows", "first"))
        return cls(ids, stored.array(f"{name}.words", np.uint64).reshape(-1, WINDOW), sizes, windows, first)

    def automaton(self, item: int) -> Automaton:
        if item not in self._automata:
            if len(self._automata) > 256:
                self._automata.clear()
            self._automata[item] = Automaton(self.windows[self.first[item] : self.first[item + 1]].tolist())
        return self._automata[item]


class Automaton:
    """The suffix automaton of an item's windows: how far a document follows the item, wherever it does so longest."""

    def __init__(self, symbols: list[int]):
        self.size, self.link, self.next = [0], [-1], [{}]
        last = 0
        for s in symbols:
            own = self._state(self.size[last] + 1, 0, {})
            p = last
            while p >= 0 and s not in self.next[p]:
                self.next[p][s] = own
                p = self.link[p]
            if p >= 0:
                q = self.next[p][s]
                if self.size[q] == self.size[p] + 1:
                    self.link[own] = q
                else:
                    copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
                    while p >= 0 and self.next[p].get(s) == q:
                        self.next[p][s] = copy
                        p = self.link[p]
                    self.link[q] = self.link[own] = copy
            last = own

    def _state(self, size: int, link: int, after: dict) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(after)
        return len(self.size) - 1

    def matches(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(first, number) of symbols that match the item verbatim and are part of no longer match."""
        out, state, length = [], 0, 0
        for k, s in enumerate(symbols):
            if s not in self.next[state]:
                if length:
                    out.append((k - length, length))
                while state and s not in self.next[state]:
                    state = self.link[state]
                length = min(length, self.size[state])
            if s in self.next[state]:
                state, length = self.next[state][s], length + 1
        return out + [(len(symbols) - length, length)] if length else out


def occurrences(index: Suffixes, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(window, position): where each different window occurs. A position starts at most one window of a size."""
    found = []
    for a in range(0, len(items.sizes), CHUNK):
        words, sizes = items.words[a : a + CHUNK], items.sizes[a : a + CHUNK]
        lo, hi = index.ranges(words, sizes)
        count = np.maximum(hi - lo, 0)
        window = np.repeat(np.arange(len(count)), count)
        at = index.order[np.repeat(lo, count) + np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)]
        same = at + sizes[window] <= index.end[at]
        window, at = window[same], at[same]
        for k in range(WINDOW):  # codes may collide, hashes don't
            same = (sizes[window] <= k) | (index.h[np.minimum(at + k, len(index.h) - 1)] == words[window, k])
            window, at = window[same], at[same]
        found.append((window + a, at))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))


Match = tuple[str | None, int, int]


def hits(texts: pa.Array, parts: list[Items] | PartList, spans: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[Match]]]]:
    """For each shard of texts: words, hit words and, with spans, longest matches (item id, first word, words) of each document."""
    data, offs = tx.column_bytes(texts)
    for i, j in tx.blocks(offs, SHARD):
        part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, first = tx.tokens(part, o, "alnum")
        h = tx.hashes(part, starts, ends)
        cover = np.zeros(len(h) + 1, np.int64)
        found: list[set[Match]] = [set() for _ in range(j - i)]
        index = Suffixes(h, first) if len(h) else None
        for items in parts if index else ():
            window, at = occurrences(index, items)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + items.sizes[window], -1)
            if spans and len(at):
                _matches(window, at, first, items, found)
        hit = tx.per_doc((np.cumsum(cover[:-1]) > 0).astype(np.int64), first)
        yield np.diff(first), hit, [sorted(f, key=lambda m: (m[0] is not None, *m)) for f in found]


def _matches(window: np.ndarray, at: np.ndarray, first: np.ndarray, items: Items, found: list[set[Match]]) -> None:
    """Adds the longest matches of a part's items. Windows of one size that start at neighbouring words are one stretch."""
    by = np.lexsort((at, items.sizes[window]))
    window, at = window[by], at[by]
    size, doc = items.sizes[window], np.searchsorted(first, at, "right") - 1
    cut = np.ones(len(at), bool)
    cut[1:] = (np.diff(at) != 1) | (np.diff(size) != 0) | (np.diff(doc) != 0)
    start = np.flatnonzero(cut)
    for a, b in zip(start.tolist(), np.append(start[1:], len(at)).tolist(), strict=True):
        d, place, words, own = int(doc[a]), int(at[a] - first[doc[a]]), int(size[a]), window[a:b].tolist()
        for item in sorted({int(x) for w in set(own) for x in items.items[items.items_from[w] : items.items_from[w + 1]]}):
            found[d].update((items.ids[item], place + k, n + words - 1) for k, n in items.automaton(item).matches(own))


class PartList:
    """The parts of a stored benchmark one after the other; a worker keeps a few of them."""

    _loaded: OrderedDict[str, Items] = OrderedDict()

    def __init__(self, stored: Stored, names: list[str]):
        self.stored, self.names = stored, names

    def __iter__(self) -> Iterator[Items]:
        for name in self.names:
            key = f"{self.stored.folder}/{name}"  # no other benchmark has this folder
            if key not in self._loaded:
                self._loaded[key] = Items.load(self.stored, name)
            self._loaded.move_to_end(key)
            while len(self._loaded) > KEPT:
                self._loaded.popitem(last=False)
            yield self._loaded[key]


def encode_benchmark(bench: DataFrame, item_id: str = "item_id", text: str = "text") -> PartList:
    """Writes the benchmark's windows, by tasks, as parts of about PART bytes of text (a longer item is not cut).

    Rows without text have no words; items without id are items too, all of them that of no id.
    """
    spark = bench.sparkSession
    rows = bench.select(F.col(item_id).cast("string").alias("_i"), F.col(text).alias("_t")).where("_t is not null")
    n = 1 + rows.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()[0] // PART
    folder = new_path(spark, "benchmark")

    def encode(batches):
        ids, texts = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        if ids:
            saving = Saving(folder, "part")
            saving.add(**Items.of(ids, texts).arrays())
            yield pa.RecordBatch.from_arrays([pa.array([saving.close()])], names=["name"])

    dealt = rows.repartition(int(n), F.xxhash64("_i", "_t")).sortWithinPartitions("_i", "_t")
    # one name for each megabyte of benchmark
    return PartList(Stored(folder), sorted(r[0] for r in dealt.mapInArrow(encode, "name string").collect()))


FOUND = "array<struct<item_id:string,first_word:bigint,words:bigint>>"


def find_contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id_col, n_words, n_hit, longest (the words of the longest match), matches.

    A window is 10 consecutive item words, or the whole item if it has fewer, but not none. ``matches`` are the
    longest verbatim matches, those that are part of no longer match with the item, by item id (null first) and place
    in the document. Null and empty texts have no words and no matches; so have all documents if the benchmark is
    empty. An item without id contaminates like any other and has a null id in matches; rows of an item that repeat
    count once. Other columns of docs are not read; an id column that has the name of another output column gets
    "_in" behind its own.
    """
    parts = encode_benchmark(bench, item_id, item_text)
    out_type = pa.list_(pa.struct([("item_id", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))

    def search(texts):
        got = list(hits(texts, parts))
        n, hit = (np.concatenate([g[k] for g in got]) if got else np.empty(0, np.int64) for k in (0, 1))
        found = [f for g in got for f in g[2]]
        return [
            pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([max((w for _, _, w in f), default=0) for f in found], pa.int64()),
            pa.array([[{"item_id": i, "first_word": a, "words": w} for i, a, w in f] for f in found], out_type),
        ]

    return arrow_rows(docs, search, f"n_words bigint, n_hit bigint, longest bigint, matches {FOUND}", id_col, text)


def remove_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, all columns, without the documents in which a benchmark window occurs; null and empty texts stay."""
    parts = encode_benchmark(bench, item_id, item_text)

    def clean(texts):
        found = [g[1] for g in hits(texts, parts, spans=False)]
        return np.concatenate(found) == 0 if found else np.empty(0, bool)

    return keep_rows(docs, clean, text)


def items_digest(matches_col: str = "matches"):
    """(n_items, items_sha256) of a matches column; a null id counts as an item and is not in the digest."""
    ids = F.array_distinct(F.transform(matches_col, lambda m: m["item_id"]))
    return F.size(ids).cast("long"), F.sha2(F.array_join(F.array_sort(ids), ",").cast("binary"), 256)


def op8(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n, sha = items_digest()
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with i as (select cast(item_id as varchar) as item_id, {_WORDS.format("text")} as w from benchmark where text is not null),
iw as (select distinct item_id, z, array_to_string(w[p:p + z - 1], ' ') as k
    from (select item_id, w, least(len(w), 10) as z, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from i where len(w) > 0)),
d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
h as (select doc_id, p, z, item_id from (select doc_id, z, p, array_to_string(w[p:p + z - 1], ' ') as k
    from (select doc_id, w, z, unnest(range(1, len(w) - z + 2)) as p from d, (select distinct z from iw))) join iw using (z, k)),
c as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(p, p + z)) as x from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c on d.doc_id = c.doc_id left join t on d.doc_id = t.doc_id
"""
