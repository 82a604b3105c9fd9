"""Token-id files with Elias-Fano document boundaries.

A file holds a run of documents in ascending id order. Its head is big-endian, all else little-endian:

    "QEF1" | u32 bytes of the ids' width | u64 tokens | u64 documents | u64 null ids | i64 first id
    Elias-Fano of the documents' ends | Elias-Fano of id - first id | the concatenated ids | 0x0A

    Elias-Fano: u64 values | u64 universe | u32 low bits | u32 select samples | u64 bytes of low, of high
    | samples (u32: position of every 256th one) | low | high

Files are written and read by Spark's own file sources, so any store that Spark reaches will do: the text
writer puts the raw bytes of its one row and the closing 0x0A; ``binaryFile`` reads them back.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import TEXT_ROWS, batches_of, new_path, released

HEAD, EF_HEAD, EVERY = struct.Struct(">4sIQQQq"), struct.Struct("<QQIIQQ"), 256
#: Text bytes that one file takes, about.
FILE_BYTES = 16 << 20
#: Fixed value: the units that the tokenizer's file cuts a text into.
UNIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of integers from 0 to universe, in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, universe: int, bits: int, samples: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.universe, self.bits, self.samples, self.low, self.high = n, universe, bits, samples, low, high

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, int(universe // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((n + (universe >> bits) + 8) // 8 if n else 0, np.uint8)
        np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        places = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, universe, bits, ones[::EVERY].astype(np.uint32), low, high)

    def to_bytes(self) -> bytes:
        head = EF_HEAD.pack(self.n, self.universe, self.bits, len(self.samples), len(self.low), len(self.high))
        return head + self.samples.astype("<u4").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, universe, bits, samples, low, high = EF_HEAD.unpack_from(raw, at)
        at += EF_HEAD.size
        s = np.frombuffer(raw, "<u4", samples, at)
        lo = np.frombuffer(raw, np.uint8, low, at := at + 4 * samples)
        hi = np.frombuffer(raw, np.uint8, high, at := at + low)
        return cls(n, universe, bits, s, lo, hi), at + high

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.bits):
            place = i * self.bits + b
            out |= ((self.low[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(np.int64) << b
        return out

    def select(self, i: int) -> int:
        """Value i: from the nearest sample the one with this rank is found by byte counts."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, skip = int(self.samples[i // EVERY]), i % EVERY
        byte = place >> 3
        skip += int(_ONES[self.high[byte] & ((1 << (place & 7)) - 1)])
        while skip >= (ones := int(_ONES[self.high[byte]])):
            skip -= ones
            byte += 1
        bit = [b for b in range(8) if self.high[byte] >> b & 1][skip]
        return (byte * 8 + bit - i << self.bits) | int(self._low(np.array([i]))[0])

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((ones - i) << self.bits) | self._low(i)


def pack(ids: bytes, width: int, doc_ids: list[int | None], counts: list[int]) -> bytes:
    """One file's bytes, but for the closing 0x0A. doc_ids ascend, nulls first."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    first = int(known[0]) if len(known) else 0
    ends = np.cumsum(np.array(counts, np.int64))
    total = int(ends[-1]) if len(ends) else 0
    gaps = known.astype(np.uint64) - np.uint64(first & (1 << 64) - 1)
    head = HEAD.pack(b"QEF1", width, total, len(doc_ids), nulls, first)
    return b"".join([head, EliasFano.encode(ends, total).to_bytes(), EliasFano.encode(gaps, int(gaps[-1]) if len(gaps) else 0).to_bytes(), ids])


class TokenFile:
    """A file's bytes as a mapping: ``doc_ids``, ``ends`` and the ids of document i."""

    def __init__(self, raw: bytes):
        raw = memoryview(raw)
        magic, self.width, self.tokens, self.docs, self.nulls, self.first = HEAD.unpack_from(raw, 0)
        if magic != b"QEF1":
            raise ValueError("not a token file")
        self.ends, at = EliasFano.from_bytes(raw, HEAD.size)
        self.gaps, at = EliasFano.from_bytes(raw, at)
        self.ids = np.frombuffer(raw, f"<u{self.width}", self.tokens, at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.gaps.values().astype(np.uint64) + np.uint64(self.first & (1 << 64) - 1)).astype(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def words_stand_apart(tokenizer: dict) -> bool:
    """Whether a tokenizer's file says what ``Encoder`` needs to encode words for texts: white space parts units and is
    dropped, texts are lower-cased, units are those of UNIT, and a unit's last token ends in "</w>"."""
    steps = lambda part, inner: [dict(x) for x in (part or {}).get(inner, [part] if part else [])]
    normal, cut, model = steps(tokenizer.get("normalizer"), "normalizers"), steps(tokenizer.get("pre_tokenizer"), "pretokenizers"), tokenizer.get("model", {})
    blanks = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    split = {"type": "Split", "pattern": {"Regex": UNIT.pattern}, "behavior": "Removed", "invert": True}
    return (
        {"type": "Lowercase"} in normal
        and all(n in ({"type": "NFC"}, {"type": "Lowercase"}, blanks) for n in normal)
        and cut[:1] == [split]
        and [(c["type"], c.get("add_prefix_space"), c.get("use_regex")) for c in cut[1:]] in ([], [("ByteLevel", False, False)])
        and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", "</w>", None)
        and not tokenizer.get("post_processor")
        and not tokenizer.get("truncation")
        and not tokenizer.get("padding")
        and all(t["content"].startswith("<") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in tokenizer.get("added_tokens", []))
    )


class Encoder:
    """A tokenizer that encodes each different word of a block once, with a cache of words.

    It does so where the tokenizer's own file states that words may be encoded for texts (``words_stand_apart``); with
    any other tokenizer every whole text is encoded. Words are cut at spaces and line feeds, and between ASCII letters,
    digits and other signs, where a unit of the text ends too; words with an apostrophe or "<" stay whole, for
    contractions and special tokens. A-Z count as a-z, as for the tokenizer, but in words with "<". Words are told apart
    by their bytes. The cache has two generations of bounded size: what is met again moves to the young one.
    """

    KEEP, BLOCK = 200_000, 3 << 20

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.type = f"<u{self.width}"
        self.by_words = words_stand_apart(json.loads(self.tok.to_str()))
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)  # tokens that end a unit of the text
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word. Many words go in one line, which is cut by the number of units each has: a unit ends in a token of its own kind."""
        known: dict[str, bytes] = {}
        lined = [w for w in words if "<" not in w]
        for at in range(0, len(lined), 500):
            line = lined[at : at + 500]
            ids = np.array(self.batch([" ".join(line)], add_special_tokens=False)[0].ids, self.type)
            units = np.cumsum([1 if w.isalpha() else len(UNIT.findall(unicodedata.normalize("NFC", w).lower())) for w in line])
            cut = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
            if len(cut) != units[-1] + 1:
                continue  # letters whose lower case holds a mark, and the like: such words go one by one
            raw, a = ids.tobytes(), 0
            for w, b in zip(line, (cut[units] * self.width).tolist(), strict=True):
                known[w] = raw[a:b]
                a = b
        rest = [w for w in words if w not in known]
        known.update(zip(rest, (np.array(e.ids, self.type).tobytes() for e in self.batch(rest, add_special_tokens=False)), strict=True))
        return [known[w] for w in words]

    def _words(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first, bytes): the words, and the bytes by which they are told apart."""
        starts, ends, _ = tx.tokens(data, offs, "cut")
        kind = tx.classes("unit")[data]
        # two ASCII bytes of different kinds in one word: a unit ends between them, but near ' and <
        inner = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 1) & (kind[:-1] > 1)) + 1
        word = np.searchsorted(starts, inner, "right") - 1
        whole, signs = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
        whole[np.searchsorted(starts, np.flatnonzero(data == 39), "right") - 1] = True
        signs[np.searchsorted(starts, np.flatnonzero(data == 60), "right") - 1] = True
        inner = inner[~(whole | signs)[word]]
        inner = inner[~np.isin(inner, offs)] if len(inner) else inner
        low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        for k in np.flatnonzero(signs).tolist():
            low[starts[k] : ends[k]] = data[starts[k] : ends[k]]
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        return starts, ends, np.searchsorted(starts, offs), low

    def _different(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """(words, place of each word in them). Hashes find equal words; bytes tell whether they are."""
        h = tx.hashes(low, starts, ends)
        _, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        words = [low[a:b].tobytes() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        size, first = ends - starts, starts[where][inverse]
        same = size == size[where][inverse]
        # eight bytes at a time, whatever place they start at
        eight = np.ndarray((len(low),), "<u8", np.append(low, np.zeros(8, np.uint8)), 0, (1,))
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        live, k = np.flatnonzero(same & (starts != first)), 0
        while len(live):
            mask = masks[np.minimum(size[live] - k, 8)]
            same[live[((eight[starts[live] + k] ^ eight[first[live] + k]) & mask) != 0]] = False
            k += 8
            live = live[size[live] > k]
        # equal hashes of words that differ (or by case in words with "<")
        extra: dict[bytes, int] = {}
        for k in np.flatnonzero(~same).tolist():
            own = low[starts[k] : ends[k]].tobytes()
            inverse[k] = extra.setdefault(own, len(words) + len(extra))
        return words + list(extra), inverse

    def __call__(self, texts: pa.Array):
        """For each block of texts in turn: their ids in one array, and the n+1 offsets of the texts in it."""
        data, offs = tx.column_bytes(texts)
        for i, j in tx.blocks(offs, self.BLOCK):
            part, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            if not self.by_words:
                whole = [part[a:b].tobytes().decode() for a, b in zip(own.tolist(), own[1:].tolist(), strict=False)]
                ids = [np.array(e.ids, self.type) for e in self.batch(whole, add_special_tokens=False)]
                yield np.concatenate(ids), np.append(0, np.cumsum([len(x) for x in ids]))
                continue
            starts, ends, first, low = self._words(part, own)
            words, inverse = self._different(low, starts, ends)
            ids = self._ids(words)
            size = np.array([len(x) for x in ids], np.int64) // self.width
            at = np.cumsum(size) - size
            flat = np.frombuffer(b"".join(ids), self.type)
            size = size[inverse]
            upto = np.append(0, np.cumsum(size))
            yield flat[np.repeat(at[inverse] - upto[:-1], size) + np.arange(upto[-1])], upto[first]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        if len(self.young) > self.KEEP:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, words))
        new = []
        for k in [k for k, x in enumerate(found) if x is None]:
            if (x := self.old.get(words[k])) is None:
                new.append(k)
            else:
                self.young[words[k]] = found[k] = x
        for k, x in zip(new, self.encode([words[k].decode() for k in new]), strict=True):
            self.young[words[k]] = found[k] = x
        return found


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> None:
    """Writes every whole text of docs as ids, each document closed by end_id, to files under path.

    Documents ascend by id through the files in name order and within each; null ids come first, equal ids by
    their texts' hash. Null and empty texts are the end id alone. An empty table gives files without documents.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_tie"))
    # rows equal in id and text may be many: their place in the input lets the exchange deal them to several files
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(files, "_id", "_tie", "_row").sortWithinPartitions("_id", "_tie").select("_id", "_text")

    def encode(batches):
        enc = encoder(tokenizer)
        ids, doc_ids, counts = [], [], []
        for batch in batches:
            for block, offs in enc(batch.column(1)):
                ids.append(np.insert(block, offs[1:], end_id).tobytes())
                counts += (np.diff(offs) + 1).tolist()
            doc_ids += batch.column(0).to_pylist()
        raw = pack(b"".join(ids), enc.width, doc_ids, counts)
        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["raw"])

    with batches_of(spark, TEXT_ROWS):
        dealt.mapInArrow(released(encode), "raw binary").select(F.col("raw").cast("string").alias("value")).write.text(path)


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document of the files under path: doc_id, start (ids before it), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").load(path).withColumn("_file", F.regexp_extract("path", "part-(\\d+)", 1).cast("int"))
    tokens = F.conv(F.hex(F.substring("content", 9, 8)), 16, 10).cast("long")
    # one number per file; each file holds tens of megabytes of text
    totals = sorted(tuple(r) for r in files.select("_file", tokens.alias("n")).collect())
    before, run = {}, 0
    for f, n in totals:
        before[f] = run
        run += n

    def decode(batches):
        for batch in batches:
            for f, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = TokenFile(raw.as_buffer())
                ends = file.ends.values()
                starts = np.append(0, ends)[:-1]
                crcs = [zlib.crc32(file.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids(), pa.int64()), pa.array(starts + before[f], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return files.select("_file", "content").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_tokens(spark, path)
