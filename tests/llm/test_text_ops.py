"""Operators against plain versions, on rows with nulls, copies, ties and clashing columns."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import decontaminate, lm, mixing, near_dup, sharding, token_files
from quire.llm import text as tx
from tests.llm import brute
from tests.llm.conftest import TEXTS

public_tokenizers = pytest.importorskip("public_tokenizers")
LOWER = {k: k + 32 for k in range(65, 91)}
LETTERS = st.text(alphabet="aAbBé1,.'<|> \n\t!ß漢", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(LETTERS, max_size=6))
def test_tokens_are_those_of_the_patterns(texts):
    import re

    data, offs = tx.column_bytes(pa.array(texts, pa.string()))
    for kind, pattern in (("alnum", "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), ("space", "[^\x20\x09-\x0d]+")):
        starts, ends, first = tx.tokens(data, offs, kind)
        got = [[data[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first, first[1:], strict=False)]
        if kind == "alnum":  # A-Z count as a-z
            assert [[w.translate(LOWER) for w in g] for g in got] == [re.findall(pattern, t.translate(LOWER)) for t in texts]
        else:
            assert got == [re.findall(pattern, t) for t in texts]


def test_hashes_ignore_case_and_place():
    data, offs = tx.column_bytes(pa.array(["Foo foo FOO bar", "foo"]))
    h = tx.hashes(data, *tx.tokens(data, offs, "alnum")[:2])
    assert len(set(h.tolist())) == 2 and h[0] == h[1] == h[2] == h[4]


BENCH = [("q1", "quick brown fox jumps over the lazy dog and runs far"), ("q2", "One TWO"), ("q3", None), (None, "text without any"), ("q4", "..."), ("q2", "One TWO"), ("q5", "word " * 12)]


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    found = decontaminate.find_contamination(docs, bench)
    n, sha = decontaminate.items_digest()
    got = sorted(map(str, found.select("doc_id", "n_words", "n_hit", n, sha).collect()))
    items = [(i, t) for i, t in BENCH if t]
    want = [(t[0], *x) for t, x in zip(TEXTS, brute.contamination([t[1] for t in TEXTS], items), strict=True)]
    names = found.select("doc_id", "n_words", "n_hit", n.alias("n"), sha.alias("sha"))
    assert sorted(map(str, (tuple(r) for r in names.collect()))) == sorted(map(str, want)) and got
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(x[1] == 0 for x in brute.contamination([t[1] for t in TEXTS], items))
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_longest_matches_have_places():
    items = decontaminate.Items.of(["a"], [" ".join(f"w{k}" for k in range(15))])
    text = "x y " + " ".join(f"w{k}" for k in range(2, 14)) + " z"
    (_, hit, found), = decontaminate.hits(pa.array([text]), [items])
    assert hit.tolist() == [12] and found == [[("a", 2, 12)]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("aab"), max_size=60), st.lists(st.lists(st.sampled_from("aab"), max_size=40), max_size=3))
def test_longest_matches_of_repetitive_texts(text, items):
    bench = [(f"i{k}" if k else None, " ".join(t)) for k, t in enumerate(items)]
    got = list(decontaminate.hits(pa.array([" ".join(text)]), [decontaminate.Items.of([i], [t]) for i, t in bench]))
    assert set(got[0][2][0]) == brute.longest_matches(" ".join(text), bench)
    assert got[0][1][0] == brute.contamination([" ".join(text)], bench)[0][1]


def test_repeated_words_are_not_multiplied():
    import time

    began = time.perf_counter()
    items = decontaminate.Items.of(["a", "b"], ["word " * 20000, "on and " * 10000])
    got = list(decontaminate.hits(pa.array(["word " * 20000 + "on and " * 10000]), [items]))
    assert got[0][1].tolist() == [40000] and got[0][2] == [[("a", 0, 20000), ("b", 20000, 20000)]]
    assert time.perf_counter() - began < 5


def test_many_benchmarks_in_one_session(spark):
    texts = [f"{k} some words before item{k} has one two three four five six seven and after {k}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "matches long, text string").coalesce(1)
    for k in range(40):
        items = [(f"q{k}", f"before item{k} has one two three four five six seven and")]
        found = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id string, text string"), "matches")
        assert found.columns == ["matches_in", "n_words", "n_hit", "longest", "matches"]
        got = [(r["n_words"], r["n_hit"], len(r["matches"])) for r in sorted(found.collect())]
        assert got == [x[:3] for x in brute.contamination(texts, items)]


def test_several_benchmark_parts_make_one_answer(spark, docs, monkeypatch):
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    n, sha = decontaminate.items_digest()
    whole = decontaminate.find_contamination(docs, bench).select("doc_id", "n_hit", sha).collect()
    monkeypatch.setattr(decontaminate, "PART", 30)
    parts = decontaminate.find_contamination(docs, bench).select("doc_id", "n_hit", sha).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 10**12), max_size=700), st.integers(0, 5))
def test_elias_fano(values, more):
    values = sorted(values)
    universe = (values[-1] if values else 0) + more
    coded = token_files.EliasFano.encode(np.array(values, np.int64), universe)
    back, _ = token_files.EliasFano.from_bytes(memoryview(coded.to_bytes()), 0)
    assert back.values().tolist() == values
    assert [back.select(k) for k in range(0, len(values), 37)] == values[::37]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é.,'<|>s1! \ń…漢", max_size=30), max_size=8))
def test_words_encode_like_whole_texts(texts):
    enc = token_files.encoder(public_tokenizers.path("word_bpe_49k.json"))
    got = [block[offs[k] : offs[k + 1]].tolist() for block, offs in enc(pa.array(texts, pa.string())) for k in range(len(offs) - 1)]
    assert got == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = token_files.encoder(path)
    token_files.write_tokens(docs, path, f"file://{tmp_path}/t")
    rows = sorted(token_files.read_tokens(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted((t[0] for t in TEXTS), key=lambda i: (i is not None, i or 0))
    want = sorted((str(t[0]), zlib.crc32(np.array(enc.tok.encode(t[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for t in TEXTS)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in rows) == want
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    token_files.write_tokens(empty, path, f"file://{tmp_path}/e")
    assert token_files.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    raw = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    assert token_files.words_stand_apart(raw)
    for part, other in (("normalizer", None), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}), ("normalizer", {"type": "Sequence", "normalizers": [{"type": "NFC"}]})):
        (tmp_path / "t.json").write_text(json.dumps(raw | {part: other}))
        assert not token_files.words_stand_apart(raw | {part: other})
        enc = token_files.Encoder(f"{tmp_path}/t.json")
        texts = ["Hello World  don't 12", None, "", "AbC <|endoftext|> é"]
        got = [block[offs[k] : offs[k + 1]].tolist() for block, offs in enc(pa.array(texts)) for k in range(len(offs) - 1)]
        assert got == [enc.tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tx, "hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    enc = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["alpha bravo gamma ALPHA delta <b> <B> <|endoftext|>", "bravo gamma"]
    got = [block[offs[k] : offs[k + 1]].tolist() for block, offs in enc(pa.array(texts)) for k in range(len(offs) - 1)]
    assert got == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_one_document_of_a_file():
    raw = token_files.pack(np.array([1, 2, 3, 4], "<u2").tobytes(), 2, [None, -5, 9], [1, 0, 3])
    file = token_files.TokenFile(raw)
    assert file.doc_ids() == [None, -5, 9] and file.document(2).tolist() == [2, 3, 4] and file.document(1).tolist() == []


def test_sharding(docs, empty):
    out = sharding.shard_documents(docs, 3).collect()
    assert len(out) == len(TEXTS) and all(r["size"] == len((r["text"] or "").encode()) + 1 for r in out)
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert sharding.shard_documents(empty, 3).count() == 0


def test_shards_are_near_equal_and_cut_large_groups(spark):
    rows = [(k, "same text " * 20 if k % 3 == 0 else f"text {k} " * (k % 40)) for k in range(3000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    sizes = [r[0] for r in out.groupBy("shard").agg({"size": "sum"}).select("sum(size)").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 400
    again = sharding.shard_documents(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7), 8)
    assert out.select("doc_id", "shard", "slot").exceptAll(again.select("doc_id", "shard", "slot")).isEmpty()


def test_shards_follow_the_keys(spark):
    # plain version: rows in the order of their keys, cut where the sum of sizes comes nearest to each share
    rows = [(k, f"text {k % 700} " * (1 + k % 50)) for k in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(sharding.shard_documents(frame, 4).collect(), key=lambda r: (r["shard"], r["slot"]))
    key = {r[0]: (r[1], r[2]) for r in frame.selectExpr("doc_id", "shiftrightunsigned(xxhash64(text), 1)", "shiftrightunsigned(xxhash64(doc_id, text, 7), 1)").collect()}
    keys = [key[r["doc_id"]] for r in out]
    assert keys == sorted(keys)
    total, upto, ends = sum(r["size"] for r in out), 0, {}
    for r in out:
        upto += r["size"]
        ends[r["shard"]] = upto
    largest = max(r["size"] for r in out)
    assert all(abs(ends[i] - total * (i + 1) / 4) <= max(0.001 * total / 4, largest / 2) for i in range(4))


def test_equal_rows_are_cut(spark):
    rows = [(7, "one text " * 30, None)] * 3000 + [(k, f"other {k}", k) for k in range(500)] + [(None, None, None)] * 40
    frame = spark.createDataFrame(rows, "doc_id long, text string, size long").repartition(5)
    out = sharding.shard_documents(frame, 8).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out) == sorted((str(r[0]), r[1] or "") for r in rows)
    sizes, slots = {}, {}
    for r in out:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * 271
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_mixing(docs, empty):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(TEXTS)
    sizes: dict = {}
    for _, t, s in TEXTS:
        sizes[s] = sizes.get(s, 0) + len([w for w in (t or "").split()])
    want = brute.mixed_targets(sizes)
    for r in out:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    assert mixing.mix_sources(empty).count() == 0


def test_targets_are_the_fixed_point(spark):
    rng = np.random.default_rng(0)
    for _ in range(6):
        named = {(f"s{k}" if k else None): int(n) for k, n in enumerate(rng.integers(0, 60, rng.integers(1, 9)))}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(named.items()), "source string, source_size long")).collect()}
        want = brute.mixed_targets(named)
        assert got.keys() == want.keys() and all(abs(got[s] - t) < 1e-6 for s, t in want.items())
        assert abs(sum(want.values()) - 1.5 * sum(named.values())) < 1e-6


def test_targets_of_many_sources_in_several_ranges(spark):
    drawn = np.random.default_rng(5).choice([0, 1, 7, 1000, 10**6, 123_456_789], 900)
    named = {f"s{k:04}" if k else None: int(n) for k, n in enumerate(drawn)}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = mixing.targets(spark.createDataFrame(list(named.items()), "source string, source_size long")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = brute.mixed_targets(named)
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(want) and len(rows) == 900


def test_mixing_takes_what_lies_below_the_thresholds(spark):
    from pyspark.sql import functions as F

    rows = [(k, "w " * (k % 17), f"s{k % 7 % 3}" if k % 5 else None) for k in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(frame.withColumn("key", F.xxhash64("doc_id", "text", "source"))).collect()
    assert [r["copies"] for r in got] == brute.mixed_copies([(r["key"], r["source"], r["size"]) for r in got])


def test_mixing_meets_targets(spark):
    rows = [(k, "w " * (1 + k % 30), f"s{0 if k % 3 == 0 else k % 11}") for k in range(4000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in out.groupBy("source").agg({"taken": "sum", "target": "first"}).collect():
        assert abs(r["sum(taken)"] - r["first(target)"]) <= 30


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, docs, empty, order, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 3000)
    train = [t[1] for t in TEXTS if zlib.crc32(str("" if t[0] is None else t[0]).encode()) % 7 != 2]
    model = lm.train(docs.where(~(lm.crc_mod("doc_id", 7) == 2)), order=order)
    want = brute.kneser_ney(train, [t[1] for t in TEXTS], lm.discounts, order)
    got = sorted((tuple(r) for r in lm.score(docs, model).collect()), key=str)
    assert lm.score(docs, model).columns == ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    want = sorted(((t[0], *w) for t, w in zip(TEXTS, want, strict=True)), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want] and model.tokens == want[0][3]
    assert np.allclose([g[3:] for g in got], [w[4:] for w in want])
    if order == 2:
        nothing = lm.train(empty)
        assert nothing.tokens == 0 and lm.score(docs, nothing).count() == len(TEXTS) and lm.score(empty, model).count() == 0


def test_language_model_of_many_texts(spark, monkeypatch):
    # counts over 255, several tasks, flushes and shards
    monkeypatch.setattr(lm, "KEPT", 200)
    monkeypatch.setattr(lm, "SUMS", 100)
    monkeypatch.setattr(lm, "BLOCK", 2000)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(1, 60)) if x < 500) for _ in range(400)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n_tokens long, text string").repartition(5)
    model = lm.train(frame, order=3)
    got = sorted(tuple(r) for r in lm.score(frame, model, "n_tokens").collect())
    want = brute.kneser_ney(texts, texts, lm.discounts, 3)
    assert [g[:3] for g in got] == [(k, *w[:2]) for k, w in enumerate(want)] and model.tokens == want[0][2]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want])


def test_probabilities_sum_to_one(spark):
    model = lm.train(spark.createDataFrame([("a b a c",), ("b a",), ("a a b",)], "text string"))
    # over all one-word texts and the empty one, the first tokens' probabilities: by the model's own lookups
    first = {w: model.score(pa.array([w]))[3][0] for w in ("a", "b", "c", "unknown")}
    last = {w: _conditional(model, w) for w in first}
    total = sum(10 ** (first[w] - last[w]) for w in first) + 10 ** model.score(pa.array([""]))[3][0]
    assert abs(total - 1) < 1e-9


def _conditional(model, word):
    """log10 P(end | word), from the stored counts."""
    data, offs = tx.column_bytes(pa.array([word]))
    words, slots, _ = lm.sequences(data, offs, 2)
    context, gram = lm.gram_hashes(words, slots, 2)
    sums, c = model.words.sums(context[-1:].view(np.int64))[0], model.grams[2].counts(gram[-1:].view(np.int64))[0]
    end = model.words.sums(words[-1:].view(np.int64))[0]
    d1, d2 = np.array(model.discounts[1]), np.array(model.discounts[2])
    p = max(end[1] - d1[min(end[1], 3)], 0) / model.pairs + d1[1:] @ np.array(model.classes) / model.pairs / (model.different + 1)
    if sums[2]:
        p = max(c - d2[min(c, 3)], 0) / sums[2] + sums[3:6] @ d2[1:] / sums[2] * p
    return np.log10(p)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in rng.integers(0, 500, 300)]
    texts = [" ".join(base), " ".join(base + base[:60]), " ".join(base * 3), " ".join(base[:150] * 2 + base)]
    data, offs = tx.column_bytes(pa.array(texts))
    sh, first = near_dup.shingles(data, offs)
    sig = near_dup.signatures(sh, first)
    sets = [near_dup.multiset(sh[a:b]) for a, b in zip(first, first[1:], strict=False)]
    for a in range(4):
        for b in range(a):
            assert abs((sig[a] == sig[b]).mean() - near_dup.overlap(sets[a], sets[b])) < 0.16


def test_near_duplicates(spark, docs, empty):
    rng = np.random.default_rng(2)
    rows = [(t[0], t[1]) for t in TEXTS]
    base = [f"w{k}" for k in rng.integers(0, 300, 120)]
    for k in range(60):  # copies that differ in a few words, so that some pairs are under the threshold
        own = list(base)
        for at in rng.integers(0, 120, 1 + k % 4):
            own[at] = f"x{k}"
        rows.append((100 + k, " ".join(own)))
    frame = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, class_id string, _c string")
    got = sorted(map(str, (tuple(r) for r in near_dup.classify(frame.drop("_c")).select("doc_id", "class_id").collect())))
    want = [c if t is not None else i for (i, t), c in zip(rows, brute.near_classes(rows), strict=True)]
    assert got == sorted(map(str, zip([i for i, _ in rows], want, strict=True)))
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["1", "4", "5", "None", "7", "8", "9", "10"])
    assert near_dup.classify(empty).count() == 0 and near_dup.keep_one(empty).count() == 0


def _signed(monkeypatch, texts, sig):
    """(signatures, short signatures) that the operator makes of texts whose registers are sig."""
    monkeypatch.setattr(near_dup, "signatures", lambda sh, first: sig)
    batch = pa.RecordBatch.from_arrays([pa.array([b"a", b"b"]), pa.array([0, 1]), pa.array(texts)], names=["_node", "_id", "_text"])
    (out,) = near_dup._sign([batch])
    return out.column("_sig"), out.column("_short")


def _tiled(sig, short):
    """Pairs from the tiles of all buckets that two nodes in different components share."""
    width = 4 * near_dup.BAND
    bands = [[int.from_bytes(hashlib.md5(bytes([k]) + x.as_py()[k * width : (k + 1) * width]).digest()[:7]) for k in range(near_dup.REGISTERS // near_dup.BAND)] for x in sig]
    shared = [(k, a) for k, (a, b) in enumerate(zip(*bands, strict=True)) if a == b]
    one = lambda x, y: pa.array([x, y], pa.int64())
    names = ["_bucket", "_i", "_j", "_block", "_nid", "_c", "_band", "_short", "_bands"]
    tiles = [pa.RecordBatch.from_arrays([one(a, a), one(0, 0), one(0, 0), one(0, 0), one(0, 1), one(0, 1), one(k, k), short, pa.array(bands, pa.list_(pa.int64()))], names=names) for k, a in shared]
    return [tuple(r.values()) for t in near_dup._tile_pairs(tiles, 0.8) for r in t.to_pylist()], len(shared)


_LONG = [f"w{k}" for k in range(200)]


def test_tiles_keep_pairs_that_agree_falsely_in_an_earlier_band(monkeypatch):
    # registers of the first band agree in their last 8 bits only, so it makes two buckets
    sig = np.tile(np.random.default_rng(0).integers(0, 2**32, near_dup.REGISTERS, np.uint32), (2, 1))
    sig[1, : near_dup.BAND] ^= np.uint32(256)
    pairs, shared = _tiled(*_signed(monkeypatch, [" ".join(_LONG), " ".join([*_LONG[:-1], "x"])], sig))
    assert shared == 31 and pairs == [(0, 1)]


def test_no_estimate_rules_out_similar_texts(monkeypatch):
    # similarity 0.97, but registers that agree in one band only
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 2**32, (2, near_dup.REGISTERS), np.uint32)
    sig[1, 20:24] = sig[0, 20:24]
    texts = [" ".join(_LONG), " ".join([*_LONG[:-1], "x"])]
    sig, short = _signed(monkeypatch, texts, sig)
    assert _tiled(sig, short) == ([(0, 1)], 1)
    star = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), short.slice(0, 1), short.slice(1, 1)], names=["_a", "_b", "_x", "_y"])
    assert sum(b.num_rows for b in near_dup._alike(0.8)([star])) == 1


def test_digest_of_items(spark):
    frame = spark.createDataFrame([([],), ([("b", 0, 10), ("a", 3, 12), ("b", 40, 10), (None, 1, 10)],)], f"matches {decontaminate.FOUND}")
    n, sha = decontaminate.items_digest()
    got = [tuple(r) for r in frame.select(n, sha).collect()]
    assert got == [(0, hashlib.sha256(b"").hexdigest()), (3, hashlib.sha256(b"a,b").hexdigest())]


def test_large_buckets_meet_by_length(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 8)
    # texts that share half their words fill common buckets; some of them are similar in pairs
    rng = np.random.default_rng(3)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for k in range(60):
        own = shared + [f"o{k // 2}-{j}" for j in range(20 + k // 2 * 3)]
        if k % 2:
            own[-1] = f"z{k}"
        rows.append((k, " ".join(own)))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.near_classes(rows)
    assert [got[k] for k in range(60)] == want and rng is not None


def test_near_pairs_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(150):
        own = [f"w{k}-{j}" for j in range(100)]
        # one changed word in n takes 5 shingles of 96: similarities from 0.8 to 0.9
        other = list(own)
        for at in rng.choice([10, 50, 90], rng.integers(1, 3), replace=False):
            other[at] = f"x{k}-{at}"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == brute.near_classes(rows)


def test_intermediate_tables_can_be_removed(spark, tmp_path):
    from quire.llm import shared

    table = shared.written(spark.range(3), "x")
    path = table.inputFiles()[0].removeprefix("file://")
    assert table.count() == 3
    shared.remove_intermediate(spark)
    import os

    assert not os.path.exists(path)
