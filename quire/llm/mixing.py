"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Each source has a budget of words. A document is taken ``floor(target / size of source)`` whole times, and
once more if its hash lies below the source's threshold. The threshold comes from histograms: words are
summed by source and hash bucket, the bucket in which the running sum meets the budget is found, and only
this boundary bucket is summed again by finer buckets, until the hash is used up. No row is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: The weights that sources get in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Bits of the hash that each round of histograms resolves; six rounds use up 60 bits.
BITS, ROUNDS = 10, 6
#: Most bytes of the table of sources that is broadcast.
SMALL = 16 << 20


def word_count(text: Column) -> Column:
    """Number of maximal runs without space and \\x09-\\x0D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources in code-point order, null last, weigh as ``weights``, repeating. Together they get ``share`` of all
    sizes; a target above ``most`` times its source's size stops there and the excess goes to the others by weight.
    The fixed point is found in closed form: with sources in order of the ratio size / weight, a source is full
    if the level that would fill it is at most the level the rest share. No task sees all sources: ranks and running
    sums are counted within ranges of sources. An empty table gives an empty one.
    """
    own = [F.col("source").isNull(), F.col("source")]
    t = _running(sizes.select("source", "source_size"), own, _rank=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    t = t.withColumn("_weight", weight).withColumn("_cap", most * F.col("source_size").cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    t = _running(t, [F.col("_ratio"), *own], _full=F.col("_cap"), _spent=F.col("_weight"))
    words, heavy = t.agg(F.sum("source_size"), F.sum("_weight")).first()
    t = t.withColumn("_level", (share * (words or 0) - F.col("_full")) / (F.lit(heavy or 0.0) - F.col("_spent")))
    # of the first source in order that stays below its cap
    open_ = F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", own[0].alias("_null"), "source", "_level"))
    level = t.agg(F.min(open_)["_level"]).first()[0]
    target = F.least(F.col("_cap"), F.lit(level).cast("double") * F.col("_weight")) if level is not None else F.col("_cap")
    return t.select("source", "source_size", target.alias("target"))


def _running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with the sums over all rows before each in a strict order: those of its own range and of the ranges before it."""
    placed = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row a range, and there are as many as shuffle partitions at most
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_range").agg(*(F.sum(x).alias(f"{n}_in") for n, x in sums.items()))
    ranges = ranges.select("_range", *(F.coalesce(F.sum(f"{n}_in").over(ahead), F.lit(0)).alias(f"{n}_ahead") for n in sums))
    counted = placed.withColumns({n: F.coalesce(F.sum(x).over(before), F.lit(0)) for n, x in sums.items()})
    return counted.join(F.broadcast(ranges), "_range").select(*rows.columns, *((F.col(n) + F.col(f"{n}_ahead")).alias(n) for n in sums))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds to docs: size, source_size (long), target (double), copies (int), taken (long, copies times size).

    Columns of these names that docs already has are replaced. A null source is a source; a null or empty text
    has size 0 and goes with its hash like any other; null ids are hashed as nulls. Rows equal in id, text and
    source get the same decision, so a rerun or a lost task changes nothing. An empty table gives an empty one.
    A source's taken words miss its target by less than the documents that share one 60-bit hash prefix.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    docs = docs.drop(*[c for c in docs.columns if c in made])
    key = F.xxhash64(F.col(id_col), F.col(text), F.col(source))
    sized = docs.select(F.col(source).alias("source"), key.alias("_key"), word_count(F.col(text)).alias("size"))
    narrow = written(sized, "sizes")
    top = 64 - BITS
    bucket = F.shiftrightunsigned("_key", top)
    first = written(narrow.groupBy("source", bucket.alias("_b")).agg(F.sum("size").alias("_words")), "histogram")
    t = targets(first.groupBy("source").agg(F.sum("_words").cast("long").alias("source_size")), weights, share, most)
    t = t.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    t = written(t.withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size")), "targets")
    running = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = t.select("source", F.col("_left"), F.lit(0).cast("long").alias("_prefix"))
    hist = first
    for r in range(ROUNDS):
        if r:
            shift = 64 - BITS * r
            inside = narrow.alias("n").join(bounds.alias("b"), F.expr("n.source <=> b.source") & (F.shiftrightunsigned("n._key", shift) == F.col("b._prefix")))
            hist = inside.select("n.source", F.shiftrightunsigned("n._key", shift - BITS).alias("_b"), "size").groupBy("source", "_b").agg(F.sum("size").alias("_words"))
        summed = hist.withColumn("_upto", F.sum("_words").over(running))
        met = summed.alias("h").join(bounds.alias("b"), F.expr("h.source <=> b.source")).where(F.col("_upto") > F.col("_left"))
        best = met.groupBy("h.source").agg(F.min(F.struct("h._b", (F.col("_left") - F.col("_upto") + F.col("_words")).alias("l"))).alias("m"))
        # a source whose budget is never met has no boundary: it keeps its prefix and the next round takes nothing from it
        bounds = written(best.select("source", F.col("m.l").alias("_left"), F.col("m._b").alias("_prefix")), f"bounds{r}")
    # the last bucket is one hash prefix: it is taken if that comes nearer to the budget
    last = narrow.alias("n").join(bounds.alias("b"), F.expr("n.source <=> b.source") & (F.shiftrightunsigned("n._key", 64 - BITS * ROUNDS) == F.col("b._prefix")))
    last = last.groupBy("n.source").agg(F.sum("size").alias("_words"), F.first("b._left").alias("_rest"), F.first("b._prefix").alias("_prefix"))
    cut = last.select(F.col("source").alias("_cs"), (F.col("_prefix") + (2 * F.col("_rest") >= F.col("_words")).cast("long")).alias("_cut"))
    rule = t.join(cut, F.expr("source <=> _cs"), "left").select(F.col("source").alias("_s"), "source_size", "target", "_whole", "_cut", (F.col("_left") > 0).alias("_some"))
    rule = written(rule, "rule")
    # sources are few; where they are not, both sides shuffle
    if rule.agg(F.count("*") * 64 + F.coalesce(F.sum(F.octet_length("_s")), F.lit(0))).first()[0] <= SMALL:
        rule = F.broadcast(rule)
    # text and hash are taken again rather than kept: one more scan against a shuffle of all texts
    below = F.when(F.col("_cut").isNull(), F.col("_some")).otherwise(F.shiftrightunsigned("_key", 64 - BITS * ROUNDS) < F.col("_cut"))
    out = docs.withColumn("_key", key).withColumn("size", word_count(F.col(text))).join(rule, F.col(source).eqNullSafe(F.col("_s")), "left")
    out = out.withColumn("copies", (F.col("_whole") + F.coalesce(below, F.lit(False)).cast("int")).cast("int"))
    out = out.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.drop("_s", "_key", "_whole", "_cut", "_some")


def op10(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
