"""Sharding by histogram sort.

Rows are ordered by a key of two 64-bit hashes: of the text, then of the whole row, so copies of a text lie
together. The driver holds a probe interval for every splitter. Each round counts the exact bytes in
sub-buckets of all open intervals across all partitions and narrows each interval to the sub-bucket that
holds its target, until a bucket edge meets the tolerance or the key is used up. A splitter that then lies inside a
group of rows that are equal in every column cuts the group by number: such a group travels as one row and its
count. All other rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Bits resolved in each round, over the 63-bit text key and then the 63-bit row key.
BITS, KEY_BITS = 9, 63
#: Rows of a cut group that one task makes again from its one row.
PIECE = 1 << 14

#: A cut: (k1, k2, row, rows). Rows with a lesser key go left; of the ``rows`` equal ones with this key, the first ``row`` too.
Cut = tuple[int, int, int, int]


def find_splitters(keys: DataFrame, parts: int, tolerances: dict[int, float], loose: float) -> tuple[int, list[Cut]]:
    """keys: (_k1, _k2, _w). Total weight, and parts-1 ascending splitters.

    Splitter i aims at i/parts of the weight, within tolerances.get(i, loose) of the whole weight over ``parts``.
    Of the histograms the driver is sent, for each open splitter, the one bucket that holds its target.
    """
    total = keys.agg(F.coalesce(F.sum("_w"), F.lit(0)).cast("long")).first()[0]
    if not total:
        step = (1 << KEY_BITS) // parts
        return 0, [(i * step, 0, 0, 0) for i in range(1, parts)]
    done: dict[int, Cut] = {}
    # splitter -> (level, prefix, k1 of level 0 once level is 1, weight below the interval)
    open_ = {i: (0, 0, 0, 0) for i in range(1, parts)}
    level, shift = 0, KEY_BITS
    while open_:
        # those at the first key go on until it is used up or told, then those at the second
        if level == 0 and (shift == 0 or all(x[0] for x in open_.values())):
            level, shift = 1, KEY_BITS
        waiting = {i: open_.pop(i) for i in [i for i, x in open_.items() if x[0] != level]}
        shift -= BITS
        key = F.col("_k1" if level == 0 else "_k2")
        prefix, owner = F.shiftright(key, shift + BITS), F.lit(0).cast("long") if level == 0 else F.col("_k1")
        # at most one row a splitter
        spark = keys.sparkSession
        intervals = F.broadcast(spark.createDataFrame(sorted({(p, k1) for _, p, k1, _ in open_.values()}), "_p long, _t long"))
        wanted = F.broadcast(spark.createDataFrame([(i, p, k1, total * i / parts - below) for i, (_, p, k1, below) in open_.items()], "_i int, _p long, _t long, _aim double"))
        rows = keys.withColumns({"_kp": prefix, "_kt": owner}).join(intervals, (F.col("_kp") == F.col("_p")) & (F.col("_kt") == F.col("_t")), "left_semi")
        hist = rows.groupBy("_kp", "_kt", F.shiftright(key, shift).alias("_b")).agg(F.sum("_w").alias("_bw"), F.count("*").alias("_n"), *(f(c).alias(f"_{n}{c[-1]}") for c in ("_k1", "_k2") for n, f in (("lo", F.min), ("hi", F.max))))
        upto = F.sum("_bw").over(Window.partitionBy("_kp", "_kt").orderBy("_b"))
        hit = hist.withColumn("_upto", upto).join(wanted, (F.col("_kp") == F.col("_p")) & (F.col("_kt") == F.col("_t")))
        hit = hit.where((F.col("_upto") > F.col("_aim")) & (F.col("_upto") - F.col("_bw") <= F.col("_aim")))
        for i, aim, b, w, n, above, lo1, hi1, lo2, hi2 in hit.select("_i", "_aim", "_b", "_bw", "_n", "_upto", "_lo1", "_hi1", "_lo2", "_hi2").collect():
            _, _, k1, below = open_.pop(i)
            before = above - w
            off, edge = min((aim - before, b), (above - aim, b + 1))
            if off <= tolerances.get(i, loose) * total / parts:
                done[i] = (edge << shift, 0, 0, 0) if level == 0 else (k1, edge << shift, 0, 0)
            elif (lo1, lo2) == (hi1, hi2):  # rows of one key
                row = round((aim - before) / w * n)
                done[i] = (lo1, lo2, row, n) if 0 < row < n else (lo1, lo2 + (row > 0), 0, 0)
            elif level == 0 and lo1 == hi1:
                open_[i] = (1, 0, lo1, below + before)
            else:
                open_[i] = (level, b, k1, below + before)
        open_ |= waiting
    return total, sorted(done.values())


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", tolerance: float = 0.001) -> DataFrame:
    """Adds size (long), shard (int) and slot (long, gapless from 0 in each shard) to docs; shards differ little in bytes.

    A row weighs the UTF-8 bytes of its text (null: none) plus 1. Shard boundaries lie within ``tolerance`` of
    the even share where a group of equal texts allows it, and cut the group where not: then the boundary is the
    nearest row, among rows equal in every column too. Columns named size, shard or slot are replaced. An empty table
    gives an empty one. Nothing depends on the order or partitions of the input.

    The exchange goes to several partitions a shard, so no task has to hold a whole shard; row numbers
    count within a partition and are shifted by the partitions before it. Rows of a group that is cut have the last
    slots of their partition.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c in ("size", "shard", "slot")])
    k1 = F.shiftrightunsigned(F.xxhash64(F.col(text)), 1)
    k2 = F.shiftrightunsigned(F.xxhash64(*[F.to_json(F.struct(c)) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in docs.dtypes], F.lit(7)), 1)
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")
    keys = written(docs.select(k1.alias("_k1"), k2.alias("_k2"), size.alias("_w")), "keys")
    each = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    parts = shards * each
    _, cuts = find_splitters(keys, parts, {i: tolerance * each for i in range(each, parts, each)}, 0.1)
    keyed = docs.withColumns({"_k1": k1, "_k2": k2, "size": size})
    spans = _spans(cuts)
    groups = None
    if spans:
        # at most two rows a cut
        groups = F.broadcast(spark.createDataFrame(spans, "_g1 long, _g2 long, _gp int, _from long, _to long, _before long"))
        same = (F.col("_k1") == F.col("_g1")) & (F.col("_k2") == F.col("_g2"))
        whole, keyed, keys = keyed, keyed.join(groups, same, "left_anti"), keys.join(groups, same, "left_anti")
    dealt = _placed(keyed, cuts).repartitionById(parts, "_part").sortWithinPartitions("_part", "_k1", "_k2")
    counts = _placed(keys, cuts).groupBy("_part").count()
    if spans:
        counts = counts.withColumn("_own", F.col("count")).unionByName(groups.select(F.col("_gp").alias("_part"), (F.col("_to") - F.col("_from")).alias("count"), F.lit(0).cast("long").alias("_own")))
        counts = counts.groupBy("_part").agg(F.sum("count").alias("count"), F.sum("_own").alias("_own"))
    else:
        counts = counts.withColumn("_own", F.col("count"))
    ahead = Window.partitionBy(F.floor(F.col("_part") / each)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("_part").alias("_bp"), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_base"), "_own")
    # base has one row a partition
    own = Window.partitionBy("_part").orderBy("_k1", "_k2")
    out = dealt.withColumn("_at", F.row_number().over(own) - 1)
    if spans:
        one = F.first(F.struct(*docs.columns, "size")).alias("_row")
        rows = whole.join(groups.select("_g1", "_g2").distinct(), same, "left_semi").groupBy("_k1", "_k2").agg(one)
        pieces = rows.join(groups, same).withColumn("_piece", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1, F.lit(PIECE).cast("long"))))
        pieces = pieces.join(F.broadcast(base), F.col("_gp") == F.col("_bp")).repartition(parts, "_gp", "_piece", "_k1")
        again = pieces.withColumn("_at", F.explode(F.sequence("_piece", F.least(F.col("_piece") + PIECE, F.col("_to")) - 1)))
        again = again.withColumn("_at", F.col("_own") + F.col("_before") + F.col("_at") - F.col("_from"))
        again = again.select("_row.*", F.col("_gp").alias("_part"), "_at")
        out = out.select(*docs.columns, "size", "_part", F.col("_at").cast("long")).unionByName(again)
    out = out.join(F.broadcast(base), F.col("_part") == F.col("_bp"))
    out = out.withColumn("shard", F.floor(F.col("_part") / each).cast("int")).withColumn("slot", (F.col("_base") + F.col("_at")).cast("long"))
    return out.select(*docs.columns, "size", "shard", "slot")


def _spans(cuts: list[Cut]) -> list[tuple[int, int, int, int, int, int]]:
    """(k1, k2, part, from, to, before) for the rows of each group that is cut: rows from up to to lie in part, behind
    ``before`` rows of other such groups."""
    out, filled = [], {}
    groups: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for k1, k2, row, rows in cuts:
        if rows:
            groups.setdefault((k1, k2), (rows, []))[1].append(row)
    for (k1, k2), (rows, inside) in sorted(groups.items()):
        part = sum((c[0], c[1], c[2]) <= (k1, k2, 0) for c in cuts)
        for a, b in zip([0, *sorted(inside)], [*sorted(inside), rows], strict=True):
            if a < b:
                out.append((k1, k2, part, a, b, filled.get(part, 0)))
                filled[part] = filled.get(part, 0) + b - a
            part += 1
    return out


def _placed(keyed: DataFrame, cuts: list[Cut]) -> DataFrame:
    """keyed with _part: how many cuts are at or below the row's key.

    The top bits of the key select, in a table of a few rows per cut, the cuts before them and those among them.
    """
    bits = max(8, len(cuts).bit_length() + 2)
    among: dict[int, list[tuple[int, int]]] = {}
    for cut in cuts:
        among.setdefault(min(cut[0] >> KEY_BITS - bits, (1 << bits) - 1), []).append(cut[:2])
    rows, before = [], 0
    for b in range(1 << bits):
        own = among.get(b, [])
        rows.append((b, before, own))
        before += len(own)
    table = keyed.sparkSession.createDataFrame(rows, "_b int, _before int, _own array<struct<a:bigint,b:bigint>>")
    below = F.filter("_own", lambda c: (c["a"] < F.col("_k1")) | ((c["a"] == F.col("_k1")) & (c["b"] <= F.col("_k2"))))
    found = keyed.join(F.broadcast(table), F.shiftright("_k1", KEY_BITS - bits).cast("int") == F.col("_b"))
    return found.withColumn("_part", F.col("_before") + F.size(below)).drop("_b", "_before", "_own")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_documents(docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
