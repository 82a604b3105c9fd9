"""The lookups, orderings and merges of document decoding as joins, windows and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine_sections(spine: DataFrame, manifest: DataFrame, entries: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, ord, path): sections in the spine's order. spine: ord, idref; manifest: ord, id, href; entries: path. The last item of an id counts."""
    hrefs = manifest.where(F.col("id").isNotNull() & F.col("href").rlike("(?i)Contents/section\\d+\\.xml$"))
    hrefs = hrefs.groupBy(doc, "id").agg(F.max_by("href", "ord").alias("href"))
    found = spine.join(hrefs, (spine[doc] == hrefs[doc]) & (spine["idref"] == hrefs["id"])).select(spine[doc], spine["ord"], "href")
    return found.join(entries, (found[doc] == entries[doc]) & (found["href"] == entries["path"]), "left_semi").withColumnRenamed("href", "path")


def ordered_text(df: DataFrame, keys: list[str], order: list[str], text: str, separator: str, out: str) -> DataFrame:
    """Texts of one key joined in order; nulls are left out."""
    own = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return df.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(own, lambda x: x["_t"]), separator).alias(out))


def merge_neighbours(df: DataFrame, keys: list[str], order: str, same: str, text: str, separator: str = "") -> DataFrame:
    """(keys, first_order, same, text, merged): runs of neighbours of one kind as one row."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce((~F.col(same).eqNullSafe(F.lag(same).over(w))) | F.lag(F.lit(1)).over(w).isNull(), F.lit(True))
    marked = df.withColumn("_new", changed.cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    out = marked.groupBy(*keys, "_island", same).agg(F.min(order).alias("first_order"), own.alias("_own"))
    return out.select(*keys, "first_order", same, F.array_join(F.transform("_own", lambda x: x["t"]), separator).alias(text), F.size("_own").alias("merged"))


def runs_from_changes(texts: DataFrame, changes: DataFrame, key: str, text: str = "text", at: str = "char_pos", shape: str = "shape_id") -> DataFrame:
    """(key, run_idx, shape, text): each change holds up to the next one; what lies past the text's end is empty."""
    w = Window.partitionBy(key).orderBy(at)
    spans = changes.withColumn("_to", F.lead(at).over(w)).withColumn("run_idx", F.row_number().over(w) - 1)
    out = texts.select(key, F.col(text).alias("_text")).where(F.length("_text") > 0).join(spans, key)
    end = F.greatest(F.coalesce("_to", F.length("_text")), F.col(at))
    return out.select(key, "run_idx", shape, F.expr(f"substring(_text, cast({at} as int) + 1, cast(greatest(coalesce(_to, length(_text)), {at}) - {at} as int))").alias(text), end.alias("char_end"))


def parent_rows(df: DataFrame, keys: list[str], seq: str = "seq", level: str = "level") -> DataFrame:
    """df with parent_seq: the nearest row before it of the level above; null at the top. Levels from 0, without a bound."""
    # a row stands in the group of its level, and as a child, with all its columns, in that of the level above
    roles = F.array(*[F.struct(F.lit(k).alias("child"), (F.col(level).cast("long") - int(k)).alias("of")) for k in (False, True)])
    child = F.col("_role.child")
    both = df.withColumn("_role", F.explode(roles)).select("_role", *[c if c in (*keys, seq) else F.when(child, F.col(c)).alias(c) for c in df.columns])
    # of equal seq the child stands first: its parent comes before it
    w = Window.partitionBy(*keys, "_role.of").orderBy(F.col(seq), child.desc()).rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.when(~child, F.col(seq)), ignorenulls=True).over(w)
    return both.withColumn("parent_seq", F.when(F.col(level) > 0, above)).where(child).select(*df.columns, "parent_seq")


def after_first(df: DataFrame, keys: list[str], seq: str, is_mark: Column, is_head: Column) -> DataFrame:
    """Heads that come after the first mark of their key: cells after the table record, so not captions."""
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_seen", F.max(is_mark.cast("int")).over(w)).where(is_head & (F.col("_seen") == 1)).drop("_seen")


def grouped_by_counts(items: DataFrame, counts: DataFrame, key: str, ord_col: str, group: str, count: str, last: int) -> DataFrame:
    """items with group: item n falls in the group whose share of the running counts holds it, one past all in ``last``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(ord_col)) - 1
    w = Window.partitionBy(key).orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("_end", F.sum(count).over(w)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(group, "_end"))).alias("_ends"))
    found = F.get(F.filter("_ends", lambda e: e["_end"] > F.col("_n")), F.lit(0))[group]
    return items.withColumn("_n", n).join(ends, key, "left").withColumn(group, F.coalesce(found, F.lit(last))).drop("_n", "_ends")


def grid_cells(cells: DataFrame, keys: list[str], rows: str = "row_count", cols: str = "col_count") -> DataFrame:
    """(keys, r, c, cell_idx): the cell at each place of a table; a span covers its places, the first cell to come keeps a place."""
    inside = cells.where((F.col("row") >= 0) & (F.col("row") < F.col(rows)) & (F.col("col") >= 0) & (F.col("col") < F.col(cols)))
    spread = inside.withColumn("r", F.explode(F.expr(f"sequence(row, least(row + row_span, {rows}) - 1)"))).withColumn("c", F.explode(F.expr(f"sequence(col, least(col + col_span, {cols}) - 1)")))
    return spread.groupBy(*keys, "r", "c").agg(F.min("cell_idx").alias("cell_idx"))


def picture_paths(refs: DataFrame, manifest: DataFrame, entries: DataFrame, doc: str = "doc_id", ref: str = "ref") -> DataFrame:
    """refs with path: the file of that name in BinData, else by the manifest's href in or out of BinData, else the name."""
    inside = lambda c: F.when(c.startswith("BinData/"), c).otherwise(F.concat(F.lit("BinData/"), c))
    own = refs.withColumn("_direct", F.concat(F.lit("BinData/"), F.col(ref)))
    first = manifest.groupBy(F.col(doc).alias("_d"), F.col("id").alias("_i")).agg(F.min_by("href", "ord").alias("_href"))
    own = own.join(first, (F.col(doc) == F.col("_d")) & (F.col(ref) == F.col("_i")), "left").drop("_d", "_i").withColumn("_inside", inside(F.col("_href")))
    for k, c in enumerate(("_direct", "_inside", "_href")):
        there = entries.select(F.col(doc).alias("_d"), F.col("path").alias(f"_p{k}")).distinct()
        own = own.join(there, (F.col(doc) == F.col("_d")) & (F.col(c) == F.col(f"_p{k}")), "left").drop("_d")
    return own.withColumn("path", F.coalesce("_p0", "_p1", "_p2", "_direct")).drop("_direct", "_href", "_inside", "_p0", "_p1", "_p2")


def with_templates(packages: DataFrame, templates: DataFrame, name: str = "name") -> DataFrame:
    """packages with data: the JSON of the same name, else that named default, else {}. templates: name, data; one row a name."""
    default = templates.where(F.col(name) == "default").select(F.col("data").alias("_default"))
    default = default.agg(F.coalesce(F.first("_default"), F.lit("{}")).alias("_default"))
    # one row
    return packages.join(templates.select(name, "data"), name, "left").join(F.broadcast(default)).withColumn("data", F.coalesce("data", "_default")).drop("_default")
