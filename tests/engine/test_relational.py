"""Joins, windows and merges on rows with nulls, ties and no rows."""

from pyspark.sql import functions as F

from quire.functions import names, scalar
from quire.operators import relational as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_spine(spark):
    spine = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "x"), (1, 3, None), (2, 0, "a")], "doc_id int, ord int, idref string")
    manifest = spark.createDataFrame([(1, 0, "a", "Contents/old.xml"), (1, 1, "a", "Contents/section0.xml"), (1, 2, "b", "Contents/Section1.XML"), (1, 3, None, "Contents/section2.xml")], "doc_id int, ord int, id string, href string")
    entries = spark.createDataFrame([(1, "Contents/section0.xml"), (1, "Contents/Section1.XML"), (1, "Contents/Section1.XML")], "doc_id int, path string")
    assert rows(R.spine_sections(spine, manifest, entries)) == [(1, 0, "Contents/Section1.XML"), (1, 1, "Contents/section0.xml")]
    assert rows(R.spine_sections(spine, manifest, entries.where("false"))) == []


def test_neighbours_merge(spark):
    df = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "a", None), (1, 2, None, "y"), (1, 3, None, "z"), (1, 4, "a", "w"), (None, 0, "a", "n")], "k int, o int, s string, t string")
    assert rows(R.merge_neighbours(df, ["k"], "o", "s", "t")) == sorted([(1, 0, "a", "x", 2), (1, 2, None, "yz", 2), (1, 4, "a", "w", 1), (None, 0, "a", "n", 1)], key=str)


def test_runs_from_changes_clip(spark):
    texts = spark.createDataFrame([(1, "abcdef"), (2, ""), (3, None)], "id int, text string")
    changes = spark.createDataFrame([(1, 4, 2), (1, 1, 1), (1, 9, 3), (2, 0, 1), (3, 0, 1)], "id int, char_pos int, shape_id int")
    got = R.runs_from_changes(texts, changes, "id").select("run_idx", "shape_id", "text")
    assert rows(got) == [(0, 1, "bcd"), (1, 2, "ef"), (2, 3, "")]


def test_parents_and_captions(spark):
    df = spark.createDataFrame([(1, k, level) for k, level in enumerate([0, 1, 2, 1, 2, 2, 0, 2])], "d int, seq int, level int")
    assert [r[3] for r in rows(R.parent_rows(df, ["d"]))] == [None, 0, 1, 0, 3, 3, None, 3]
    marks = spark.createDataFrame([(1, 0, "h"), (1, 1, "t"), (1, 2, "h"), (2, 0, "h")], "d int, seq int, kind string")
    assert rows(R.after_first(marks, ["d"], "seq", F.col("kind") == "t", F.col("kind") == "h")) == [(1, 2, "h")]


def test_parents_have_no_deepest_level(spark):
    levels = [*range(21), 20, 5, 1023, None, 1, 2]
    df = spark.createDataFrame([(1, k, level, "x") for k, level in enumerate(levels)] + [(2, 0, 20, "y")], "d int, seq int, level int, data string")
    got = R.parent_rows(df, ["d"])
    assert got.columns == [*df.columns, "parent_seq"] and got.where("data is null").isEmpty()
    want = [None, *range(20), 19, 4, None, None, 0, 25, None]
    assert [r["parent_seq"] for r in got.orderBy("d", "seq").collect()] == want


def test_groups_and_grids(spark):
    fonts = spark.createDataFrame([(1, k) for k in range(6)] + [(2, 0)], "d int, n int")
    counts = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (1, 2, 1)], "d int, g int, c int")
    assert [r[2] for r in rows(R.grouped_by_counts(fonts, counts, "d", "n", "g", "c", 6))] == [0, 0, 2, 6, 6, 6, 6]
    cells = spark.createDataFrame([(1, 0, 0, 0, 2, 2, 2, 3), (1, 1, 1, 1, 1, 5, 2, 3), (1, 2, 7, 0, 1, 1, 2, 3)], "t int, cell_idx int, row int, col int, row_span int, col_span int, row_count int, col_count int")
    assert rows(R.grid_cells(cells, ["t"])) == [(1, 0, 0, 0), (1, 0, 1, 0), (1, 1, 0, 0), (1, 1, 1, 0), (1, 1, 2, 1)]


def test_pictures_and_templates(spark):
    refs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "d")], "doc_id int, ref string")
    manifest = spark.createDataFrame([(1, 0, "b", "x.png"), (1, 1, "c", "other/y.png")], "doc_id int, ord int, id string, href string")
    entries = spark.createDataFrame([(1, "BinData/a"), (1, "BinData/x.png"), (1, "other/y.png")], "doc_id int, path string")
    got = {r["ref"]: r["path"] for r in R.picture_paths(refs, manifest, entries).collect()}
    assert got == {"a": "BinData/a", "b": "BinData/x.png", "c": "other/y.png", "d": "BinData/d"}
    packages = spark.createDataFrame([("p",), ("q",)], "name string")
    templates = spark.createDataFrame([("p", "1")], "name string, data string")
    assert rows(R.with_templates(packages, templates).select("name", "data")) == [("p", "1"), ("q", "{}")]


def test_names(spark):
    one = spark.range(1).select(names.tag_name(F.lit(66)), names.tag_name(F.lit(5)), names.control_name(F.lit("gso ")), names.field_kind(F.lit("%dte")), names.field_kind(F.lit("tbl ")))
    assert tuple(one.first()) == ("PARA_HEADER", "UNKNOWN", "GenShape", "date", None)
    assert spark.range(1).select(scalar.section_number(F.lit("Contents/section12.xml")), scalar.section_number(F.lit("x"))).first() == (12, 0)
