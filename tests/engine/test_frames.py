import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quire import api, plans
from quire.functions import scalar, templates
from quire.operators import frames, relational, render
from quire.sources import files
from quire.streaming import render_stream, write_stream

from .test_binary import _whole

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations benchmark labels embeddings".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("in")
    (out / "a.hwpx").write_bytes(api.text_to_hwpx("Hi {{ name }}\nbye"))
    (out / "b c.HWPX").write_bytes(api.markdown_to_hwpx("# T\n\nx {{k}}"))
    (out / "bad.hwpx").write_bytes(b"PK\3\4broken")
    (out / "w.hwp").write_bytes(_whole())
    (out / "n.txt").write_bytes(b"plain")
    return out


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_folders_are_scanned_and_failures_are_rows(spark, folder):
    found = files.read_documents(spark, str(folder))
    assert dict(rows(found, "name", "format")) == {"a.hwpx": "hwpx", "b c.HWPX": "hwpx", "bad.hwpx": "hwpx", "w.hwp": "hwp", "n.txt": "unknown"}
    got = {r["name"]: r for r in frames.render_as(found, "text", keys=["name"]).collect()}
    assert got["a.hwpx"]["text"] == "Hi {{ name }}\nbye" and got["w.hwp"]["text"].startswith("First\nnote")
    assert {n: r["status"] for n, r in got.items()} == {"a.hwpx": "ok", "b c.HWPX": "ok", "w.hwp": "ok", "bad.hwpx": "invalid_container", "n.txt": "invalid_format"}
    assert frames.render_as(found, "markdown", keys=["name"], mode="drop").count() == 3
    with pytest.raises(Exception, match="invalid|package|format"):
        frames.render_as(found, "markdown", keys=["name"], mode="failfast").collect()
    assert files.read_documents(spark, str(folder), ".hwpx").count() == 3


def test_nulls_empties_and_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "id long, content string")
    assert rows(frames.render_as(df, "text", "txt"), "id", "text", "status") == [(1, None, "null"), (2, "", "ok"), (3, "x", "ok")]
    assert frames.render_as(df.where("false"), "html", "md").count() == 0
    assert rows(frames.document_table(df, "paragraph", "md"), "id", "text") == [(3, "x")]


def test_tables_of_binary_documents(spark, folder):
    found = files.read_documents(spark, str(folder), ".hwp").select("name", "content")
    cells = frames.document_table(found, "table_cell", "hwp")
    assert cells.count() == 3 and frames.document_table(found, "font_face", "hwp").count() == 3
    grid = cells.withColumns({"row_count": F.lit(2), "col_count": F.lit(2)}).withColumn("t", F.concat_ws(".", F.col("control_path").cast("array<string>")))
    assert rows(relational.grid_cells(grid, ["name", "t"]), "r", "c", "cell_idx") == [(0, 0, 0), (0, 1, 1), (1, 0, 0), (1, 1, 2)]
    streams = frames.compound_entries(found)
    assert "/DocInfo" in [r[0] for r in rows(streams, "path")]
    assert frames.package_entries(files.read_documents(spark, str(folder), "a.hwpx").select("name", "content"), prefixes=("Contents/",)).count() == 3


def test_batches(spark, folder, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.json").write_text(json.dumps({"name": "<Ann>"}))
    (tmp_path / "data" / "default.json").write_text(json.dumps({"k": 7}))
    got = {r["name"]: r["html"] for r in api.batch_templates(spark, str(folder), str(tmp_path / "data")).collect()}
    assert got["a"] == "<p>Hi &lt;Ann&gt;</p><p>bye</p>" and got["b c"] == "<p>T</p><p>x 7</p>"
    api.write_named(api.batch_html(spark, str(folder)), "html", str(tmp_path / "out"), ".html")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.html", "b c.html"]


def test_streams(spark, folder, tmp_path):
    out = render_stream(spark, str(folder), "text", ".hwpx")
    assert out.isStreaming
    write_stream(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert dict(rows(spark.read.parquet(str(tmp_path / "out")), "name", "status")) == {"a.hwpx": "ok", "b c.HWPX": "ok", "bad.hwpx": "invalid_container"}


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(scalar.color_hex(F.lit(c))) for c in (0, 0xFFFFFF, 0xFF, 0xFF0000, 0x0030618E, 0xFF000000)] == ["#000000", "#FFFFFF", "#FF0000", "#0000FF", "#8E6130", "#000000"]
    assert [value(scalar.points(F.lit(c))) for c in (1000, 1050, 1055, 0, 5)] == ["10", "10.5", "10.6", "0", "0.1"]
    assert value(scalar.decode_entities(F.lit("&amp;lt;"))) == "<"
    assert value(templates.fill_template(F.lit("{{a.b}}-{{ a.b }}{{no}}"), F.lit('{"a": {"b": "{{a.b}}"}}'))) == "{{a.b}}-{{a.b}}"
    assert value(scalar.data_uri_parts(F.lit("http://x"))) is None
    assert [value(scalar.detect_format(F.lit(x).cast("binary"))) for x in ("", "ab", "HWP Document File")] == ["unknown", "unknown", "hwp3"]


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(plans.oracle_sql()[name])
    got = plans.queries()[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    mine = sorted(map(str, (tuple(r) for r in got.select(*columns).collect())))
    theirs = sorted(map(str, want.project(", ".join(f'"{x}"' for x in columns)).fetchall()))
    assert mine == theirs


def test_entry_works_without_the_llm_folder():
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[2]
    probe = "import builtins, importlib; real = builtins.__import__\ndef fake(n, *a, **k):\n    if n == 'corpus_pipeline': raise ModuleNotFoundError('no', name='corpus_pipeline')\n    return real(n, *a, **k)\nbuiltins.__import__ = fake\n" + "import __spark_entry__ as e; assert len(e.queries()) > 30 and not any(q.startswith('op1_') for q in e.queries())"
    assert subprocess.run([sys.executable, "-c", probe], cwd=root, capture_output=True).returncode == 0


@pytest.mark.parametrize("limits", [(1 << 20,)])
def test_parts_that_are_no_xml_show_in_status(spark, limits):
    import io
    import zipfile

    whole, out = zipfile.ZipFile(io.BytesIO(api.markdown_to_hwpx("# T\n\nx"))), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in whole.infolist():
            raw = whole.read(i)
            z.writestr(i.filename, raw[:-9] if i.filename == "Contents/header.xml" else raw)
    df = spark.createDataFrame([(1, bytearray(out.getvalue()))], "id long, content binary")
    got = {w: frames.render_as(df, w).first() for w in ("text", "markdown", "html")}
    assert [got[w]["status"] for w in got] == ["ok", "partial", "partial"]  # a text needs no header
    assert got["markdown"]["markdown"].strip() == "T\n\nx" and "header.xml" in got["html"]["message"]
    assert frames.render_as(df, "html", mode="drop").count() == 0 and len(limits) == 1


def test_one_broken_document_does_not_end_the_job(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string")

    def one(raw):
        if raw == "a":
            raise TypeError("odd")
        yield (raw,)

    assert rows(frames.flat_map(df, "content", "x string", one, ["id"]), "id", "x", "status") == [(1, None, "error"), (2, "b", "ok")]


def test_gaps_and_missing_definitions():
    from quire.sources import hwp

    from . import build as b

    parts = {"/FileHeader": b.file_header(flags=0), "/DocInfo": b"", "/BodyText/Section0": b.plain(0, "zero"), "/BodyText/Section2": b.plain(0, "two"), "/BodyText/Section1": b.plain(0, "one")}
    gap = {k: v for k, v in parts.items() if k != "/BodyText/Section1"} | {"/BodyText/Section7": b""}
    assert [p.text for s in hwp.read_document(b.compound(gap)).sections for p in s] == ["zero", "two"]
    with pytest.raises(api.DocumentError):
        hwp.read_document(b.compound({k: v for k, v in parts.items() if k != "/DocInfo"}))


def test_templates_have_one_rule(spark):
    data = {"a": {"b": [1, 2.0, None, [True, "x"]]}, "n": 5.0, "big": 12345678901234567890, "s": "{{n}}", "o": {}, "small": 1.5e-7}
    text = "{{a.b}}|{{a}}|{{n}}|{{ big }}|{{s}}|{{o}}|{{none.x}}|{{a.b.1}}|{{s.length}}|{{small}}"
    want = "1,2,,true,x|[object Object]|5|12345678901234567000|{{n}}|[object Object]||2|5|1.5e-7"
    df = spark.createDataFrame([(text, json.dumps(data)), (text, "broken"), (None, "{}"), ("x", None)], "text string, data string")
    assert api.fill(text, data) == want
    assert [r["filled"] for r in frames.fill_template(df).collect()] == [want, "|||||||||", None, "x"]


def test_previews_are_cut_by_units(spark):
    for text in ("x" * 1999 + "😀" + "y", "😀" * 1500, "a" * 2000 + "😀", "x" * 1998 + "😀y"):
        got = spark.createDataFrame([(text,)], "t string").select(scalar.preview(scalar.paragraphs(F.col("t")))).first()[0]
        assert got == render.to_preview(frames.read_text(text)) and len(got.encode("utf-16-le")) <= 4000


def test_packages_can_not_put_markup_into_html():
    from quire.sources.package import Package

    bad = '"><script>x</script>'
    esc = bad.replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")
    section = f'<sec><p><run charPrIDRef="0"><t>t</t><tbl><tr><tc colSpan="{esc}"><subList><p/></subList></tc></tr></tbl></run></p></sec>'
    header = f'<head><refList><charProperties><charPr id="0" textColor="{esc}" height="1000"/></charProperties></refList></head>'
    html = Package({"Contents/section0.xml": section.encode(), "Contents/header.xml": header.encode()}).to_html()
    assert "<script>" not in html and "&lt;script&gt;" in html


def test_long_adversarial_markdown_is_linear():
    import time

    for text in ("*a **b " * 15000, "_a __b " * 15000, "~~a " * 25000, "[" * 20000, "`a " * 3):
        began = time.perf_counter()
        frames.to_text("md", text)
        assert time.perf_counter() - began < 8


def test_commands(tmp_path, capsys):
    from quire.__main__ import main

    def run(*argv):
        code = main(list(map(str, argv)))
        return code, capsys.readouterr().out

    (tmp_path / "w.hwp").write_bytes(_whole())
    (tmp_path / "a.md").write_text("# T\n\nHi {{ name }} **b**")
    (tmp_path / "a.html").write_text("<p>Hi {{ name }}</p>")
    (tmp_path / "d.json").write_text('{"name": "<you>"}')
    assert run("md:hwpx", tmp_path / "a.md", tmp_path / "m.hwpx", "title")[0] == 0 and run("html:hwpx", tmp_path / "a.html", tmp_path / "h.hwpx")[0] == 0
    assert run("write:txt", tmp_path / "t.hwpx", "one\ntwo", "title")[0] == 0 and run("convert:hwp", tmp_path / "w.hwp", tmp_path / "c.hwpx")[0] == 0
    assert run("txt", tmp_path / "t.hwpx") == (0, "one\ntwo\n") and run("txt", tmp_path / "w.hwp")[1] == run("hwp:txt", tmp_path / "w.hwp")[1]
    assert run("md", tmp_path / "m.hwpx")[1].startswith("**T**") and run("md", tmp_path / "w.hwp", "--embed")[1] == run("hwp:md", tmp_path / "w.hwp", "--embed")[1]
    assert "<p>" in run("html", tmp_path / "m.hwpx")[1] and json.loads(run("inspect", tmp_path / "m.hwpx")[1])["metadata"]["title"] == "title"
    assert run("html:tpl", tmp_path / "h.hwpx", tmp_path / "d.json") == (0, "<p>Hi &lt;you&gt;</p>\n")
    assert run() [0] == 1 and run("none")[0] == 1 and run("txt", tmp_path / "missing.hwpx")[0] == 1 and run("txt")[0] == 1


def test_batch_commands(spark, tmp_path):
    from quire.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "data").mkdir()
    (tmp_path / "in" / "a.hwpx").write_bytes(api.text_to_hwpx("Hi {{ name }}"))
    (tmp_path / "data" / "a.json").write_text('{"name": "you"}')
    assert main(["batch", f"{tmp_path}/in", f"{tmp_path}/out"]) == 0 and main(["batch:tpl", f"{tmp_path}/in", f"{tmp_path}/data", f"{tmp_path}/filled"]) == 0
    assert "Hi {{ name }}" in (tmp_path / "out" / "a.html").read_text() and (tmp_path / "filled" / "a.html").read_text() == "<p>Hi you</p>"
