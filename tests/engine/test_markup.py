import base64
import io
import zipfile

import pytest

from quire import api
from quire.model import DocumentError
from quire.operators import render
from quire.sources import html, markdown, package

PNG = "data:image/png;base64," + base64.b64encode(b"\x89PNG").decode()


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def sec(*paragraphs):
    return '<hs:sec xmlns:hs="s" xmlns:hp="p" xmlns:hc="c">' + "".join(paragraphs) + "</hs:sec>"


def para(text, attrs=""):
    return f"<hp:p><hp:run {attrs}><hp:t>{text}</hp:t></hp:run></hp:p>"


def lines(doc):
    return [p.text for s in doc.sections for p in s]


def test_html_blocks():
    doc = html.read_html("<h1>T</h1><p>a <strong>b</strong></p><ul><li>A</li><li></li></ul><ol start=4><li>x</li><li>y</li></ol><blockquote>인용</blockquote><hr><script>alert(1)</script><style>color</style>")
    assert lines(doc) == ["T", "a b", "- A", "- ", "1. x", "2. y", "> 인용", "─────"]
    assert [r.shape for r in doc.sections[0][1].runs] == [html.DEFAULT, html.BOLD] and doc.sections[0][0].runs[0].shape == 5


def test_html_oddities():
    assert lines(html.read_html("A &amp; B &lt; C")) == ["A & B < C"]
    assert lines(html.read_html("<pre>a\n\n  b<br>c</pre>")) == ["a", "  b", "c"]
    assert lines(html.read_html("<li>\n<p>x</p></li>"))[-1] == "x"
    assert lines(html.read_html("<ul><li>\n<p>x</p></li></ul>")) == ["-  ", "x"]
    assert lines(html.read_html("<div>a<h2>b</h2><ul><li>c</li></ul></div>")) == ["abc"]
    assert lines(html.read_html("<p>a<p>b</p></p>c")) == ["a", "b", "c"]


def test_html_tables_and_pictures():
    doc = html.read_html(f'<table><thead><tr><th>h</th></tr></thead><tbody><tr><td rowspan="2">x</td><td colspan=0>y</td></tr></tbody></table><p><img alt="pic" src="{PNG}"><img src="http://x/y.png"></p>')
    table = doc.sections[0][0].controls[0]
    assert (table.rows, table.cols) == (2, 2) and [(c.row, c.col, c.row_span, c.col_span) for c in table.cells] == [(0, 0, 1, 1), (1, 0, 2, 1), (1, 1, 1, 1)]
    assert doc.binaries == {1: (b"\x89PNG", "png")} and doc.sections[0][1].text == "pic"
    raw = api.html_to_hwpx(f'<table><tr><td rowspan="2">x</td></tr></table><img src="{PNG}">')
    p = package.open_package(raw)
    assert 'hp:rowSpan="2"' in p.text("Contents/section0.xml") and p.images() == ["BinData/image1.png"]


def test_markdown_blocks():
    doc = markdown.read_markdown("# 제목 **x**\n\npara\nnext  \nhard\n\n- a\n- b\n  1. c\n\n3. x\n4. y\n\n> q1\n> q2\n\n```\nl1\n\nl2\n```\n\n---\n\nT\n---\n\n<div>gone</div>\n\n    code")
    assert lines(doc) == ["제목 x", "para\nnext\nhard", "- a", "- b", "1. c", "3. x", "4. y", "> q1\nq2", "l1", "", "l2", "─────", "T", "code"]
    assert [r.shape for r in doc.sections[0][0].runs] == [4, markdown.BOLD]


@pytest.mark.parametrize(
    "text,runs",
    [
        ("**굵은** 텍스트 *기울임*", [(1, "굵은"), (0, " 텍스트 "), (2, "기울임")]),
        ("***both*** `a*b` ~~del~~", [(3, "both"), (0, " "), (8, "a*b"), (0, " del")]),
        ("a\\*b snake_case [l](http://x \"t\") <http://y>", [(0, "a*b snake_case l http://y")]),
        ("&amp;lt; <b>x</b>", [(0, "< <b>x</b>")]),
        ("2 * 3 * 4", [(0, "2 * 3 * 4")]),
    ],
)
def test_markdown_spans(text, runs):
    assert [(r.shape, r.text) for r in markdown.read_markdown(text).sections[0][0].runs] == runs


def test_markdown_tables_and_pictures():
    doc = markdown.read_markdown(f"| a | b |\n|---|:-:|\n| 1 | x\\|y |\n| only |\n\n![alt]({PNG})\n\n# ![h]({PNG})")
    table = doc.sections[0][0].controls[0]
    assert (table.rows, table.cols) == (3, 2) and [c.paragraphs[0].text for c in table.cells] == ["a", "b", "1", "x|y", "only", ""]
    assert doc.binaries == {1: (b"\x89PNG", "png")} and doc.sections[0][1].text == "alt" and not doc.sections[0][2].controls


def test_markdown_round_trip():
    raw = api.markdown_to_hwpx("# 제목\n\n**굵게** | x\n\n| 이름 | 나이 |\n| --- | --- |\n| a | 1 |\n", "T")
    md = api.hwpx_to_markdown(raw)
    assert "**제목**" in md and "**굵게** | x" in md and "| **이름** | **나이** |\n| --- | --- |\n| a | 1 |" in md
    header = package.open_package(raw).text("Contents/header.xml")
    assert "<hh:bold/>" in header and "<hh:italic/>" in header and header.count("<hh:fontface ") == 7


def test_text_package():
    raw = api.text_to_hwpx("a\r\nb <tag attr=\"v\">A & B</tag> 'q'\n", "제목", "나")
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        first = z.infolist()[0]
        assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED and z.read("mimetype") == b"application/owpml"
        assert {"META-INF/container.xml", "META-INF/manifest.xml", "version.xml", "settings.xml", "Contents/content.hpf", "Contents/header.xml", "Contents/section0.xml"} < set(z.namelist())
        assert "제목" in z.read("Contents/content.hpf").decode()
    assert api.hwpx_to_text(raw) == "a\nb <tag attr=\"v\">A & B</tag> 'q'\n"
    assert raw == api.text_to_hwpx("a\r\nb <tag attr=\"v\">A & B</tag> 'q'\n", "제목", "나")


def test_sections_without_a_spine():
    files = {f"Contents/section{k}.xml": sec(para(f"s{k}")) for k in (10, 2, 1)}
    raw = zipped(**files)
    assert api.hwpx_to_text(raw) == "s1\ns2\ns10" and api.hwpx_to_markdown(raw) == "s1\n\ns10\n\ns2\n"
    assert api.hwpx_to_text(zipped(**{"Contents/other.xml": sec(para("x")), "Contents/no.xml": "<a/>"})) == "x"


def test_spine_decides():
    book = '<opf:package xmlns:opf="o"><opf:manifest><opf:item id="a" href="Contents/section0.xml"/><opf:item id="b" href="Contents/section1.xml"/></opf:manifest><opf:spine><opf:itemref idref="b"/><opf:itemref idref="a"/><opf:itemref idref="none"/></opf:spine></opf:package>'
    raw = zipped(**{"Contents/content.hpf": book, "Contents/section0.xml": sec(para("0")), "Contents/section1.xml": sec(para("1"))})
    assert api.hwpx_to_text(raw) == "1\n0"


def test_encodings_preview_and_encryption():
    assert package.decode_text("가a".encode("utf-16")) == "가a" and package.decode_text("abcd".encode("utf-16-le")) == "abcd" and package.decode_text("abcd".encode("utf-16-be")) == "abcd" and package.decode_text(b"\xef\xbb\xbfx") == "x"
    assert api.hwpx_to_text(zipped(**{"Contents/section0.xml": sec(para(" ")), "preview/prvtext.txt": "seen"})) == "seen"
    assert api.hwpx_to_html(zipped(**{"Contents/x.txt": "", "Preview/PrvText.txt": "a\n\nb<"})) == "<p>a</p><p>b&lt;</p>"
    with pytest.raises(DocumentError) as e:
        api.hwpx_to_text(zipped(**{"META-INF/manifest.xml": '<m><f name="EncryptionData"/></m>'}))
    assert e.value.status == "encrypted"
    with pytest.raises(DocumentError):
        api.hwpx_to_text(b"PK\3\4nothing")


def test_runs_in_packages():
    two = "<hp:p><hp:run><hp:t>a</hp:t><hp:t>b</hp:t></hp:run><hp:run><hp:ctrl/><hp:t>c</hp:t></hp:run><hp:run><hp:ctrl x='1'/><hp:t>d</hp:t></hp:run></hp:p>"
    raw = zipped(**{"Contents/section0.xml": sec(two)})
    assert api.hwpx_to_text(raw) == "abc" and api.hwpx_to_html(raw) == "<p>c</p>"
    table = "<hp:p><hp:run><hp:t>x</hp:t><hp:tbl><hp:tr><hp:tc colSpan='2'><hp:subList>" + para("1") + para("2") + "</hp:subList></hp:tc><hp:tc/></hp:tr><hp:tr/></hp:tbl></hp:run></hp:p>"
    raw = zipped(**{"Contents/section0.xml": sec(table)})
    assert api.hwpx_to_text(raw) == "x1\n2 " and api.hwpx_to_markdown(raw) == "x\n\n| 1 2 |   |\n| --- | --- |\n"
    assert api.hwpx_to_html(raw, head_row=True, table_class="t") == '<p>x</p><table class="t"><tr><th colspan="2">1\n2</th><th></th></tr><tr></tr></table>'


def test_pictures_resolve_by_manifest():
    book = '<package><manifest><item id="i1" href="image1.png" media-type="image/png"/></manifest></package>'
    body = sec("<hp:p align='CENTER'><hp:run><hp:pic><hc:img binaryItemIDRef='i1'/></hp:pic></hp:run></hp:p>")
    raw = zipped(**{"Contents/content.hpf": book, "Contents/section0.xml": body, "BinData/image1.png": b"x"})
    assert api.hwpx_to_html(raw) == '<p style="text-align:center"><img src="BinData/image1.png" alt="" /></p>'
    assert api.hwpx_to_html(raw, embed=True).count("data:image/png;base64,eA==") == 1
    assert api.hwpx_to_markdown(raw) == "![](BinData/i1)\n" and api.hwpx_to_html(raw, images=False) == '<p style="text-align:center"></p>'
    assert api.hwpx_to_html(raw, resolver=lambda p: "cdn/" + p) == '<p style="text-align:center"><img src="cdn/BinData/image1.png" alt="" /></p>'


def test_templates():
    data = {"a": {"b": 1, "t": True}, "n": None, "z": 0}
    assert api.fill("{{ a.b }}{{a.t}}[{{n}}{{ q.r }}{{z}}{{z.k}}] {{ x y }}", data) == "1true[0] {{ x y }}"
    assert api.fill("{{l}}|{{l.1}}|{{o}}|{{f}}|{{l.length}}", {"l": [1, "b", None], "o": {"x": 1}, "f": 2.0}) == "1,b,|b|[object Object]|2|3"


def test_styles_of_runs():
    head = "<hh:head xmlns:hh='h'><hh:refList><hh:charProperties><hh:charPr id='0' height='1050' textColor='#FF0000' shadeColor='#00FF00'><hh:bold/><hh:italic/><hh:underline type='BOTTOM'/></hh:charPr></hh:charProperties></hh:refList></hh:head>"
    raw = zipped(**{"Contents/header.xml": head, "Contents/section0.xml": sec(para("a*b", "charPrIDRef='0'"))})
    assert api.hwpx_to_html(raw) == '<p><strong><em><span style="text-decoration:underline;color:#FF0000;font-size:10.5pt;background-color:#00FF00">a*b</span></em></strong></p>'
    assert api.hwpx_to_markdown(raw) == "***a\\*b***\n" and api.hwpx_to_html(raw, styles=False) == "<p>a*b</p>"


def test_escapes():
    assert render.escape_md("a\\b *c* `d`\n# e\n> f") == "a\\\\b \\*c\\* \\`d\\`\n\\# e\n\\> f"
