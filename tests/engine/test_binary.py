import struct

import pytest

from quire import api
from quire.model import DocumentError
from quire.operators import render
from quire.sources import hwp, tables
from quire.sources.binary import CompoundFile, Cursor, inflate, records

from . import build as b

PNG = bytes.fromhex("89504E470D0A1A0A") + b"data"


def test_cursor():
    c = Cursor(bytes.fromhex("42341278563412"))
    assert (c.u8(), c.u16(), c.u32()) == (0x42, 0x1234, 0x12345678)
    c = Cursor(bytes.fromhex("9cffe0e3ffff"))
    assert (c.i16(), c.i32()) == (-100, -7200)
    assert Cursor(bytes.fromhex("02005cd500ae")).text() == "한글"
    with pytest.raises(IndexError):
        Cursor(b"\1").u16()


def test_records():
    raw = b.record(66, 0, b"ab") + b.record(67, 1) + b.record(68, 2, bytes(5000)) + b"\1\2\3"
    got = records(raw)
    assert [(r.tag, r.level, len(r.data)) for r in got] == [(66, 0, 2), (67, 1, 0), (68, 2, 5000)]
    assert records(b"") == []
    for cut in (b.record(66, 0, b"abcd")[:-1], struct.pack("<I", 66 | 4095 << 20)):
        with pytest.raises(DocumentError):
            records(cut)


def test_compound_file():
    large = bytes(range(256)) * 300
    box = CompoundFile(b.compound({"/FileHeader": b"x" * 256, "/BodyText/Section0": b"s", "/BodyText/Section1": large, "/BinData/BIN0001.png": PNG, "/Empty": b""}))
    assert box.read("BodyText/Section1") == large and box.read("/BodyText/Section0") == b"s" and box.read("/Empty") == b""
    assert box.read("/BodyText") is None and box.read("/none") is None
    assert box.section_count() == 2 and box.binary_streams() == [("/BinData/BIN0001.png", 1, "png")]
    assert "/FileHeader" in box.streams() and "/BodyText" not in box.streams()


@pytest.mark.parametrize("raw", [b"", b"x", bytes.fromhex("D0CF11E0A1B11AE1") + bytes(56), bytes.fromhex("D0CF11E0A1B11AE1") + bytes(2000)])
def test_damaged_containers(raw):
    with pytest.raises(DocumentError):
        CompoundFile(raw)


def test_inflate():
    assert inflate(b"") == b"" and inflate(b.deflated(b"hello")) == b"hello"
    with pytest.raises(DocumentError):
        inflate(b"\xff\xff\xff")


@pytest.mark.parametrize(
    "raw,status",
    [
        (bytes(512), "invalid_format"),
        (b"PK\3\4" + bytes(20), "invalid_format"),
        (b"HWP Document File V3.00", "unsupported"),
        (b.compound({"/FileHeader": b"short"}), "invalid_header"),
        (b.document([], flags=3), "encrypted"),
        (b.document([], version=(5, 2, 0, 0)), "unsupported"),
        (b.document([], flags=5), "unsupported"),
    ],
)
def test_gates(raw, status):
    with pytest.raises(DocumentError) as e:
        hwp.read_document(raw)
    assert e.value.status == status


def test_paragraph_text():
    units = struct.pack("<HH", ord("a"), 9) + bytes(14) + "b".encode("utf-16-le") + struct.pack("<H", 2) + bytes(14) + struct.pack("<6H", 10, 0x1E, 0x18, 0x1F, 0, 5 + 20) + "c😀".encode("utf-16-le") + b"\r\0z\0"
    assert hwp.paragraph_text(units) == "a\tb\n-   c😀"


def test_runs_follow_places_in_the_text():
    runs = hwp.split_runs("abcdef", [(4, 2), (0, 1), (9, 3)])
    assert [(r.shape, r.text) for r in runs] == [(1, "abcd"), (2, "ef"), (3, "")]
    assert [(r.shape, r.text) for r in hwp.split_runs("abc", [(1, 5)])] == [(5, "bc")]
    assert hwp.split_runs("", [(0, 1)]) == [] and hwp.split_runs("x", [])[0].shape == 0


def _table(level):
    cells = b.cell(level + 1, 0, 0, 2, 1, b.paragraph(level + 1, "tall")) + b.cell(level + 1, 0, 1, 1, 1, b.paragraph(level + 1, "a|b") + b.paragraph(level + 1, "c"))
    cells += b.cell(level + 1, 1, 1, 0, 0, b.paragraph(level + 1, "d"))
    caption = b.cell(level + 1, 0, 0, 1, 1, b.paragraph(level + 1, "caption"))
    return b.control(level, "tbl ", below=caption + b.record(77, level + 1, struct.pack("<IHH", 0, 2, 2)) + cells)


def _whole():
    picture = b.control(1, "gso ", below=b.record(76, 2) + b.record(85, 3, bytes(71) + struct.pack("<H", 1)))
    line = b.control(1, "gso ", below=b.record(78, 3, struct.pack("<4i", 1, -2, 3, 4)))
    equation = b.control(1, "eqed", below=b.record(88, 2, bytes(15) + b.wide("x over y")))
    note = b.control(1, "fn  ", below=b.record(72, 2, bytes(8)) + b.paragraph(3, "note"))
    link = b.control(1, "%hlk", bytes(5) + b.wide("http://x"))
    body = b.paragraph(0, "First", [(0, 1)], 0, 0, note) + b.paragraph(0, "", controls=_table(1)) + b.paragraph(0, "pic", controls=picture + line + equation + link)
    info = b.record(17, 0, struct.pack("<8I", 1, 1, 1, 0, 0, 0, 0, 0)) + b.record(18, 1, struct.pack("<HH", 1, 1) + b.wide("png"))
    info += b.record(19, 1, b"\0" + b.wide("Font A")) + b.record(19, 1, b"\x80" + b.wide("Font B") + b"\1" + b.wide("Sub")) + b.record(19, 1, b"\0" + b.wide("Font C"))
    info += b.record(21, 1, b.char_shape()) + b.record(21, 1, b.char_shape(1400, 2 | 1, 0x0000FF))
    lines = b"".join(struct.pack("<BBI", *x) for x in ((1, 4, 0), (2, 4, 255), (3, 6, 0), (8, 7, 0)))
    info += b.record(20, 1, struct.pack("<H", 4) + lines + struct.pack("<BBI", 1, 0, 0) + struct.pack("<IIIi", 1, 0xD9D9D9, 0, -1))
    info += b.record(22, 1, struct.pack("<I", 1)) + b.record(23, 1, b"".join(bytes(12) + b.wide(f"^{k}." if k < 3 else "") for k in range(1, 8)) + struct.pack("<H", 5))
    info += b.record(24, 1, bytes(12) + struct.pack("<H", ord("■"))) + b.record(25, 1, struct.pack("<I6i", 3 << 2, 1, 2, 3, 4, 5, 180)) + b.record(26, 1, b.wide("본문") + b.wide("Body") + bytes(3) + struct.pack("<HH", 0, 1))
    return b.document([body, b"\1\2\3\4\5", b.paragraph(0, "last")], info, extra={"/BinData/BIN0001.png": b.deflated(PNG)})


def test_whole_document():
    doc = hwp.read_document(_whole())
    assert [len(s) for s in doc.sections] == [3, 0, 1]
    assert render.to_text(doc) == "First\nnote\ntall\na|b\nc\nd\npic\nx over y\n\n\n\nlast"
    md = render.to_markdown(doc)
    assert "***First***\n\n> note" in md and "| tall | a\\|b c |\n| --- | --- |\n| tall | d |" in md and "![](BinData/image1.png)" in md and "```\nx over y\n```" in md
    assert render.to_preview(doc).startswith("First\r\nnote\r\n<tall ><a|b c >\r\n<d >")
    t = doc.tables
    assert [[n for n, _ in g] for g in t.fonts] == [["Font A"], ["Font B"], [], [], [], [], ["Font C"]] and t.fonts[1][0][1] == "Sub"
    assert t.chars[1].bold and t.chars[1].italic and t.chars[1].size == 1400 and t.paras[0].align == "center" and t.paras[0].line == 180
    assert t.numberings == [(["^1.", "^2.", "", "", "", "", ""], 5)] and t.bullets == ["■"] and t.tabs == [(True, False)] and t.styles[0].char_shape == 1
    assert doc.binaries == {1: (PNG, "png")}
    kinds = [c.kind for p in doc.sections[0] for c in p.controls]
    assert kinds == ["footnote", "table", "picture", "shape", "equation", "field"]
    assert doc.sections[0][2].controls[1].points == (1, -2, 3, 4) and doc.sections[0][2].controls[3].command == "http://x"


def test_conversion_to_a_package():
    raw = api.hwp_to_hwpx(_whole(), "Title", "Me")
    assert "note" in api.hwpx_to_text(raw) and "tall" in api.hwpx_to_text(raw)
    html = api.hwpx_to_html(raw)
    assert 'rowspan="2"' in html and '<img src="BinData/image1.png" alt="" />' in html and "color:#FF0000" in html
    header = api.package.open_package(raw).text("Contents/header.xml")
    assert 'hh:type="DASH" hh:width="0.25 mm" hh:color="#FF0000"' in header and 'hh:faceColor="#D9D9D9"' in header and 'hh:hatchStyle="NONE"' in header
    assert '<hh:slash hh:type="SOLID"' in header and '<hh:backSlash hh:type="NONE"' in header and 'hh:horizontal="CENTER"' in header
    assert api.inspect(raw)["images"] == ["BinData/image1.png"]


def test_tables_of_a_document():
    doc = hwp.read_document(_whole())
    got = list(tables.rows(doc, "paragraph"))
    assert [(r[1], r[3], r[6]) for r in got[:3]] == [([0], "body", "First"), ([0, 0, 0, 0], "footnote", "note"), ([1], "body", "")]
    assert sorted(got, key=lambda r: (r[0], r[1])) == got
    for name in tables.SCHEMAS:
        for row in tables.rows(doc, name):
            assert len(row) == tables.SCHEMAS[name].count(",") + 1 - tables.SCHEMAS[name].count("struct")
    assert [r[3:] for r in tables.rows(doc, "table_cell")] == [(0, 0, 2, 1), (0, 1, 1, 1), (1, 1, 1, 1)]


def test_storage_loses_a_length_prefix():
    magic = bytes.fromhex("D0CF11E0A1B11AE1")
    info = b.record(18, 0, struct.pack("<HH", 2, 2) + b.wide("")) + b.record(18, 0, struct.pack("<H", 0)) + b.record(18, 0, struct.pack("<HH", 1, 9) + b.wide("gif"))
    doc = hwp.read_document(b.document([b""], info, extra={"/BinData/BIN0002.OLE": b.deflated(b"1234" + magic)}))
    assert doc.binaries == {2: (magic, "ole")}
