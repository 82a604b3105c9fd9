"""Documents and plain texts as ZIP/XML packages.

The layout of a package is fixed by the readers of the format; the values below state it. Elements are put
together by ``tag``, which escapes every value.
"""

from __future__ import annotations

import io
import re
import zipfile
from functools import lru_cache

from ..functions.scalar import ALIGNMENTS, BINARY_MIME, LINE_TYPES, OTHER_MIME, WIDTHS
from ..model import BorderFill, CharShape, Control, Document, Paragraph, ParaShape
from .render import NOTES, cells_by_row, to_preview

# Namespaces, media types, language groups and the numbers that every paragraph and shape has.
NAMESPACES = {
    "ha": "http://www.hancom.co.kr/hwpml/2011/app",
    "hh": "http://www.hancom.co.kr/hwpml/2011/head",
    "hc": "http://www.hancom.co.kr/hwpml/2011/core",
    "hp": "http://www.hancom.co.kr/hwpml/2011/paragraph",
    "hs": "http://www.hancom.co.kr/hwpml/2011/section",
    "opf": "http://www.idpf.org/2007/opf/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "manifest": "urn:oasis:names:tc:opendocument:xmlns:manifest:1.0",
}
CONTAINER = "urn:oasis:names:tc:opendocument:xmlns:container"
MIMETYPE, PACKAGE_TYPE, XML_TYPE = "application/owpml", "application/hwpml-package+xml", "application/xml"
GROUPS = ("HANGUL", "LATIN", "HANJA", "JAPANESE", "OTHER", "SYMBOL", "USER")
LINE = {"textpos": 0, "vertpos": 0, "vertsize": 1000, "textheight": 1000, "baseline": 850, "spacing": 600, "horzpos": 0, "horzsize": 42520, "flags": 393216}
BREAKS = {"breakLatinWord": "KEEP_WORD", "breakNonLatinWord": "KEEP_WORD", "widowOrphan": 0, "keepWithNext": 0, "keepLines": 0, "pageBreakBefore": 0, "lineWrap": "BREAK"}
SHAPE_TAGS = {"line": "line", "rectangle": "rect", "ellipse": "ellipse", "arc": "arc", "polygon": "polygon"}
DEFAULT_FONT, DEFAULT_STYLE = "바탕", ("바탕글", "Normal")


#: A carriage return, which readers would take for a line feed, is written as a reference; what XML forbids as U+FFFD.
_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;", "\r": "&#13;"}
_ESCAPED = re.compile("[&<>\"'\r\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def escape(s: object) -> str:
    s = str(s)
    return _ESCAPED.sub(lambda m: _ESCAPES.get(m[0], "\ufffd"), s) if _ESCAPED.search(s) else s


def tag(name: str, attrs: dict | None = None, *inner: str, bare: bool = False) -> str:
    """An element; attributes take its prefix unless bare, inner parts are XML already."""
    prefix = "" if bare or ":" not in name else name.split(":")[0] + ":"
    own = "".join(f' {k if ":" in k or k == "xmlns" else prefix + k}="{escape(v)}"' for k, v in (attrs or {}).items())
    body = "".join(inner)
    return f"<{name}{own}>{body}</{name}>" if inner else f"<{name}{own}/>"


def spaces(*prefixes: str) -> dict[str, str]:
    return {f"xmlns:{p}": NAMESPACES[p] for p in prefixes}


def xml_file(body: str, alone: bool = False) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"{" standalone=" + chr(34) + "yes" + chr(34) if alone else ""}?>\n{body}'


def color(c: int) -> str:
    return f"#{c & 255:02X}{c >> 8 & 255:02X}{c >> 16 & 255:02X}"


def line_name(i: int) -> str:
    return LINE_TYPES[i] if 0 <= i < len(LINE_TYPES) else "SOLID"


def width(i: int) -> str:
    return (WIDTHS[i] if 0 <= i < len(WIDTHS) else WIDTHS[0]) + " mm"


# definitions


def counted(name: str, items: list[str], count: str = "itemCnt") -> str:
    return tag(f"hh:{name}", {count: len(items)}, *items)


@lru_cache(4096)
def per_group(name: str, values: tuple) -> str:
    return tag(f"hh:{name}", dict(zip((g.lower() for g in GROUPS), values, strict=True)))


def fonts_xml(groups: list[list[tuple[str, str | None]]]) -> str:
    out = []
    for k, lang in enumerate(GROUPS):
        own = groups[k] if k < len(groups) else []
        items = [
            tag("hh:font", {"id": i, "type": "TTF", "name": n}, tag("hh:substFont", {"type": "UNKNOWN", "name": s}) if s else "") for i, (n, s) in enumerate(own)
        ] or [tag("hh:font", {"id": 0, "type": "TTF", "name": DEFAULT_FONT})]
        out.append(tag("hh:fontface", {"lang": lang, "fontCnt": len(items)}, *items))
    return counted("fontfaces", out)


def border_xml(i: int, b: BorderFill | None) -> str:
    lines = b.lines if b else []
    sides = []
    for k, side in enumerate(("left", "right", "top", "bottom")):
        kind, size, shade = lines[k] if k < len(lines) else (1, 0, 0)
        sides.append(tag(f"hh:{side}Border", {"type": line_name(kind), "width": width(size), "color": color(shade)}))
    attr, diagonal = (b.attr, b.diagonal) if b else (0, (0, 0, 0))
    slash, back = attr >> 2 & 7, attr >> 5 & 7
    drawn = lambda x: "SOLID" if x else "NONE"
    crossing = [tag(f"hh:{n}", {"type": drawn(v), "Crooked": 0, "isCounter": 0}) for n, v in (("slash", slash), ("backSlash", back))]
    last = tag("hh:diagonal", {"type": drawn(slash or back), "width": width(diagonal[1]), "color": color(diagonal[2])})
    fill = ""
    if b and b.fill:
        hatch = "NONE" if b.fill.pattern < 0 else "HORIZONTAL"
        fill = tag("hh:fillBrush", None, tag("hh:winBrush", {"faceColor": color(b.fill.background), "hatchColor": color(b.fill.pattern_color), "hatchStyle": hatch, "alpha": 0}))
    return tag("hh:borderFill", {"id": i, "threeD": attr & 1, "shadow": attr >> 1 & 1, "centerLine": "NONE", "breakCellSeparateLine": 0}, *crossing, *sides, last, fill)


def char_xml(i: int, c: CharShape | None) -> str:
    shade = "none" if c is None or c.shade_color in (0, 0xFFFFFF) else color(c.shade_color)
    parts = [per_group("fontRef", tuple(c.faces) if c else (0,) * 7), per_group("ratio", (100,) * 7), per_group("spacing", (0,) * 7), per_group("relSz", (100,) * 7), per_group("offset", (0,) * 7)]
    if c:
        parts += ["<hh:italic/>"] * c.italic + ["<hh:bold/>"] * c.bold
        parts += [tag("hh:underline", {"type": "BOTTOM", "shape": "SOLID", "color": color(c.underline_color)})] * c.underline
        parts += [tag("hh:strikeout", {"shape": "SOLID", "color": color(c.text_color)})] * c.strikeout
    head = {"id": i, "height": c.size if c else 1000, "textColor": color(c.text_color if c else 0), "shadeColor": shade, "useFontSpace": 0, "useKerning": 0, "symMark": "NONE", "borderFillIDRef": 0}
    return tag("hh:charPr", head, *parts)


def para_xml(i: int, p: ParaShape) -> str:
    margins = {"intent": p.indent, "left": p.left, "right": p.right, "prev": p.before, "next": p.after}
    return tag(
        "hh:paraPr",
        {"id": i, "tabPrIDRef": 0, "condense": 0, "fontLineHeight": 0, "snapToGrid": 0, "suppressLineNumbers": 0, "checked": 0},
        tag("hh:align", {"horizontal": ALIGNMENTS.get(p.align, "JUSTIFY"), "vertical": "BASELINE"}),
        tag("hh:heading", {"type": "NONE", "idRef": 0, "level": 0}),
        tag("hh:breakSetting", BREAKS),
        tag("hh:margin", None, *(tag(f"hh:{k}", {"value": v}) for k, v in margins.items())),
        tag("hh:lineSpacing", {"type": "PERCENT", "value": max(0, p.line)}),
    )


def numbering_xml(i: int, formats: list[str], start: int) -> str:
    number = tag("hh:autoNumberFormat", {"type": "DIGIT", "userChar": "", "prefixChar": "", "suffixChar": "."})
    heads = [
        tag("hh:paraHead", {"level": k, "start": 1, "numFormat": f or f"^{k}.", "textOffsetType": "PERCENT", "textOffset": 50, "numberingChar": "false", "charPrIDRef": 0}, number)
        for k, f in enumerate(formats, 1)
    ]
    return tag("hh:numbering", {"id": i, "start": start}, *heads)


def style_xml(i: int, name: str, english: str, para: int, char: int) -> str:
    return tag("hh:style", {"id": i, "type": "PARA", "name": name, "engName": english, "paraPrIDRef": para, "charPrIDRef": char, "nextStyleIDRef": i, "langID": 1042, "lockForm": 0})


def header_xml(doc: Document) -> str:
    t = doc.tables
    picture = tag("hh:img", {"bright": 0, "contrast": 0, "effect": "REAL_PIC", "binaryItemIDRef": 0})
    tabs = [tag("hh:tabPr", {"id": i, "autoTabLeft": int(a), "autoTabRight": int(b)}, tag("hh:items", {"itemCnt": 0})) for i, (a, b) in enumerate(t.tabs or [(True, True)])]
    lists = [
        fonts_xml(t.fonts),
        counted("borderFills", [border_xml(i, b) for i, b in enumerate(t.borders or [None])]),
        counted("charProperties", [char_xml(i, c) for i, c in enumerate(t.chars or [None])]),
        counted("tabPrs", tabs),
        counted("numberings", [numbering_xml(i, f, s) for i, (f, s) in enumerate(t.numberings or [([""] * 7, 1)])]),
        counted("bullets", [tag("hh:bullet", {"id": i, "char": b, "imageBullet": 0, "checkedChar": 0}, picture) for i, b in enumerate(t.bullets or ["●"])]),
        counted("paraProperties", [para_xml(i, p) for i, p in enumerate(t.paras or [ParaShape()])]),
        counted("styles", [style_xml(i, s.name or f"Style{i}", s.english, s.para_shape, s.char_shape) for i, s in enumerate(t.styles)] or [style_xml(0, *DEFAULT_STYLE, 0, 0)]),
    ]
    return head_xml(lists)


def head_xml(lists: list[str]) -> str:
    begin = tag("hh:beginNum", dict.fromkeys(("page", "footnote", "endnote", "pic", "tbl", "equation"), 1))
    return xml_file(tag("hh:head", spaces("hh", "hc"), begin, tag("hh:refList", None, *lists)))


# sections

LINES = tag("hp:linesegarray", None, tag("hp:lineseg", LINE))


def run_xml(shape: int, *inner: str) -> str:
    return tag("hp:run", {"charPrIDRef": shape}, *inner)


@lru_cache(1024)
def _around_text(shape: int) -> tuple[str, str]:
    """What stands before and behind the text of a run."""
    before, _, behind = run_xml(shape, tag("hp:t", None, "\0")).partition("\0")
    return before, behind


def text_run(shape: int, text: str) -> str:
    before, behind = _around_text(shape)
    return before + escape(text) + behind


@lru_cache(1024)
def _around_runs(para: int, style: int) -> tuple[str, str]:
    attrs = {"paraPrIDRef": para, "styleIDRef": style, "pageBreak": 0, "columnBreak": 0, "merged": 0}
    before, _, behind = tag("hp:p", attrs, "\0", LINES).partition("\0")
    return before, behind


def paragraph_xml(para: int, style: int, parts: list[str]) -> str:
    before, behind = _around_runs(para, style)
    return before + ("".join(parts) if parts else run_xml(0)) + behind


class SectionWriter:
    def __init__(self, hrefs: dict[int, str]):
        self.hrefs = hrefs

    def section(self, paragraphs: list[Paragraph]) -> str:
        """Paragraphs in order, each followed by those of its headers, footers and notes."""
        parts = []
        for p in paragraphs:
            parts.append(self.paragraph(p))
            parts += [self.paragraph(q) for c in p.controls if c.kind in NOTES for q in c.paragraphs]
        return section_xml(parts)

    def paragraph(self, p: Paragraph) -> str:
        runs = [text_run(r.shape, r.text) for r in p.runs] if p.runs else [text_run(0, p.text)] if p.text else []
        return paragraph_xml(p.para_shape, p.style, runs + [x for x in map(self.control, p.controls) if x])

    def control(self, c: Control) -> str:
        if c.kind == "table":
            return run_xml(0, self.table(c))
        if c.kind == "picture" and c.binary in self.hrefs:
            return run_xml(0, tag("hp:pic", {"href": self.hrefs[c.binary]}, tag("hc:img", {"binaryItemIDRef": f"image{c.binary}"})))
        if c.kind == "shape":
            ends = ""
            if c.shape == "line" and c.points:
                x1, y1, x2, y2 = c.points
                ends = tag("hc:startPt", {"x": x1, "y": y1}, bare=True) + tag("hc:endPt", {"x": x2, "y": y2}, bare=True)
            return run_xml(0, tag("hp:" + SHAPE_TAGS.get(c.shape, "curve"), None, ends))
        if c.kind == "equation" and c.script:
            return run_xml(0, tag("hp:equation", None, tag("hp:script", None, escape(c.script))))
        return ""

    def table(self, c: Control) -> str:
        empty = tag("hp:p", {"paraPrIDRef": 0, "styleIDRef": 0}, run_xml(0), LINES)
        rows = []
        for row in cells_by_row(c):
            cells = []
            for cell in row:
                spans = {k: n for k, n in (("colSpan", cell.col_span), ("rowSpan", cell.row_span)) if n > 1}
                cells.append(tag("hp:tc", spans, tag("hp:subList", None, "".join(map(self.paragraph, cell.paragraphs)) or empty)))
            rows.append(tag("hp:tr", None, "".join(cells)))
        return tag("hp:tbl", {"rowCnt": c.rows, "colCnt": c.cols}, "".join(rows))


def section_xml(parts: list[str]) -> str:
    return xml_file(tag("hs:sec", spaces("hs", "hp", "hh", "hc"), "".join(parts)), alone=True)


# packages


@lru_cache(256)
def _parts(n: int, title: str, creator: str, version: tuple, binaries: tuple) -> list[tuple[str, str]]:
    """The files of a package that do not hold its texts: n sections, binaries as (id, href, media type)."""
    names = [f"Contents/section{k}.xml" for k in range(n)]
    listed = [("/", PACKAGE_TYPE), ("version.xml", XML_TYPE), ("settings.xml", XML_TYPE), ("Contents/content.hpf", PACKAGE_TYPE), ("Contents/header.xml", XML_TYPE)]
    listed += [(n, XML_TYPE) for n in names] + [(href, media) for _, href, media in binaries]
    items = [("header", "Contents/header.xml", XML_TYPE), *((f"section{k}", n, XML_TYPE) for k, n in enumerate(names)), *binaries]
    root = tag("rootfiles", None, tag("rootfile", {"full-path": "Contents/content.hpf", "media-type": PACKAGE_TYPE}))
    metadata = [tag("dc:title", None, escape(title)), tag("dc:creator", None, escape(creator)), tag("dc:format", None, PACKAGE_TYPE)]
    book = [
        tag("opf:metadata", None, *metadata),
        tag("opf:manifest", None, "".join(tag("opf:item", {"id": i, "href": h, "media-type": m}, bare=True) for i, h, m in items)),
        tag("opf:spine", None, "".join(tag("opf:itemref", {"idref": f"section{k}"}, bare=True) for k in range(len(names)))),
    ]
    numbers = dict(zip(("major", "minor", "micro", "buildNumber"), version, strict=True))
    return [
        ("META-INF/container.xml", xml_file(tag("container", {"xmlns": CONTAINER}, root))),
        ("META-INF/manifest.xml", xml_file(tag("manifest:manifest", spaces("manifest"), *(tag("manifest:file-entry", {"full-path": p, "media-type": m}) for p, m in listed)))),
        ("version.xml", xml_file(tag("ha:HCFVersion", spaces("ha") | {"targetApplication": "WORDPROCESSOR"} | numbers))),
        ("settings.xml", xml_file(tag("ha:HWPApplicationSetting", spaces("ha"), tag("ha:CaretPosition", {"listIDRef": 0, "paraIDRef": 0, "pos": 0})))),
        ("Contents/content.hpf", xml_file(tag("opf:package", spaces("opf", "dc") | {"version": "1.0"}, *book, bare=True))),
    ]


def package(sections: list[str], header: str, title: str, creator: str, version=(5, 0, 6, 0), binaries: list[tuple[str, str, str, bytes]] = (), preview: str | None = None) -> bytes:
    """The ZIP file; binaries are (id, href, media type, bytes)."""
    listed = tuple(b[:3] for b in binaries)
    files: list[tuple[str, str | bytes]] = [
        *_parts(len(sections), title, creator, tuple(version), listed),
        ("Contents/header.xml", header),
        *((f"Contents/section{k}.xml", x) for k, x in enumerate(sections)),
        *((href, raw) for _, href, _, raw in binaries),
    ]
    if preview is not None:
        files.append(("Preview/PrvText.txt", preview))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body, how in [("mimetype", MIMETYPE, zipfile.ZIP_STORED), *((n, b, zipfile.ZIP_DEFLATED) for n, b in files)]:
            # one date for all, so that equal documents make equal packages
            z.writestr(zipfile.ZipInfo(name), body.encode("utf-8", "replace") if isinstance(body, str) else body, how)
    return out.getvalue()


def write_document(doc: Document, title: str = "", creator: str = "") -> bytes:
    binaries = [(f"image{i}", f"BinData/image{i}.{ext.lower()}", BINARY_MIME.get(ext.lower(), OTHER_MIME), raw) for i, (raw, ext) in doc.binaries.items()]
    writer = SectionWriter(dict(zip(doc.binaries, (b[1] for b in binaries), strict=True)))
    return package([writer.section(s) for s in doc.sections], header_xml(doc), title, creator, doc.version, binaries, to_preview(doc))


@lru_cache(1)
def _least_head() -> str:
    """The smallest set of definitions."""
    lists = [
        counted("fontfaces", [tag("hh:fontface", {"lang": GROUPS[0], "fontCnt": 1}, tag("hh:font", {"id": 0, "type": "TTF", "name": DEFAULT_FONT}))]),
        counted("charProperties", [char_xml(0, None)]),
        counted("paraProperties", [para_xml(0, ParaShape())]),
        counted("styles", [style_xml(0, *DEFAULT_STYLE, 0, 0)]),
    ]
    return head_xml(lists)


def write_text(text: str, title: str = "", creator: str = "") -> bytes:
    """A plain text, one paragraph per line; the smallest set of definitions, no preview."""
    parts = [paragraph_xml(0, 0, [text_run(0, line)]) for line in re.split("\r?\n", text)]
    return package([section_xml(parts)], _least_head(), title, creator)
