"""ZIP/XML packages: their parts, what they say of themselves, and their bodies as text, Markdown and HTML."""

from __future__ import annotations

import base64
import io
import math
import re
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from xml.etree import ElementTree

from ..functions.scalar import ALIGNMENTS, IMAGE_MIME, LINE_TYPES, MARKDOWN_MIME, OTHER_MIME, SPACE_CHARACTERS, WIDTHS
from ..model import BorderFill, Cell, CharShape, Control, Document, DocumentError, Paragraph, ParaShape, Run, Style, Tables
from ..operators.render import escape_md, table_lines

_MARK = re.compile("encrypt|cipher", re.I)
_SECTION = re.compile(r"section(\d+)\.xml")


def decode_text(raw: bytes) -> str:
    """By byte order mark, else by the side of most zero bytes in the first 1,024, else UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    head = raw[:1024]
    even, odd = head[::2].count(0), head[1::2].count(0)
    name = "utf-16-le" if odd > 2 * even else "utf-16-be" if even > 2 * odd else "utf-8"
    return raw.decode(name, "replace")


class Element:
    """An element without prefixes, over a parsed one; what is below it is made when it is asked for."""

    __slots__ = ("_children", "_text", "attrs", "name", "node")

    def __init__(self, node):
        self.node, self._children, self._text = node, None, None
        self.name = node.tag.rpartition("}")[2]
        self.attrs = {k.rpartition("}")[2]: _kept(v) for k, v in node.attrib.items()}

    @property
    def children(self) -> list[Element]:
        if self._children is None:
            self._children = [Element(c) for c in self.node]
        return self._children

    @property
    def text(self) -> str:
        if self._text is None:
            text = (self.node.text or "") + "".join(c.tail or "" for c in self.node)
            self._text = "" if len(self.node) and not text.strip() else _kept(text)
        return self._text

    def all(self, name: str) -> list[Element]:
        return [c for c in self.children if c.name == name]

    def one(self, name: str) -> Element | None:
        return next((c for c in self.children if c.name == name), None)

    @property
    def empty(self) -> bool:
        return not (self.attrs or len(self.node) or self.text)

    @property
    def plain(self) -> bool:
        """Nothing but text."""
        return not (self.attrs or len(self.node))

    def path(self, *names: str) -> Element | None:
        at: Element | None = self
        for n in names:
            at = at.one(n) if at else None
        return at


#: What no XML may hold, as characters or as references to them; parsed as private characters and given back as it was.
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")
_REFERENCE = re.compile(r"&#(?:x0*([0-9a-fA-F]{1,4})|0*(\d{1,5}));")
_PRIVATE = 0x100000


def _hidden(m) -> str:
    return chr(_PRIVATE + ord(m[0]))


def _hidden_reference(m) -> str:
    c = chr(int(m[1], 16) if m[1] else min(int(m[2]), 0xFFFF))
    return chr(_PRIVATE + ord(c)) if _ILLEGAL.match(c) else m[0]


def _kept(text: str) -> str:
    return re.sub("[\U00100000-\U0010ffff]", lambda m: c if _ILLEGAL.match(c := chr(ord(m[0]) - _PRIVATE)) else m[0], text) if max(text, default="") >= chr(_PRIVATE) else text


def parse_xml(text: str) -> Element | None:
    """The root; None where the text is no XML. Characters that XML forbids are taken as any others."""
    text = re.sub(r"^\s*<\?xml[^>]*\?>", "", text)
    if _ILLEGAL.search(text):
        text = _ILLEGAL.sub(_hidden, text)
    if "&#" in text:
        text = _REFERENCE.sub(_hidden_reference, text)
    try:
        return Element(ElementTree.fromstring(text))
    except (ElementTree.ParseError, ValueError):
        return None


def unzip(raw: bytes, want: Callable[[str], bool] = lambda path: True) -> dict[str, bytes]:
    """The files of a package that are wanted, in their order; folders are left out."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return {i.filename: z.read(i) for i in z.infolist() if not i.is_dir() and want(i.filename)}
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError, ValueError) as e:
        raise DocumentError("invalid_container", f"no readable package: {e}") from e


@dataclass
class HtmlOptions:
    paragraph_tag: str = "p"
    images: bool = True
    tables: bool = True
    styles: bool = True
    embed: bool = False
    resolver: Callable[[str], str] | None = None
    table_class: str = "hwpx-table"
    head_row: bool = False


def escape_html(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attr(s: str) -> str:
    return escape_html(s).replace('"', "&quot;")


class Package:
    def __init__(self, files: dict[str, bytes]):
        self.files = files
        self._trees: dict[str, Element | None] = {}
        #: Parts that were looked into and are no XML.
        self.damaged: list[str] = []

    def text(self, path: str) -> str | None:
        return decode_text(self.files[path]) if path in self.files else None

    def tree(self, path: str) -> Element | None:
        if path not in self._trees:
            text = self.text(path)
            self._trees[path] = parse_xml(text) if text else None
            if text and self._trees[path] is None:
                self.damaged.append(path)
        return self._trees[path]

    # what a package says of itself

    @cached_property
    def book(self) -> Element | None:
        root = self.tree("Contents/content.hpf")
        return root if root is not None and root.name == "package" else None

    @cached_property
    def manifest(self) -> list[tuple[str | None, str | None, str | None]]:
        """(id, href, media type) of each item."""
        found = self.book.path("manifest") if self.book else None
        return [(i.attrs.get("id"), i.attrs.get("href"), i.attrs.get("media-type", i.attrs.get("mediaType"))) for i in (found.all("item") if found else [])]

    @cached_property
    def spine(self) -> list[str]:
        found = self.book.path("spine") if self.book else None
        refs = (found.all("itemref") or found.all("itemRef")) if found else []
        return [r for x in refs if (r := x.attrs.get("idref", x.attrs.get("idRef")))]

    @cached_property
    def likely(self) -> bool:
        """Whether the mimetype part names a package of this kind; tells, and rejects nothing."""
        kind = (self.text("mimetype") or "").strip().lower()
        return "owpml" in kind or "hwpx" in kind

    @cached_property
    def encrypted(self) -> bool:
        """A mark of encryption in any name or value of the manifest."""

        def marked(e: Element) -> bool:
            return any(map(_MARK.search, [e.name, e.text, *e.attrs, *e.attrs.values()])) or any(map(marked, e.children))

        root = self.tree("META-INF/manifest.xml")
        return root is not None and marked(root)

    def metadata(self) -> dict[str, str | None]:
        found = self.book.path("metadata") if self.book else None
        value = lambda n: (e.text if (e := found.one(n)) is not None else None) if found else None
        out = {n: value(n) for n in ("title", "creator", "created", "modified")}
        version = self.tree("version.xml")
        out["version"] = None
        if version is not None and version.name in ("Version", "version"):
            own = version.one("OWPMLVersion" if version.name == "Version" else "owpmlVersion")
            out["version"] = own.text if own is not None and own.plain else None
        settings = self.tree("settings.xml")
        caret = None
        if settings is not None and settings.name in ("HWPApplicationSetting", "Settings", "settings"):
            caret = settings.one("CaretPosition") or settings.one("caretPosition")
        places = [caret.attrs.get(n) for n in ("listIDRef", "paraIDRef", "pos")] if caret else []
        out["caret_position"] = ":".join("0" if x is None else x for x in places) if any(places) else None
        return out

    def contents(self) -> list[str]:
        return sorted(p for p in self.files if p.startswith("Contents/"))

    def images(self) -> list[str]:
        return sorted(p for p in self.files if p.startswith("BinData/") and not p.endswith("/"))

    def section_paths(self, by_name: bool = False) -> list[str]:
        """In the spine's order; else by file name, in order of numbers or of names; else whatever has a section for root."""
        hrefs = {i: h for i, h, _ in self.manifest if i and h and re.search(r"Contents/section\d+\.xml$", h, re.I)}
        found = [hrefs[r] for r in self.spine if hrefs.get(r) in self.files]
        if found:
            return found
        number = lambda p: int(m[1]) if (m := _SECTION.search(p)) else 0
        found = [p for p in self.files if re.fullmatch(r"contents/section\d+\.xml", p.lower())]
        if found:
            return sorted(found) if by_name else sorted(found, key=number)
        found = [p for p in self.files if p.startswith("Contents/") and p.lower().endswith(".xml") and self.section(p) is not None]
        return found if by_name else sorted(found, key=number)

    def section(self, path: str) -> Element | None:
        root = self.tree(path)
        return root if root is not None and root.name in ("sec", "section") else None

    @cached_property
    def shapes(self) -> dict[str, Element]:
        root = self.tree("Contents/header.xml")
        found = root.path("refList", "charProperties") if root is not None else None
        return {i: c for c in (found.all("charPr") if found else []) if (i := c.attrs.get("id"))}

    def preview(self) -> str | None:
        path = next((p for p in self.files if p.lower() == "preview/prvtext.txt"), None)
        text = self.text(path) if path else None
        return text if text and text.strip() else None

    def readable(self) -> Package:
        if self.encrypted:
            raise DocumentError("encrypted", "the package is encrypted")
        return self

    # text

    def to_text(self, joiner: str = "\n") -> str:
        out = []
        for path in self.section_paths():
            root, section = self.tree(path), self.section(path)
            if section is not None and section.all("p"):
                out += [self.paragraph_text(p) for p in section.all("p")]
            elif root is not None and (said := "".join(all_text(root))):
                out.append(said)
        whole = joiner.join(out)
        return whole if whole.strip() else self.preview() or whole

    def paragraph_text(self, p: Element) -> str:
        return "".join(run_text(r) + "".join(self.table_text(t) for t in r.all("tbl")) for r in runs(p))

    def table_text(self, table: Element) -> str:
        rows = [tr.all("tc") for tr in table.all("tr")]
        return "\n".join(" ".join("\n".join(map(self.paragraph_text, cell_paragraphs(c))) for c in row) for row in rows if row)

    # Markdown

    def to_markdown(self, embed: bool = False, resolver: Callable[[str], str] | None = None) -> str:
        blocks = []
        for path in self.section_paths(by_name=True):
            section = self.section(path)
            blocks += [b for p in (section.all("p") if section else []) if (b := self.paragraph_markdown(p, embed, resolver)).strip()]
        return "\n\n".join(blocks).strip() + "\n"

    def paragraph_markdown(self, p: Element, embed: bool, resolver) -> str:
        parts, line = [], ""
        for r in runs(p):
            if said := run_text(r):
                shape = self.shapes.get(r.attrs.get("charPrIDRef", ""))
                said = escape_md(said)
                if shape is not None:
                    said = f"**{said}**" if shape.one("bold") is not None else said
                    said = f"*{said}*" if shape.one("italic") is not None else said
                line += said
            found = [self.table_markdown(t, embed, resolver) for t in r.all("tbl")]
            pictures = r.all("pic")
            if len(pictures) == 1 and not pictures[0].empty:
                found += self.picture_markdown(pictures[0], embed, resolver)
            if found or pictures:
                parts += [line] if line else []
                line = ""
                parts += found
        return "\n\n".join(parts + ([line] if line else []))

    def picture_markdown(self, pic: Element, embed: bool, resolver) -> list[str]:
        image = pic.one("img")
        ref = image.attrs.get("binaryItemIDRef") if image is not None else None
        path = pic.attrs.get("href", f"BinData/{ref}" if ref else "")
        if not path:
            return []
        if embed and path in self.files:
            path = data_uri(path.rpartition(".")[2].lower(), self.files[path], MARKDOWN_MIME)
        elif resolver and not embed:
            path = resolver(path)
        return [f"![]({path})"]

    def table_markdown(self, table: Element, embed: bool, resolver) -> str:
        rows = []
        for tr in table.all("tr"):
            if cells := tr.all("tc"):
                texts = [" ".join(self.paragraph_markdown(p, embed, resolver) for p in cell_paragraphs(c)) for c in cells]
                rows.append([re.sub(r"\n+", " ", t).replace("|", "\\|") for t in texts])
        widest = max(map(len, rows), default=0)
        return table_lines([r + [""] * (widest - len(r)) for r in rows]) if rows else ""

    # HTML

    def to_html(self, options: HtmlOptions = HtmlOptions()) -> str:
        out, tag = [], options.paragraph_tag
        for path in self.section_paths():
            section = self.section(path)
            if section is None:
                continue
            for p in section.all("p"):
                out.append(f"<{tag}{style_attr(alignment(p))}>{self.node_html(p, options)}</{tag}>")
                if options.tables:
                    out += [self.table_html(t, options) for r in runs(p) for t in r.all("tbl")]
            if options.tables:
                out += [self.table_html(t, options) for t in section.all("tbl")]
        html = "".join(out)
        if not html.strip() and (preview := self.preview()):
            html = "<p>" + re.sub(r"\n+", "</p><p>", escape_html(preview)) + "</p>"
        return html

    def table_html(self, table: Element, o: HtmlOptions) -> str:
        rows = []
        for k, tr in enumerate(table.all("tr")):
            name, cells = "th" if o.head_row and k == 0 else "td", []
            for c in tr.all("tc"):
                spans = ""
                for attr, names in (("colspan", ("colSpan", "colspan", "gridSpan")), ("rowspan", ("rowSpan", "rowspan"))):
                    n = next((c.attrs[x] for x in names if x in c.attrs), "")
                    spans += f' {attr}="{escape_attr(n)}"' if n not in ("", "1") else ""
                inner = c.one("subList")
                cells.append(f"<{name}{spans}{style_attr(alignment(c))}>{self.node_html(inner if inner is not None and not inner.empty else c, o)}</{name}>")
            rows.append("<tr>" + "".join(cells) + "</tr>")
        return f'<table class="{escape_attr(o.table_class)}">' + "".join(rows) + "</table>"

    def node_html(self, node: Element, o: HtmlOptions) -> str:
        if inner := node.all("p"):
            return "\n".join(self.node_html(p, o) for p in inner)
        if inner := node.all("run"):
            return "".join(self.run_html(r, o) for r in inner)
        return escape_html(node.text)

    def run_html(self, r: Element, o: HtmlOptions) -> str:
        if is_setting(r):
            return ""
        texts = r.all("t")
        html = escape_html(texts[0].text) if len(texts) == 1 else ""
        if o.images and (ref := image_ref(r)):
            path = self.image_path(ref)
            if o.embed:
                path = data_uri(path.rpartition(".")[2].lower(), self.files[path], IMAGE_MIME) if path in self.files else path
            elif o.resolver:
                path = o.resolver(path)
            html += f'<img src="{escape_attr(path)}" alt="" />'
        shape = self.shapes.get(r.attrs.get("charPrIDRef", "")) if o.styles else None
        return styled(html, shape) if shape is not None else html

    def image_path(self, ref: str) -> str:
        direct = f"BinData/{ref}"
        if direct in self.files:
            return direct
        href = next((h for i, h, _ in self.manifest if i == ref), None)
        if href:
            inside = href if href.startswith("BinData/") else f"BinData/{href}"
            for path in (inside, href):
                if path in self.files:
                    return path
        return direct


def _number(e: Element | None, name: str, other: int = 0) -> int:
    m = re.match(r"\s*([+-]?\d+)", e.attrs.get(name, "")) if e is not None else None
    return int(m[1]) if m else other


def _color(e: Element | None, name: str, other: int) -> int:
    """#RRGGBB as 0x00BBGGRR."""
    m = re.fullmatch("#?([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})", e.attrs.get(name, "").strip()) if e is not None else None
    return int(m[3] + m[2] + m[1], 16) if m else other


class Relations:
    """A package as a Document, for its relations: the body in document order, and the definitions of its header.

    Ids of shapes and styles are the header's. A definition's id is its place, so definitions stand at the id they state,
    and places that no id has hold defaults; one without a number comes after the last.
    """

    def __init__(self, p: Package):
        self.package, self.images = p, {}

    def document(self) -> Document:
        p = self.package
        sections = [[self.paragraph(x) for x in s.all("p")] for path in p.section_paths() if (s := p.section(path)) is not None]
        return Document(sections, self.tables(), {i: (p.files[path], path.rpartition(".")[2].lower()) for path, i in self.images.items() if path in p.files})

    def paragraph(self, e: Element) -> Paragraph:
        own = [r for r in runs(e)]
        texts = [Run(_number(r, "charPrIDRef"), t) for r in own if (t := run_text(r))]
        controls = [c for r in own for x in r.children if (c := self.control(x)) is not None]
        return Paragraph("".join(r.text for r in texts), texts, controls, _number(e, "paraPrIDRef"), _number(e, "styleIDRef"))

    def control(self, e: Element) -> Control | None:
        if e.name == "tbl":
            return self.table(e)
        if e.name in ("pic", "picture"):
            image = e.one("img")
            path = e.attrs.get("href") or self.package.image_path((image if image is not None else e).attrs.get("binaryItemIDRef", ""))
            return Control("picture", binary=self.images.setdefault(path, len(self.images) + 1))
        if e.name == "equation":
            script = e.one("script")
            return Control("equation", script=script.text if script is not None else "")
        shape = {"line": "line", "rect": "rectangle", "ellipse": "ellipse", "arc": "arc", "polygon": "polygon", "curve": "curve"}.get(e.name)
        if shape:
            ends = [e.one("startPt"), e.one("endPt")]
            points = tuple(_number(x, n) for x in ends for n in ("x", "y")) if all(x is not None for x in ends) else None
            return Control("shape", shape=shape, points=points)
        return None

    def table(self, e: Element) -> Control:
        rows = e.all("tr")
        out = Control("table", rows=_number(e, "rowCnt", len(rows)), cols=_number(e, "colCnt", max((len(r.all("tc")) for r in rows), default=0)))
        taken: set[tuple[int, int]] = set()
        for r, row in enumerate(rows):
            col = 0
            for c in row.all("tc"):
                place, span = c.one("cellAddr"), c.one("cellSpan")
                spans = [max(1, _number(span, n, _number(c, n, 1))) for n in ("rowSpan", "colSpan")]
                while (r, col) in taken:
                    col += 1
                at = _number(place, "rowAddr", r), _number(place, "colAddr", col)
                # what a span covers is bounded by the table
                for k in range(at[0], min(at[0] + spans[0], len(rows))):
                    taken.update((k, j) for j in range(at[1], at[1] + min(spans[1], max(out.cols, 1))))
                out.cells.append(Cell(*at, *spans, [self.paragraph(x) for x in cell_paragraphs(c)]))
        return out

    def tables(self) -> Tables:
        head = self.package.tree("Contents/header.xml")
        lists = head.one("refList") if head is not None else None

        def listed(name: str, item: str) -> list[Element]:
            own = lists.one(name) if lists is not None else None
            return own.all(item) if own is not None else []

        def placed(items: list[Element], make, empty) -> list:
            known = {_number(e, "id", -1): e for e in items if 0 <= _number(e, "id", -1) < 1 << 16}
            out = [make(known[i]) if i in known else empty() for i in range(max(known, default=-1) + 1)]
            return out + [make(e) for e in items if not 0 <= _number(e, "id", -1) < 1 << 16]

        fonts = [[(f.attrs.get("name", f.attrs.get("face", "")), s.attrs.get("name", s.attrs.get("face")) if (s := f.one("substFont")) is not None else None) for f in x.all("font")] for x in listed("fontfaces", "fontface")]
        return Tables(
            fonts=(fonts + [[] for _ in range(7)])[: max(7, len(fonts))],
            chars=placed(listed("charProperties", "charPr"), self.char_shape, CharShape),
            paras=placed(listed("paraProperties", "paraPr"), self.para_shape, ParaShape),
            styles=placed(listed("styles", "style"), lambda e: Style(e.attrs.get("name", ""), e.attrs.get("engName", ""), _number(e, "paraPrIDRef"), _number(e, "charPrIDRef")), lambda: Style("")),
            borders=placed(listed("borderFills", "borderFill"), self.border, BorderFill),
            tabs=placed(listed("tabPrs", "tabPr"), lambda e: (_number(e, "autoTabLeft") == 1, _number(e, "autoTabRight") == 1), lambda: (False, False)),
            numberings=placed(listed("numberings", "numbering"), lambda e: ([h.attrs.get("numFormat", "") for h in e.all("paraHead")], _number(e, "start", 1)), lambda: ([], 1)),
            bullets=placed(listed("bullets", "bullet"), lambda e: e.attrs.get("char", "●"), lambda: "●"),
        )

    @staticmethod
    def char_shape(e: Element) -> CharShape:
        under, strike, faces = e.one("underline"), e.one("strikeout"), e.one("fontRef")
        drawn = lambda x, n: x is not None and x.attrs.get(n, "SOLID") != "NONE"
        return CharShape(
            _number(e, "height", 1000), e.one("bold") is not None, e.one("italic") is not None, drawn(under, "type"), drawn(strike, "shape"),
            tuple(_number(faces, n) for n in ("hangul", "latin", "hanja", "japanese", "other", "symbol", "user")),
            _color(e, "textColor", 0), _color(under, "color", 0), _color(e, "shadeColor", 0xFFFFFF),
        )

    @staticmethod
    def para_shape(e: Element) -> ParaShape:
        names = {v: k for k, v in ALIGNMENTS.items()}
        align, margin, line = e.one("align"), e.one("margin"), e.one("lineSpacing")
        side = lambda n: _number(margin.one(n) if margin is not None else None, "value")
        kind = names.get(align.attrs.get("horizontal", ""), "justify") if align is not None else "justify"
        return ParaShape(kind, side("left"), side("right"), side("intent"), side("prev"), side("next"), _number(line, "value", 160))

    @staticmethod
    def border(e: Element) -> BorderFill:
        def line(x: Element | None) -> tuple[int, int, int]:
            kind, wide = (x.attrs.get(n, "") for n in ("type", "width")) if x is not None else ("", "")
            size = wide.replace("mm", "").strip()
            return LINE_TYPES.index(kind) if kind in LINE_TYPES else 1, WIDTHS.index(size) if size in WIDTHS else 0, _color(x, "color", 0)

        return BorderFill(_number(e, "threeD") | _number(e, "shadow") << 1, [line(e.one(f"{s}Border")) for s in ("left", "right", "top", "bottom")], line(e.one("diagonal")))


def is_setting(r: Element) -> bool:
    return any(not c.empty for c in r.children if c.name in ("secPr", "ctrl"))


def runs(p: Element) -> list[Element]:
    """The runs of a paragraph but those that hold settings."""
    return [r for r in p.all("run") if not is_setting(r)]


def run_text(r: Element) -> str:
    return "".join(t.text for t in r.all("t"))


def cell_paragraphs(cell: Element) -> list[Element]:
    inner = cell.one("subList")
    return inner.all("p") if inner is not None else []


def all_text(e: Element):
    """All texts below an element, but in settings; a plain t stands for all its parent holds."""
    if any(not c.empty for c in e.children if c.name in ("secPr", "ctrl", "linesegarray")):
        return
    if e.text:
        yield e.text
    own = e.all("t")
    if len(own) == 1 and own[0].plain:
        yield own[0].text
        return
    for c in e.children:
        if c.name not in ("t", "secPr", "ctrl", "linesegarray"):
            yield from all_text(c)


def alignment(e: Element) -> str:
    holders = [(e, "align"), (e, "textAlign"), (e.one("paraPr"), "align"), (e.one("cellPr"), "align")]
    value = next((h.attrs[n] for h, n in holders if h is not None and n in h.attrs), "").lower()
    return f"text-align:{value}" if value in ("center", "right", "left", "justify") else ""


def style_attr(style: str) -> str:
    return f' style="{escape_attr(style)}"' if style else ""


def image_ref(r: Element) -> str | None:
    for node in (r.one("picture") or r.one("pic"), r.one("draw"), r.one("img")):
        if node is None:
            continue
        inner, item = node.one("img"), node.one("binItem")
        for holder, name in ((node, "binaryItemIDRef"), (inner, "binaryItemIDRef"), (item, "ref"), (node, "ref")):
            if holder is not None and holder.attrs.get(name):
                return holder.attrs[name]
    return None


def data_uri(ext: str, raw: bytes, table: dict[str, str]) -> str:
    return f"data:{table.get(ext, OTHER_MIME)};base64,{base64.b64encode(raw).decode()}"


def css_color(c: str) -> str:
    c = c.strip(SPACE_CHARACTERS)
    return "#" + c if re.fullmatch("[0-9a-fA-F]{6}", c) else c


def point_size(height: str) -> str:
    m = re.match(r"\s*([+-]?\d+)", height)
    if not m:
        return "NaN"
    tenths = math.floor(int(m[1]) / 10 + 0.5)
    return str(tenths // 10) if tenths % 10 == 0 else str(tenths / 10)


def styled(html: str, shape: Element) -> str:
    css, under = [], shape.one("underline")
    if under is not None and not under.empty and under.attrs.get("type") != "NONE":
        css.append("text-decoration:underline")
    if (c := shape.attrs.get("textColor")) and c != "#000000":
        css.append(f"color:{css_color(c)}")
    if height := shape.attrs.get("height"):
        css.append(f"font-size:{point_size(height)}pt")
    if (c := shape.attrs.get("shadeColor")) and c not in ("none", "#FFFFFF"):
        css.append(f"background-color:{css_color(c)}")
    names = [n for n, part in (("strong", "bold"), ("em", "italic")) if shape.one(part) is not None]
    if not names and not css:
        return html
    return "".join(f"<{n}>" for n in names) + f"<span{style_attr(';'.join(css))}>{html}</span>" + "".join(f"</{n}>" for n in reversed(names))


def open_package(raw: bytes, want: Callable[[str], bool] = lambda path: True) -> Package:
    return Package(unzip(raw, want))
