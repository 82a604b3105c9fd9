"""HTML to a Document."""

from __future__ import annotations

import base64
import binascii
import re
from html.parser import HTMLParser

from ..model import Cell, CharShape, Control, Document, Paragraph, Run, markup_tables

#: Tags by their part in a page.
VOID = frozenset("br img hr input meta link source track wbr col area base embed".split())
SKIPPED = frozenset("script style head noscript template".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em i kbd mark q s samp small span strong sub sup time u var wbr del ins img".split())
FLAT = frozenset("p div section article".split())
#: Shape ids, and the extensions of embedded pictures.
DEFAULT, BOLD, ITALIC, BOTH, MONO = range(5)
HEADING = {"h1": 5, "h2": 6, "h3": 7, "h4": 8, "h5": 8, "h6": 8}
EXTENSION = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/bmp": "bmp"}
RULE = "─────"
BLANK = re.compile("[\\t\\n\\x0b\\x0c\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")


def shapes() -> list[CharShape]:
    mono = CharShape(faces=(2,) * 7)
    return [CharShape(), CharShape(bold=True), CharShape(italic=True), CharShape(bold=True, italic=True), mono, *(CharShape(size=s, bold=True) for s in (1800, 1600, 1400, 1200))]


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []


#: Open tags that a new tag closes first, if they are innermost.
_P = frozenset(("p",))
_FORM = frozenset("input option optgroup select button datalist textarea".split())
_TABLE = frozenset(("thead", "tbody"))
CLOSES = (
    dict.fromkeys("h1 h2 h3 h4 h5 h6 address article aside blockquote details div dl fieldset figcaption figure footer form header hr main nav ol p pre section table ul".split(), _P)
    | dict.fromkeys("select input output button datalist textarea".split(), _FORM)
    | {"tr": frozenset(("tr", "th", "td")), "th": frozenset(("th",)), "td": frozenset(("thead", "th", "td")), "body": frozenset(("head", "link", "script")), "li": frozenset(("li",))}
    | {"option": frozenset(("option",)), "optgroup": frozenset(("optgroup", "option")), "dd": frozenset(("dt", "dd")), "dt": frozenset(("dt", "dd"))}
    | {"rt": frozenset(("rt", "rp")), "rp": frozenset(("rt", "rp")), "tbody": _TABLE, "tfoot": _TABLE}
)
NEVER_OPEN = VOID | frozenset("basefont command frame isindex keygen param".split())


class TreeBuilder(HTMLParser):
    """Tags close what they imply; an end tag closes all that is open inside its own. Comments and declarations are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.open: list[str] = []
        self.skipped = 0

    def _begin(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in SKIPPED:
            self.skipped += 1
        elif not self.skipped:
            node = Node(tag, attrs, self.at)
            self.at.children.append(node)
            if tag not in VOID:
                self.at = node

    def _end(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif not self.skipped and tag not in VOID and self.at.tag == tag and self.at.parent:
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        while self.open and self.open[-1] in CLOSES.get(tag, ()):
            self._end(self.open.pop())
        known: dict[str, str] = {}
        for k, v in attrs:
            known.setdefault(k, v or "")
        self._begin(tag, known)
        if tag in NEVER_OPEN:
            self._end(tag)
        else:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes only tags that never stay open anyway

    def handle_endtag(self, tag):
        if tag in NEVER_OPEN:
            if tag == "br":
                self._begin("br", {})
        elif tag in self.open:
            while True:
                last = self.open.pop()
                self._end(last)
                if last == tag:
                    break
        elif tag == "p":
            self.handle_starttag("p", [])
            self.handle_endtag("p")

    def handle_data(self, data):
        if not self.skipped and data:
            self.at.children.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def decode_image(uri: str, extensions: dict[str, str]) -> tuple[bytes, str] | None:
    """Bytes and extension of a base64 data URI; None for any other address."""
    m = re.match("data:([^;]+);base64,([^\\n\\r\\u2028\\u2029]*)$", uri, re.I)
    if not m:
        return None
    body = re.sub(r"[^A-Za-z0-9+/]", "", m[2].replace("-", "+").replace("_", "/").split("=")[0])
    body = body[:-1] if len(body) % 4 == 1 else body
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4)), extensions.get(m[1].lower(), "bin")
    except binascii.Error:
        return None


def merged(runs: list[Run]) -> list[Run]:
    """Neighbours of one shape as one run; empty ones go."""
    out: list[Run] = []
    for r in runs:
        if not r.text:
            continue
        if out and out[-1].shape == r.shape:
            out[-1] = Run(r.shape, out[-1].text + r.text)
        else:
            out.append(r)
    return out


class HtmlReader:
    def __init__(self):
        self.binaries: dict[int, tuple[bytes, str]] = {}

    def document(self, html: str) -> Document:
        found = [p for child in parse(html).children for p in self.block(child, frozenset(), "")]
        found = [p for p in found if BLANK.sub("", p.text) or p.controls]
        return Document([found], markup_tables(shapes()), self.binaries)

    @staticmethod
    def shape(state: frozenset) -> int:
        if "mono" in state:
            return MONO
        return BOTH if {"bold", "italic"} <= state else BOLD if "bold" in state else ITALIC if "italic" in state else DEFAULT

    def made(self, prefix: str, runs: list[Run], controls: list[Control]) -> list[Paragraph]:
        text = "".join(r.text for r in runs)
        if not text and not controls:
            return []
        return [Paragraph(prefix + text, [Run(DEFAULT, prefix), *runs] if prefix else runs, controls)]

    def block(self, node: Node | str, state: frozenset, prefix: str) -> list[Paragraph]:
        if isinstance(node, str):
            text = BLANK.sub(" ", node)
            return self.made(prefix, [Run(self.shape(state), text)] if text else [], [])
        handler = getattr(self, "on_" + node.tag, None) if node.tag.isalnum() else None
        if node.tag in FLAT:
            return self.made(prefix, self.inline(node, state), self.images(node))
        if node.tag in HEADING:
            return self.made("", self.inline(node, state, HEADING[node.tag]), [])
        return handler(node, state) if handler else self.inside(node, state, prefix)

    def inside(self, node: Node, state: frozenset, prefix: str) -> list[Paragraph]:
        """One paragraph if all children are inline; else each for itself, the first with the prefix."""
        if all(isinstance(c, str) or c.tag in INLINE for c in node.children):
            return self.made(prefix, self.inline(node, state), self.images(node))
        return [p for k, c in enumerate(node.children) for p in self.block(c, state, "" if k else prefix)]

    def _items(self, node: Node, state: frozenset, mark) -> list[Paragraph]:
        items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
        return [p for k, item in enumerate(items, 1) for p in self.inside(item, state, mark(k)) or [Paragraph(mark(k), [Run(DEFAULT, mark(k))])]]

    def on_ul(self, node, state):
        return self._items(node, state, lambda k: "- ")

    def on_ol(self, node, state):
        return self._items(node, state, lambda k: f"{k}. ")

    def on_blockquote(self, node, state):
        inner = self.inside(node, state, "")
        return [Paragraph("> " + p.text, [Run(p.runs[0].shape if p.runs else DEFAULT, "> "), *p.runs], p.controls) for p in inner]

    def on_br(self, node, state):
        return [Paragraph()]

    def on_hr(self, node, state):
        return [Paragraph(RULE, [Run(DEFAULT, RULE)])]

    def on_pre(self, node, state):
        raw = lambda n: n if isinstance(n, str) else "\n" if n.tag == "br" else "".join(map(raw, n.children))
        return [Paragraph(line, [Run(MONO, line)] if line else []) for line in "".join(map(raw, node.children)).split("\n")]

    def on_img(self, node, state):
        found = self.image(node)
        return [Paragraph(controls=[found])] if found else []

    def on_table(self, node, state):
        rows: list[Node] = []

        def gather(n: Node):
            for c in n.children:
                if isinstance(c, Node):
                    if c.tag == "tr":
                        rows.append(c)
                    elif c.tag in ("thead", "tbody", "tfoot"):
                        gather(c)

        gather(node)
        table = Control("table", rows=len(rows))
        for r, row in enumerate(rows):
            own = [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]
            table.cols = max(table.cols, len(own))
            for k, c in enumerate(own):
                head = c.tag == "th"
                runs = self.inline(c, frozenset(("bold",)) if head else frozenset(), BOLD if head else DEFAULT)
                table.cells.append(Cell(r, k, self.span(c, "rowspan"), self.span(c, "colspan"), [Paragraph("".join(x.text for x in runs), runs)]))
        return [Paragraph(controls=[table])]

    @staticmethod
    def span(node: Node, name: str) -> int:
        try:
            return max(1, int(float(node.attrs.get(name, "1").strip() or 1)))
        except (ValueError, OverflowError):
            return 1

    def inline(self, node: Node, state: frozenset, fixed: int | None = None) -> list[Run]:
        out: list[Run] = []

        def walk(n: Node | str, state: frozenset):
            if isinstance(n, str):
                out.append(Run(self.shape(state) if fixed is None else fixed, BLANK.sub(" ", n)))
            elif n.tag == "img":
                out.append(Run(self.shape(state), n.attrs.get("alt", "")))
            elif n.tag == "br":
                out.append(Run(self.shape(state), "\n"))
            else:
                more = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "code": "mono", "samp": "mono", "kbd": "mono"}.get(n.tag)
                for c in n.children:
                    walk(c, state | {more} if more else state)

        walk(node, state)
        return merged(out)

    def image(self, node: Node) -> Control | None:
        found = decode_image(node.attrs.get("src", ""), EXTENSION)
        if not found:
            return None
        i = len(self.binaries) + 1
        self.binaries[i] = found
        return Control("picture", binary=i)

    def images(self, node: Node) -> list[Control]:
        out = []
        for c in node.children:
            if isinstance(c, Node):
                out += [x for x in [self.image(c)] if x] if c.tag == "img" else self.images(c)
        return out


def read_html(html: str) -> Document:
    return HtmlReader().document(html)


