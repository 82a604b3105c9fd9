"""Markdown (the common constructs of GFM) to a Document: blocks first, then spans."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..model import Cell, CharShape, Control, Document, Paragraph, Run, markup_tables
from .html import RULE, decode_image, merged

#: Shape ids by use, and the extensions of embedded pictures.
DEFAULT, BOLD, ITALIC, BOTH, MONO = 0, 1, 2, 3, 8
HEADING = (4, 5, 6, 7, 7, 7)
EXTENSION = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/bmp": "bmp", "image/webp": "webp"}

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^`]*)$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])(?:([ \t]+)(.*)|[ \t]*)$")
_QUOTE = re.compile(r" {0,3}> ?")
_DELIM = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_BLOCK_HTML = re.compile(r" {0,3}<(?:!--|[?!]|/?(?:address|article|aside|blockquote|body|center|details|dialog|div|dl|dd|dt|fieldset|figure|figcaption|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|nav|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)\b)", re.I)
_DEFINITION = re.compile(r" {0,3}\[([^\]]+)\]:[ \t]*(\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")


@dataclass
class Block:
    """kind: heading, paragraph, text (of a tight item), quote, list, code, table, rule or other."""

    kind: str
    text: str = ""
    level: int = 0
    children: list[Block] = field(default_factory=list)
    items: list[list[Block]] = field(default_factory=list)
    ordered: bool = False
    start: int = 1
    rows: list[list[str]] = field(default_factory=list)


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    if line.endswith("|") and not line.endswith("\\|"):
        line = line[:-1]
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


class BlockParser:
    def __init__(self):
        self.links: dict[str, str] = {}

    def parse(self, text: str) -> list[Block]:
        return self.blocks(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))

    def _interrupts(self, line: str) -> bool:
        """Whether a line ends the paragraph before it."""
        item = _ITEM.match(line)
        return bool(_FENCE.match(line) or _ATX.match(line) or _RULE.match(line) or _QUOTE.match(line) or _BLOCK_HTML.match(line) or item and item[4] and item[2] in ("-", "*", "+", "1.", "1)"))

    def blocks(self, lines: list[str]) -> list[Block]:
        out: list[Block] = []
        at = 0
        while at < len(lines):
            line = lines[at]
            if not line.strip():
                at += 1
            elif re.match(r"(?: {4}| {0,3}\t)", line):
                at = self._indented(lines, at, out)
            elif m := _FENCE.match(line):
                at = self._fenced(lines, at, m, out)
            elif m := _ATX.match(line):
                out.append(Block("heading", (m[2] or "").strip(), len(m[1])))
                at += 1
            elif _RULE.match(line):
                out.append(Block("rule"))
                at += 1
            elif _QUOTE.match(line):
                at = self._quote(lines, at, out)
            elif _ITEM.match(line):
                at = self._list(lines, at, out)
            elif _BLOCK_HTML.match(line):
                while at < len(lines) and lines[at].strip():
                    at += 1
                out.append(Block("other"))
            elif m := _DEFINITION.match(line):
                self.links.setdefault(m[1].lower(), m[2].strip("<>"))
                at += 1
            elif at + 1 < len(lines) and "|" in line and _DELIM.match(lines[at + 1]) and len(_cells(line)) == len(_cells(lines[at + 1])):
                at = self._table(lines, at, out)
            else:
                at = self._paragraph(lines, at, out)
        return out

    def _indented(self, lines, at, out) -> int:
        code = []
        while at < len(lines) and (not lines[at].strip() or re.match(r"(?: {4}| {0,3}\t)", lines[at])):
            code.append(re.sub(r"^(?: {4}| {0,3}\t| {0,3}$)", "", lines[at]))
            at += 1
        while code and not code[-1].strip():
            code.pop()
        out.append(Block("code", "\n".join(code)))
        return at

    def _fenced(self, lines, at, m, out) -> int:
        indent, close = len(lines[at]) - len(lines[at].lstrip(" ")), re.compile(r" {0,3}" + re.escape(m[1][0]) + "{%d,}[ \t]*$" % len(m[1]))
        code = []
        at += 1
        while at < len(lines) and not close.match(lines[at]):
            code.append(re.sub(r"^ {0,%d}" % indent, "", lines[at]))
            at += 1
        out.append(Block("code", "\n".join(code)))
        return at + 1

    def _quote(self, lines, at, out) -> int:
        inner = []
        while at < len(lines) and lines[at].strip():
            if not _QUOTE.match(lines[at]) and (self._interrupts(lines[at]) or not inner or not inner[-1].strip()):
                break
            inner.append(_QUOTE.sub("", lines[at], count=1))
            at += 1
        out.append(Block("quote", children=self.blocks(inner)))
        return at

    def _list(self, lines, at, out) -> int:
        first = _ITEM.match(lines[at])
        mark = first[2][-1]
        block = Block("list", ordered=mark in ".)", start=int(first[2][:-1]) if mark in ".)" else 1)
        loose, raw = False, []
        while at < len(lines):
            m = _ITEM.match(lines[at])
            if not m or m[2][-1] != mark or _RULE.match(lines[at]):
                break
            width = len(m[1]) + len(m[2]) + (len(m[3]) if m[3] and len(m[3]) <= 4 and m[4] else 1)
            own = [lines[at][width:] if m[4] else ""]
            at += 1
            while at < len(lines):
                line = lines[at]
                if not line.strip():
                    nxt = next((x for x in lines[at:] if x.strip()), None)
                    if nxt is None or len(nxt) - len(nxt.lstrip(" ")) < width:
                        break
                    own.append("")
                elif len(line) - len(line.lstrip(" ")) >= width:
                    own.append(line[width:])
                elif own[-1].strip() and not _ITEM.match(line) and not self._interrupts(line):
                    own.append(line.strip())
                else:
                    break
                at += 1
            while own and not own[-1].strip():
                own.pop()
            gap = at
            while at < len(lines) and not lines[at].strip():
                at += 1
            m = _ITEM.match(lines[at]) if at < len(lines) else None
            more = bool(m and m[2][-1] == mark and not _RULE.match(lines[at]))
            loose |= "" in own or (more and at > gap)
            raw.append(own)
            if not more:
                break
        for own in raw:
            task = re.match(r"\[[ xX]\] +", own[0]) if own else None
            if task:
                own[0] = own[0][task.end() :]
            inner = self.blocks(own)
            if not loose:
                for b in inner:
                    b.kind = "text" if b.kind == "paragraph" else b.kind
            block.items.append(inner)
        out.append(block)
        return at

    def _table(self, lines, at, out) -> int:
        head = _cells(lines[at])
        rows, at = [head], at + 2
        while at < len(lines) and lines[at].strip() and not self._interrupts(lines[at]):
            cells = _cells(lines[at])[: len(head)]
            rows.append(cells + [""] * (len(head) - len(cells)))
            at += 1
        out.append(Block("table", rows=rows))
        return at

    def _paragraph(self, lines, at, out) -> int:
        own = []
        while at < len(lines) and lines[at].strip():
            if own:
                if m := re.match(r" {0,3}(=+|-+)[ \t]*$", lines[at]):
                    out.append(Block("heading", "\n".join(own), 1 if m[1][0] == "=" else 2))
                    return at + 1
                if self._interrupts(lines[at]):
                    break
            # two spaces at the end of a line break it
            own.append(lines[at].lstrip())
            at += 1
        out.append(Block("paragraph", "\n".join(own).rstrip()))
        return at


@dataclass(frozen=True)
class State:
    bold: bool = False
    italic: bool = False


class SpanParser:
    """The inline constructs of one text, in order, as (shape, text) runs; embedded pictures are kept apart."""

    _CODE = re.compile(r"(`+)(?!`)(.*?[^`])\1(?!`)", re.S)
    _LINK = re.compile(r"(!?)\[((?:\\.|\[[^\]]*\]|[^\[\]\\])*)\](?:\(\s*(<[^>]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)|\[([^\]]*)\])?")
    _AUTO = re.compile(r"<((?:[a-z][a-z0-9+.-]{1,31}:|[^\s<>@]+@)[^\s<>]*)>", re.I)
    _PLAIN = re.compile(r"[^\\`!\[<*_~\n]+")
    _MARKS = {c: re.compile(re.escape(c) + "+") for c in "*_~"}
    _TAG = re.compile(r"</?[a-z][a-z0-9-]*(?:\s[^<>]*)?/?>|<!--.*?-->", re.I | re.S)
    _ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))

    def __init__(self, links: dict[str, str]):
        self.links = links
        self.images: list[str] = []

    @classmethod
    def plain(cls, text: str) -> str:
        for a, b in cls._ENTITIES:
            text = text.replace(a, b)
        return text

    @staticmethod
    def shape(state: State, base: int) -> int:
        return BOTH if state.bold and state.italic else BOLD if state.bold else ITALIC if state.italic else base

    def runs(self, text: str, base: int = DEFAULT, state: State = State()) -> list[Run]:
        out: list[Run] = []
        dead: dict[tuple[str, int, bool], int] = {}  # from which place on no mark closes such an emphasis
        say = lambda t, shape=None: out.append(Run(self.shape(state, base) if shape is None else shape, t))
        at = 0
        while at < len(text):
            c = text[at]
            if c == "\\" and at + 1 < len(text):
                if text[at + 1] == "\n":
                    say("\n")
                else:
                    say(text[at + 1] if re.match(r"[!-/:-@\[-`{-~]", text[at + 1]) else text[at : at + 2])
                at += 2
            elif c == "`" and (m := self._CODE.match(text, at)):
                code = m[2].replace("\n", " ")
                say(code[1:-1] if code.strip() and code[0] == code[-1] == " " else code, MONO)
                at = m.end()
            elif c in "![" and (m := self._LINK.match(text, at)) and (target := self._target(m)) is not None:
                if m[1]:
                    self.images.append(target)
                    say(self.plain(m[2]))
                else:
                    out += self.runs(m[2], base, state)
                at = m.end()
            elif c == "<" and (m := self._AUTO.match(text, at)):
                say(m[1])
                at = m.end()
            elif c == "<" and (m := self._TAG.match(text, at)):
                say(m[0])
                at = m.end()
            elif c in "*_~" and (found := self._emphasis(text, at, dead)):
                inner, end, size = found
                now = state if c == "~" else State(state.bold or size > 1, state.italic or size != 2)
                out += self.runs(inner, base, now)
                at = end
            elif c == "\n":
                if out:
                    out[-1] = Run(out[-1].shape, out[-1].text.rstrip(" "))
                say("\n")
                at += 1
            else:
                m = self._PLAIN.match(text, at)
                say(self.plain(m[0] if m else c))
                at = m.end() if m else at + 1
        return merged(out)

    def _target(self, m) -> str | None:
        if m[3] is not None:
            return m[3].strip("<>")
        return self.links.get((m[4] or m[2]).lower())

    @classmethod
    def _emphasis(cls, text: str, at: int, dead: dict) -> tuple[str, int, int] | None:
        """(inner, end, marks) of an emphasis that opens here. What closes one depends on its kind only, not on its place,
        so each kind is sought once where there is none."""
        mark = text[at]
        marks = cls._MARKS[mark]
        size = marks.match(text, at).end() - at
        for n in (2, 1) if mark == "~" else (3, 2, 1):
            if size < n or at + n >= len(text) or text[at + n].isspace() or (mark == "_" and at and text[at - 1].isalnum()):
                continue
            kind = (mark, n, size == n)
            k = at + n
            if k >= dead.get(kind, len(text)):
                continue
            while (k := text.find(mark * n, k)) >= 0:
                run = marks.match(text, k).end() - k
                after = text[k + run : k + run + 1]
                if not text[k - 1].isspace() and text[k - 1] != "\\" and run >= n and (run == n or (run > n and n < 3 and size == n and run % 2 == n % 2)) and not (mark == "_" and after.isalnum()):
                    return text[at + n : k + run - n], k + run, n
                k += run
            dead[kind] = at + n
        return None


class MarkdownReader:
    def __init__(self):
        self.binaries: dict[int, tuple[bytes, str]] = {}
        self.parser = BlockParser()

    def document(self, text: str) -> Document:
        blocks = self.parser.parse(text)
        paragraphs = [p for b in blocks for p in self.block(b)]
        sizes = [CharShape(), CharShape(bold=True), CharShape(italic=True), CharShape(bold=True, italic=True), *(CharShape(size=s, bold=True) for s in (1800, 1600, 1400, 1200)), CharShape(faces=(2,) * 7)]
        return Document([paragraphs], markup_tables(sizes), self.binaries)

    def spans(self, text: str, base: int = DEFAULT) -> tuple[list[Run], list[str]]:
        parser = SpanParser(self.parser.links)
        return parser.runs(text, base), parser.images

    @staticmethod
    def made(runs: list[Run], controls: list[Control] | None = None) -> Paragraph:
        return Paragraph("".join(r.text for r in runs), runs, controls or [])

    def block(self, b: Block) -> list[Paragraph]:
        return getattr(self, "on_" + b.kind)(b)

    def on_heading(self, b):
        return [self.made(self.spans(b.text, HEADING[b.level - 1])[0])]

    def on_paragraph(self, b):
        runs, images = self.spans(b.text)
        controls = []
        for uri in images:
            if found := decode_image(uri, EXTENSION):
                self.binaries[i := len(self.binaries) + 1] = found
                controls.append(Control("picture", binary=i))
        return [self.made(runs, controls)]

    def on_text(self, b):
        return [self.made(self.spans(b.text)[0])]

    def on_quote(self, b):
        inner = [p for c in b.children for p in self.block(c)]
        return [Paragraph("> " + p.text, [Run(p.runs[0].shape, "> " + p.text)] if p.runs else [], p.controls) for p in inner]

    def on_list(self, b):
        out = []
        for k, item in enumerate(b.items):
            mark = f"{b.start + k}. " if b.ordered else "- "
            inner = [p for c in item for p in self.block(c)] or [Paragraph()]
            first = inner[0]
            inner[0] = Paragraph(mark + first.text, [Run(DEFAULT, mark), *first.runs], first.controls)
            out += inner
        return out

    def on_code(self, b):
        return [Paragraph(line, [Run(MONO, line)] if line else []) for line in b.text.split("\n")]

    def on_table(self, b):
        table = Control("table", rows=len(b.rows), cols=len(b.rows[0]))
        for r, row in enumerate(b.rows):
            table.cells += [Cell(r, k, paragraphs=[self.made(self.spans(t, BOLD if r == 0 else DEFAULT)[0])]) for k, t in enumerate(row)]
        return [Paragraph(controls=[table])]

    def on_rule(self, b):
        return [Paragraph(RULE, [Run(DEFAULT, RULE)])]

    def on_other(self, b):
        return []


def read_markdown(text: str) -> Document:
    return MarkdownReader().document(text)
