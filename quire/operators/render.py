"""A Document as text, Markdown and preview lines."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from ..functions.scalar import BINARY_MIME, OTHER_MIME
from ..model import Control, Document, Paragraph

NOTES = ("header", "footer", "footnote")
Resolver = Callable[[str, int], str]


def escape_md(text: str) -> str:
    text = re.sub(r"([\\*_`~])", r"\\\1", text)
    return re.sub("(^|[\\n\\r\\u2028\\u2029])([#>])", r"\1\\\2", text)


def text_of(p: Paragraph) -> str:
    parts = [p.text] if p.text else []
    for c in p.controls:
        if c.kind == "table":
            parts.append("\n".join("\n".join(map(text_of, cell.paragraphs)) for cell in c.cells))
        elif c.kind in NOTES:
            parts.append("\n".join(map(text_of, c.paragraphs)))
        elif c.kind == "equation" and c.script:
            parts.append(c.script)
    return "\n".join(parts)


def to_text(doc: Document, paragraph: str = "\n", section: str = "\n\n") -> str:
    """Stored texts, then what controls hold; cells one below the other in stored order."""
    return section.join(paragraph.join(map(text_of, s)) for s in doc.sections)


def fill_grid(c: Control) -> list[list]:
    """Cells by row and column, those with spans in every place they cover; the first to come keeps a place."""
    grid = [[None] * c.cols for _ in range(c.rows)]
    for cell in c.cells:
        if 0 <= cell.row < c.rows and 0 <= cell.col < c.cols:
            for r in range(cell.row, min(c.rows, cell.row + cell.row_span)):
                for k in range(cell.col, min(c.cols, cell.col + cell.col_span)):
                    grid[r][k] = grid[r][k] or cell
    return grid


def table_lines(rows: list[list[str]]) -> str:
    """A Markdown table; the first row is its head."""
    line = lambda cells: "| " + " | ".join(x or " " for x in cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


class MarkdownWriter:
    def __init__(self, doc: Document, embed: bool = False, resolver: Resolver | None = None):
        self.doc, self.embed, self.resolver = doc, embed, resolver

    def document(self) -> str:
        blocks = [b for s in self.doc.sections for p in s if (b := self.paragraph(p))]
        return re.sub(r"\n{3,}", "\n\n", "\n\n".join(blocks)).strip() + "\n"

    def paragraph(self, p: Paragraph) -> str:
        parts = ["".join(self.run(r.shape, r.text) for r in p.runs if r.text) if p.runs else escape_md(p.text)]
        parts += [self.control(c) for c in p.controls]
        return "\n\n".join(x for x in parts if x)

    def run(self, shape: int, text: str) -> str:
        out, chars = escape_md(text), self.doc.tables.chars
        if shape < len(chars):
            out = f"**{out}**" if chars[shape].bold else out
            out = f"*{out}*" if chars[shape].italic else out
        return out

    def control(self, c: Control) -> str:
        if c.kind == "table" and c.rows and c.cols:
            return table_lines([[self.cell(cell.paragraphs) if cell else "" for cell in row] for row in fill_grid(c)])
        if c.kind == "picture":
            return self.picture(c.binary)
        if c.kind in NOTES:
            inner = "\n".join(x for x in map(self.paragraph, c.paragraphs) if x)
            return "\n".join("> " + line for line in inner.split("\n")) if inner else ""
        return f"```\n{c.script}\n```" if c.kind == "equation" and c.script else ""

    def cell(self, paragraphs: list[Paragraph]) -> str:
        inner = " ".join(x for x in map(self.paragraph, paragraphs) if x)
        return re.sub(r"\n+", " ", inner).replace("|", "\\|")

    def picture(self, i: int) -> str:
        if i not in self.doc.binaries:
            return ""
        raw, ext = self.doc.binaries[i]
        path = f"BinData/image{i}.{ext.lower()}"
        if self.embed:
            path = f"data:{BINARY_MIME.get(ext.lower(), OTHER_MIME)};base64,{base64.b64encode(raw).decode()}"
        elif self.resolver:
            path = self.resolver(path, i)
        return f"![]({path})"


def to_markdown(doc: Document, embed: bool = False, resolver: Resolver | None = None) -> str:
    return MarkdownWriter(doc, embed, resolver).document()


def cells_by_row(c: Control) -> list[list]:
    """The cells of each row by column; cells outside the table are left out."""
    rows = [[] for _ in range(c.rows)]
    for cell in c.cells:
        if 0 <= cell.row < c.rows:
            rows[cell.row].append(cell)
    return [sorted(row, key=lambda cell: cell.col) for row in rows]


def preview_lines(p: Paragraph) -> list[str]:
    out = [p.text] if p.text else []
    for c in p.controls:
        if c.kind == "table":
            for row in cells_by_row(c):
                if row:
                    out.append("".join("<" + " ".join(" ".join(preview_lines(q)) for q in cell.paragraphs) + " >" for cell in row))
        elif c.kind in NOTES:
            out += [line for q in c.paragraphs for line in preview_lines(q)]
        elif c.kind == "equation" and c.script:
            out.append(c.script)
    return out


def to_preview(doc: Document, units: int = 2000) -> str:
    """The first 2,000 UTF-16 units of the preview lines."""
    whole = "\r\n".join(line for s in doc.sections for p in s for line in preview_lines(p))
    return whole if len(whole) <= units // 2 else whole.encode("utf-16-le", "surrogatepass")[: 2 * units].decode("utf-16-le", "ignore")
