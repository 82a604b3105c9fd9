"""One document in memory, as decoders make it and renderers take it.

Documents nest (a cell holds paragraphs, which hold tables), so one is handled whole by one task; ``quire.sources.tables``
flattens it to rows with paths where relations are wanted.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Run:
    shape: int
    text: str


@dataclass
class Cell:
    row: int
    col: int
    row_span: int = 1
    col_span: int = 1
    paragraphs: list[Paragraph] = field(default_factory=list)


@dataclass
class Control:
    """kind: table, picture, shape, equation, header, footer, footnote, field or unknown; the other fields as the kind needs."""

    kind: str
    rows: int = 0
    cols: int = 0
    cells: list[Cell] = field(default_factory=list)
    paragraphs: list[Paragraph] = field(default_factory=list)
    binary: int = 0
    shape: str = ""
    points: tuple[int, int, int, int] | None = None
    script: str = ""
    ctrl_id: str = ""
    command: str | None = None


@dataclass
class Paragraph:
    text: str = ""
    runs: list[Run] = field(default_factory=list)
    controls: list[Control] = field(default_factory=list)
    para_shape: int = 0
    style: int = 0


@dataclass
class CharShape:
    size: int = 1000
    bold: bool = False
    italic: bool = False
    underline: bool = False
    strikeout: bool = False
    faces: tuple[int, ...] = (0,) * 7
    text_color: int = 0
    underline_color: int = 0
    shade_color: int = 0xFFFFFF
    shadow_color: int = 0


@dataclass
class ParaShape:
    align: str = "justify"
    left: int = 0
    right: int = 0
    indent: int = 0
    before: int = 0
    after: int = 0
    line: int = 160


@dataclass
class Style:
    name: str
    english: str = ""
    para_shape: int = 0
    char_shape: int = 0


@dataclass
class Fill:
    background: int
    pattern_color: int
    pattern: int


@dataclass
class BorderFill:
    attr: int = 0
    #: (type, width index, color) of left, right, top, bottom.
    lines: list[tuple[int, int, int]] = field(default_factory=list)
    diagonal: tuple[int, int, int] = (0, 0, 0)
    fill: Fill | None = None


@dataclass
class Tables:
    """What shapes and styles ids refer to; ids are places in these lists."""

    #: Seven language groups of (name, substitute or None).
    fonts: list[list[tuple[str, str | None]]] = field(default_factory=lambda: [[] for _ in range(7)])
    chars: list[CharShape] = field(default_factory=list)
    paras: list[ParaShape] = field(default_factory=list)
    styles: list[Style] = field(default_factory=list)
    borders: list[BorderFill] = field(default_factory=list)
    #: (formats of seven levels, start).
    numberings: list[tuple[list[str], int]] = field(default_factory=list)
    bullets: list[str] = field(default_factory=list)
    #: (left, right) automatic tabs.
    tabs: list[tuple[bool, bool]] = field(default_factory=list)
    #: (type, storage id, extension): link, embedding or storage.
    binaries: list[tuple[str, int, str]] = field(default_factory=list)
    #: Sections, and first numbers of pages, footnotes, endnotes, pictures, tables and equations.
    starts: tuple[int, ...] = (1,) * 7


@dataclass
class Document:
    sections: list[list[Paragraph]] = field(default_factory=list)
    tables: Tables = field(default_factory=Tables)
    #: Storage id -> (bytes, extension), in order of arrival.
    binaries: dict[int, tuple[bytes, str]] = field(default_factory=dict)
    version: tuple[int, int, int, int] = (5, 0, 6, 0)
    flags: int = 0


class DocumentError(Exception):
    """A document that can't be read; ``status`` names the kind of failure."""

    def __init__(self, status: str, message: str):
        super().__init__(message)
        self.status = status


def markup_tables(chars: list[CharShape]) -> Tables:
    """The tables of documents made from Markdown and HTML, with these character shapes."""
    fonts = [[("함초롬바탕", None), ("맑은 고딕", None), ("Courier New", None)], [("Times New Roman", None)], [], [], [], [], []]
    return Tables(fonts=fonts, chars=chars, paras=[ParaShape()], styles=[Style("바탕글", "Normal")])
