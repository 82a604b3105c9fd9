"""Documents as relations.

A paragraph lives at ``para_path``: places of paragraph, control, cell, paragraph, ... from its section down, so a
prefix is an ancestor and array order is document order. All tables carry the caller's id column.
"""

from __future__ import annotations

from collections.abc import Iterator

from ..model import Document, Paragraph
from ..operators.render import NOTES

SCHEMAS = {
    "paragraph": "section_idx int, para_path array<int>, depth int, container string, para_shape_id int, style_id int, text string",
    "run": "section_idx int, para_path array<int>, run_idx int, char_shape_id int, text string",
    "control": "section_idx int, para_path array<int>, ctrl_idx int, kind string, ctrl_id string, row_count int, col_count int, bin_data_id int, shape_type string, points array<int>, script string, command string",
    "table_cell": "section_idx int, control_path array<int>, cell_idx int, row int, col int, row_span int, col_span int",
    "char_shape": "id int, size int, bold boolean, italic boolean, underline boolean, strikeout boolean, text_color bigint, shade_color bigint",
    "para_shape": "id int, alignment string, left_margin int, right_margin int, indent int, prev_spacing int, next_spacing int, line_spacing int",
    "style": "id int, name string, eng_name string, para_shape_id int, char_shape_id int",
    "border_fill": "id int, attr int, line_types array<int>, widths array<int>, colors array<bigint>",
    "font_face": "lang_idx int, font_id int, name string, substitute string",
    "numbering": "id int, formats array<string>, start int",
    "bullet": "id int, char string",
    "tab_def": "id int, auto_left boolean, auto_right boolean",
    "binary_item": "storage_id int, ord int, extension string, data binary",
}


def walk(doc: Document) -> Iterator[tuple[int, tuple[int, ...], str, Paragraph]]:
    """(section, path, container, paragraph) of every paragraph, an ancestor before what it holds."""

    def below(s: int, paragraphs: list[Paragraph], above: tuple[int, ...], container: str):
        for k, p in enumerate(paragraphs):
            path = (*above, k)
            yield s, path, container, p
            for c, control in enumerate(p.controls):
                if control.kind == "table":
                    for i, cell in enumerate(control.cells):
                        yield from below(s, cell.paragraphs, (*path, c, i), "cell")
                elif control.kind in NOTES:
                    yield from below(s, control.paragraphs, (*path, c, 0), control.kind)

    for s, paragraphs in enumerate(doc.sections):
        yield from below(s, paragraphs, (), "body")


def rows(doc: Document, table: str) -> Iterator[tuple]:
    """The rows of one table, as SCHEMAS has it."""
    t = doc.tables
    if table == "paragraph":
        for s, path, container, p in walk(doc):
            yield s, list(path), len(path) // 3, container, p.para_shape, p.style, p.text
    elif table == "run":
        for s, path, _, p in walk(doc):
            yield from ((s, list(path), k, r.shape, r.text) for k, r in enumerate(p.runs))
    elif table == "control":
        for s, path, _, p in walk(doc):
            for k, c in enumerate(p.controls):
                grid = (c.rows, c.cols) if c.kind == "table" else (None, None)
                yield s, list(path), k, c.kind, c.ctrl_id or None, *grid, c.binary if c.kind == "picture" else None, c.shape or None, list(c.points) if c.points else None, c.script if c.kind == "equation" else None, c.command
    elif table == "table_cell":
        for s, path, _, p in walk(doc):
            for k, c in enumerate(p.controls):
                yield from ((s, [*path, k], i, x.row, x.col, x.row_span, x.col_span) for i, x in enumerate(c.cells))
    elif table == "char_shape":
        yield from ((i, c.size, c.bold, c.italic, c.underline, c.strikeout, c.text_color, c.shade_color) for i, c in enumerate(t.chars))
    elif table == "para_shape":
        yield from ((i, p.align, p.left, p.right, p.indent, p.before, p.after, p.line) for i, p in enumerate(t.paras))
    elif table == "style":
        yield from ((i, x.name, x.english, x.para_shape, x.char_shape) for i, x in enumerate(t.styles))
    elif table == "border_fill":
        yield from ((i, b.attr, *map(list, zip(*b.lines, strict=True))) if b.lines else (i, b.attr, [], [], []) for i, b in enumerate(t.borders))
    elif table == "font_face":
        yield from ((g, i, n, x) for g, own in enumerate(t.fonts) for i, (n, x) in enumerate(own))
    elif table == "numbering":
        yield from ((i, f, n) for i, (f, n) in enumerate(t.numberings))
    elif table == "bullet":
        yield from enumerate(t.bullets)
    elif table == "tab_def":
        yield from ((i, a, b) for i, (a, b) in enumerate(t.tabs))
    elif table == "binary_item":
        yield from ((i, k, ext, raw) for k, (i, (raw, ext)) in enumerate(doc.binaries.items()))
    else:
        raise ValueError(f"no table {table}")
