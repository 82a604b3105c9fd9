"""Binary word-processor documents: records to a Document."""

from __future__ import annotations

import struct

from ..model import BorderFill, Cell, CharShape, Control, Document, DocumentError, Fill, Paragraph, ParaShape, Run, Style, Tables
from .binary import CompoundFile, Cursor, Record, inflate, records, utf16

#: Record tags.
TAGS = {
    "DOCUMENT_PROPERTIES": 16, "ID_MAPPINGS": 17, "BIN_DATA": 18, "FACE_NAME": 19, "BORDER_FILL": 20, "CHAR_SHAPE": 21, "TAB_DEF": 22, "NUMBERING": 23,
    "BULLET": 24, "PARA_SHAPE": 25, "STYLE": 26, "PARA_HEADER": 66, "PARA_TEXT": 67, "PARA_CHAR_SHAPE": 68, "PARA_LINE_SEG": 69, "CTRL_HEADER": 71,
    "LIST_HEADER": 72, "SHAPE_COMPONENT": 76, "TABLE": 77, "LINE": 78, "RECTANGLE": 79, "ELLIPSE": 80, "ARC": 81, "POLYGON": 82, "CURVE": 83, "PICTURE": 85, "EQEDIT": 88,
}
NAMES = {v: k for k, v in TAGS.items()}
#: Characters of paragraph texts that take eight units, and those with a text of their own.
WIDE = frozenset((1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23))
NARROW = {0x0A: "\n", 0x18: " ", 0x19: " ", 0x1E: "-", 0x1F: " "}
ALIGN = ("justify", "left", "right", "center", "distribute", "distributeSpace")
SHAPES = {"LINE": "line", "RECTANGLE": "rectangle", "ELLIPSE": "ellipse", "ARC": "arc", "POLYGON": "polygon", "CURVE": "curve"}


def paragraph_text(raw: bytes) -> str:
    """Text units, with controls left out or replaced; a carriage return ends the text."""
    out, at = bytearray(), 0
    while at + 2 <= len(raw):
        unit = raw[at] | raw[at + 1] << 8
        if unit == 13:
            break
        if unit == 9:
            out += b"\t\0"
            at += 16
        elif unit in WIDE:
            at += 16
        else:
            if unit >= 32:
                out += raw[at : at + 2]
            elif unit in NARROW:
                out += NARROW[unit].encode("utf-16-le")
            at += 2
    return utf16(bytes(out))


def split_runs(text: str, changes: list[tuple[int, int]]) -> list[Run]:
    """Runs between the places at which the shape changes; places count UTF-16 units of the text."""
    if not text:
        return []
    if not changes:
        return [Run(0, text)]
    raw = text.encode("utf-16-le", "surrogatepass")
    changes = sorted(changes, key=lambda c: c[0])
    ends = [at for at, _ in changes[1:]] + [len(raw) // 2]
    return [Run(shape, utf16(raw[2 * at : 2 * max(at, end)])) for (at, shape), end in zip(changes, ends, strict=True)]


def _subtree(rows: list[Record], at: int) -> int:
    """The end of the rows below rows[at]."""
    end = at + 1
    while end < len(rows) and rows[end].level > rows[at].level:
        end += 1
    return end


def read_section(data: bytes) -> list[Paragraph]:
    rows = records(data)
    return read_paragraphs(rows, rows[0].level) if rows else []


def read_paragraphs(rows: list[Record], level: int) -> list[Paragraph]:
    """The paragraphs whose heads stand at this level."""
    out, at = [], 0
    while at < len(rows):
        if rows[at].tag == TAGS["PARA_HEADER"] and rows[at].level == level:
            end = _subtree(rows, at)
            out.append(_paragraph(rows[at:end]))
            at = end
        else:
            at += 1
    return out


def _paragraph(rows: list[Record]) -> Paragraph:
    head = rows[0].data
    p = Paragraph(para_shape=struct.unpack_from("<H", head, 8)[0] if len(head) >= 10 else 0, style=head[10] if len(head) >= 11 else 0)
    changes: list[tuple[int, int]] = []
    at = 1
    while at < len(rows):
        r = rows[at]
        end = _subtree(rows, at)
        if r.level == rows[0].level + 1:
            if r.tag == TAGS["PARA_TEXT"]:
                p.text = paragraph_text(r.data)
            elif r.tag == TAGS["PARA_CHAR_SHAPE"]:
                changes = [struct.unpack_from("<II", r.data, k) for k in range(0, len(r.data) - 7, 8)]
            elif r.tag == TAGS["CTRL_HEADER"]:
                p.controls.append(read_control(rows[at:end]))
                at = end
                continue
        at += 1
    p.runs = split_runs(p.text, changes)
    return p


def read_control(rows: list[Record]) -> Control:
    """A control from its head and the records below it."""
    head, level = rows[0].data, rows[0].level
    if len(head) < 4:
        return Control("unknown")
    name = head[3::-1].decode("latin-1")
    below = rows[1:]
    if name == "tbl ":
        return _table(below, level + 1)
    if name == "gso ":
        return _drawing(below, level)
    if name == "eqed":
        edit = next((r for r in below if r.tag == TAGS["EQEDIT"]), None)
        return Control("equation", script=_script(edit.data) if edit else "")
    if name in ("head", "foot", "fn  "):
        kind = {"head": "header", "foot": "footer", "fn  ": "footnote"}[name]
        at = next((k for k, r in enumerate(below) if r.tag == TAGS["LIST_HEADER"] and r.level == level + 1), None)
        return Control(kind, paragraphs=[] if at is None else read_paragraphs(below[at + 1 : _subtree(below, at)], level + 2))
    if name[0] == "%":
        cursor = Cursor(head, 4)
        if len(head) - 4 < 7:
            return Control("field", ctrl_id=name)
        cursor.take(5)
        size = cursor.u16()
        return Control("field", ctrl_id=name, command=cursor.text(size) if 0 < size * 2 <= cursor.left else None)
    return Control("unknown", ctrl_id=name)


def _table(rows: list[Record], level: int) -> Control:
    """Cells stand beside their paragraphs: a cell lasts to the next list or table head at its level."""
    out = Control("table")
    heads = [k for k, r in enumerate(rows) if r.level == level and r.tag in (TAGS["TABLE"], TAGS["LIST_HEADER"])]
    tables = [k for k in heads if rows[k].tag == TAGS["TABLE"]]
    for k, end in zip(heads, heads[1:] + [len(rows)], strict=True):
        data = rows[k].data
        if k in tables:
            out.rows, out.cols = struct.unpack_from("<HH", data, 4) if len(data) >= 8 else (0, 0)
        elif tables and k > tables[0]:  # a list before the table is its caption
            col, row, cols, height = struct.unpack_from("<HHHH", data, 8) if len(data) >= 16 else (0, 0, 1, 1)
            out.cells.append(Cell(row, col, height or 1, cols or 1, read_paragraphs(rows[k + 1 : end], level)))
    return out


def _drawing(rows: list[Record], level: int) -> Control:
    for r in rows:
        if r.tag == TAGS["PICTURE"] and r.level <= level + 3 and len(r.data) >= 73:
            return Control("picture", binary=struct.unpack_from("<H", r.data, 71)[0])
    for r in rows:
        shape = SHAPES.get(NAMES.get(r.tag, "")) if r.level <= level + 3 else None
        if shape:
            whole = shape == "line" and len(r.data) >= 16
            return Control("shape", shape=shape, points=struct.unpack_from("<4i", r.data) if whole else None)
    return Control("unknown", ctrl_id="gso ")


def _script(data: bytes) -> str:
    """An equation's script; none if its length is 0, over 10,000, or past the end."""
    if len(data) < 17:
        return ""
    size = struct.unpack_from("<H", data, 15)[0]
    return utf16(data[17 : 17 + 2 * size]) if 0 < size <= 10_000 and 17 + 2 * size <= len(data) else ""


# definitions


def _border_fill(c: Cursor) -> BorderFill:
    out = BorderFill(c.u16() if c.left >= 2 else 0)
    out.lines = [(c.u8(), c.u8(), c.u32()) if c.left >= 6 else (1, 0, 0) for _ in range(4)]
    if c.left >= 6:
        out.diagonal = (c.u8(), c.u8(), c.u32())
    if c.left >= 4 and (kind := c.u32()) & 1 and c.left >= 12:
        out.fill = Fill(c.u32(), c.u32(), c.i32())
    return out


def _numbering(c: Cursor) -> tuple[list[str], int]:
    formats = []
    for _ in range(7):
        if c.left < 14:
            return formats + [""] * (7 - len(formats)), 1
        c.take(12)
        size = c.u16()
        formats.append(c.text(size) if size * 2 <= c.left else "")
    return formats, c.u16() if c.left >= 2 else 1


def _bullet(c: Cursor) -> str:
    if c.left < 14:
        return "●"
    c.take(12)
    unit = c.u16()
    return chr(unit) if unit and not 0xD800 <= unit < 0xE000 else "●"


def _char_shape(c: Cursor) -> CharShape:
    faces = tuple(c.u16() for _ in range(7))
    c.take(28)
    size, attr = c.i32(), c.u32()
    c.take(2)
    colors = [c.u32() if c.left >= 4 else d for d in (0, 0, 0xFFFFFF, 0)]
    return CharShape(size, bool(attr & 2), bool(attr & 1), bool(attr >> 2 & 3), (attr >> 18 & 7) > 1, faces, *colors)


def _para_shape(c: Cursor) -> ParaShape:
    kind = c.u32() >> 2 & 7
    v = [c.i32() if c.left >= 4 else d for d in (0, 0, 0, 0, 0, 160)]
    return ParaShape(ALIGN[kind] if kind < len(ALIGN) else "unknown", *v)


def _style(c: Cursor) -> Style:
    name, english = c.optional_text() or "", c.optional_text() or ""
    if c.left < 7:
        return Style(name, english)
    c.take(3)
    return Style(name, english, c.u16(), c.u16())


def _binary(c: Cursor) -> tuple[str, int, str]:
    kind = {0: "link", 1: "embedding", 2: "storage"}.get(c.u16() & 15, "link")
    if kind == "link":
        return kind, 0, ""
    return kind, c.u16(), c.optional_text() or ""


def read_tables(data: bytes) -> Tables:
    """All definitions; a font belongs to the group in whose share of the counts it falls, one over all counts to the last."""
    out, ends = Tables(), None
    fonts = 0
    for r in records(data):
        c, kind = Cursor(r.data), NAMES.get(r.tag)
        try:
            if kind == "DOCUMENT_PROPERTIES":
                out.starts = tuple(c.u16() if c.left >= 2 else 1 for _ in range(7))
            elif kind == "ID_MAPPINGS":
                counts = [struct.unpack_from("<I", r.data, 4 * k)[0] if len(r.data) >= 4 * k + 4 else 0 for k in range(1, 8)]
                ends = [sum(counts[: k + 1]) for k in range(7)]
            elif kind == "FACE_NAME":
                attr, name = c.u8(), c.optional_text() or ""
                substitute = None
                if attr & 0x80 and c.left:
                    c.take(1)
                    substitute = c.optional_text()
                group = 0 if ends is None else next((k for k in range(7) if fonts < ends[k]), 6)
                out.fonts[group].append((name, substitute))
                fonts += 1
            elif kind == "BORDER_FILL":
                out.borders.append(_border_fill(c))
            elif kind == "TAB_DEF":
                attr = c.u32() if c.left >= 4 else 0
                out.tabs.append((bool(attr & 1), bool(attr & 2)))
            elif kind == "NUMBERING":
                out.numberings.append(_numbering(c))
            elif kind == "BULLET":
                out.bullets.append(_bullet(c))
            elif kind == "CHAR_SHAPE":
                out.chars.append(_char_shape(c))
            elif kind == "PARA_SHAPE":
                out.paras.append(_para_shape(c))
            elif kind == "STYLE":
                out.styles.append(_style(c))
            elif kind == "BIN_DATA":
                out.binaries.append(_binary(c))
        except (struct.error, IndexError) as e:
            raise DocumentError("invalid_record", f"{kind}: {e}") from e
    return out


def read_file_header(raw: bytes | None) -> tuple[tuple[int, int, int, int], int]:
    """(version, flags)."""
    if raw is None or len(raw) < 256 or not raw[:32].split(b"\0")[0].startswith(b"HWP Document File"):
        raise DocumentError("invalid_header", "no valid file header")
    return (raw[35], raw[34], raw[33], raw[32]), struct.unpack_from("<I", raw, 36)[0]


def format_of(data: bytes) -> str:
    if len(data) >= 8 and data[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
        return "hwp"
    if len(data) >= 8 and data[:4] == b"PK\x03\x04":
        return "hwpx"
    return "hwp3" if data[:17] == b"HWP Document File" else "unknown"


def read_document(data: bytes) -> Document:
    """A binary document; DocumentError with the first gate that fails."""
    kind = format_of(data)
    if kind == "hwp3":
        raise DocumentError("unsupported", "version 3 documents are not supported")
    if kind != "hwp":
        raise DocumentError("invalid_format", f"no binary document: {kind}")
    box = CompoundFile(data)
    version, flags = read_file_header(box.read("/FileHeader"))
    if flags & 2:
        raise DocumentError("encrypted", "the document has a password")
    if version[0] != 5 or version[1] > 1:
        raise DocumentError("unsupported", "version " + ".".join(map(str, version)))
    if flags & 4:
        raise DocumentError("unsupported", "a document for distribution")
    unpack = inflate if flags & 1 else bytes
    info = box.read("/DocInfo")
    if info is None:
        raise DocumentError("invalid_container", "no stream /DocInfo")
    out = Document(version=version, flags=flags, tables=read_tables(unpack(info)))
    for k in range(box.section_count()):
        raw = box.read(f"/BodyText/Section{k}")
        if raw is None:
            continue  # a gap in the numbers
        raw = unpack(raw)
        try:
            out.sections.append(read_section(raw))
        except (DocumentError, struct.error, IndexError):
            out.sections.append([])  # a section that can't be read is empty, the others stay
    out.binaries = _embedded(box, out.tables.binaries)
    return out


def _embedded(box: CompoundFile, refs: list[tuple[str, int, str]]) -> dict[int, tuple[bytes, str]]:
    streams = {(i, e): p for p, i, e in box.binary_streams()}
    out = {}
    for kind, i, ext in refs:
        if kind == "link":
            continue
        ext = (ext or ("OLE" if kind == "storage" else "dat")).lower()
        path = streams.get((i, ext))
        raw = box.read(path) if path else None
        if raw is None:
            continue
        try:
            raw = inflate(raw)
        except DocumentError:
            pass  # kept as it is
        magic = bytes.fromhex("D0CF11E0A1B11AE1")
        if kind == "storage" and raw[:8] != magic and raw[4:12] == magic:
            raw = raw[4:]
        out[i] = (raw, ext)
    return out
