"""Names of record tags, control ids and field ids, as lookups in literal maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Record tags.
TAG_NAMES = {
    16: "DOCUMENT_PROPERTIES", 17: "ID_MAPPINGS", 18: "BIN_DATA", 19: "FACE_NAME", 20: "BORDER_FILL", 21: "CHAR_SHAPE", 22: "TAB_DEF", 23: "NUMBERING", 24: "BULLET",
    25: "PARA_SHAPE", 26: "STYLE", 27: "DOC_DATA", 28: "DISTRIBUTE_DOC_DATA", 30: "COMPATIBLE_DOCUMENT", 31: "LAYOUT_COMPATIBILITY", 32: "TRACKCHANGE",
    66: "PARA_HEADER", 67: "PARA_TEXT", 68: "PARA_CHAR_SHAPE", 69: "PARA_LINE_SEG", 70: "PARA_RANGE_TAG", 71: "CTRL_HEADER", 72: "LIST_HEADER", 73: "PAGE_DEF",
    74: "FOOTNOTE_SHAPE", 75: "PAGE_BORDER_FILL", 76: "SHAPE_COMPONENT", 77: "TABLE", 78: "SHAPE_LINE", 79: "SHAPE_RECTANGLE", 80: "SHAPE_ELLIPSE", 81: "SHAPE_ARC",
    82: "SHAPE_POLYGON", 83: "SHAPE_CURVE", 84: "SHAPE_OLE", 85: "SHAPE_PICTURE", 86: "SHAPE_CONTAINER", 87: "CTRL_DATA", 88: "EQEDIT", 90: "SHAPE_TEXTART",
    91: "FORM_OBJECT", 92: "MEMO_SHAPE", 93: "MEMO_LIST", 94: "FORBIDDEN_CHAR", 95: "CHART_DATA",
}
#: Control ids.
CONTROL_NAMES = {
    "secd": "SectionDef", "cold": "ColumnDef", "tbl ": "Table", "eqed": "Equation", "gso ": "GenShape", "head": "Header", "foot": "Footer", "fn  ": "Footnote",
    "en  ": "Endnote", "atno": "AutoNumber", "nwno": "NewNumber", "pgnp": "PageNumPos", "pghd": "PageHide", "idxm": "IndexMark", "bokm": "Bookmark", "tcps": "Tcps",
    "form": "Form", "tdut": "CharOverlap", "tcmt": "HiddenComment",
}
#: Ids of shapes and of fields.
SHAPE_IDS = {"picture": "$pic", "rectangle": "$rec", "line": "$lin", "ellipse": "$ell", "polygon": "$pol", "arc": "$arc", "curve": "$cur", "connector": "$col"}
FIELD_IDS = {
    "clickhere": "%clk", "hyperlink": "%hlk", "bookmark": "%bmk", "date": "%dte", "docdate": "%ddt", "path": "%pat", "mailmerge": "%mmg", "crossref": "%xrf",
    "formula": "%fmu", "summary": "%smr", "userinfo": "%usr",
}


def _looked_up(table: dict, key: Column, other: str) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(other))


def tag_name(tag: Column) -> Column:
    return _looked_up(TAG_NAMES, tag.cast("int"), "UNKNOWN")


def control_name(ctrl_id: Column) -> Column:
    """The name of a control id of four characters."""
    return _looked_up(CONTROL_NAMES, ctrl_id, "Unknown")


def field_kind(ctrl_id: Column) -> Column:
    """The kind of a field id; null for any other control."""
    pairs = [F.lit(x) for kind, i in FIELD_IDS.items() for x in (i, kind)]
    return F.try_element_at(F.create_map(*pairs), ctrl_id)
