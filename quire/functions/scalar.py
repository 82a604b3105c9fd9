"""Per-value functions as Column expressions: they stay in the JVM and in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what JavaScript's \s and trim() hold.
SPACES = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
SPACE_CHARACTERS = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Border line types and widths in mm by index.
LINE_TYPES = (
    "NONE", "SOLID", "DASH", "DOT", "DASH_DOT", "DASH_DOT_DOT", "LONG_DASH", "CIRCLE", "DOUBLE", "THIN_THICK_DOUBLE", "THICK_THIN_DOUBLE",
    "THIN_THICK_THIN_TRIPLE", "WAVE", "DOUBLE_WAVE", "THICK_3D", "THICK_3D_REVERSE", "THIN_3D", "THIN_3D_REVERSE",
)
WIDTHS = ("0.1", "0.12", "0.15", "0.2", "0.25", "0.3", "0.4", "0.5", "0.6", "0.7", "1.0", "1.5", "2.0", "3.0", "4.0", "5.0")
#: Paragraph alignments and their names in packages.
ALIGNMENTS = {"left": "LEFT", "right": "RIGHT", "center": "CENTER", "justify": "JUSTIFY", "distribute": "DISTRIBUTE", "distributeSpace": "DISTRIBUTE_SPACE"}
#: The bits of a file header's flags.
FLAGS = ("compressed", "encrypted", "distribution", "script", "drm", "xml_template", "history", "signature", "certificate_encrypted", "signature_reserve", "certificate_drm")
#: Three tables of media types by extension.
IMAGE_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp"}
BINARY_MIME = IMAGE_MIME | {"svg": "image/svg+xml"}
MARKDOWN_MIME = {k: IMAGE_MIME[k] for k in ("png", "jpg", "jpeg", "gif")}
OTHER_MIME = "application/octet-stream"


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_md(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.regexp_replace(c, "([*_`~])", "\\\\$1")
    return F.regexp_replace(c, "(?m)(?<![\\u0085])^([#>])", "\\\\$1")


def escape_html(c: Column) -> Column:
    return _replaced(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escape_xml(c: Column) -> Column:
    return _replaced(escape_html(c), ('"', "&quot;"), ("'", "&apos;"))


def decode_entities(c: Column) -> Column:
    """&amp; goes first, so an escaped entity is decoded twice."""
    return _replaced(c, ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACES}]+", " ")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def color_hex(c: Column) -> Column:
    """0xAABBGGRR as #RRGGBB."""
    part = lambda shift: F.lpad(F.hex(F.shiftright(c.cast("long"), shift).bitwiseAND(F.lit(255))), 2, "0")
    return F.concat(F.lit("#"), part(0), part(8), part(16))


def normalize_color(c: Column) -> Column:
    """Without white space around it; six hex digits get a #, all else stays."""
    c = trimmed(c)
    return F.when(c.rlike("^[0-9a-fA-F]{6}$"), F.concat(F.lit("#"), c)).otherwise(c)


def points(c: Column) -> Column:
    """Hundredths of a point, rounded to a tenth, without a closing .0."""
    tenth = F.floor(c.cast("double") / 10 + 0.5)
    return F.concat(F.floor(tenth / 10).cast("string"), F.when(tenth % 10 == 0, "").otherwise(F.concat(F.lit("."), F.pmod(tenth, F.lit(10)).cast("string"))))


def _listed(names: tuple[str, ...], i: Column, other: str) -> Column:
    return F.when((i >= 0) & (i < len(names)), F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)).otherwise(other)


def line_type(i: Column) -> Column:
    return _listed(LINE_TYPES, i, "SOLID")


def width_mm(i: Column) -> Column:
    return F.concat(_listed(WIDTHS, i, "0.1"), F.lit(" mm"))


def _mapped(table: dict[str, str], c: Column, other: str) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def alignment(c: Column) -> Column:
    return _mapped(ALIGNMENTS, c, "JUSTIFY")


def mime(ext: Column, table: dict[str, str] = IMAGE_MIME) -> Column:
    return _mapped(table, F.lower(ext), OTHER_MIME)


def data_uri(content: Column, media: Column) -> Column:
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.regexp_replace(F.base64(content), "\\s", ""))


def data_uri_parts(uri: Column) -> Column:
    """A struct of media and content, null where uri is no base64 data URI."""
    pattern = "(?is)^data:([^;]+);base64,(.*)$"
    body = F.struct(F.lower(F.regexp_extract(uri, pattern, 1)).alias("media"), F.try_to_binary(F.regexp_extract(uri, pattern, 2), F.lit("base64")).alias("content"))
    return F.when(uri.rlike(pattern), body)


def u32(content: Column, at: int) -> Column:
    """The little-endian unsigned 32-bit number at this byte."""
    byte = lambda k: F.conv(F.hex(F.substring(content, at + 1 + k, 1)), 16, 10).cast("long")
    return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216


def detect_format(content: Column) -> Column:
    """hwp, hwpx, hwp3 or unknown by the first bytes."""
    starts = lambda h: F.hex(F.substring(content, 1, len(h) // 2)) == h
    long = F.length(content)
    return (
        F.when((long >= 8) & starts("D0CF11E0A1B11AE1"), "hwp")
        .when((long >= 8) & starts("504B0304"), "hwpx")
        .when((long >= 17) & starts(b"HWP Document File".hex().upper()), "hwp3")
        .otherwise("unknown")
    )


def file_header(content: Column) -> Column:
    """valid, version numbers and flags of a 256-byte file header; nulls where it is invalid."""
    valid = (F.length(content) >= 256) & (F.hex(F.substring(content, 1, 17)) == b"HWP Document File".hex().upper())
    byte = lambda k: F.conv(F.hex(F.substring(content, k + 1, 1)), 16, 10).cast("int")
    numbers = {n: F.when(valid, byte(k)) for n, k in (("major", 35), ("minor", 34), ("build", 33), ("revision", 32))}
    return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), *(c.alias(n) for n, c in numbers.items()), F.when(valid, u32(content, 36)).alias("flags"))


def flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(1 << FLAGS.index(name)).cast("long")) != 0


def version_text(major: Column, minor: Column, build: Column, revision: Column) -> Column:
    return F.concat_ws(".", *(c.cast("string") for c in (major, minor, build, revision)))


def version_supported(major: Column, minor: Column) -> Column:
    return (major == 5) & minor.isin(0, 1)


def open_status(fmt: Column, header: Column) -> Column:
    """ok, or the first gate that a binary document fails: the order counts."""
    return (
        F.when(fmt == "hwp3", "unsupported")
        .when(fmt != "hwp", "invalid_format")
        .when(~header["valid"], "invalid_header")
        .when(flag(header["flags"], "encrypted"), "encrypted")
        .when(~version_supported(header["major"], header["minor"]), "unsupported")
        .when(flag(header["flags"], "distribution"), "unsupported")
        .otherwise("ok")
    )


def record_header(word: Column) -> Column:
    """tag, level and size of a record's first word; size 4095 means that the next word has it."""
    w = word.cast("long")
    return F.struct(w.bitwiseAND(F.lit(1023)).alias("tag"), F.shiftright(w, 10).bitwiseAND(F.lit(1023)).alias("level"), F.shiftright(w, 20).bitwiseAND(F.lit(4095)).alias("size"))


def ctrl_id_text(word: Column) -> Column:
    """A control id's four characters, from the number that they make big-endian."""
    return F.concat(*(F.chr(F.shiftright(word.cast("long"), s).bitwiseAND(F.lit(255))) for s in (24, 16, 8, 0)))


def is_field_id(word: Column) -> Column:
    return F.shiftright(word.cast("long"), 24).bitwiseAND(F.lit(255)) == 37


def hex_id(i: Column) -> Column:
    return F.lpad(F.lower(F.hex(i.cast("long"))), 4, "0")


def paragraphs(text: Column) -> Column:
    """The lines of a plain text."""
    return F.split(text, "\\r?\\n", -1)


def preview(lines: Column, most: int = 2000) -> Column:
    """The first UTF-16 units of the lines; a character of two units is not cut."""
    whole = F.array_join(F.filter(lines, lambda x: x != ""), "\r\n")
    raw = F.encode(F.substring(whole, 1, most), "UTF-16BE")
    half = F.conv(F.hex(F.substring(raw, 2 * most - 1, 1)), 16, 10).between(0xD8, 0xDB)
    cut = F.decode(F.when(half, F.substring(raw, 1, 2 * most - 2)).otherwise(F.substring(raw, 1, 2 * most)), "UTF-16BE")
    return F.when(F.length(raw) > 2 * most, cut).otherwise(F.substring(whole, 1, most))


def section_number(path: Column) -> Column:
    """The number that orders sections in text and HTML; 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "section(\\d+)\\.xml", 1), F.lit("")).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def likely_package_type(media: Column) -> Column:
    """Whether a media type names a package of this kind, without case."""
    return F.lower(media).contains("owpml") | F.lower(media).contains("hwpx")
