"""Document operators over DataFrames: one map over Arrow batches per operator, no shuffle.

A document is decoded and rendered whole by one task. What fails is a row with status and message, not a failed job:
mode ``permissive`` keeps it, ``drop`` leaves it out, ``failfast`` raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, templates
from ..model import Document, DocumentError, Paragraph, Run, markup_tables
from ..sources import html, hwp, markdown, package, tables
from . import package_writer, render

MODES = ("permissive", "drop", "failfast")


def _bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else x


def _text(x: bytes | str) -> str:
    return x if isinstance(x, str) else package.decode_text(x)


def read_text(text: str) -> Document:
    lines = text.replace("\r\n", "\n").split("\n")
    return Document([[Paragraph(x, [Run(0, x)] if x else []) for x in lines]], markup_tables([]))


#: Kinds of sources that have a document model.
READERS: dict[str, Callable[[bytes | str], Document]] = {
    "hwp": lambda x: hwp.read_document(_bytes(x)),
    "html": lambda x: html.read_html(_text(x)),
    "md": lambda x: markdown.read_markdown(_text(x)),
    "txt": lambda x: read_text(_text(x)),
    "hwpx": lambda x: package.Relations(_opened(x, True)).document(),
}
#: What a renderer of packages needs to unzip: pictures only to embed them.
_NO_PICTURES = lambda path: not path.startswith("BinData/")


def kind_of(raw: bytes | str) -> str:
    return hwp.format_of(_bytes(raw))


def _opened(raw: bytes | str, pictures: bool) -> package.Package:
    return package.open_package(_bytes(raw), (lambda path: True) if pictures else _NO_PICTURES).readable()


class PartialDocument(DocumentError):
    """What could be read of a document, and what could not."""

    def __init__(self, result, parts: list[str]):
        super().__init__("partial", "no XML: " + ", ".join(sorted(parts)))
        self.result = result


def _whole(p: package.Package, result: str) -> str:
    if p.damaged:
        raise PartialDocument(result, p.damaged)
    return result


def to_text(kind: str, raw: bytes | str) -> str:
    """PartialDocument, with the text of the others, where a part that was needed is no XML; so for all that read packages."""
    return _whole(p := _opened(raw, False), p.to_text()) if kind == "hwpx" else render.to_text(READERS[kind](raw))


def to_markdown(kind: str, raw: bytes | str, embed: bool = False, resolver=None) -> str:
    """resolver: the address of a picture from its path (and storage id, but for packages)."""
    # pictures are unzipped only to embed them
    return _whole(p := _opened(raw, embed), p.to_markdown(embed, resolver)) if kind == "hwpx" else render.to_markdown(READERS[kind](raw), embed, resolver)


def to_html(kind: str, raw: bytes | str, options: package.HtmlOptions) -> str:
    if kind != "hwpx":
        raw = to_package(kind, raw)
    p = _opened(raw, options.images)
    return _whole(p, p.to_html(options))


def to_preview(kind: str, raw: bytes | str) -> str:
    return (_opened(raw, False).preview() or "") if kind == "hwpx" else render.to_preview(READERS[kind](raw))


def to_package(kind: str, raw: bytes | str, title: str = "", creator: str = "") -> bytes:
    if kind == "hwpx":
        return _bytes(raw)
    if kind == "txt":
        return package_writer.write_text(_text(raw), title, creator)
    return package_writer.write_document(READERS[kind](raw), title, creator)


def _guarded(one: Callable, raw, mode: str) -> tuple[str, str | None, list]:
    """(status, message, results)."""
    if raw is None:
        return "null", None, []
    try:
        return "ok", None, list(one(raw))
    except PartialDocument as e:
        if mode == "failfast":
            raise
        return e.status, str(e), [(e.result,)]
    except DocumentError as e:
        if mode == "failfast":
            raise
        return e.status, str(e), []
    except Exception as e:  # one damaged document is a row, not the end of the job
        if mode == "failfast":
            raise
        return "error", f"{type(e).__name__}: {e}", []


def flat_map(df: DataFrame, content: str, schema: str, one: Callable[..., Iterator[tuple]], keys: list[str], mode: str = "permissive", outer: bool = False, beside: str | None = None) -> DataFrame:
    """keys, the columns of schema for every tuple that ``one`` gives, status and message. one takes the content, and the value beside it.

    With outer a document without results has one row of nulls, so none is lost; else only failures have.
    A key that has the name of an output column gets "_in" behind its own.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode}")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    own = StructType.fromDDL(schema)
    made = StructType([*own, *StructType.fromDDL("status string, message string")])
    df = df.select(*(F.col(k).alias(f"{k}_in" if k in made.names else k) for k in keys), F.col(content).alias("_content"), *([F.col(beside).alias("_beside")] if beside else []))
    out = StructType([*df.schema.fields[: len(keys)], *made])
    arrow = to_arrow_schema(out)
    n = len(own)

    def run(batches):
        for batch in batches:
            contents = batch.column(len(keys)).to_pylist()
            besides = batch.column(len(keys) + 1).to_pylist() if beside else None
            take, columns, status, message, size = [], [[] for _ in range(n)], [], [], 0

            def flush():
                ids = pa.array(take, pa.int64())
                arrays = [batch.column(k).take(ids) for k in range(len(keys))]
                arrays += [pa.array(c, f.type) for c, f in zip([*columns, status, message], list(arrow)[len(keys) :], strict=True)]
                return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

            for k, raw in enumerate(contents):
                said, why, got = _guarded(partial(one, beside=besides[k]) if beside else one, raw, mode)
                if said not in ("ok", "null") and mode == "drop":
                    continue
                if not got and (outer or said not in ("ok", "null")):
                    got = [(None,) * n]
                for values in got:
                    take.append(k)
                    for c, v in zip(columns, values, strict=True):
                        c.append(v)
                        size += len(v) if isinstance(v, (str, bytes)) else 8
                    status.append(said)
                    message.append(why)
                    if size > 16 << 20:
                        yield flush()
                        take, columns, status, message, size = [], [[] for _ in range(n)], [], [], 0
            if take:
                yield flush()

    return df.mapInArrow(run, out)


def _keys(df: DataFrame, content: str, keys: list[str] | None) -> list[str]:
    return [c for c in df.columns if c != content] if keys is None else keys


def render_as(df: DataFrame, what: str, kind: str | None = None, content: str = "content", keys: list[str] | None = None, mode: str = "permissive", links: str | None = None, **options) -> DataFrame:
    """keys, ``what`` (text, markdown, html, preview or package), status, message: one row per document.

    kind: hwp, hwpx, html, md or txt; None takes it from each document's first bytes. A package some of whose parts are
    no XML has status "partial" and what the others give. links: a column of maps from a picture's path to the address
    that Markdown or HTML shall have for it; a path that a map lacks stays.
    """
    if what == "html":
        options = {"options": package.HtmlOptions(**options)}
    make = {"text": to_text, "markdown": to_markdown, "html": to_html, "preview": to_preview, "package": to_package}[what]

    def one(raw, beside=None):
        own, more = kind or kind_of(raw), options
        if own not in READERS:
            raise DocumentError("unsupported" if own == "hwp3" else "invalid_format", f"format {own}")
        if links:
            known = dict(beside or ())
            resolver = lambda path, *_: known.get(path, path)
            more = {"options": replace(options["options"], resolver=resolver)} if what == "html" else options | {"resolver": resolver}
        yield (make(own, raw, **more),)

    if links and what not in ("markdown", "html"):
        raise ValueError(f"no links in {what}")
    return flat_map(df, content, f"{what} {'binary' if what == 'package' else 'string'}", one, [k for k in _keys(df, content, keys) if keys is not None or k != links], mode, outer=True, beside=links)


def document_table(df: DataFrame, table: str, kind: str, content: str = "content", keys: list[str] | None = None, mode: str = "permissive") -> DataFrame:
    """The rows of one of ``tables.SCHEMAS`` for every document."""
    return flat_map(df, content, tables.SCHEMAS[table], lambda raw: tables.rows(READERS[kind](raw), table), _keys(df, content, keys), mode)


def package_entries(df: DataFrame, content: str = "content", keys: list[str] | None = None, mode: str = "permissive", prefixes: tuple[str, ...] = ("",)) -> DataFrame:
    """(entry_ord, path, bytes) of every file of a package whose path starts with one of prefixes; no other is inflated."""
    one = lambda raw: ((k, p, b) for k, (p, b) in enumerate(package.unzip(_bytes(raw), lambda p: p.startswith(prefixes)).items()))
    return flat_map(df, content, "entry_ord int, path string, bytes binary", one, _keys(df, content, keys), mode)


def package_info(df: DataFrame, content: str = "content", keys: list[str] | None = None, mode: str = "permissive") -> DataFrame:
    """Metadata, encryption, contents, manifest, spine and images of packages."""
    schema = (
        "title string, creator string, created string, modified string, version string, caret_position string, has_encryption_info boolean, contents_files array<string>, "
        "manifest array<struct<id:string,href:string,media_type:string>>, spine array<string>, images array<string>, likely_mimetype boolean"
    )

    def one(raw):
        p = package.open_package(_bytes(raw))
        m = p.metadata()
        items = [dict(zip(("id", "href", "media_type"), i, strict=True)) for i in p.manifest]
        yield *(m[k] for k in ("title", "creator", "created", "modified", "version", "caret_position")), p.encrypted, p.contents(), items, p.spine, p.images(), p.likely

    return flat_map(df, content, schema, one, _keys(df, content, keys), mode, outer=True)


def hwp_records(df: DataFrame, content: str = "content", keys: list[str] | None = None, mode: str = "permissive") -> DataFrame:
    """(seq, tag_id, level, size, data) of the records of a stream."""
    from ..sources.binary import records

    one = lambda raw: ((k, r.tag, r.level, len(r.data), r.data) for k, r in enumerate(records(_bytes(raw))))
    return flat_map(df, content, "seq int, tag_id int, level int, size bigint, data binary", one, _keys(df, content, keys), mode)


def compound_entries(df: DataFrame, content: str = "content", keys: list[str] | None = None, mode: str = "permissive") -> DataFrame:
    """(path, size, data) of the streams of a compound file."""
    from ..sources.binary import CompoundFile

    def one(raw):
        box = CompoundFile(_bytes(raw))
        for p in box.streams():
            data = box.read(p)
            yield p, len(data), data

    return flat_map(df, content, "path string, size bigint, data binary", one, _keys(df, content, keys), mode)


def fill_template(df: DataFrame, text: str = "text", data: str = "data", out: str = "filled") -> DataFrame:
    """df with {{ keys }} of text filled from the JSON in data."""
    return df.withColumn(out, templates.fill_template(F.col(text), F.col(data)))


def template_html(filled: Column) -> Column:
    """Each run of line feeds ends a paragraph."""
    lines = F.transform(F.split(filled, "\\n+", -1), lambda x: F.concat(F.lit("<p>"), scalar.escape_html(x), F.lit("</p>")))
    return F.array_join(lines, "")
