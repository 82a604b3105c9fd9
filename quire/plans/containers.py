"""Queries over binary documents: containers are made from table rows and decoded by the engine; SQL starts from the rows."""

from __future__ import annotations

import json
import struct

from pyspark.sql import functions as F

from ..operators import frames
from . import build as b
from .catalogue import c, query, table


def _made(rows, make, key="doc_id"):
    """(key, content): make's bytes for the JSON array of each key's rows, in the order of their first field."""
    own = [x for x in rows.columns if x != key]
    gathered = rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*own)))).alias("rows"))
    return frames.flat_map(gathered, "rows", "content binary", lambda raw: iter([(make(json.loads(raw)),)]), [key]).select(key, "content")


def _lines(text: str) -> bytes:
    """A document of a paragraph a line; every other one is compressed."""
    lines = text.replace("\r\n", "\n").split("\n")
    return b.document([b"".join(b.plain(0, x) for x in lines)], flags=len(text) % 2)


def _texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", parsed=True).where("text is not null")
    return frames.flat_map(docs, "text", "content binary", lambda raw: iter([(_lines(raw),)]), ["doc_id"]).select("doc_id", "content")


@query("hwp_to_text", "select doc_id, replace(text, chr(13) || chr(10), chr(10)) as text from documents where text is not null")
def hwp_to_text(spark, sf_dir):
    return frames.render_as(_texts(spark, sf_dir), "text").select("doc_id", "text")


@query("hwp_paragraphs", r"select doc_id, cast(i - 1 as int) as para_idx, p[i] as text from (select doc_id, string_split_regex(text, '\r?\n') as p from documents where text is not null), lateral (select unnest(range(1, len(p) + 1)) as i)")
def hwp_paragraphs(spark, sf_dir):
    rows = frames.document_table(_texts(spark, sf_dir), "paragraph", "hwp")
    return rows.select("doc_id", F.element_at("para_path", 1).alias("para_idx"), "text")


@query("hwp_to_hwpx_text", "select doc_id, replace(text, chr(13) || chr(10), chr(10)) as text from documents where text is not null")
def hwp_to_hwpx_text(spark, sf_dir):
    packed = frames.render_as(_texts(spark, sf_dir), "package").select("doc_id", c("package").alias("content"))
    return frames.render_as(packed, "text").select("doc_id", "text")


@query("hwp_to_preview", r"select doc_id, substr(array_to_string(list_filter(string_split_regex(text, '\r?\n'), lambda x: x <> ''), chr(13) || chr(10)), 1, 2000) as preview from documents where text is not null")
def hwp_to_preview(spark, sf_dir):
    return frames.render_as(_texts(spark, sf_dir), "preview").select("doc_id", "preview")


_CHANGES = (0, 5, 40, 200)


@query(
    "hwp_runs",
    """with d as (select doc_id, replace(replace(text, chr(13), ' '), chr(10), ' ') as text from documents where length(text) > 0),
    ch as (select doc_id, unnest([0, 5, 40, 200]) as pos from d),
    w as (select doc_id, pos, lead(pos) over (partition by doc_id order by pos) as nxt, row_number() over (partition by doc_id order by pos) - 1 as run_idx from ch)
    select d.doc_id, cast(run_idx as int) as run_idx, pos % 7 as char_shape_id, substr(text, pos + 1, greatest(coalesce(nxt, length(text)), pos) - pos) as text from d join w on d.doc_id = w.doc_id""",
)
def hwp_runs(spark, sf_dir):
    """Runs between the places of a paragraph's shape changes."""
    docs = table(spark, sf_dir, "documents", parsed=True).where("length(text) > 0").select("doc_id", F.regexp_replace("text", "[\r\n]", " ").alias("text"))
    changes = tuple((at, at % 7) for at in _CHANGES)
    # a tab takes eight units in the stream and one in the text, so places count the text's
    make = lambda raw: iter([(b.document([b.plain(0, raw, changes)]),)])
    made = frames.flat_map(docs, "text", "content binary", make, ["doc_id"]).select("doc_id", "content")
    return frames.document_table(made, "run", "hwp").select("doc_id", "run_idx", "char_shape_id", "text")


_STREAM = "select o_custkey, o_orderkey, 16 + o_orderkey % 90 as tag_id, o_orderkey % 1024 as level, o_orderkey * 7 % 5000 as size from orders"


@query(
    "hwp_records",
    f"select o_custkey, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as seq, cast(tag_id as int) as tag_id, cast(level as int) as level, size, md5(repeat(chr(cast(97 + tag_id % 26 as int)), cast(size as int))) as data from ({_STREAM})",
)
def hwp_records(spark, sf_dir):
    """Streams of records, those from 4,095 bytes on with a size of their own."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (16 + c("o_orderkey") % 90).alias("tag"), (c("o_orderkey") % 1024).alias("level"), (c("o_orderkey") * 7 % 5000).alias("size"))
    make = lambda rows: b"".join(b.record(r["tag"], r["level"], bytes([97 + r["tag"] % 26]) * r["size"]) for r in rows)
    found = frames.hwp_records(_made(rows, make, "o_custkey"))
    return found.select("o_custkey", "seq", "tag_id", "level", "size", F.md5("data").alias("data"))


@query(
    "hwp_open_status",
    """select o_orderkey, case when k = 4 then 'invalid_container' when k = 3 then 'unsupported' when k = 2 then 'invalid_format' when o_orderkey % 11 = 0 then 'invalid_header' when f & 2 <> 0 then 'encrypted'
    when not (5 + o_orderkey % 2 = 5 and o_orderkey % 3 in (0, 1)) then 'unsupported' when f & 4 <> 0 then 'unsupported' when o_orderkey % 13 = 0 then 'invalid_container' else 'ok' end as status
    from (select o_orderkey, o_orderkey % 5 as k, o_orderkey % 8 as f from orders)""",
)
def hwp_open_status(spark, sf_dir):
    """Which gate a document fails, in their order: format, container, header, password, version, distribution, definitions."""

    def make(raw):
        key = int(raw)
        if key % 5 in (2, 3):
            yield (b"?" * 600 if key % 5 == 2 else b"HWP Document File V3.00" + bytes(600),)
        elif key % 5 == 4:
            yield (bytes.fromhex("D0CF11E0A1B11AE1") + b"x" * (key % 700),)
        else:
            name = b"XWP Document File" if key % 11 == 0 else b"HWP Document File"
            parts = {"/FileHeader": b.file_header((5 + key % 2, key % 3, 0, 0), key % 8, name), "/BodyText/Section0": b""}
            yield (b.compound(parts if key % 13 == 0 else parts | {"/DocInfo": b""}),)

    rows = table(spark, sf_dir, "orders", parsed=True).select("o_orderkey", c("o_orderkey").cast("string").alias("key"))
    made = frames.flat_map(rows, "key", "content binary", make, ["o_orderkey"]).select("o_orderkey", "content")
    return frames.render_as(made, "text").select("o_orderkey", "status")


# definitions: one document for 32 parts, each part with a definition of every kind


def _definitions(rows) -> bytes:
    info = b.record(16, 0, struct.pack("<7H", *range(1, 8)))
    info += b.record(17, 0, struct.pack("<8I", len(rows), *[4] * 7))
    kinds: list[list[bytes]] = [[] for _ in range(9)]
    extra = {}
    for r in rows:
        k, size = r["p_partkey"], r["p_size"]
        kinds[0].append(b.record(18, 0, struct.pack("<HH", 1, k % 32 + 1) + b.wide("png")))
        kinds[1].append(b.record(19, 0, bytes([0x80 if k % 2 else 0]) + b.wide(r["p_name"]) + (b"\1" + b.wide(r["p_brand"]) if k % 2 else b"")))
        lines = b"".join(struct.pack("<BBI", (k + s) % 18, (k + s) % 16, (k * 7919 + s) % (1 << 24)) for s in range(4))
        kinds[2].append(b.record(20, 0, struct.pack("<H", k % 65536) + lines + struct.pack("<BBI", 1, 0, 0) + struct.pack("<I", 0)))
        kinds[3].append(b.record(21, 0, struct.pack("<7H", *[k % 4] * 7) + bytes(28) + struct.pack("<iI", 1000 + size * 10, k * 40503 % (1 << 21)) + bytes(2) + struct.pack("<4I", k * 7919 % (1 << 24), 0, k * 31 % (1 << 24), 0)))
        kinds[4].append(b.record(22, 0, struct.pack("<I", k % 4)))
        kinds[5].append(b.record(23, 0, b"".join(bytes(12) + b.wide(f"^{n}{r['p_type']}") for n in range(1, 8)) + struct.pack("<H", size)))
        kinds[6].append(b.record(24, 0, bytes(12) + struct.pack("<H", 0x2460 + k % 20)))
        kinds[7].append(b.record(25, 0, struct.pack("<I6i", (k % 8) << 2, size, -size, k, size * 2, size * 3, 100 + size)))
        kinds[8].append(b.record(26, 0, b.wide(r["p_name"]) + b.wide(r["p_brand"]) + bytes(3) + struct.pack("<HH", k % 7, k % 5)))
        extra[f"/BinData/BIN{k % 32 + 1:04X}.png"] = b.deflated(r["p_name"].encode()) if k % 2 else r["p_name"].encode()
    return b.document([b""], info + b"".join(b"".join(x) for x in kinds), extra=extra)


def _defined(spark, sf_dir, name):
    rows = table(spark, sf_dir, "part").select((F.floor(c("p_partkey") / 32)).alias("doc_id"), "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    made = frames.document_table(_made(rows, _definitions), name, "hwp").drop("status", "message")
    shown = {n: F.array_join(c(n).cast("array<string>"), ",") for n, t in made.dtypes if t.startswith("array")} | {n: F.decode(n, "UTF-8") for n, t in made.dtypes if t == "binary"}
    return made.withColumns(shown) if shown else made


_PARTS = "select p_partkey // 32 as doc_id, p_partkey as k, p_size as s, p_name, p_brand, p_type, cast(row_number() over (partition by p_partkey // 32 order by p_partkey) - 1 as int) as id from part"

for _name, _table, _sql in (
    ("hwp_char_shapes", "char_shape", "doc_id, id, cast(1000 + s * 10 as int) as size, (a >> 1) & 1 = 1 as bold, a & 1 = 1 as italic, (a >> 2) & 3 > 0 as underline, (a >> 18) & 7 > 1 as strikeout, k * 7919 % 16777216 as text_color, k * 31 % 16777216 as shade_color from (select *, k * 40503 % 2097152 as a from p)"),
    ("hwp_para_shapes", "para_shape", "doc_id, id, (['justify', 'left', 'right', 'center', 'distribute', 'distributeSpace', 'unknown', 'unknown'])[k % 8 + 1] as alignment, cast(s as int) as left_margin, cast(-s as int) as right_margin, cast(k as int) as indent, cast(s * 2 as int) as prev_spacing, cast(s * 3 as int) as next_spacing, cast(100 + s as int) as line_spacing from p"),
    ("hwp_styles", "style", "doc_id, id, p_name as name, p_brand as eng_name, cast(k % 7 as int) as para_shape_id, cast(k % 5 as int) as char_shape_id from p"),
    ("hwp_border_fills", "border_fill", "doc_id, id, cast(k % 65536 as int) as attr, array_to_string([(k + x) % 18 for x in [0, 1, 2, 3]], ',') as line_types, array_to_string([(k + x) % 16 for x in [0, 1, 2, 3]], ',') as widths, array_to_string([(k * 7919 + x) % 16777216 for x in [0, 1, 2, 3]], ',') as colors from p"),
    ("hwp_font_faces", "font_face", "doc_id, least(id // 4, 6)::int as lang_idx, cast(case when id >= 28 then id - 24 else id % 4 end as int) as font_id, p_name as name, case when k % 2 = 1 then p_brand end as substitute from p"),
    ("hwp_numberings", "numbering", "doc_id, id, array_to_string(['^' || x || p_type for x in [1, 2, 3, 4, 5, 6, 7]], ',') as formats, cast(s as int) as start from p"),
    ("hwp_bullets", "bullet", "doc_id, id, chr(cast(9312 + k % 20 as int)) as char from p"),
    ("hwp_tab_defs", "tab_def", "doc_id, id, k % 2 = 1 as auto_left, k % 4 >= 2 as auto_right from p"),
    ("hwp_binary_items", "binary_item", "doc_id, cast(k % 32 + 1 as int) as storage_id, id as ord, 'png' as extension, p_name as data from p"),
):
    query(_name, f"with p as ({_PARTS}) select {_sql}")(lambda spark, sf_dir, t=_table: _defined(spark, sf_dir, t))


@query("hwp_streams", f"with p as ({_PARTS}) select doc_id, '/Root Entry' as x, path from p, lateral (select unnest(['/BinData/BIN' || printf('%04X', cast(k % 32 + 1 as int)) || '.png', '/FileHeader', '/DocInfo', '/BodyText/Section0']) as path) where id = 0 or path like '/BinData%' group by all".replace("'/Root Entry' as x, ", ""))
def hwp_streams(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.floor(c("p_partkey") / 32)).alias("doc_id"), "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return frames.compound_entries(_made(rows, _definitions)).select("doc_id", "path")


# controls: a paragraph for each part, with a control by its key


def _control(r) -> bytes:
    k, name = r["p_partkey"], r["p_name"]
    kind = k % 8
    if kind == 0:
        return b.control(1, "eqed", below=b.record(88, 2, bytes(15) + b.wide(name)))
    if kind == 1:
        return b.control(1, "gso ", below=b.record(76, 2, bytes(4)) + b.record(78, 3, struct.pack("<4i", k, -k, r["p_size"], 7)))
    if kind == 2:
        return b.control(1, "gso ", below=b.record(76, 2, bytes(4)) + b.record(79, 3, bytes(8)))
    if kind == 3:
        return b.control(1, "gso ", below=b.record(76, 2, bytes(4)) + b.record(85, 3, bytes(71) + struct.pack("<H", k % 100)))
    if kind == 4:
        return b.control(1, "%hlk", bytes(5) + b.wide(name))
    if kind in (5, 6):
        return b.control(1, ("head", "fn  ")[kind - 5], below=b.record(72, 2, bytes(8)) + b.plain(3, name) + b.plain(3, r["p_brand"]))
    return b.control(1, "secd")


def _controls(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.floor(c("p_partkey") / 16)).alias("doc_id"), "p_partkey", "p_name", "p_brand", "p_size")
    make = lambda rows: b.document([b"".join(b.plain(0, r["p_brand"], shape=r["p_size"], style=3, controls=_control(r)) for r in rows)])
    return _made(rows, make)


_CONTROLLED = "select p_partkey // 16 as doc_id, p_partkey as k, p_name, p_brand, p_size, cast(row_number() over (partition by p_partkey // 16 order by p_partkey) - 1 as int) as para from part"


@query(
    "hwp_controls",
    f"""with p as ({_CONTROLLED}) select doc_id, para, (['equation', 'shape', 'shape', 'picture', 'field', 'header', 'footnote', 'unknown'])[k % 8 + 1] as kind, case k % 8 when 4 then '%hlk' when 7 then 'secd' end as ctrl_id,
    case when k % 8 = 3 then cast(k % 100 as int) end as bin_data_id, case k % 8 when 1 then 'line' when 2 then 'rectangle' end as shape_type, case when k % 8 = 1 then concat_ws(',', k, -k, p_size, 7) end as points,
    case when k % 8 = 0 then p_name end as script, case when k % 8 = 4 then p_name end as command from p""",
)
def hwp_controls(spark, sf_dir):
    rows = frames.document_table(_controls(spark, sf_dir), "control", "hwp")
    points = F.array_join(c("points").cast("array<string>"), ",")
    return rows.select("doc_id", F.element_at("para_path", 1).alias("para"), "kind", "ctrl_id", "bin_data_id", "shape_type", points.alias("points"), "script", "command")


@query(
    "hwp_note_paragraphs",
    f"""with p as ({_CONTROLLED}) select doc_id, para, 'body' as container, 0 as depth, cast(p_size as int) as para_shape_id, 3 as style_id, p_brand as text from p
    union all select doc_id, para, case k % 8 when 5 then 'header' else 'footnote' end, 1, 0, 0, unnest([p_name, p_brand]) from p where k % 8 in (5, 6)""",
)
def hwp_note_paragraphs(spark, sf_dir):
    rows = frames.document_table(_controls(spark, sf_dir), "paragraph", "hwp")
    return rows.select("doc_id", F.element_at("para_path", 1).alias("para"), "container", "depth", "para_shape_id", "style_id", "text")


@query(
    "hwp_control_text",
    f"""with p as ({_CONTROLLED}) select doc_id, string_agg(p_brand || case when k % 8 = 0 then chr(10) || p_name when k % 8 in (5, 6) then chr(10) || p_name || chr(10) || p_brand else '' end, chr(10) order by k) as text from p group by doc_id""",
)
def hwp_control_text(spark, sf_dir):
    return frames.render_as(_controls(spark, sf_dir), "text").select("doc_id", "text")


# tables: three rows of two cells for six parts, behind a caption


def _tabled(rows) -> bytes:
    cells = b"".join(b.cell(2, r["p_partkey"] % 6 // 2, r["p_partkey"] % 2, 1 + r["p_size"] % 2, 1 + r["p_size"] % 3, b.plain(2, r["p_name"])) for r in rows)
    caption = b.record(72, 2, bytes(16)) + b.plain(2, "caption")
    grid = b.record(77, 2, struct.pack("<IHH", 0, 4, 3))
    return b.document([b.plain(0, "before", controls=b.control(1, "tbl ", below=caption + grid + cells)) + b.plain(0, "after")])


def _tables(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.floor(c("p_partkey") / 6)).alias("doc_id"), "p_partkey", "p_name", "p_size")
    return _made(rows, _tabled)


_CELLS = "select p_partkey // 6 as doc_id, p_partkey as k, cast(row_number() over (partition by p_partkey // 6 order by p_partkey) - 1 as int) as cell_idx, cast(p_partkey % 6 // 2 as int) as r, cast(p_partkey % 2 as int) as c, cast(1 + p_size % 2 as int) as rs, cast(1 + p_size % 3 as int) as cs, p_name from part"


@query("hwp_table_cells", f'select doc_id, cell_idx, r as "row", c as col, rs as row_span, cs as col_span from ({_CELLS})')
def hwp_table_cells(spark, sf_dir):
    return frames.document_table(_tables(spark, sf_dir), "table_cell", "hwp").select("doc_id", "cell_idx", "row", "col", "row_span", "col_span")


@query("hwp_cell_text", f"select doc_id, 'before' || chr(10) || string_agg(p_name, chr(10) order by k) || chr(10) || 'after' as text from ({_CELLS}) group by doc_id")
def hwp_cell_text(spark, sf_dir):
    """Cells stand one below the other; a caption is none."""
    return frames.render_as(_tables(spark, sf_dir), "text").select("doc_id", "text")


@query(
    "hwp_table_markdown",
    f"""with cells as ({_CELLS}), spread as (select doc_id, cell_idx, unnest(range(r, least(r + rs, 4))) as r, c, cs from cells),
    places as (select doc_id, r, unnest(range(c, least(c + cs, 3))) as c, cell_idx from spread), best as (select doc_id, r, c, min(cell_idx) as cell_idx from places group by all),
    grid as (select d.doc_id, r.r, c.c, coalesce(x.p_name, ' ') as t from (select distinct doc_id from cells) d, (select unnest(range(4)) as r) r, (select unnest(range(3)) as c) c
        left join best b on b.doc_id = d.doc_id and b.r = r.r and b.c = c.c left join cells x on x.doc_id = d.doc_id and x.cell_idx = b.cell_idx),
    lines as (select doc_id, r, '| ' || string_agg(t, ' | ' order by c) || ' |' as line from grid group by doc_id, r)
    select doc_id, 'before' || chr(10) || chr(10) || string_agg(line || case when r = 0 then chr(10) || '| --- | --- | --- |' else '' end, chr(10) order by r) || chr(10) || chr(10) || 'after' || chr(10) as markdown from lines group by doc_id""",
)
def hwp_table_markdown(spark, sf_dir):
    """Cells with spans fill the places they cover."""
    return frames.render_as(_tables(spark, sf_dir), "markdown").select("doc_id", "markdown")


@query("hwp_table_hwpx_cells", f'select doc_id, cell_idx, p_name as text, rs as row_span, cs as col_span from ({_CELLS})')
def hwp_table_hwpx_cells(spark, sf_dir):
    """Cells of the package that a binary document becomes, through the package's own relations; a row's cells ascend by column."""
    packed = frames.render_as(_tables(spark, sf_dir), "package").select("doc_id", c("package").alias("content"))
    cells = frames.document_table(packed, "table_cell", "hwpx").select("doc_id", "cell_idx", "row_span", "col_span")
    texts = frames.document_table(packed, "paragraph", "hwpx").where("container = 'cell'").select("doc_id", F.element_at("para_path", 3).alias("cell_idx"), "text")
    return cells.join(texts, ["doc_id", "cell_idx"]).select("doc_id", "cell_idx", "text", "row_span", "col_span")
