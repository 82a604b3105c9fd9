"""Every query calls the engine's own operator over a whole table; its SQL starts from the raw columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import scalar as S
from ..operators import frames, relational

FLAGSHIP = "text_roundtrip"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Bytes of a table for each core up to which its rows are dealt out to all cores before they are parsed.
DEALT = 32 << 20


def table(spark, sf_dir: str, name: str, parsed: bool = False) -> DataFrame:
    """A table; one that will be parsed, row by row, is dealt out if it is so small that its row groups are fewer than the cores."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if parsed:
        at, cores = spark._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext.defaultParallelism
        size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        if size < DEALT * cores:
            df = df.repartition(2 * cores)
    return df


def scalar_query(name: str, source: str, key: str, columns: dict, sql: str):
    """A query of per-value functions: columns maps names to functions of the table's columns."""

    @query(name, sql)
    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(key, *(f().alias(n) for n, f in columns.items()))


c = F.col

# per-value functions

scalar_query(
    "escape_md", "documents", "doc_id", {"escaped": lambda: S.escape_md(c("text"))},
    r"""select doc_id, regexp_replace(regexp_replace(replace(text, '\', '\\'), '([*_`~])', '\\\1', 'g'), '(^|\n)([#>])', '\1\\\2', 'g') as escaped from documents""",
)
scalar_query(
    "escape_xml", "documents", "doc_id", {"escaped": lambda: S.escape_xml(c("text"))},
    """select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as escaped from documents""",
)
scalar_query(
    "escape_html", "pages", "page_id", {"escaped": lambda: S.escape_html(c("html"))},
    "select page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped from pages",
)
scalar_query(
    "decode_entities", "pages", "page_id", {"decoded": lambda: S.decode_entities(c("html"))},
    """select page_id, replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' ') as decoded from pages""",
)
scalar_query(
    "collapse_ws", "pages", "page_id", {"collapsed": lambda: S.collapse_whitespace(c("html"))},
    r"select page_id, regexp_replace(html, '[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g') as collapsed from pages",
)
scalar_query(
    "color_bgr_hex", "part", "p_partkey", {"color": lambda: S.color_hex((c("p_partkey") * 7919) % 16777216)},
    "select p_partkey, printf('#%02X%02X%02X', v & 255, (v >> 8) & 255, (v >> 16) & 255) as color from (select p_partkey, (p_partkey * 7919) % 16777216 as v from part)",
)
scalar_query(
    "normalize_color", "part", "p_partkey", {"color": lambda: S.normalize_color(F.when(c("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.lpad(F.hex("p_partkey"), 6, "0"))).otherwise(F.concat("p_brand", F.lit("\n "))))},
    "select p_partkey, case when p_partkey % 2 = 0 then '#' || lpad(printf('%X', p_partkey), 6, '0') else p_brand end as color from part",
)
scalar_query(
    "hwpunit_to_pt", "part", "p_partkey", {"points": lambda: S.points(c("p_partkey") * 7)},
    "select p_partkey, case when t % 10 = 0 then cast(t // 10 as varchar) else cast(t // 10 as varchar) || '.' || cast(t % 10 as varchar) end as points from (select p_partkey, cast(floor(p_partkey * 7 / 10.0 + 0.5) as bigint) as t from part)",
)
scalar_query(
    "line_type_name", "part", "p_partkey", {"line_type": lambda: S.line_type(c("p_partkey") % 20 - 1)},
    "select p_partkey, coalesce((['NONE', 'SOLID', 'DASH', 'DOT', 'DASH_DOT', 'DASH_DOT_DOT', 'LONG_DASH', 'CIRCLE', 'DOUBLE', 'THIN_THICK_DOUBLE', 'THICK_THIN_DOUBLE', 'THIN_THICK_THIN_TRIPLE', 'WAVE', 'DOUBLE_WAVE', 'THICK_3D', 'THICK_3D_REVERSE', 'THIN_3D', 'THIN_3D_REVERSE'])[case when p_partkey % 20 = 0 then 99 else p_partkey % 20 end], 'SOLID') as line_type from part",
)
scalar_query(
    "width_mm", "part", "p_partkey", {"width": lambda: S.width_mm(c("p_partkey") % 18)},
    "select p_partkey, coalesce((['0.1', '0.12', '0.15', '0.2', '0.25', '0.3', '0.4', '0.5', '0.6', '0.7', '1.0', '1.5', '2.0', '3.0', '4.0', '5.0'])[p_partkey % 18 + 1], '0.1') || ' mm' as width from part",
)
scalar_query(
    "align_owpml", "part", "p_partkey",
    {"align": lambda: S.alignment(F.element_at(F.array(*map(F.lit, ("left", "right", "center", "justify", "distribute", "distributeSpace", "unknown"))), (c("p_partkey") % 7 + 1).cast("int")))},
    "select p_partkey, (['LEFT', 'RIGHT', 'CENTER', 'JUSTIFY', 'DISTRIBUTE', 'DISTRIBUTE_SPACE', 'JUSTIFY'])[p_partkey % 7 + 1] as align from part",
)
_EXT = "(['png', 'JPG', 'jpeg', 'gif', 'bmp', 'webp', 'svg', 'dat'])[p_partkey % 8 + 1]"
_ext = lambda: F.element_at(F.array(*map(F.lit, ("png", "JPG", "jpeg", "gif", "bmp", "webp", "svg", "dat"))), (c("p_partkey") % 8 + 1).cast("int"))
scalar_query(
    "likely_mimetype", "part", "p_partkey", {"likely": lambda: S.likely_package_type(F.concat(F.element_at(F.array(*map(F.lit, ("application/OWPML", "x/hwpx+zip", "text/plain", ""))), (c("p_partkey") % 4 + 1).cast("int")), c("p_brand")))},
    "select p_partkey, p_partkey % 4 < 2 as likely from part",
)
scalar_query(
    "mime_by_ext", "part", "p_partkey", {"image": lambda: S.mime(_ext()), "stored": lambda: S.mime(_ext(), S.BINARY_MIME), "markdown": lambda: S.mime(_ext(), S.MARKDOWN_MIME)},
    f"""select p_partkey,
    case lower({_EXT}) when 'png' then 'image/png' when 'jpg' then 'image/jpeg' when 'jpeg' then 'image/jpeg' when 'gif' then 'image/gif' when 'bmp' then 'image/bmp' when 'webp' then 'image/webp' else 'application/octet-stream' end as image,
    case lower({_EXT}) when 'png' then 'image/png' when 'jpg' then 'image/jpeg' when 'jpeg' then 'image/jpeg' when 'gif' then 'image/gif' when 'bmp' then 'image/bmp' when 'webp' then 'image/webp' when 'svg' then 'image/svg+xml' else 'application/octet-stream' end as stored,
    case lower({_EXT}) when 'png' then 'image/png' when 'jpg' then 'image/jpeg' when 'jpeg' then 'image/jpeg' when 'gif' then 'image/gif' else 'application/octet-stream' end as markdown from part""",
)
scalar_query(
    "flags_decode", "orders", "o_orderkey", {n: (lambda n=n: S.flag(c("o_orderkey") % 2048, n)) for n in S.FLAGS},
    """select o_orderkey, f & 1 <> 0 as compressed, f & 2 <> 0 as encrypted, f & 4 <> 0 as distribution, f & 8 <> 0 as script, f & 16 <> 0 as drm, f & 32 <> 0 as xml_template, f & 64 <> 0 as history,
    f & 128 <> 0 as signature, f & 256 <> 0 as certificate_encrypted, f & 512 <> 0 as signature_reserve, f & 1024 <> 0 as certificate_drm from (select o_orderkey, o_orderkey % 2048 as f from orders)""",
)
scalar_query(
    "version_gate", "orders", "o_orderkey",
    {"version": lambda: S.version_text(c("o_orderkey") % 7, c("o_orderkey") % 3, c("o_orderkey") % 5, F.lit(0)), "supported": lambda: S.version_supported(c("o_orderkey") % 7, c("o_orderkey") % 3)},
    "select o_orderkey, concat_ws('.', o_orderkey % 7, o_orderkey % 3, o_orderkey % 5, 0) as version, o_orderkey % 7 = 5 and o_orderkey % 3 in (0, 1) as supported from orders",
)
_WORD = "(case when p_partkey % 3 = 0 then 37 else 97 end) * 16777216 + (97 + p_partkey % 26) * 65536 + (97 + p_partkey % 7) * 256 + 32"
scalar_query(
    "ctrl_id_string", "part", "p_partkey",
    {"ctrl_id": lambda: S.ctrl_id_text(F.expr(f"cast({_WORD} as bigint)")), "is_field": lambda: S.is_field_id(F.expr(f"cast({_WORD} as bigint)")), "hex_id": lambda: S.hex_id(c("p_partkey"))},
    "select p_partkey, case when p_partkey % 3 = 0 then '%' else 'a' end || chr(cast(97 + p_partkey % 26 as int)) || chr(cast(97 + p_partkey % 7 as int)) || ' ' as ctrl_id, p_partkey % 3 = 0 as is_field, lpad(printf('%x', p_partkey), 4, '0') as hex_id from part",
)
#: Names of record tags, stated once more for SQL.
_TAGS = """16: 'DOCUMENT_PROPERTIES', 17: 'ID_MAPPINGS', 18: 'BIN_DATA', 19: 'FACE_NAME', 20: 'BORDER_FILL', 21: 'CHAR_SHAPE', 22: 'TAB_DEF', 23: 'NUMBERING', 24: 'BULLET', 25: 'PARA_SHAPE',
26: 'STYLE', 27: 'DOC_DATA', 28: 'DISTRIBUTE_DOC_DATA', 30: 'COMPATIBLE_DOCUMENT', 31: 'LAYOUT_COMPATIBILITY', 32: 'TRACKCHANGE', 66: 'PARA_HEADER', 67: 'PARA_TEXT', 68: 'PARA_CHAR_SHAPE',
69: 'PARA_LINE_SEG', 70: 'PARA_RANGE_TAG', 71: 'CTRL_HEADER', 72: 'LIST_HEADER', 73: 'PAGE_DEF', 74: 'FOOTNOTE_SHAPE', 75: 'PAGE_BORDER_FILL', 76: 'SHAPE_COMPONENT', 77: 'TABLE',
78: 'SHAPE_LINE', 79: 'SHAPE_RECTANGLE', 80: 'SHAPE_ELLIPSE', 81: 'SHAPE_ARC', 82: 'SHAPE_POLYGON', 83: 'SHAPE_CURVE', 84: 'SHAPE_OLE', 85: 'SHAPE_PICTURE', 86: 'SHAPE_CONTAINER',
87: 'CTRL_DATA', 88: 'EQEDIT', 90: 'SHAPE_TEXTART', 91: 'FORM_OBJECT', 92: 'MEMO_SHAPE', 93: 'MEMO_LIST', 94: 'FORBIDDEN_CHAR', 95: 'CHART_DATA'"""
scalar_query(
    "tag_names", "part", "p_partkey", {"tag": lambda: names.tag_name(c("p_partkey") % 100), "control": lambda: names.control_name(F.when(c("p_partkey") % 3 == 0, "tbl ").otherwise("none")), "field": lambda: names.field_kind(F.when(c("p_partkey") % 2 == 0, "%hlk"))},
    f"select p_partkey, coalesce((map {{{_TAGS}}})[p_partkey % 100], 'UNKNOWN') as tag, case when p_partkey % 3 = 0 then 'Table' else 'Unknown' end as control, case when p_partkey % 2 = 0 then 'hyperlink' end as field from part",
)
scalar_query(
    "record_header_unpack", "lineitem", "l_orderkey",
    {"l_linenumber": lambda: c("l_linenumber"), **{n: (lambda n=n: S.record_header((c("l_orderkey") * 2654435761 + c("l_linenumber")) % 4294967296)[n]) for n in ("tag", "level", "size")}},
    "select l_orderkey, l_linenumber, w & 1023 as tag, (w >> 10) & 1023 as level, (w >> 20) & 4095 as size from (select l_orderkey, l_linenumber, (l_orderkey * 2654435761 + l_linenumber) % 4294967296 as w from lineitem)",
)


def _heads():
    """Four kinds of first bytes by part key."""
    key, name = c("p_partkey") % 4, c("p_name").cast("binary")
    magic = F.when(key == 0, F.unhex(F.lit("D0CF11E0A1B11AE1"))).when(key == 1, F.unhex(F.lit("504B0304"))).when(key == 2, F.lit("HWP Document File V3.00").cast("binary")).otherwise(F.lit("?").cast("binary"))
    return F.concat(magic, name)


scalar_query(
    "detect_format", "part", "p_partkey", {"format": lambda: S.detect_format(_heads())},
    "select p_partkey, case p_partkey % 4 when 0 then 'hwp' when 1 then case when 4 + strlen(p_name) >= 8 then 'hwpx' else 'unknown' end when 2 then 'hwp3' else 'unknown' end as format from part",
)


@query(
    "errors_status",
    """select o_orderkey, case when k = 3 then 'unsupported' when k = 2 then 'invalid_format' when o_orderkey % 11 = 0 then 'invalid_header' when f & 2 <> 0 then 'encrypted'
    when not (5 + o_orderkey % 2 = 5 and o_orderkey % 3 in (0, 1)) then 'unsupported' when f & 4 <> 0 then 'unsupported' else 'ok' end as status
    from (select o_orderkey, o_orderkey % 4 as k, o_orderkey % 8 as f from orders)""",
)
def errors_status(spark, sf_dir):
    key = c("o_orderkey")
    byte = lambda x: F.unhex(F.lpad(F.hex(x.cast("long")), 2, "0"))
    name = F.when(key % 11 == 0, F.lit("XWP Document File")).otherwise(F.lit("HWP Document File"))
    head = F.concat(F.rpad(name, 32, "\0").cast("binary"), byte(F.lit(0)), byte(F.lit(0)), byte(key % 3), byte(5 + key % 2), byte(key % 8), F.lit("\0" * 219).cast("binary"))
    fmt = F.when(key % 4 == 3, "hwp3").when(key % 4 == 2, "unknown").otherwise("hwp")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.open_status(fmt, S.file_header(head)).alias("status"))


@query("binary_data_uri", "select doc_id, 'image/png' as media, text, 'data:image/png;base64,' || to_base64(encode(text)) as uri from documents")
def binary_data_uri(spark, sf_dir):
    uri = table(spark, sf_dir, "documents").select("doc_id", S.data_uri(c("text").cast("binary"), F.lit("image/png")).alias("uri"))
    parts = uri.withColumn("p", S.data_uri_parts(c("uri")))
    return parts.select("doc_id", F.col("p.media").alias("media"), F.decode("p.content", "UTF-8").alias("text"), "uri")


@query("template_fill", "select event_id, 'Hi ' || json_extract_string(props, '$.k') || ', ' || event_type || ' ' || json_extract_string(props, '$.k') || '!' as filled from events")
def template_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("raw", F.concat(F.lit("Hi {{ k }}, "), "event_type", F.lit(" {{k}}{{ none.here }}!")))
    return frames.fill_template(rows, "raw", "props").select("event_id", "filled")


@query(
    "template_html",
    """select event_id, '<p>' || replace(replace(replace('Hi ' || json_extract_string(props, '$.k'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p><p>' || event_type || '</p>' as html from events""",
)
def template_html(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("raw", F.concat(F.lit("Hi {{ k }}\n\n"), "event_type"))
    return frames.fill_template(rows, "raw", "props").select("event_id", frames.template_html(c("filled")).alias("html"))


@query("paragraph_split", r"select doc_id, cast(i - 1 as int) as para_idx, p[i] as text from (select doc_id, string_split_regex(text, '\r?\n') as p from documents), lateral (select unnest(range(1, len(p) + 1)) as i)")
def paragraph_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.paragraphs(c("text"))).alias("para_idx", "text"))


@query("preview_text", r"select doc_id, substr(array_to_string(list_filter(string_split_regex(text, '\r?\n'), lambda x: x <> ''), chr(13) || chr(10)), 1, 2000) as preview from documents")
def preview_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.preview(S.paragraphs(c("text"))).alias("preview"))


# orders, lookups and merges


def _sections(spark, sf_dir):
    """A package for each customer of a nation, with a section for each of its first orders."""
    orders = table(spark, sf_dir, "orders").where("o_custkey is not null")
    return orders.select(c("o_custkey").alias("doc_id"), "o_orderkey", F.concat(F.lit("Contents/section"), c("o_orderkey") % 97, F.lit(".xml")).alias("path"))


@query("section_order_numeric", "select o_custkey as doc_id, string_agg('Contents/section' || (o_orderkey % 97) || '.xml', ',' order by o_orderkey % 97, o_orderkey) as paths from orders group by o_custkey")
def section_order_numeric(spark, sf_dir):
    rows = _sections(spark, sf_dir).withColumn("n", S.section_number(c("path")))
    return relational.ordered_text(rows, ["doc_id"], ["n", "o_orderkey"], "path", ",", "paths")


@query("section_order_lexical", "select o_custkey as doc_id, string_agg('Contents/section' || (o_orderkey % 97) || '.xml', ',' order by 'Contents/section' || (o_orderkey % 97) || '.xml') as paths from orders group by o_custkey")
def section_order_lexical(spark, sf_dir):
    return relational.ordered_text(_sections(spark, sf_dir), ["doc_id"], ["path"], "path", ",", "paths")


@query(
    "section_order_spine",
    """with s as (select o_custkey as doc_id, o_orderkey as ord, 's' || (o_orderkey % 97) as idref from orders),
    m as (select o_custkey as doc_id, 's' || (o_orderkey % 97) as id, max_by('Contents/section' || (o_orderkey % 50) || '.xml', o_orderkey) as href from orders where o_orderkey % 5 <> 0 group by all),
    e as (select distinct o_custkey as doc_id, 'Contents/section' || (o_orderkey % 50) || '.xml' as path from orders where o_orderkey % 7 <> 0)
    select s.doc_id, s.ord, m.href as path from s join m on s.doc_id = m.doc_id and s.idref = m.id semi join e on e.doc_id = s.doc_id and e.path = m.href""",
)
def section_order_spine(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("doc_id", c("o_custkey"))
    ident, href = F.concat(F.lit("s"), c("o_orderkey") % 97), F.concat(F.lit("Contents/section"), c("o_orderkey") % 50, F.lit(".xml"))
    spine = orders.select("doc_id", c("o_orderkey").alias("ord"), ident.alias("idref"))
    manifest = orders.where("o_orderkey % 5 <> 0").select("doc_id", c("o_orderkey").alias("ord"), ident.alias("id"), href.alias("href"))
    entries = orders.where("o_orderkey % 7 <> 0").select("doc_id", href.alias("path"))
    return relational.spine_sections(spine, manifest, entries)


@query(
    "picture_paths",
    """with r as (select o_custkey as doc_id, o_orderkey as ord, 'i' || (o_orderkey % 9) as ref from orders),
    m as (select o_custkey as doc_id, 'i' || (o_orderkey % 9) as id, min_by(case when o_orderkey % 2 = 0 then 'BinData/p' || (o_orderkey % 6) else 'p' || (o_orderkey % 6) end, o_orderkey) as href from orders group by all),
    e as (select distinct o_custkey as doc_id, case o_orderkey % 3 when 0 then 'BinData/i' || (o_orderkey % 9) when 1 then 'BinData/p' || (o_orderkey % 6) else 'p' || (o_orderkey % 6) end as path from orders)
    select r.doc_id, r.ord, r.ref, coalesce(a.path, b.path, d.path, 'BinData/' || r.ref) as path from r left join m on r.doc_id = m.doc_id and r.ref = m.id
    left join e a on a.doc_id = r.doc_id and a.path = 'BinData/' || r.ref
    left join e b on b.doc_id = r.doc_id and b.path = case when starts_with(m.href, 'BinData/') then m.href else 'BinData/' || m.href end
    left join e d on d.doc_id = r.doc_id and d.path = m.href""",
)
def picture_paths(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("doc_id", c("o_custkey"))
    key = c("o_orderkey")
    ref, name = F.concat(F.lit("i"), key % 9), F.concat(F.lit("p"), key % 6)
    inside = lambda x: F.concat(F.lit("BinData/"), x)
    refs = orders.select("doc_id", key.alias("ord"), ref.alias("ref"))
    manifest = orders.select("doc_id", key.alias("ord"), ref.alias("id"), F.when(key % 2 == 0, inside(name)).otherwise(name).alias("href"))
    entries = orders.select("doc_id", F.when(key % 3 == 0, inside(ref)).when(key % 3 == 1, inside(name)).otherwise(name).alias("path"))
    return relational.picture_paths(refs, manifest, entries)


_CELLS = """select p_partkey // 6 as table_id, p_partkey % 6 as cell_idx, (p_partkey % 6) // 2 as r0, p_partkey % 2 as c0, 1 + p_size % 2 as rs, 1 + p_size % 3 as cs from part"""


@query(
    "grid_fill",
    f"""with cells as ({_CELLS}), spread as (select table_id, cell_idx, unnest(range(r0, least(r0 + rs, 4))) as r, c0, cs from cells),
    places as (select table_id, cell_idx, r, unnest(range(c0, least(c0 + cs, 3))) as c from spread)
    select table_id, r, c, min(cell_idx) as cell_idx from places group by all""",
)
def grid_fill(spark, sf_dir):
    key = c("p_partkey")
    cells = table(spark, sf_dir, "part").select(
        F.floor(key / 6).alias("table_id"), (key % 6).alias("cell_idx"), F.floor(key % 6 / 2).alias("row"), (key % 2).alias("col"),
        (1 + c("p_size") % 2).cast("long").alias("row_span"), (1 + c("p_size") % 3).cast("long").alias("col_span"), F.lit(4).cast("long").alias("row_count"), F.lit(3).cast("long").alias("col_count"),
    )
    return relational.grid_cells(cells, ["table_id"])


@query(
    "merge_runs",
    """with m as (select *, case when role is distinct from lag(role) over w or row_number() over w = 1 then 1 else 0 end as n from conversations window w as (partition by conv_id order by turn)),
    g as (select *, sum(n) over (partition by conv_id order by turn rows unbounded preceding) as island from m)
    select conv_id, min(turn) as first_order, role, string_agg(text, '' order by turn) as text, cast(count(*) as int) as merged from g group by conv_id, island, role""",
)
def merge_runs(spark, sf_dir):
    return relational.merge_neighbours(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "text")


@query(
    "runs_from_changes",
    """with ch as (select doc_id, unnest([0, 5, 40, 200]) as char_pos from documents),
    w as (select doc_id, char_pos, lead(char_pos) over (partition by doc_id order by char_pos) as nxt, row_number() over (partition by doc_id order by char_pos) - 1 as run_idx from ch)
    select d.doc_id, cast(run_idx as int) as run_idx, char_pos % 7 as shape_id, substr(text, char_pos + 1, greatest(coalesce(nxt, length(text)), char_pos) - char_pos) as text
    from documents d join w on d.doc_id = w.doc_id where length(text) > 0""",
)
def runs_from_changes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changes = docs.select("doc_id", F.explode(F.array(*map(F.lit, (0, 5, 40, 200)))).alias("char_pos")).withColumn("shape_id", c("char_pos") % 7)
    return relational.runs_from_changes(docs, changes, "doc_id").drop("char_end")


@query(
    "font_group_assign",
    """with n as (select p_size, p_partkey, row_number() over (partition by p_size order by p_partkey) - 1 as n from part),
    e as (select s.p_size, g.g, (s.p_size + 1) * (g.g + 1) as e from (select distinct p_size from part) s, (select unnest(range(0, 7)) as g) g where s.p_size % 5 <> 0)
    select n.p_size, n.p_partkey, cast(coalesce((select min(g) from e where e.p_size = n.p_size and e.e > n.n), 6) as int) as lang_idx from n""",
)
def font_group_assign(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_size", "p_partkey")
    groups = F.explode(F.sequence(F.lit(0), F.lit(6)))
    counts = parts.where("p_size % 5 <> 0").select("p_size").distinct().select("p_size", groups.alias("lang_idx"), (c("p_size") + 1).alias("fonts"))
    return relational.grouped_by_counts(parts, counts, "p_size", "p_partkey", "lang_idx", "fonts", 6)


_LEVELS = "select o_custkey, o_orderkey, (o_orderkey * 7 // 3) % 4 as level, (o_orderkey * 5 // 2) % 3 as kind from orders"


def _levels(spark, sf_dir):
    """Records of a stream per customer, with a level and a kind."""
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr("(o_orderkey * 7 div 3) % 4").alias("level"), F.expr("(o_orderkey * 5 div 2) % 3").alias("kind"))


@query(
    "subtree_parent",
    f"""with r as ({_LEVELS}) select a.o_custkey, a.o_orderkey, a.level, case when a.level > 0 then max(b.o_orderkey) end as parent_seq
    from r a left join r b on a.o_custkey = b.o_custkey and b.o_orderkey < a.o_orderkey and b.level = a.level - 1 group by a.o_custkey, a.o_orderkey, a.level""",
)
def subtree_parent(spark, sf_dir):
    return relational.parent_rows(_levels(spark, sf_dir).drop("kind"), ["o_custkey"], "o_orderkey")


@query(
    "caption_skip",
    f"""with r as ({_LEVELS}), m as (select o_custkey, min(o_orderkey) as first from r where kind = 0 group by 1)
    select r.o_custkey, r.o_orderkey from r join m on r.o_custkey = m.o_custkey where kind = 1 and r.o_orderkey > m.first""",
)
def caption_skip(spark, sf_dir):
    return relational.after_first(_levels(spark, sf_dir), ["o_custkey"], "o_orderkey", c("kind") == 0, c("kind") == 1).select("o_custkey", "o_orderkey")


@query(
    "template_join",
    """select o_orderkey, 't' || (o_orderkey % 6) as name, case when o_orderkey % 6 < 4 then '{"k": ' || (o_orderkey % 6) || '}' else '{"k": "d"}' end as data from orders""",
)
def template_join(spark, sf_dir):
    names = spark.range(4).select(F.concat(F.lit("t"), "id").alias("name"), F.concat(F.lit('{"k": '), "id", F.lit("}")).alias("data"))
    names = names.union(spark.range(1).select(F.lit("default"), F.lit('{"k": "d"}')))
    packages = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("t"), c("o_orderkey") % 6).alias("name"))
    return relational.with_templates(packages, names).select("o_orderkey", "name", "data")


# whole documents


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", parsed=True).select("doc_id", c("text").alias("content"))


def _packed(spark, sf_dir):
    return frames.render_as(_docs(spark, sf_dir), "package", "txt", title="t").select("doc_id", c("package").alias("content"))


@query("text_roundtrip", "select doc_id, replace(text, chr(13) || chr(10), chr(10)) as text from documents")
def text_roundtrip(spark, sf_dir):
    """Plain text to a package and back: source, decode, ordered assembly and sink."""
    return frames.render_as(_packed(spark, sf_dir), "text").select("doc_id", "text")


_P = "'<p><span style=\"font-size:10pt\">' || replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</span></p>'"


@query("hwpx_to_html", rf"select doc_id, array_to_string(list_transform(string_split_regex(text, '\r?\n'), lambda x: {_P}), '') as html from documents")
def hwpx_to_html(spark, sf_dir):
    return frames.render_as(_packed(spark, sf_dir), "html").select("doc_id", "html")


@query(
    "hwpx_info",
    """select doc_id, 't' as title, '0:0:0' as caret_position, false as has_encryption_info, 'Contents/content.hpf,Contents/header.xml,Contents/section0.xml' as contents_files, 'section0' as spine, cast(2 as int) as items from documents""",
)
def hwpx_info(spark, sf_dir):
    info = frames.package_info(_packed(spark, sf_dir))
    return info.select("doc_id", "title", "caret_position", "has_encryption_info", F.array_join("contents_files", ",").alias("contents_files"), F.array_join("spine", ",").alias("spine"), F.size("manifest").alias("items"))


@query("package_entries", "select doc_id, cast(unnest(range(0, 8)) as int) as entry_ord, unnest(['mimetype', 'META-INF/container.xml', 'META-INF/manifest.xml', 'version.xml', 'settings.xml', 'Contents/content.hpf', 'Contents/header.xml', 'Contents/section0.xml']) as path from documents")
def package_entries(spark, sf_dir):
    return frames.package_entries(_packed(spark, sf_dir)).select("doc_id", "entry_ord", "path")


@query("text_paragraph_table", r"select doc_id, cast(i - 1 as int) as para_idx, 'body' as container, p[i] as text from (select doc_id, string_split_regex(text, '\r?\n') as p from documents), lateral (select unnest(range(1, len(p) + 1)) as i)")
def text_paragraph_table(spark, sf_dir):
    rows = frames.document_table(_docs(spark, sf_dir), "paragraph", "txt")
    return rows.select("doc_id", F.element_at("para_path", 1).alias("para_idx"), "container", "text")


@query("text_escape_md_document", r"""select doc_id, trim(regexp_replace(array_to_string(list_transform(list_filter(string_split_regex(text, '\r?\n'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(replace(x, '\', '\\'), '([*_`~])', '\\\1', 'g'), '^([#>])', '\\\1')), chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') || chr(10) as markdown from documents""")
def text_escape_md_document(spark, sf_dir):
    return frames.render_as(_docs(spark, sf_dir), "markdown", "txt").select("doc_id", "markdown")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages", parsed=True).select("page_id", c("html").alias("content"))


def _plain(x: str) -> str:
    """SQL for the text of an HTML fragment of inline tags and few entities."""
    x = f"replace(regexp_replace({x}, '\\s+', ' ', 'g'), '<br>', chr(10))"
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    # the semicolon of these may be missing
    for a, b in (("&lt;?", "'<'"), ("&gt;?", "'>'"), ("&quot;?", "'\"'"), ("&#x27;?", "''''"), ("&copy;?", "'©'"), ("&middot;?", "'·'"), ("&amp;?", "'&'")):
        x = f"regexp_replace({x}, '{a}', {b}, 'g')"
    return x


@query("html_article_text", "select page_id, " + _plain("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)") + " as text from pages where html like '%<article>%'")
def html_article_text(spark, sf_dir):
    """The one paragraph that an article becomes: the last of its page but the footer."""
    rows = frames.document_table(_pages(spark, sf_dir), "paragraph", "html")
    last = F.reverse(F.array_sort(F.collect_list(F.struct("para_path", "text"))))
    return rows.groupBy("page_id").agg(F.get(last, F.lit(1))["text"].alias("text"))


@query("html_nav_items", "select page_id, string_agg('- ' || x, chr(10)) as items from (select page_id, unnest(regexp_extract_all(html, '<li><a[^>]*>(.*?)</a></li>', 1)) as x from pages) group by page_id")
def html_nav_items(spark, sf_dir):
    rows = frames.document_table(_pages(spark, sf_dir), "paragraph", "html").where(c("text").startswith("- "))
    return relational.ordered_text(rows, ["page_id"], ["para_path"], "text", "\n", "items")


_PARAGRAPHS = f"""
with parts as (select page_id, list_concat(list_transform(regexp_extract_all(html, '<li><a[^>]*>(.*?)</a></li>', 1), lambda x: '- ' || {_plain("x")}),
    [{_plain("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")}, {_plain("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")}, {_plain("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")}]) as p from pages),
kept as (select page_id, list_filter(p, lambda x: trim(replace(x, chr(10), ' ')) <> '') as p from parts)
"""


@query("html_paragraphs", _PARAGRAPHS + "select page_id, cast(i - 1 as int) as para_idx, p[i] as text from kept, lateral (select unnest(range(1, len(p) + 1)) as i)")
def html_paragraphs(spark, sf_dir):
    return frames.document_table(_pages(spark, sf_dir), "paragraph", "html").select("page_id", F.element_at("para_path", 1).alias("para_idx"), "text")


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
#: Pages as lists of paragraphs, each a list of runs with shape and text; bold in an article never ends.
_RUNS = f"""
with split as (select page_id, html, {_ARTICLE} as x, strpos({_ARTICLE}, '<b>') as b from pages),
runs as (select page_id, list_concat(list_transform(regexp_extract_all(html, '<li><a[^>]*>(.*?)</a></li>', 1), lambda y: [{{'s': 0, 't': '- '}}, {{'s': 0, 't': {_plain("y")}}}]),
    [[{{'s': 0, 't': {_plain("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")}}}],
    [{{'s': 0, 't': {_plain("case when b > 0 then substr(x, 1, b - 1) else x end")}}}, {{'s': 1, 't': {_plain("case when b > 0 then substr(x, b) else '' end")}}}],
    [{{'s': 0, 't': {_plain("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")}}}]]) as p from split),
shown as (select page_id, list_filter(list_transform(p, lambda r: list_filter(r, lambda z: z.t <> '')), lambda r: trim(replace(array_to_string(list_transform(r, lambda z: z.t), ''), chr(10), ' ')) <> '') as p from runs)
"""
_ESCAPED = r"regexp_replace(regexp_replace(replace(z.t, '\', '\\'), '([*_`~])', '\\\1', 'g'), '(^|\n)([#>])', '\1\\\2', 'g')"


@query(
    "html_to_markdown",
    _RUNS + f"""select page_id, trim(regexp_replace(array_to_string(list_transform(p, lambda r: array_to_string(list_transform(r, lambda z: case when z.s = 1 then '**' || {_ESCAPED} || '**' else {_ESCAPED} end), '')), chr(10) || chr(10)),
    '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) || chr(10) as markdown from shown""",
)
def html_to_markdown(spark, sf_dir):
    return frames.render_as(_pages(spark, sf_dir), "markdown", "html").select("page_id", "markdown")


@query("html_to_text", _PARAGRAPHS + "select page_id, array_to_string(p, chr(10)) as text from kept")
def html_to_text(spark, sf_dir):
    return frames.render_as(_pages(spark, sf_dir), "text", "html").select("page_id", "text")


@query("html_to_hwpx_text", _PARAGRAPHS + "select page_id, array_to_string(p, chr(10)) as text from kept")
def html_to_hwpx_text(spark, sf_dir):
    packed = frames.render_as(_pages(spark, sf_dir), "package", "html").select("page_id", c("package").alias("content"))
    return frames.render_as(packed, "text").select("page_id", "text")


@query("html_to_preview", _PARAGRAPHS + "select page_id, substr(array_to_string(p, chr(13) || chr(10)), 1, 2000) as preview from kept")
def html_to_preview(spark, sf_dir):
    return frames.render_as(_pages(spark, sf_dir), "preview", "html").select("page_id", "preview")


@query(
    "html_run_table",
    _RUNS + """, paras as (select page_id, i, p[i] as r from shown, lateral (select unnest(range(1, len(p) + 1)) as i))
    select page_id, cast(i - 1 as int) as para_idx, cast(j - 1 as int) as run_idx, cast(r[j].s as int) as char_shape_id, r[j].t as text from paras, lateral (select unnest(range(1, len(r) + 1)) as j)""",
)
def html_run_table(spark, sf_dir):
    rows = frames.document_table(_pages(spark, sf_dir), "run", "html")
    return rows.select("page_id", F.element_at("para_path", 1).alias("para_idx"), "run_idx", "char_shape_id", "text")


@query("md_to_hwpx_text")
def md_to_hwpx_text(spark, sf_dir):
    packed = frames.render_as(_docs(spark, sf_dir), "package", "md").select("doc_id", c("package").alias("content"))
    return frames.render_as(packed, "text").select("doc_id", "text")


@query("md_to_markdown")
def md_to_markdown(spark, sf_dir):
    return frames.render_as(_docs(spark, sf_dir), "markdown", "md").select("doc_id", "markdown")


@query("hwpx_to_markdown", r"""select doc_id, trim(array_to_string(list_transform(list_filter(string_split_regex(text, '\r?\n'), lambda x: trim(x, ' ' || chr(9)) <> ''), lambda x: regexp_replace(regexp_replace(replace(x, '\', '\\'), '([*_`~])', '\\\1', 'g'), '^([#>])', '\\\1')), chr(10) || chr(10)), ' ' || chr(10)) || chr(10) as markdown from documents""")
def hwpx_to_markdown(spark, sf_dir):
    return frames.render_as(_packed(spark, sf_dir), "markdown").select("doc_id", "markdown")


@query("open_errors", "select doc_id, 'invalid_format' as status from documents")
def open_errors(spark, sf_dir):
    """Texts offered as documents of unknown format: a status for each, no failure."""
    return frames.render_as(_docs(spark, sf_dir), "text").select("doc_id", "status")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
