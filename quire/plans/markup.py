"""Queries over Markdown and HTML made from table rows, of the constructs that the tables' own texts and pages lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames
from .catalogue import c, query, table

_MD = "# {n}\n\nA **{b}** and *{t}* or ***{n}*** in `{b}`\n\n- {n}\n- {b}\n\n3. {t}\n4. {n}\n\n> {b}\n\n```\n{t}\n{n}\n```\n\n| {n} | {b} |\n| --- | --- |\n| {t} | x \\| y |\n\n---\n\nlast {n}"
_HTML = (
    "<h2>{n}</h2><div>A <b>{b}</b> and <i>{t}</i>, <code>{n}</code><br>next &amp; {b}</div><ul><li>{n}</li><li>{b}</li></ul><ol><li>{t}</li></ol><blockquote>{b}</blockquote><hr>"
    "<pre>{t}\n{n}</pre><table><thead><tr><th>{n}</th><th rowspan=\"2\">{b}</th></tr></thead><tbody><tr><td colspan=\"2\">{t} <b>x</b></td></tr></tbody></table><script>no</script><section><p>last {n}</p></section>"
)


def _filled(spark, sf_dir, text):
    own = F.lit(text)
    for mark, name in (("{n}", "p_name"), ("{b}", "p_brand"), ("{t}", "p_type")):
        own = F.replace(own, F.lit(mark), F.col(name))
    return table(spark, sf_dir, "part", parsed=True).select("p_partkey", own.alias("content"))


def _sql(lines: list[str]) -> str:
    """SQL for a list of texts with {n}, {b}, {t}."""
    quoted = ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in lines)
    return f"[replace(replace(replace(x, '{{n}}', p_name), '{{b}}', p_brand), '{{t}}', p_type) for x in [{quoted}]]"


_RULE = "─────"
_MD_BODY = ["{n}", "A {b} and {t} or {n} in {b}", "- {n}", "- {b}", "3. {t}", "4. {n}", "> {b}", "{t}", "{n}", "", _RULE, "last {n}"]
_MD_CELLS = ["{n}", "{b}", "{t}", "x | y"]
_HTML_BODY = ["{n}", "A {b} and {t}, {n}\nnext & {b}", "- {n}", "- {b}", "1. {t}", "> {b}", _RULE, "{t}", "{n}", "", "last {n}"]
_HTML_CELLS = ["{n}", "{b}", "{t} x"]


def _paragraphs(body: list[str], cells: list[str]) -> str:
    one = lambda kind, lines: f"select p_partkey, '{kind}' as container, unnest(range(1, {len(lines) + 1}))::int as place, unnest({_sql(lines)}) as text from part"
    return f"{one('body', body)} union all {one('cell', cells)}"


def _placed(rows):
    """Body paragraphs by their number, cells by theirs."""
    place = F.when(c("container") == "body", F.element_at("para_path", 1) + 1).otherwise(F.element_at("para_path", 3) + 1)
    return rows.select("p_partkey", "container", place.cast("int").alias("place"), "text")


@query("md_paragraphs", _paragraphs(_MD_BODY, _MD_CELLS))
def md_paragraphs(spark, sf_dir):
    return _placed(frames.document_table(_filled(spark, sf_dir, _MD), "paragraph", "md"))


@query("html_blocks", _paragraphs(_HTML_BODY, _HTML_CELLS))
def html_blocks(spark, sf_dir):
    return _placed(frames.document_table(_filled(spark, sf_dir, _HTML), "paragraph", "html"))


@query("md_hwpx_paragraphs", _paragraphs(_MD_BODY, _MD_CELLS))
def md_hwpx_paragraphs(spark, sf_dir):
    """The same through a package and its relations."""
    packed = frames.render_as(_filled(spark, sf_dir, _MD), "package", "md").select("p_partkey", c("package").alias("content"))
    return _placed(frames.document_table(packed, "paragraph", "hwpx"))


_RUNS = [(1, 0, "A "), (1, 1, "{b}"), (1, 0, " and "), (1, 2, "{t}"), (1, 0, " or "), (1, 3, "{n}"), (1, 0, " in "), (1, 8, "{b}")]


def _runs(runs) -> str:
    lines = _sql([t for _, _, t in runs])
    return f"select p_partkey, unnest(range(0, {len(runs)}))::int as run_idx, unnest({[s for _, s, _ in runs]})::int as char_shape_id, unnest({lines}) as text from part"


@query("md_runs", _runs(_RUNS))
def md_runs(spark, sf_dir):
    """Shapes of emphasis and code in the second paragraph."""
    rows = frames.document_table(_filled(spark, sf_dir, _MD), "run", "md").where((F.size("para_path") == 1) & (F.element_at("para_path", 1) == 1))
    return rows.select("p_partkey", "run_idx", "char_shape_id", "text")


@query("md_hwpx_runs", _runs(_RUNS))
def md_hwpx_runs(spark, sf_dir):
    packed = frames.render_as(_filled(spark, sf_dir, _MD), "package", "md").select("p_partkey", c("package").alias("content"))
    rows = frames.document_table(packed, "run", "hwpx").where((F.size("para_path") == 1) & (F.element_at("para_path", 1) == 1))
    return rows.select("p_partkey", "run_idx", "char_shape_id", "text")


_MD_AGAIN = "**{n}**\n\nA **{b}** and *{t}* or ***{n}*** in {b}\n\n- {n}\n\n- {b}\n\n3. {t}\n\n4. {n}\n\n\\> {b}\n\n{t}\n\n{n}\n\n| **{n}** | **{b}** |\n| --- | --- |\n| {t} | x \\| y |\n\n" + _RULE + "\n\nlast {n}\n"


@query("md_blocks_markdown", f"select p_partkey, ({_sql([_MD_AGAIN])})[1] as markdown from part")
def md_blocks_markdown(spark, sf_dir):
    return frames.render_as(_filled(spark, sf_dir, _MD), "markdown", "md").select("p_partkey", "markdown")


_HTML_MD = "**{n}**\n\nA **{b}** and *{t}*, {n}\nnext & {b}\n\n- {n}\n\n- {b}\n\n1. {t}\n\n\\> {b}\n\n" + _RULE + "\n\n{t}\n\n{n}\n\n| **{n}** | **{b}** |\n| --- | --- |\n| {t} x | **{b}** |\n\nlast {n}\n"


@query("html_blocks_markdown", f"select p_partkey, ({_sql([_HTML_MD])})[1] as markdown from part")
def html_blocks_markdown(spark, sf_dir):
    return frames.render_as(_filled(spark, sf_dir, _HTML), "markdown", "html").select("p_partkey", "markdown")


@query("html_table_cells", "select p_partkey, unnest([0, 1, 2])::int as cell_idx, unnest([0, 0, 1])::int as \"row\", unnest([0, 1, 0])::int as col, unnest([1, 2, 1])::int as row_span, unnest([1, 1, 2])::int as col_span from part")
def html_table_cells(spark, sf_dir):
    return frames.document_table(_filled(spark, sf_dir, _HTML), "table_cell", "html").select("p_partkey", "cell_idx", "row", "col", "row_span", "col_span")


@query("control_characters", r"select doc_id, replace('�' || text || '�' || '<&>' || '�', chr(13) || chr(10), chr(10)) as text, 'ok' as status from documents where text is not null")
def control_characters(spark, sf_dir):
    """Texts with characters that XML forbids, through a package: these are replaced, all else stays."""
    docs = table(spark, sf_dir, "documents", parsed=True).where("text is not null").select("doc_id", F.concat(F.lit("\1"), "text", F.lit("\x0b<&>\x1f")).alias("content"))
    packed = frames.render_as(docs, "package", "txt").select("doc_id", c("package").alias("content"))
    return frames.render_as(packed, "text").select("doc_id", "text", "status")


_PNG = "data:image/png;base64,"


@query("md_picture_links", "select p_partkey, 'see ' || p_name || chr(10) || chr(10) || '![](' || case when p_partkey % 2 = 0 then 'https://img/' || p_partkey else 'BinData/image1.png' end || ')' || chr(10) as markdown from part")
def md_picture_links(spark, sf_dir):
    """A picture's address from a column of maps, where it has one."""
    body = F.concat(F.lit("see "), "p_name", F.lit(" ![]("), F.lit(_PNG), F.regexp_replace(F.base64(c("p_name").cast("binary")), "\\s", ""), F.lit(")"))
    links = F.when(c("p_partkey") % 2 == 0, F.create_map(F.lit("BinData/image1.png"), F.concat(F.lit("https://img/"), "p_partkey")))
    rows = table(spark, sf_dir, "part", parsed=True).select("p_partkey", body.alias("content"), links.alias("links"))
    out = frames.render_as(rows, "markdown", "md", links="links")
    return out.select("p_partkey", F.replace("markdown", F.lit(" \n\n"), F.lit("\n\n")).alias("markdown"))


@query("md_picture_bytes", "select p_partkey, 1::int as storage_id, 'png' as extension, p_name as data from part")
def md_picture_bytes(spark, sf_dir):
    """Embedded pictures through a package and its relations."""
    body = F.concat(F.lit("![a]("), F.lit(_PNG), F.regexp_replace(F.base64(c("p_name").cast("binary")), "\\s", ""), F.lit(")"))
    packed = frames.render_as(table(spark, sf_dir, "part", parsed=True).select("p_partkey", body.alias("content")), "package", "md").select("p_partkey", c("package").alias("content"))
    return frames.document_table(packed, "binary_item", "hwpx").select("p_partkey", "storage_id", "extension", F.decode("data", "UTF-8").alias("data"))


@query("hwpx_char_shapes", "select p_partkey, unnest(range(9))::int as id, unnest([1000, 1000, 1000, 1000, 1800, 1600, 1400, 1200, 1000])::int as size, unnest([false, true, false, true, true, true, true, true, false]) as bold, unnest([false, false, true, true, false, false, false, false, false]) as italic from part")
def hwpx_char_shapes(spark, sf_dir):
    packed = frames.render_as(_filled(spark, sf_dir, _MD), "package", "md").select("p_partkey", c("package").alias("content"))
    return frames.document_table(packed, "char_shape", "hwpx").select("p_partkey", "id", "size", "bold", "italic")
