"""The functions of the command line: over one document, and over a folder by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.templates import fill
from .model import DocumentError
from .operators import frames, package_writer, relational, render
from .sources import files, html, hwp, markdown, package

# one document


def hwp_to_text(raw: bytes, paragraph: str = "\n", section: str = "\n\n") -> str:
    return render.to_text(hwp.read_document(raw), paragraph, section)


def hwp_to_markdown(raw: bytes, embed: bool = False, resolver=None) -> str:
    return render.to_markdown(hwp.read_document(raw), embed, resolver)


def hwp_to_hwpx(raw: bytes, title: str = "", creator: str = "") -> bytes:
    return package_writer.write_document(hwp.read_document(raw), title, creator)


def markdown_to_hwpx(text: str, title: str = "", creator: str = "") -> bytes:
    return package_writer.write_document(markdown.read_markdown(text), title, creator)


def html_to_hwpx(text: str, title: str = "", creator: str = "") -> bytes:
    return package_writer.write_document(html.read_html(text), title, creator)


def text_to_hwpx(text: str, title: str = "", creator: str = "") -> bytes:
    return package_writer.write_text(text, title, creator)


def hwpx_to_text(raw: bytes, joiner: str = "\n") -> str:
    return package.open_package(raw).readable().to_text(joiner)


def hwpx_to_markdown(raw: bytes, embed: bool = False, resolver=None) -> str:
    return package.open_package(raw).readable().to_markdown(embed, resolver)


def hwpx_to_html(raw: bytes, **options) -> str:
    return package.open_package(raw).readable().to_html(package.HtmlOptions(**options))


def inspect(raw: bytes) -> dict:
    """What a package says of itself."""
    p = package.open_package(raw)
    manifest = [dict(zip(("id", "href", "mediaType"), i, strict=True)) for i in p.manifest]
    return {"metadata": p.metadata(), "summary": {"hasEncryptionInfo": p.encrypted, "contentsFiles": p.contents(), "manifest": manifest, "spine": p.spine}, "images": p.images()}


# folders


def batch_html(spark: SparkSession, folder: str) -> DataFrame:
    """(name, html, status, message): every package of a folder with its pictures embedded. A bad file is a row, not an end."""
    found = files.read_documents(spark, folder, ".hwpx").withColumn("name", files.base_name(F.col("name")))
    return frames.render_as(found, "html", "hwpx", keys=["name"], embed=True)


def batch_templates(spark: SparkSession, folder: str, data: str) -> DataFrame:
    """(name, html, status): every package's text with its keys filled from <name>.json, default.json or nothing in the folder data."""
    found = files.read_documents(spark, folder, ".hwpx").withColumn("name", files.base_name(F.col("name")))
    texts = frames.render_as(found, "text", "hwpx", keys=["name"])
    side = files.read_documents(spark, data, ".json").select(files.base_name(F.col("name")).alias("name"), F.decode("content", "UTF-8").alias("data"))
    filled = frames.fill_template(relational.with_templates(texts, side))
    return filled.select("name", frames.template_html(F.col("filled")).alias("html"), "status")


def write_named(df: DataFrame, column: str, out: str, suffix: str, name: str = "name") -> None:
    """Each row's column as a file of its own under out, which executors must have mounted; a task that runs again replaces its files.

    A name may be a path with folders; what leads out of the folder is left out of it.
    """
    def save(rows):
        import os
        import uuid

        os.makedirs(out, exist_ok=True)
        for r in rows:
            body = r[column]
            if body is None:
                continue
            path = os.path.join(out, os.path.normpath("/" + r[name]).lstrip("/") + suffix)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                f.write(body.encode() if isinstance(body, str) else bytes(body))
            os.replace(part, path)

    df.select(name, column).foreachPartition(save)


__all__ = ["DocumentError", "batch_html", "batch_templates", "fill", "hwp_to_hwpx", "hwp_to_markdown", "hwp_to_text", "hwpx_to_html", "hwpx_to_markdown", "hwpx_to_text", "html_to_hwpx", "inspect", "markdown_to_hwpx", "text_to_hwpx", "write_named"]
