"""Sections of a dump as Columns, and the ordered write of a whole dump."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions.classify import fence_language
from folio.functions.text import display_path, fence_width, xml_escape
from folio.operators.tree import tree_lines, tree_text
from folio.plans.shared import running

RULE = "=" * 48


def _ended(text: Column) -> Column:
    return F.concat(text, F.when(text.endswith("\n"), "").otherwise("\n"))


def plain_section(path: str = "relative", text: str = "text") -> Column:
    return F.concat(F.lit(RULE + "\nFILE: "), display_path(path), F.lit("\n" + RULE + "\n"), _ended(F.col(text)), F.lit("\n"))


def markdown_section(path: str = "relative", text: str = "text", kind: str = "kind", source_mode: bool = False) -> Column:
    fence = F.repeat(F.lit("`"), fence_width(text).cast("int"))
    return F.concat(F.lit("## "), display_path(path), F.lit("\n\n"), fence, fence_language(path, kind, source_mode), F.lit("\n"), _ended(F.col(text)), fence, F.lit("\n\n"))


def xml_section(index: str = "ordinal", path: str = "relative", text: str = "text") -> Column:
    return F.concat(F.lit('<document index="'), F.col(index).cast("string"), F.lit('">\n<source>'), xml_escape(display_path(path)), F.lit("</source>\n<document_content>\n"), xml_escape(text), F.lit("\n</document_content>\n</document>\n"))


def dumped(packed: DataFrame) -> DataFrame:
    """Files that a dump shows: all but skipped binaries."""
    return packed.where("status IS NULL OR status <> 'skipped_binary'")


def in_dump_order(packed: DataFrame) -> DataFrame:
    """Adds ordinal, the place in the dump (by path, then id, then text).

    Paths and ids alone are ordered; the texts are shuffled once, when they meet their number.
    """
    names = packed.groupBy("relative", "id").agg(F.count(F.lit(1)).alias("_n"))
    places = running(names, [F.col("relative"), F.col("id")], {"_last": F.col("_n")}).select(F.col("relative").alias("_r"), F.col("id").alias("_i"), "_n", "_last")
    rows = packed.join(places, F.col("relative").eqNullSafe(F.col("_r")) & F.col("id").eqNullSafe(F.col("_i")))
    inside = F.row_number().over(Window.partitionBy("_r", "_i").orderBy("text"))
    return rows.withColumn("ordinal", (F.col("_last") - F.col("_n") + inside).cast("bigint")).drop("_r", "_i", "_n", "_last")


def sections(packed: DataFrame, fmt: str = "plain", source_mode: bool = False) -> DataFrame:
    """ordinal (dump order), id, section of every shown file."""
    columns = [c for c in ("id", "relative", "kind", "text") if c in packed.columns]
    rows = in_dump_order(dumped(packed).select(*columns).withColumn("text", F.coalesce("text", F.lit(""))))
    section = {"plain": plain_section(), "markdown": markdown_section(source_mode=source_mode), "xml": xml_section()}[fmt]
    return rows.select("ordinal", "id", section.alias("section"))


def tree_block(tree: str, fmt: str) -> str:
    """The directory map as the head of a dump."""
    if not tree:
        return ""
    if fmt == "plain":
        return f"Directory structure:\n{tree}"
    if fmt == "markdown":
        fence = "`" * max(3, 1 + max(map(len, re.findall("`+", tree)), default=0))
        return f"# Directory structure\n\n{fence}\n{tree}{fence}\n"
    escaped = tree.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return f"<document_tree>\n{escaped}\n</document_tree>\n"


def directory_map(files: DataFrame, label: str, fmt: str = "plain", path_col: str = "relative") -> str:
    """The map alone, in a dump's format."""
    return tree_block(tree_text(tree_lines(files, path_col), label), fmt)


def in_chunks(parts: Iterator[str], size: int = 8 << 20) -> Iterator[str]:
    """A dump in chunks of about ``size`` characters; a long section is handed on in slices."""
    held: list[str] = []
    n = 0
    for part in parts:
        for a in range(0, len(part), size):
            piece = part[a : a + size]
            held.append(piece)
            n += len(piece)
            if n >= size:
                yield "".join(held)
                held, n = [], 0
    if held:
        yield "".join(held)


def chunks(packed: DataFrame, fmt: str = "plain", tree: str = "", source_mode: bool = False) -> Iterator[str]:
    """A dump in order, one section at a time; a partition at most is on the driver."""
    head = tree_block(tree, fmt)
    if fmt == "xml":
        yield "<documents>\n" + head
    elif head:
        yield head + "\n"
    for row in sections(packed, fmt, source_mode).orderBy("ordinal").select("section").toLocalIterator():
        yield row[0]
    if fmt == "xml":
        yield "</documents>\n"


def write_atomic(target: str, parts: Iterator[str]) -> int:
    """Writes beside the target and replaces it in one step; nothing is left behind on an error."""
    folder = os.path.dirname(os.path.abspath(target))
    handle, temp = tempfile.mkstemp(prefix=".folio-", dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            n = sum(f.write(p) for p in parts)
        if os.path.exists(target):
            os.chmod(temp, os.stat(target).st_mode & 0o7777)
        os.replace(temp, target)
    except BaseException:
        os.unlink(temp)
        raise
    return n


def format_of(path: str, default: str = "plain") -> str:
    """Dump format by the name of its file."""
    ext = os.path.splitext(path)[1].lower().lstrip(".")
    return {"txt": "plain", "text": "plain", "md": "markdown", "markdown": "markdown", "xml": "xml"}.get(ext, default)
