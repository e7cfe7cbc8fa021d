"""Kinds and labels of files as Columns over map literals; nothing leaves the JVM.

A null path has kind and language null-safe defaults: kind null (to be sniffed), label 'text'.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import tables
from folio.functions.paths import _col, basename


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def extension(path: str | Column) -> Column:
    """Lower-case extension of the last component; null if it has none or only a leading dot."""
    return F.nullif(F.regexp_extract(F.lower(basename(path)), r"^.+\.([^.]*)$", 1), F.lit(""))


def is_numeric(ext: Column) -> Column:
    return F.coalesce(ext.rlike(r"^[0-9]{1,4}$"), F.lit(False))


def kind_from_name(path: str | Column) -> Column:
    """Kind by file name or extension; null means the bytes decide."""
    name, ext, low = F.lower(basename(path)), extension(path), F.lower(_col(path))
    return (
        F.when(name.isin(tables.TEXT_NAMES), "text")
        .when(low.rlike(r"\.(tar\.gz|tgz)$"), "targz")
        .when(low.endswith(".tar"), "tar")
        .when(is_numeric(ext), "text")
        .otherwise(_lookup(tables.kind_of_extension(), ext))
    )


def language(path: str | Column, kind: str | Column) -> Column:
    """Label of a file: by name, by extension, else the extension itself, else the kind."""
    name, ext = F.lower(basename(path)), extension(path)
    return F.coalesce(
        _lookup(tables.spread(tables.LANGUAGE_OF_NAME), name),
        F.when(is_numeric(ext), "text"),
        _lookup(tables.language_of_extension(), ext),
        F.when(ext.rlike(r"^[a-z0-9_+\-]{1,32}$"), ext),
        F.when(F.coalesce(_col(kind), F.lit("unknown")) == "unknown", "text").otherwise(_col(kind)),
    )


def fence_language(path: str | Column, kind: str | Column, source_mode: bool = False) -> Column:
    """Language of a Markdown fence; blank for rendered HTML and XML."""
    lang = F.coalesce(_lookup(tables.spread(tables.FENCE_OF_EXTENSION), extension(path)), F.lit(""))
    return lang if source_mode else F.when(F.coalesce(_col(kind).isin("html", "xml"), F.lit(False)), "").otherwise(lang)


def default_selected(path: str | Column, kind: str | Column) -> Column:
    """Whether a file starts ticked."""
    name, ext = F.lower(basename(path)), F.coalesce(extension(path), F.lit(""))
    dirs = F.transform(F.slice(F.split(_col(path), "/"), 1, F.greatest(F.size(F.split(_col(path), "/")) - 1, F.lit(0))), F.lower)
    generated = F.arrays_overlap(dirs, F.array(*map(F.lit, (d.lower() for d in tables.GENERATED_DIRS))))
    off = (
        (F.coalesce(_col(kind), F.lit("")) == "binary")
        | F.coalesce(generated, F.lit(False))
        | name.isin(*tables.GENERATED_NAMES, *tables.LOCK_NAMES, *tables.VENV_NAMES)
        | name.rlike("(" + "|".join(e.replace(".", r"\.") for e in (*tables.GENERATED_ENDS, *tables.LOCK_ENDS)) + ")$")
        | ext.isin(*tables.IMAGE_EXTENSIONS, *tables.PGP_EXTENSIONS, *tables.CYTHON_EXTENSIONS)
    )
    return F.coalesce(~off, F.lit(True))


def default_on(path: str | Column, kind: str | Column, size: str | Column, max_file_size: int, follow_archives: bool = False) -> Column:
    ok = default_selected(path, kind) & ~F.coalesce(_col(size) > max_file_size, F.lit(False))
    return ok if follow_archives else ok & ~F.coalesce(_col(kind).isin(*tables.ARCHIVE_KINDS), F.lit(False))


def looks_binary(data: str | Column) -> Column:
    """More than one byte in 32 of the first 8 KiB is no text byte; wide text is told apart later.

    Pure SQL: the bytes are viewed as Latin-1 characters and the odd ones counted by removal.
    """
    head = F.decode(F.substring(_col(data), 1, 8192), "ISO-8859-1")
    odd = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0E-\x1A\x1C-\x1F]", ""))
    return F.coalesce(odd * 32 > F.length(head), F.lit(False))


def is_heavy(kind: str | Column) -> Column:
    return F.coalesce(_col(kind).isin(*tables.HEAVY_KINDS), F.lit(False))
