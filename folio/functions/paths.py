"""Path predicates as Columns: globs, hidden paths, selection, screen patterns, orders.

Null paths match nothing and are not hidden; an empty pattern matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import tables


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def path_order(path: str | Column) -> Column:
    """Sort key that compares paths component by component."""
    return F.split(_col(path), "/")


def is_hidden(path: str | Column) -> Column:
    """Some component starts with a dot, '.' and '..' aside."""
    return F.coalesce(_col(path).rlike(r"(^|/)\.(?!/|$|\./|\.$)"), F.lit(False))


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob: '*' and '?' cross '/', '**' as a component any depth."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("/.*")
            i += 3
            continue
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                out.append(r"\[")
            else:
                body = pattern[i + 1 : end]
                out.append("[" + ("^" if body[0] in "!^" else "") + body.lstrip("!^").replace("\\", "\\\\") + "]")
                i = end
        elif c == "{":
            out.append("(?:")
        elif c == "}":
            out.append(")")
        elif c == "," and pattern.count("{", 0, i) > pattern.count("}", 0, i):
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def globs_regex(patterns: Sequence[str]) -> str | None:
    """One anchored alternation; a pattern without a leading '**/' also matches at any depth."""
    parts: list[str] = []
    for p in patterns:
        if not p:
            continue
        parts.append(glob_regex(p))
        if not p.startswith("**/") and (bare := p.lstrip("/")):
            parts.append(glob_regex(f"**/{bare}"))
    return "^(?s:" + "|".join(dict.fromkeys(parts)) + r")(?!\n)$" if parts else None


def matches_globs(path: str | Column, patterns: Sequence[str]) -> Column:
    """The whole path or its last component matches one of the globs."""
    rx = globs_regex(patterns)
    if rx is None:
        return F.lit(False)
    return F.coalesce(_col(path).rlike(rx) | basename(path).rlike(rx), F.lit(False))


def default_excludes() -> list[str]:
    return [f"{d}/**" for d in tables.GENERATED_DIRS] + tables.DEFAULT_FILE_GLOBS


def is_archive_name(path: str | Column) -> Column:
    return F.lower(_col(path)).rlike(r"\.(zip|tar|tgz|tar\.gz)$")


def keep_path(path: str | Column, include: Sequence[str] = (), exclude: Sequence[str] = (), hidden: bool = False, defaults: bool = True, under_root: str | Column | None = None, unpacking: bool = False) -> Column:
    """Path policy. Default globs match the path under its root, given ones either path;
    with ``unpacking`` an archive passes the include list."""
    inner = path if under_root is None else under_root
    keep = F.lit(True) if hidden else ~is_hidden(inner)
    if defaults:
        keep = keep & ~matches_globs(inner, default_excludes())
    keep = keep & ~(matches_globs(path, exclude) | matches_globs(inner, exclude))
    if include:
        wanted = matches_globs(path, include) | matches_globs(inner, include)
        keep = keep & ((wanted | is_archive_name(path)) if unpacking else wanted)
    return keep


def screen_pattern(pattern: str) -> str | None:
    """Regular expression of a screen pattern: '/' anchors, without one any folder will do; '*'
    and '?' stay inside a folder, '**' crosses; blank matches nothing."""
    text = pattern.strip()
    if not text:
        return None
    anchored = text.startswith("/")
    text = text.lstrip("/")
    if not text:
        return None
    out, i = [], 0
    while i < len(text):
        if text.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif text.startswith("**", i):
            out.append(".*")
            i += 2
        elif text[i] == "*":
            out.append("[^/]*")
            i += 1
        elif text[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(text[i]))
            i += 1
    body = "".join(out)
    tail = ".*" if body.endswith("/") else ""
    return f"(?i)^{'' if anchored or '/' in text.rstrip('/') else '(?:.*/)?'}{body}{tail}$"


def matches_screen(path: str | Column, pattern: str) -> Column:
    rx = screen_pattern(pattern)
    return F.lit(False) if rx is None else F.coalesce(_col(path).rlike(rx), F.lit(False))


def contains_text(path: str | Column, language: str | Column, query: str) -> Column:
    """Screen text filter: lower-case substring of the path or of the language."""
    q = F.lit(query.strip().lower())
    return F.coalesce(F.lower(_col(path)).contains(q), F.lit(False)) | F.coalesce(F.lower(_col(language)).contains(q), F.lit(False))


def select_files(files: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """Files that a list of names selects: by id, and by path for names that are nobody's id.

    Two semi joins on the name and one anti join; an empty list selects nothing.
    """
    wanted = names.select(F.col(name_col).alias("_n")).where(F.col("_n").isNotNull()).distinct()
    by_id = files.join(wanted, files["id"] == wanted["_n"], "left_semi")
    loose = wanted.join(files.select(F.col("id").alias("_n")), "_n", "left_anti")
    by_path = files.join(loose, files["relative"] == loose["_n"], "left_semi")
    return by_id.unionByName(by_path).distinct()


def skip_files(files: DataFrame, skip: DataFrame) -> DataFrame:
    """Files that are not in the skip set, by absolute path or by (dev, ino)."""
    out = files.join(skip.select("absolute").where("absolute IS NOT NULL").distinct(), "absolute", "left_anti")
    return out.join(skip.select("dev", "ino").where("dev IS NOT NULL AND ino IS NOT NULL").distinct(), ["dev", "ino"], "left_anti").select(*files.columns)
