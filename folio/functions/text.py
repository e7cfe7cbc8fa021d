"""Scalar text functions as Columns: token estimate, escapes, notes, sizes.

Null text gives null, but counts as 0 in the aggregates built on these.
"""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.paths import _col

# White space and wide scripts of the token estimate, as Unicode ranges.
WHITE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WIDE = (
    r"[\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{3130}-\x{318F}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}"
    r"\x{F900}-\x{FAFF}\x{FF66}-\x{FF9D}\x{20000}-\x{2CEAF}\x{2F800}-\x{2FA1F}\x{30000}-\x{323AF}]"
)
# Characters XML 1.0 cannot carry.
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"


def wide_chars(text: str | Column) -> Column:
    t = _col(text)
    return (F.length(t) - F.length(F.regexp_replace(t, WIDE, ""))).cast("bigint")


def other_chars(text: str | Column) -> Column:
    t = _col(text)
    return (F.length(F.regexp_replace(t, WHITE, "")) - wide_chars(t)).cast("bigint")


def token_estimate(text: str | Column) -> Column:
    """A wide character is a token; four others that are not white space are one."""
    return (wide_chars(text) + F.ceil(other_chars(text) / F.lit(4.0))).cast("bigint")


def token_estimate_sum(text: str | Column) -> Column:
    """Aggregate over chunks, rounded once."""
    return F.coalesce(F.sum(wide_chars(text)) + F.ceil(F.sum(other_chars(text)) / F.lit(4.0)), F.lit(0)).cast("bigint")


def utf8_bytes(text: str | Column) -> Column:
    return F.octet_length(_col(text)).cast("bigint")


def xml_escape(text: str | Column) -> Column:
    t = F.replace(F.replace(F.replace(_col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(t, NOT_XML, "�")


def table_cell(text: str | Column) -> Column:
    """A Markdown table cell: pipes escaped, line breaks as blanks."""
    t = F.replace(_col(text), F.lit("|"), F.lit("\\|"))
    return F.replace(F.replace(t, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def fence_width(text: str | Column) -> Column:
    """Back-quotes of a fence: one more than the longest run, at least three."""
    runs = F.transform(F.regexp_extract_all(_col(text), F.lit("(`+)"), F.lit(1)), F.length)
    return (F.greatest(F.lit(2), F.coalesce(F.array_max(runs), F.lit(0))) + 1).cast("bigint")


def report_fence(text: str | Column) -> Column:
    """The fence around a text in a report."""
    return F.repeat(F.lit("`"), fence_width(text).cast("int"))


def from_base64(text: str | Column) -> Column:
    """Bytes of a base64 text, white space aside; null if it is none."""
    return F.try_to_binary(F.regexp_replace(_col(text), r"\s+", ""), F.lit("base64"))


def expand_home(path: str, home: str | None = None) -> str:
    """'~' and '~/...' with the home folder put in; any other path as it is."""
    home = home if home is not None else os.environ.get("HOME")
    if home and (path == "~" or path.startswith("~/")):
        return home if path == "~" else os.path.join(home, path[2:])
    return path


def shorten_home(path: str, home: str | None) -> str:
    """The reverse, for paths in the home folder, unless that is the root of all."""
    home = (home or "").rstrip("/")
    if not home:
        return path
    return "~" if path == home else "~" + path[len(home) :] if path.startswith(home + "/") else path


def human_bytes(n: str | Column) -> Column:
    """Bytes for a person, one decimal, halves to even."""
    x = _col(n).cast("double")
    k = 1024.0
    return (
        F.when(x < k, F.format_string("%d B", _col(n).cast("bigint")))
        .when(x < k * k, F.format_string("%.1f KiB", F.bround(x / k, 1)))
        .when(x < k**3, F.format_string("%.1f MiB", F.bround(x / k**2, 1)))
        .otherwise(F.format_string("%.1f GiB", F.bround(x / k**3, 1)))
    )


def parse_size(text: str | Column) -> Column:
    """Bytes of '8MiB', '1m', '500k', '2_000'; null if it is none."""
    t = F.replace(F.lower(F.trim(_col(text))), F.lit("_"), F.lit(""))
    unit = F.regexp_extract(t, r"^\s*[0-9]+\s*([kmg]?)(?:ib|b)?$", 1)
    ok = t.rlike(r"^\s*[0-9]+\s*(?:[kmg](?:ib|b)?)?$")
    n = F.regexp_extract(t, r"([0-9]+)", 1).try_cast("bigint")
    return F.when(ok, n * F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1))


def join_relative(path: str | Column) -> Column:
    """A relative path without empty and '.' components."""
    return F.array_join(F.filter(F.split(_col(path), "/"), lambda p: ~p.isin("", ".")), "/")


def is_unsafe_member(name: str | Column) -> Column:
    """Empty, absolute, with a drive letter, or with a '..' component."""
    n = F.translate(_col(name), "\\", "/")
    return F.coalesce((n == "") | n.startswith("/") | n.rlike(r"^[A-Za-z]:") | n.rlike(r"(^|/)\.\.(/|$)"), F.lit(True))


def cap_utf8(text: str | Column, limit: int = 32_768) -> Column:
    """The longest prefix of whole characters within ``limit`` bytes."""
    raw = F.decode(F.encode(_col(text), "UTF-8"), "ISO-8859-1")
    cut = F.regexp_replace(F.substring(raw, 1, limit + 1), r"(?s).[\x80-\xBF]*\z", "")
    return F.when(F.octet_length(_col(text)) <= limit, _col(text)).otherwise(F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8"))


# Notes that stand in for a file's text.
def note(status: str | Column, relative: str | Column, kind: str | Column, size: str | Column, limit: str | Column, detail: str | Column) -> Column:
    s, sz = _col(status), _col(size).cast("string")
    return (
        F.when(s == "skipped_binary", F.concat(F.lit("[binary file, "), sz, F.lit(" bytes]")))
        .when(s == "too_large", F.concat(F.lit("[too large: "), sz, F.lit(" bytes; limit "), _col(limit).cast("string"), F.lit(" bytes]")))
        .when(s == "error", F.concat(F.lit("[error extracting "), display_path(relative), F.lit(": "), _col(detail), F.lit("]")))
        .when(s == "unreadable", F.concat(F.lit("["), _col(kind), F.lit(" unreadable: "), _col(detail), F.lit("]")))
        .when(s == "changed", F.concat(F.lit("[changed since scan: "), _col(detail), F.lit("]")))
        .when(s == "skipped_archive", F.concat(F.lit("[archive "), display_path(relative), F.lit(", "), sz, F.lit(" bytes; "), F.coalesce(_col(detail), F.lit("pass --archives to expand nested archives")), F.lit("]")))
    )


def status_message(status: str | Column, size: str | Column, limit: str | Column, detail: str | Column) -> Column:
    """One sentence for a person about what became of a file; empty if it was read."""
    s, sz = _col(status), _col(size).cast("string")
    return (
        F.when(s == "extracted", "")
        .when(s == "skipped_binary", F.concat(F.lit("Skipped a binary file ("), sz, F.lit(" bytes): the dump holds no text for it.")))
        .when(s == "too_large", F.concat(F.lit("File is "), sz, F.lit(" bytes, over the "), _col(limit).cast("string"), F.lit("-byte cap. Raise the cap or leave this file unchecked.")))
        .when(s == "skipped_archive", F.concat(F.lit("Archive ("), sz, F.lit(" bytes) was not expanded. Turn on archives to unpack zip and tar members into the dump.")))
        .when(s == "changed", "File changed on disk after the scan. Rescan, then pack again so the dump matches the current bytes.")
        .when(s == "error", F.concat(F.lit("Extraction failed for a "), sz, F.lit("-byte file. "), F.coalesce(_col(detail), F.lit(""))))
        .when(s == "unreadable", F.concat(F.lit("Could not parse this "), sz, F.lit("-byte file, so the dump holds a one-line note in its place. It may be damaged, encrypted, or too large to unpack. "), F.coalesce(_col(detail), F.lit(""))))
    )


def display_path(path: str | Column) -> Column:
    """A path with control, format and line-separator characters written as escapes."""
    p = _col(path)
    odd = r"[\p{Cc}\p{Cf}\x{2028}\x{2029}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{FFFE}\x{FFFF}&&[^\x{200C}\x{200D}]]"
    chars = F.filter(F.split(p, ""), lambda c: c != "")

    def escaped(c: Column) -> Column:
        point = F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-32")), r"^0+(?=[0-9A-Fa-f])", ""))
        return F.when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when(c.rlike(odd), F.concat(F.lit("\\u{"), point, F.lit("}"))).otherwise(c)

    return F.when(p.rlike(odd), F.array_join(F.transform(chars, escaped), "")).otherwise(p)
