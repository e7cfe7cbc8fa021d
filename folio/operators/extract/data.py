"""JSON, delimited tables, notebooks and arrays to text."""

from __future__ import annotations

import ast
import csv
import io
import json
import math
import re
import zipfile

import numpy as np

from folio.operators.extract.common import WHITE, Unreadable, decode, lines

MAX_PRETTY = 1 << 20
MAX_COLUMNS, MAX_ROWS = 24, 2000
_JSON_TOKEN = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|[\[\]{}:,]|[ \t\r\n]+')


def _no_constant(name: str) -> None:
    raise ValueError(name)


def is_json(text: str) -> bool:
    """Exactly one JSON value, nested at most 128 levels; numbers of any size."""
    depth = most = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', text, re.S):
        c = m[0]
        if c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    if most > 127:
        return False
    try:
        json.loads(text, parse_constant=_no_constant, parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        return False
    return not text.startswith("﻿")


def reindent(text: str) -> str:
    """Two blanks a level; every token keeps its exact text."""
    out: list[str] = []
    depth, opened = 0, False
    for m in _JSON_TOKEN.finditer(text):
        t = m[0]
        if t[0] in " \t\r\n":
            continue
        if t in "]}" and len(t) == 1:
            depth -= 1
            out.append(t if opened else "\n" + "  " * depth + t)
            opened = False
            continue
        if opened:
            out.append("\n" + "  " * depth)
        opened = t in ("{", "[")
        if opened:
            depth += 1
            out.append(t)
        elif t == ",":
            out.append(",\n" + "  " * depth)
        elif t == ":":
            out.append(": ")
        else:
            out.append(t)
    return "".join(out)


def json_text(data: bytes) -> str:
    """Re-indented JSON up to 1 MiB, or each line of JSON lines; anything else as it is."""
    text = decode(data)
    if len(text.encode("utf-8", "replace")) > MAX_PRETTY:
        return text
    if is_json(text):
        return reindent(text)
    rows = lines(text)
    first = next((r for r in rows if r.strip(WHITE)), None)
    if len(rows) >= 2 and first is not None and is_json(first.strip(WHITE)):
        return "\n".join(reindent(r) if is_json(r) else r for r in (x.strip(WHITE) for x in rows) if r)
    return text


def table_text(data: bytes, delimiter: str = ",") -> str:
    """A Markdown table up to 24 columns and 2000 rows, else tab-joined; ragged tables as they are."""
    text = decode(data)
    csv.field_size_limit(1 << 30)
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]
    if not rows:
        return ""
    head, body = rows[0], rows[1:]
    if any(len(r) != len(head) for r in body):
        return text
    if len(head) > MAX_COLUMNS or len(body) > MAX_ROWS:
        return "".join("\t".join(r) + "\n" for r in rows)

    def row(cells: list[str]) -> str:
        return "|" + "".join(f" {c.replace('|', chr(92) + '|').replace(chr(13), '').replace(chr(10), ' ')} |" for c in cells) + "\n"

    return row(head) + "|" + " --- |" * len(head) + "\n" + "".join(map(row, body))


def _joined(value: object) -> str | None:
    if isinstance(value, str):
        return value
    return "".join(p for p in value if isinstance(p, str)) if isinstance(value, list) else None


def notebook_text(data: bytes, outputs: bool = False) -> str:
    """Cells in order under '## Cell i (type)', with their text outputs if asked for."""
    try:
        book = json.loads(decode(data), parse_constant=_no_constant)
    except (ValueError, RecursionError) as e:
        raise Unreadable(f"notebook: {e}") from None
    cells = book.get("cells") if isinstance(book, dict) else None
    if not isinstance(cells, list):
        raise Unreadable("notebook missing cells array")
    out = ""
    for i, cell in enumerate(cells):
        if i:
            out += "" if out.endswith("\n") else "\n"
            out += "\n"
        cell = cell if isinstance(cell, dict) else {}
        kind = cell.get("cell_type")
        out += f"## Cell {i} ({kind if isinstance(kind, str) else 'unknown'})\n"
        source = _joined(cell.get("source")) or ""
        out += source + ("\n" if source and not source.endswith("\n") else "")
        for o in cell.get("outputs") or [] if outputs and isinstance(cell.get("outputs"), list) else []:
            if not isinstance(o, dict):
                continue
            plain = o.get("data") if isinstance(o.get("data"), dict) else {}
            shown = (_joined(o.get("text")) or "") + (_joined(plain.get("text/plain")) or "")
            if shown:
                out += "" if out.endswith("\n") else "\n"
                out += shown + ("" if shown.endswith("\n") else "\n")
    return out


_OMITTED = "preview: omitted (too large or unsupported dtype)"


def _number(v: object) -> str:
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        text = np.format_float_positional(v, unique=True, trim="0") if 1e-5 <= abs(v) < 1e16 or v == 0 else np.format_float_scientific(v, unique=True, trim="-", exp_digits=1).replace("e+", "e")
        return text
    return str(v)


def npy_text(data: bytes) -> str:
    """Header of an array and, for small numeric ones, up to 64 values in C order."""
    if not data.startswith(b"\x93NUMPY") or len(data) < 10:
        raise Unreadable("not an npy file")
    wide = data[6] > 1
    size = int.from_bytes(data[8:12] if wide else data[8:10], "little")
    start = (12 if wide else 10) + size
    try:
        head = ast.literal_eval(data[12 if wide else 10 : start].decode("latin-1").strip())
        descr, fortran, shape = head["descr"], bool(head["fortran_order"]), tuple(int(n) for n in head["shape"])
    except (ValueError, SyntaxError, KeyError, TypeError):
        raise Unreadable("npy header cannot be read") from None
    n = math.prod(shape)
    name = descr if isinstance(descr, str) else str(descr)
    out = ["format: npy", f"descr: {name}", f"fortran_order: {'true' if fortran else 'false'}", "shape: " + (f"({shape[0]},)" if len(shape) == 1 else "(" + ", ".join(map(str, shape)) + ")"), f"elements: {n}" if n < 1 << 64 else "elements: overflow"]
    m = re.fullmatch(r"([<>|=]?)([iuf])([1248])", name)
    body = data[start:]
    if not m or (m[2] == "f" and m[3] == "1") or len(shape) > 32 or n * int(m[3]) > 4096 or len(body) < n * int(m[3]):
        return "\n".join([*out, _OMITTED])
    order = "<" if m[1] in ("", "<", "|", "=") else ">"
    array = np.frombuffer(body, np.dtype(f"{order}{m[2]}{m[3]}"), n).reshape(shape, order="F" if fortran else "C")
    left = 64

    def show(a: np.ndarray) -> str:
        nonlocal left
        if a.ndim == 0:
            left -= 1
            v = a.item()
            return _number(float(np.format_float_positional(a, unique=True)) if m[2] == "f" and m[3] in "24" and math.isfinite(v) else v)
        parts = []
        for x in a:
            if left <= 0:
                parts.append("...")
                break
            parts.append(show(x if isinstance(x, np.ndarray) else np.asarray(x)))
        return "[" + ", ".join(parts) + "]"

    return "\n".join([*out, "preview: " + show(array)])


def npz_text(data: bytes) -> str:
    """The arrays of an archive by name; only the head of each is read."""
    from folio.operators.archive import unsafe_name

    try:
        book = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Unreadable(str(e)) from None
    out = []
    for info in sorted((i for i in book.infolist() if not i.is_dir() and not unsafe_name(i.filename)), key=lambda i: i.filename.replace("\\", "/")):
        name = info.filename.replace("\\", "/")
        base = name.rsplit("/", 1)[-1]
        if not base.endswith(".npy"):
            out.append(f"[skipped non-npy entry {name}, {info.file_size} bytes]")
            continue
        try:
            with book.open(info) as f:
                body = npy_text(f.read((1 << 20) + 12 + 4096))
        except (Unreadable, zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError) as e:
            body = f"[unreadable npy: {e}]"
        out.append(f"## {base}\n{body}")
    return "\n\n".join(out)
