"""Office, OpenDocument and EPUB documents on zipfile and expat."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Callable
from urllib.parse import unquote
from xml.parsers import expat

from folio.operators.extract import workbook
from folio.operators.extract.common import WHITE, Unreadable
from folio.operators.extract.markup import html_text

MAX_CELLS = 5_000_000
MAX_MEMBER, MAX_SLIDES, MAX_CHAPTERS, MAX_COLUMNS = 32 << 20, 200, 500, 24
MAX_SPACES, MAX_ALL_SPACES = 256, 64 << 10


def _open(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError) as e:
        raise Unreadable(str(e)) from None


def _member(book: zipfile.ZipFile, name: str) -> bytes:
    info = next((i for i in book.infolist() if i.filename.replace("\\", "/") == name), None)
    if info is None:
        raise Unreadable(f"missing {name}")
    if info.file_size > MAX_MEMBER:
        raise Unreadable(f"office member {name} is {info.file_size} bytes; limit {MAX_MEMBER}")
    try:
        with book.open(info) as f:
            return f.read(MAX_MEMBER)
    except (zipfile.BadZipFile, RuntimeError, OSError, EOFError, NotImplementedError) as e:
        raise Unreadable(str(e)) from None


def walk_xml(data: bytes, start: Callable[[str, dict[str, str]], None], end: Callable[[str], None], text: Callable[[str], None]) -> None:
    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler = lambda n, a: start(n.rsplit(":", 1)[-1], a)
    p.EndElementHandler = lambda n: end(n.rsplit(":", 1)[-1])
    p.CharacterDataHandler = text
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise Unreadable(str(e)) from None


def _runs(data: bytes, tabs: bool) -> str:
    """Text of 't' elements; breaks and paragraph ends as line breaks; 'tab' outside tab stops."""
    out: list[str] = []
    inside = {"t": 0, "tabs": 0}

    def start(n: str, _a: dict[str, str]) -> None:
        if n in inside:
            inside[n] += 1
        elif n == "tab" and tabs and not inside["tabs"]:
            out.append("\t")
        elif n == "br" or (n == "cr" and tabs):
            out.append("\n")

    def end(n: str) -> None:
        if n in inside:
            inside[n] -= 1
        elif n == "p":
            out.append("\n")

    walk_xml(data, start, end, lambda s: out.append(s) if inside["t"] else None)
    return "".join(out)


def docx_text(data: bytes) -> str:
    return _runs(_member(_open(data), "word/document.xml"), True).strip(WHITE)


def pptx_text(data: bytes) -> str:
    """Slides by number under '## Slide N'."""
    book = _open(data)
    slides = sorted((int(m[1]), i.filename) for i in book.infolist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", i.filename.replace("\\", "/"))))
    out, total = [], 0
    for n, name in slides[:MAX_SLIDES]:
        xml = _member(book, name.replace("\\", "/"))
        total += len(xml)
        if total > 4 * MAX_MEMBER:
            break
        text = _runs(xml, False).strip(WHITE)
        out.append(f"## Slide {n}\n" + (text + "\n" if text else ""))
    return "\n".join(out).strip(WHITE)


def opendocument_text(data: bytes) -> str:
    """Paragraphs and headings of content.xml, with tabs, line breaks and counted blanks."""
    out: list[str] = []
    depth, left = 0, MAX_ALL_SPACES

    def start(n: str, a: dict[str, str]) -> None:
        nonlocal depth, left
        if n in ("p", "h"):
            depth += 1
        elif n == "line-break":
            out.append("\n")
        elif depth and n == "tab":
            out.append("\t")
        elif depth and n == "s":
            c = next((v.strip() for k, v in a.items() if k.rsplit(":", 1)[-1] == "c"), "1")
            k = min(int(c) if c.isdigit() else 1, MAX_SPACES, left)
            left -= k
            out.append(" " * k)

    def end(n: str) -> None:
        nonlocal depth
        if n in ("p", "h"):
            depth -= 1
            out.append("\n")

    walk_xml(_member(_open(data), "content.xml"), start, end, lambda s: out.append(s) if depth else None)
    return "".join(out).strip(WHITE)


def _sheet(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    out = []
    for i, r in enumerate(rows):
        cells = " | ".join(r + [""] * (width - len(r)))
        if width <= MAX_COLUMNS:
            out.append(f"| {cells} |\n")
            if i == 0:
                out.append("| " + " | ".join(["---"] * width) + " |\n")
        else:
            out.append(cells + "\n")
    return "".join(out)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_text(data: bytes) -> str:
    """Sheets in workbook order under '## name', as piped rows."""
    book = _open(data)
    names = {i.filename.replace("\\", "/") for i in book.infolist()}
    if "content.xml" in names:
        return ods_text(data)
    if "xl/workbook.bin" in names:
        return _xlsb(book, names)
    if "xl/workbook.xml" not in names:
        raise Unreadable("no workbook")
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        cur: list[str] = []
        on = {"t": False, "rPh": False}

        def s_start(n: str, _a: dict[str, str]) -> None:
            if n == "si":
                cur.clear()
            elif n in on:
                on[n] = True

        def s_end(n: str) -> None:
            if n == "si":
                shared.append("".join(cur))
            elif n in on:
                on[n] = False

        walk_xml(_member(book, "xl/sharedStrings.xml"), s_start, s_end, lambda s: cur.append(s) if on["t"] and not on["rPh"] else None)
    sheets: list[tuple[str, str]] = []
    walk_xml(_member(book, "xl/workbook.xml"), lambda n, a: sheets.append((a.get("name", ""), next((v for k, v in a.items() if k.endswith(":id")), ""))) if n == "sheet" else None, lambda n: None, lambda s: None)
    rels: dict[str, str] = {}
    if "xl/_rels/workbook.xml.rels" in names:
        walk_xml(_member(book, "xl/_rels/workbook.xml.rels"), lambda n, a: rels.update({a.get("Id", ""): a.get("Target", "")}) if n == "Relationship" else None, lambda n: None, lambda s: None)
    out = []
    for k, (title, rid) in enumerate(sheets):
        target = rels.get(rid, f"worksheets/sheet{k + 1}.xml")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)
        if path not in names:
            continue
        grid: dict[tuple[int, int], str] = {}
        st = {"row": 0, "col": -1, "kind": "", "on": False}
        buf: list[str] = []

        def c_start(n: str, a: dict[str, str], st: dict = st, buf: list[str] = buf) -> None:
            if n == "row":
                st["row"] = int(a["r"]) - 1 if a.get("r", "").isdigit() else st["row"] + 1
                st["col"] = -1
            elif n == "c":
                st["col"] = _column(a["r"]) if a.get("r") else st["col"] + 1
                st["kind"] = a.get("t", "n")
                buf.clear()
            elif n in ("v", "t"):
                st["on"] = True

        def c_end(n: str, st: dict = st, buf: list[str] = buf, grid: dict = grid) -> None:
            if n in ("v", "t"):
                st["on"] = False
            elif n == "c" and buf:
                raw = "".join(buf)
                if st["kind"] == "s":
                    raw = shared[int(raw)] if raw.strip().isdigit() and int(raw) < len(shared) else ""
                elif st["kind"] == "b":
                    raw = "true" if raw.strip() == "1" else "false"
                elif st["kind"] == "n" and re.fullmatch(r"-?\d+\.0+", raw.strip()):
                    raw = raw.strip().split(".")[0]
                grid[st["row"], st["col"]] = raw

        walk_xml(_member(book, path), c_start, c_end, lambda s, st=st, buf=buf: buf.append(s) if st["on"] else None)
        out.append(f"## {title}\n" + _sheet(_filled(grid)))
    return "\n".join(out).strip(WHITE)


def _filled(grid: dict[tuple[int, int], str]) -> list[list[str]]:
    """The rows of the smallest range that holds all cells."""
    if not grid:
        return []
    r0, c0 = min(r for r, _ in grid), min(c for _, c in grid)
    r1, c1 = max(r for r, _ in grid), max(c for _, c in grid)
    if (r1 - r0 + 1) * (c1 - c0 + 1) > MAX_CELLS:
        raise Unreadable(f"the sheets have more than {MAX_CELLS} cells")
    return [[grid.get((r, c), "") for c in range(c0, c1 + 1)] for r in range(r0, r1 + 1)]


def _xlsb(book: zipfile.ZipFile, names: set[str]) -> str:
    """Sheets of a workbook of binary parts."""
    shared = workbook.xlsb_strings(_member(book, "xl/sharedStrings.bin")) if "xl/sharedStrings.bin" in names else []
    rels: dict[str, str] = {}
    if "xl/_rels/workbook.bin.rels" in names:
        walk_xml(_member(book, "xl/_rels/workbook.bin.rels"), lambda n, a: rels.update({a.get("Id", ""): a.get("Target", "")}) if n == "Relationship" else None, lambda n: None, lambda s: None)
    out = []
    for k, (title, rid) in enumerate(workbook.xlsb_names(_member(book, "xl/workbook.bin"))):
        target = rels.get(rid, f"worksheets/sheet{k + 1}.bin")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)
        if path in names:
            out.append(f"## {title}\n" + _sheet(_filled(workbook.xlsb_cells(_member(book, path), shared))))
    return "\n".join(out).strip(WHITE)


def ods_text(data: bytes) -> str:
    """Tables of an OpenDocument sheet; without tables its paragraphs.

    Repeated cells and rows are written out; those without text only if text follows them.  A
    sheet may come to ``MAX_CELLS`` cells.
    """
    tables: list[tuple[str, list[list[str]]]] = []
    cell: list[str] = []
    st = {"repeat": 1, "in": False, "rows": 1, "cells": 0, "blank_rows": 0, "blank_cells": 0}

    def spent(n: int) -> None:
        st["cells"] += n
        if st["cells"] > MAX_CELLS:
            raise Unreadable(f"the sheets have more than {MAX_CELLS} cells")

    def start(n: str, a: dict[str, str]) -> None:
        at = {k.rsplit(":", 1)[-1]: v for k, v in a.items()}
        if n == "table":
            tables.append((at.get("name", ""), []))
            st["blank_rows"] = 0
        elif n == "table-row" and tables:
            tables[-1][1].append([])
            st["rows"] = int(at.get("number-rows-repeated", "1") or 1)
            st["blank_cells"] = 0
        elif n in ("table-cell", "covered-table-cell"):
            cell.clear()
            st["repeat"] = int(at.get("number-columns-repeated", "1") or 1)
            st["in"] = True

    def end(n: str) -> None:
        if n in ("table-cell", "covered-table-cell") and tables and tables[-1][1]:
            row, text = tables[-1][1][-1], "".join(cell)
            if text:
                spent(st["blank_cells"] + st["repeat"])
                row += [""] * st["blank_cells"] + [text] * st["repeat"]
                st["blank_cells"] = 0
            else:
                st["blank_cells"] += st["repeat"]
            st["in"] = False
        elif n == "table-row" and tables and tables[-1][1]:
            rows = tables[-1][1]
            row = rows.pop()
            if row:
                spent(st["blank_rows"] + (st["rows"] - 1) * len(row))
                rows += [[] for _ in range(st["blank_rows"])] + [row] * st["rows"]
                st["blank_rows"] = 0
            else:
                st["blank_rows"] += st["rows"]

    walk_xml(_member(_open(data), "content.xml"), start, end, lambda s: cell.append(s) if st["in"] else None)
    if not tables:
        return opendocument_text(data)
    out = []
    for name, rows in tables:
        out.append(f"## {name}\n" + _sheet(rows))
    return "\n".join(out).strip(WHITE)


def sheet_text(data: bytes) -> str:
    if data.startswith(b"\xd0\xcf\x11\xe0"):
        try:
            return "\n".join(f"## {title}\n" + _sheet(_filled(grid)) for title, grid in workbook.xls_sheets(data)).strip(WHITE)
        except (struct.error, IndexError) as e:
            raise Unreadable(f"the workbook is damaged: {e}") from None
    return xlsx_text(data)


def epub_text(data: bytes) -> str:
    """Chapters in spine order under '# href'; without a package file the pages by name."""
    book = _open(data)
    names = {i.filename.replace("\\", "/") for i in book.infolist()}
    chapters: list[str] = []
    try:
        opf: list[str] = []
        walk_xml(_member(book, "META-INF/container.xml"), lambda n, a: opf.append(a.get("full-path", "")) if n == "rootfile" else None, lambda n: None, lambda s: None)
        items: dict[str, str] = {}
        spine: list[str] = []

        def start(n: str, a: dict[str, str]) -> None:
            if n == "item":
                items[a.get("id", "")] = a.get("href", "")
            elif n == "itemref":
                spine.append(a.get("idref", ""))

        walk_xml(_member(book, opf[0]), start, lambda n: None, lambda s: None)
        base = posixpath.dirname(opf[0])
        chapters = [posixpath.normpath(posixpath.join(base, unquote(items[i]))) for i in spine if i in items]
    except (Unreadable, IndexError):
        pass
    chapters = [c for c in chapters if c in names] or sorted(n for n in names if n.lower().endswith((".html", ".htm", ".xhtml")))
    if not chapters:
        raise Unreadable("no chapters")
    return "\n\n".join(f"# {c}\n{html_text(_member(book, c)).strip(WHITE)}" for c in chapters[:MAX_CHAPTERS]).strip(WHITE)
