from __future__ import annotations

import io
import struct
import zipfile

import pytest

from folio.operators.extract import office, workbook
from folio.operators.extract.common import Unreadable


def compound(name: str, stream: bytes) -> bytes:
    """A compound file of one stream; a short one goes to the mini stream."""
    short = len(stream) < 4096
    sectors: list[bytes] = []

    def add(raw: bytes) -> list[int]:
        first = len(sectors)
        sectors.extend(raw[k : k + 512].ljust(512, b"\0") for k in range(0, max(1, len(raw)), 512))
        return list(range(first, len(sectors)))

    body = add(stream)
    mini = add(struct.pack("<128I", *[k + 1 if k + 1 < -(-len(stream) // 64) else 0xFFFFFFFE for k in range(-(-len(stream) // 64))], *[0xFFFFFFFF] * (128 - -(-len(stream) // 64)))) if short else []

    def entry(title: str, kind: int, start: int, size: int) -> bytes:
        raw = title.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind) + bytes(49) + struct.pack("<IQ", start, size)

    entries = entry("Root Entry", 5, body[0] if short else 0xFFFFFFFE, len(body) * 512 if short else 0) + entry(name, 2, 0 if short else body[0], len(stream))
    folder = add(entries.ljust(512, b"\0"))
    fat_at = len(sectors)
    fat = [0xFFFFFFFF] * 128
    for chain in (body, mini, folder):
        for a, b in zip(chain, [*chain[1:], 0xFFFFFFFE]):
            fat[a] = b
    fat[fat_at] = 0xFFFFFFFD
    sectors.append(struct.pack("<128I", *fat))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<II", 1, folder[0]) + bytes(4)
    head += struct.pack("<5I", 4096, mini[0] if mini else 0xFFFFFFFE, len(mini), 0xFFFFFFFE, 0) + struct.pack("<109I", fat_at, *[0xFFFFFFFF] * 108)
    return head + b"".join(sectors)


def rec(kind: int, raw: bytes) -> bytes:
    return struct.pack("<HH", kind, len(raw)) + raw


def biff(long_text: str = "") -> bytes:
    def text(s: str) -> bytes:
        wide = not s.isascii()
        return struct.pack("<HB", len(s), wide) + (s.encode("utf-16-le") if wide else s.encode())

    strings = ["name", "größe é漢", long_text]
    table = struct.pack("<II", 3, 3) + b"".join(map(text, strings[:2])) + text(long_text)
    cut = len(table) - len(long_text) // 2 if long_text else len(table)
    shared = rec(0xFC, table[:cut]) + (rec(0x3C, b"\0" + table[cut:]) if long_text else b"")
    cell = lambda r, c: struct.pack("<HHH", r, c, 0)
    sheet = rec(0x809, bytes(16)) + rec(0xFD, cell(0, 0) + struct.pack("<I", 0)) + rec(0xFD, cell(0, 1) + struct.pack("<I", 1)) + rec(0x203, cell(1, 0) + struct.pack("<d", 2.5))
    sheet += rec(0x27E, cell(1, 1) + struct.pack("<I", (7 << 2) | 2)) + rec(0xBD, struct.pack("<HH", 2, 0) + struct.pack("<HI", 0, (150 << 2) | 3) + struct.pack("<HI", 0, (-3 << 2 | 2) & 0xFFFFFFFF) + struct.pack("<H", 1))
    sheet += rec(0x06, cell(3, 0) + b"\0" * 6 + b"\xff\xff" + bytes(6)) + rec(0x207, text("said")) + rec(0x205, cell(3, 1) + b"\1\0") + (rec(0xFD, cell(4, 0) + struct.pack("<I", 2)) if long_text else b"") + rec(0x0A, b"")
    place = lambda at: rec(0x85, struct.pack("<IBB", at, 0, 0) + b"\2\0S1")
    head = rec(0x809, bytes(16)) + place(0) + shared + rec(0x0A, b"")
    return rec(0x809, bytes(16)) + place(len(head)) + shared + rec(0x0A, b"") + sheet


TABLE = "## S1\n| name | größe é漢 |\n| --- | --- |\n| 2.5 | 7 |\n| 1.5 | -3 |\n| said | true |"


def test_xls():
    assert office.sheet_text(compound("Workbook", biff())) == TABLE
    assert office.sheet_text(compound("Book", biff("long " * 1500))) == TABLE + "\n| " + "long " * 1500 + " |  |"
    with pytest.raises(Unreadable):
        office.sheet_text(compound("Workbook", rec(0x809, bytes(16)) + rec(0x2F, b"")))
    with pytest.raises(Unreadable):
        office.sheet_text(compound("Other", biff()))
    whole = compound("Workbook", biff())
    for n in range(8, len(whole), 97):  # cut anywhere: a note, never another error
        try:
            office.sheet_text(whole[:n])
        except Unreadable:
            pass


def test_numbers():
    assert [workbook.number(x) for x in (1.0, -2.0, 0.1, 1e20, 1e-7, 45000.25)] == ["1", "-2", "0.1", "100000000000000000000", "0.0000001", "45000.25"]


def test_xlsb():
    def r(kind: int, raw: bytes) -> bytes:
        head = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
        return head + bytes([len(raw)]) + raw

    wide = lambda s: struct.pack("<I", len(s)) + s.encode("utf-16-le")
    cell = lambda c, raw: struct.pack("<II", c, 0) + raw
    sheet = r(0, struct.pack("<I", 0) + bytes(13)) + r(7, cell(0, struct.pack("<I", 0))) + r(6, cell(1, wide("ö"))) + r(0, struct.pack("<I", 1) + bytes(13)) + r(2, cell(0, struct.pack("<I", (9 << 2) | 2))) + r(5, cell(1, struct.pack("<d", 0.5)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.bin", r(156, bytes(8) + wide("rId1") + wide("Sheet")))
        z.writestr("xl/_rels/workbook.bin.rels", "<Relationships><Relationship Id='rId1' Target='worksheets/s.bin'/></Relationships>")
        z.writestr("xl/sharedStrings.bin", r(19, b"\0" + wide("head")))
        z.writestr("xl/worksheets/s.bin", sheet)
    assert office.sheet_text(out.getvalue()) == "## Sheet\n| head | ö |\n| --- | --- |\n| 9 | 0.5 |"


def test_a_sheet_with_far_corners_is_refused():
    x = {"xl/workbook.xml": "<workbook><sheets><sheet name='S'/></sheets></workbook>", "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row r='1'><c r='A1'><v>1</v></c></row><row r='900000'><c r='ZZ900000'><v>1</v></c></row></sheetData></worksheet>"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in x.items():
            z.writestr(n, b)
    with pytest.raises(Unreadable):
        office.sheet_text(out.getvalue())
