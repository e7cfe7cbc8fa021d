"""Binary workbooks: .xls (BIFF8 in a compound file) and .xlsb (binary records in a zip)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import Decimal

from folio.operators.extract.common import Unreadable

Grid = dict[tuple[int, int], str]
MAX_CELLS = 5_000_000


def number(x: float) -> str:
    """As a cell shows it without a format: no exponent, no '.0'."""
    if x != x or x in (float("inf"), float("-inf")):
        return str(x)
    return str(int(x)) if x == int(x) and abs(x) < 1e16 else format(Decimal(repr(x)), "f")


def _rk(raw: int) -> float:
    """A packed number: 30 bits of a whole number or of a double, the low bits say which and whether in hundredths."""
    x = float((raw >> 2) - ((raw >> 31) << 30)) if raw & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", raw & 0xFFFFFFFC))[0]
    return x / 100 if raw & 1 else x


# ---- compound files ------------------------------------------------------------------------------

_END = 0xFFFFFFFA  # sector numbers from here on are marks


class Compound:
    """Streams of a compound file, by name."""

    def __init__(self, data: bytes) -> None:
        if len(data) < 512:
            raise Unreadable("the compound file is too short")
        self.data = data
        (shift, mini_shift), (self.cutoff, first_mini, _, next_fat, _) = struct.unpack_from("<HH", data, 30), struct.unpack_from("<5I", data, 56)
        first_dir = struct.unpack_from("<I", data, 48)[0]
        self.size, self.mini = 1 << shift, 1 << mini_shift
        fat_sectors = list(struct.unpack_from("<109I", data, 76))
        seen: set[int] = set()
        while next_fat < _END and next_fat not in seen:
            seen.add(next_fat)
            block = struct.unpack(f"<{self.size // 4}I", self._sector(next_fat))
            fat_sectors += block[:-1]
            next_fat = block[-1]
        self.fat: list[int] = []
        for s in fat_sectors:
            if s < _END:
                self.fat += struct.unpack(f"<{self.size // 4}I", self._sector(s))
        mini = b"".join(self._chain(first_mini))
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini)
        entries = b"".join(self._chain(first_dir))
        self.entries: dict[str, tuple[int, int]] = {}
        root = b""
        for at in range(0, len(entries) - 127, 128):
            n, kind = struct.unpack_from("<HB", entries, at + 64)
            start, size = struct.unpack_from("<IQ", entries, at + 116)
            if kind == 5:
                root = b"".join(self._chain(start))[: size & 0xFFFFFFFF]
            elif kind == 2:
                self.entries[entries[at : at + max(0, n - 2)].decode("utf-16-le", "replace")] = (start, size & 0xFFFFFFFF)
        self.root = root

    def _sector(self, k: int) -> bytes:
        at = (k + 1) * self.size
        raw = self.data[at : at + self.size]
        if len(raw) < self.size:
            raw += bytes(self.size - len(raw))
        return raw

    def _chain(self, k: int) -> Iterator[bytes]:
        seen: set[int] = set()
        while k < _END:
            if k in seen or k >= len(self.fat) or (k + 1) * self.size > len(self.data):
                raise Unreadable("the compound file is damaged")
            seen.add(k)
            yield self._sector(k)
            k = self.fat[k]

    def stream(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        start, size = self.entries[name]
        if size >= self.cutoff:
            return b"".join(self._chain(start))[:size]
        out, seen = [], set()
        while start < _END:
            if start in seen or start >= len(self.mini_fat):
                raise Unreadable("the compound file is damaged")
            seen.add(start)
            out.append(self.root[start * self.mini : (start + 1) * self.mini])
            start = self.mini_fat[start]
        return b"".join(out)[:size]


# ---- .xls ----------------------------------------------------------------------------------------


def _records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + n]
        at += 4 + n


def _string(raw: bytes, at: int, wide_length: bool) -> str:
    n = struct.unpack_from("<H", raw, at)[0] if wide_length else raw[at]
    at += 2 if wide_length else 1
    return raw[at + 1 : at + 1 + 2 * n].decode("utf-16-le", "replace") if raw[at] & 1 else raw[at + 1 : at + 1 + n].decode("latin-1")


def _shared(blocks: list[bytes]) -> list[str]:
    """The shared strings; one that goes on in the next record starts there with its width anew."""
    out: list[str] = []
    total = struct.unpack_from("<I", blocks[0], 4)[0]
    k, at = 0, 8

    def room() -> int:
        return len(blocks[k]) - at

    def skip(n: int) -> None:
        nonlocal k, at
        while n > 0 and k < len(blocks):
            step = min(n, room())
            at += step
            n -= step
            if n and k + 1 < len(blocks):
                k, at = k + 1, 0
            elif n:
                return

    while len(out) < total:
        if room() < 3:
            if k + 1 >= len(blocks):
                break
            k, at = k + 1, 0
            continue
        n, flags = struct.unpack_from("<HB", blocks[k], at)
        at += 3
        runs = ext = 0
        if flags & 8:
            runs = struct.unpack_from("<H", blocks[k], at)[0]
            at += 2
        if flags & 4:
            ext = struct.unpack_from("<I", blocks[k], at)[0]
            at += 4
        text, wide = "", flags & 1
        while n:
            if room() == 0:
                if k + 1 >= len(blocks):
                    break
                k, at = k + 1, 1
                wide = blocks[k][0] & 1
            step = min(n, room() // (2 if wide else 1))
            if step == 0:
                at = len(blocks[k])
                continue
            raw = blocks[k][at : at + step * (2 if wide else 1)]
            text += raw.decode("utf-16-le", "replace") if wide else raw.decode("latin-1")
            at += len(raw)
            n -= step
        out.append(text)
        skip(4 * runs + ext)
    return out


def xls_sheets(data: bytes) -> list[tuple[str, Grid]]:
    """(name, cells) of the sheets of a workbook in order."""
    book = Compound(data)
    stream = book.stream("Workbook") or book.stream("Book")
    if stream is None:
        raise Unreadable("no workbook")
    places: list[tuple[int, str]] = []
    shared_blocks: list[bytes] = []
    last = 0
    for kind, raw in _records(stream):
        if kind == 0x2F:
            raise Unreadable("the workbook is encrypted")
        if kind == 0x85 and raw[5] == 0:
            places.append((struct.unpack_from("<I", raw)[0], _string(raw, 6, False)))
        elif kind == 0xFC or (kind == 0x3C and last == 0xFC):
            shared_blocks.append(raw)
            kind = 0xFC
        elif kind == 0x0A:
            break
        last = kind
    shared = _shared(shared_blocks) if shared_blocks else []
    out = []
    for at, name in places:
        cells: Grid = {}
        waiting: tuple[int, int] | None = None
        depth = 0
        for kind, raw in _records(stream, at):
            if kind == 0x809:
                depth += 1
            elif kind == 0x0A:
                depth -= 1
                if depth <= 0:
                    break
            elif kind == 0x207 and waiting:
                cells[waiting] = _string(raw, 0, True)
                waiting = None
            elif kind in (0xFD, 0x203, 0x27E, 0x204, 0x06, 0x205) and len(raw) >= 8:
                where = struct.unpack_from("<HH", raw)
                if kind == 0xFD:
                    k = struct.unpack_from("<I", raw, 6)[0]
                    cells[where] = shared[k] if k < len(shared) else ""
                elif kind == 0x203:
                    cells[where] = number(struct.unpack_from("<d", raw, 6)[0])
                elif kind == 0x27E:
                    cells[where] = number(_rk(struct.unpack_from("<I", raw, 6)[0]))
                elif kind == 0x204:
                    cells[where] = _string(raw, 6, True)
                elif kind == 0x205:
                    cells[where] = "" if raw[7] else ("true" if raw[6] else "false")
                elif raw[12:14] == b"\xff\xff":
                    if raw[6] == 0:
                        waiting = where
                    elif raw[6] == 1:
                        cells[where] = "true" if raw[8] else "false"
                else:
                    cells[where] = number(struct.unpack_from("<d", raw, 6)[0])
            elif kind == 0xBD:
                row, col = struct.unpack_from("<HH", raw)
                for k in range((len(raw) - 6) // 6):
                    cells[row, col + k] = number(_rk(struct.unpack_from("<I", raw, 6 + 6 * k)[0]))
            if len(cells) > MAX_CELLS:
                raise Unreadable(f"the sheets have more than {MAX_CELLS} cells")
        out.append((name, cells))
    return out


# ---- .xlsb ---------------------------------------------------------------------------------------


def _binary_records(raw: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0

    def varying(most: int) -> int:
        nonlocal at
        value = shift = 0
        for _ in range(most):
            if at >= len(raw):
                return value
            b = raw[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                break
        return value

    while at < len(raw):
        kind = raw[at]
        at += 1
        if kind & 0x80 and at < len(raw):
            kind = (kind & 0x7F) | (raw[at] & 0x7F) << 7
            at += 1
        n = varying(4)
        yield kind, raw[at : at + n]
        at += n


def _wide(raw: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", raw, at)[0]
    if n == 0xFFFFFFFF:
        return "", at + 4
    return raw[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def xlsb_names(workbook: bytes) -> list[tuple[str, str]]:
    """(name, relation) of the sheets."""
    out = []
    for kind, raw in _binary_records(workbook):
        if kind == 156:
            relation, at = _wide(raw, 8)
            out.append((_wide(raw, at)[0], relation))
    return out


def xlsb_strings(table: bytes) -> list[str]:
    return [_wide(raw, 1)[0] for kind, raw in _binary_records(table) if kind == 19]


def xlsb_cells(sheet: bytes, shared: list[str]) -> Grid:
    cells: Grid = {}
    row = 0
    for kind, raw in _binary_records(sheet):
        if kind == 0 and len(raw) >= 4:
            row = struct.unpack_from("<I", raw)[0]
        elif 2 <= kind <= 10 and len(raw) >= 9:
            where = (row, struct.unpack_from("<I", raw)[0])
            if kind == 2:
                cells[where] = number(_rk(struct.unpack_from("<I", raw, 8)[0]))
            elif kind in (5, 9):
                cells[where] = number(struct.unpack_from("<d", raw, 8)[0])
            elif kind in (4, 10):
                cells[where] = "true" if raw[8] else "false"
            elif kind in (6, 8):
                cells[where] = _wide(raw, 8)[0]
            elif kind == 7:
                k = struct.unpack_from("<I", raw, 8)[0]
                cells[where] = shared[k] if k < len(shared) else ""
        if len(cells) > MAX_CELLS:
            raise Unreadable(f"the sheets have more than {MAX_CELLS} cells")
    return cells
