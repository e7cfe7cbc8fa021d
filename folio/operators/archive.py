"""Members of zip and tar archives, under one budget for all that an archive holds.

The rule is greedy: a member that does not fit what is left is skipped and smaller ones after it
may still fit, so expansion is one sequential pass inside one call per archive.
"""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

MAX_COPIED, MAX_SCANNED, MAX_DEPTH = 512 << 20, 2 << 30, 3


@dataclass
class Budget:
    """Bytes of members that may still be copied and of streams that may still be scanned."""

    copied: int = MAX_COPIED
    scanned: int = MAX_SCANNED
    cut: bool = False


@dataclass
class Member:
    """tag: file, too_large, unread (wanted by name only), unreadable (detail says why)."""

    name: str
    tag: str
    size: int = 0
    data: bytes = field(default=b"", repr=False)
    detail: str = ""


Want = Callable[[str], str]  # 'bytes', 'size' or 'nothing', by a member's name


def unsafe_name(name: str) -> bool:
    """Empty, absolute, with a drive letter or a '..' component."""
    n = name.replace("\\", "/")
    return not n or n.startswith("/") or bool(re.match(r"[A-Za-z]:", n)) or ".." in n.split("/")


def _everything(_: str) -> str:
    return "bytes"


def _overlapping(infos: list[zipfile.ZipInfo]) -> set[int]:
    """Members whose data start inside the reach of an accepted one before them."""
    reach, bad = -1, set()
    for k in sorted(range(len(infos)), key=lambda k: infos[k].header_offset):
        i = infos[k]
        start = i.header_offset
        end = start + 30 + len(i.orig_filename.encode("utf-8", "replace")) + i.compress_size
        if start < reach:
            bad.add(k)
        else:
            reach = end
    return bad


def zip_members(data: bytes, max_size: int, budget: Budget, want: Want = _everything) -> Iterator[Member]:
    """In archive order; folders, links and unsafe names are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        infos = book.infolist()
        bad = _overlapping(infos)
        for k, i in enumerate(infos):
            name = i.filename.replace("\\", "/")
            if i.is_dir() or unsafe_name(i.filename) or (i.external_attr >> 28) == 0xA:
                continue
            wish = want(name)
            if wish == "nothing":
                continue
            if k in bad:
                yield Member(name, "unreadable", i.file_size, detail="its data overlaps another member's")
            elif i.file_size > max_size:
                yield Member(name, "too_large", i.file_size)
            elif wish == "size":
                yield Member(name, "unread", i.file_size)
            elif i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                yield Member(name, "unreadable", i.file_size, detail="compression method is not supported")
            elif i.file_size > budget.copied:
                budget.cut = True
            else:
                try:
                    with book.open(i) as f:
                        body = f.read(max_size + 1)
                except (zipfile.BadZipFile, RuntimeError, zlib.error, EOFError, OSError, NotImplementedError) as e:
                    yield Member(name, "unreadable", i.file_size, detail=str(e))
                    continue
                if len(body) > max_size:
                    yield Member(name, "too_large", len(body))
                else:
                    budget.copied -= len(body)
                    yield Member(name, "file", len(body), body)


class _Counted(io.RawIOBase):
    """A stream that ends when the scan budget is used up."""

    def __init__(self, inner: io.BufferedIOBase | gzip.GzipFile, budget: Budget) -> None:
        self.inner, self.budget = inner, budget

    def readable(self) -> bool:
        return True

    def readinto(self, buf) -> int:  # noqa: ANN001
        if self.budget.scanned <= 0:
            self.budget.cut = True
            return 0
        got = self.inner.read(min(len(buf), self.budget.scanned))
        self.budget.scanned -= len(got)
        buf[: len(got)] = got
        return len(got)


def tar_members(data: bytes, max_size: int, budget: Budget, want: Want = _everything, gz: bool = False) -> Iterator[Member]:
    """As a stream; a broken one keeps what came before and counts as cut."""
    raw = gzip.GzipFile(fileobj=io.BytesIO(data)) if gz else io.BytesIO(data)
    n = 0
    try:
        with tarfile.open(fileobj=io.BufferedReader(_Counted(raw, budget)), mode="r|", errors="backslashreplace") as book:
            for t in book:
                n += 1
                name = re.sub(r"\\udc([0-9a-f]{2})", r"\\x\1", t.name).replace("\\x", "\0x").replace("\\", "/").replace("\0x", "\\x")
                if not t.isreg() or unsafe_name(name):
                    continue
                wish = want(name)
                if wish == "nothing":
                    continue
                if t.size > max_size:
                    yield Member(name, "too_large", t.size)
                elif wish == "size":
                    yield Member(name, "unread", t.size)
                elif t.size > budget.copied:
                    budget.cut = True
                else:
                    f = book.extractfile(t)
                    body = f.read() if f else b""
                    if len(body) < t.size:
                        budget.cut = True
                        return
                    budget.copied -= len(body)
                    yield Member(name, "file", len(body), body)
    except (tarfile.TarError, EOFError, OSError, zlib.error):
        if n == 0:
            raise
        budget.cut = True


def members(data: bytes, kind: str, max_size: int, budget: Budget, want: Want = _everything) -> Iterator[Member]:
    return zip_members(data, max_size, budget, want) if kind == "zip" else tar_members(data, max_size, budget, want, kind == "targz")


def plain_members(data: bytes, kind: str, max_size: int, budget: Budget | None = None) -> list[tuple[str, bytes]]:
    """(name, bytes) of the files an archive of kind zip, tar or targz holds, in its order; what is too
    large or cannot be read is left out."""
    return [(m.name, m.data) for m in members(data, kind, max_size, budget or Budget()) if m.tag == "file"]
