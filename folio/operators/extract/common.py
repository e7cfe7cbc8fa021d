"""Decoding and errors shared by the readers."""

from __future__ import annotations

import codecs
import re

# White space as Unicode counts it (the ASCII separators 1C-1F are none).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


class Unreadable(Exception):
    """The bytes are not what their kind says, or are damaged."""


def lines(text: str) -> list[str]:
    """Lines end at '\\n'; a '\\r' before it goes with it; no empty line after the last end."""
    out = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    return out[:-1] if out and out[-1] == "" and text.endswith("\n") else out if text else []


def wide_guess(data: bytes) -> str | None:
    """UTF-16 without a mark, by its layout of NUL bytes: one half of the units' bytes nearly all
    zero, the other nearly never, and hardly a control character in the text."""
    sample = data[: 8192 & ~1]
    n = len(sample) // 2
    if n < 2:
        return None
    even, odd = sample[: 2 * n : 2].count(0), sample[1 : 2 * n : 2].count(0)
    for name, high, low in (("utf-16-le", odd, even), ("utf-16-be", even, odd)):
        if high * 100 >= 70 * n and low * 100 <= 5 * n:
            text = sample[: 2 * n].decode(name, "replace")
            bad = sum(c < " " and c not in "\t\n\x0b\x0c\r\x1b" or c == "�" for c in text)
            if bad * 100 <= len(text):
                return name
    return None


def decode(data: bytes) -> str:
    """Text of bytes: by mark, by layout, as strict UTF-8, else by the legacy page they look most like."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    if b"\0" in data[:8192] and (name := wide_guess(data)):
        return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    return data.decode(legacy_guess(data), "replace")


_RUNS = re.compile(rb"[\x80-\xff]+")


def legacy_guess(data: bytes) -> str:
    """The page of text that is no UTF-8, by the runs of its high bytes; the same on every machine.

    Western text has them one at a time between ASCII letters, Cyrillic and other scripts have whole
    words of them, East Asian text decodes strictly into its everyday characters.
    """
    sample = data[: 64 << 10]
    runs = [len(r) for r in _RUNS.findall(sample)]
    high = sum(runs)
    if not runs or high < 3 * len(runs):
        return "cp1252"
    best, most = "cp1252", 0.0
    for name in ("shift_jis", "euc_jp", "gb18030", "euc_kr", "big5"):
        try:
            text = sample[: len(sample) - len(sample) % 2].decode(name) if len(data) > len(sample) else sample.decode(name)
        except UnicodeDecodeError:
            continue
        common = sum("\u3041" <= c <= "\u30fe" or "\u4e00" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3" for c in text)
        kana = sum("\u3041" <= c <= "\u30fe" for c in text)
        if name in ("shift_jis", "euc_jp") and kana * 10 < common:
            continue  # Japanese is hardly written without
        score = 2.0 * common / high * (1.05 if kana * 10 >= common else 1.0)
        if score > max(most, 0.8):
            best, most = name, score
    if most and not _cyrillic(sample):
        return best
    return _cyrillic(sample) or best


def _cyrillic(sample: bytes) -> str | None:
    """Windows-1251 or KOI8-R, whichever has the commoner letters in lower case; neither if few are letters."""
    scores = {}
    for name in ("cp1251", "koi8_r"):
        text = sample.decode(name, "replace")
        letters = [c for c in text if "\u0400" <= c <= "\u04ff"]
        wide = sum(not c.isascii() for c in text) or 1
        if len(letters) < 0.9 * wide:
            continue
        scores[name] = sum(c in "оеаинтсрвлкмдпу" for c in letters) / len(letters)
    best = max(scores, key=lambda k: scores[k], default=None)
    return best if best and scores[best] > 0.5 else None


def looks_binary(data: bytes) -> bool:
    """More than one of 32 of the first 8 KiB are bytes that text does not use."""
    head = data[:8192]
    odd = len(head) - len(head.translate(None, bytes([*range(0, 9), *range(14, 27), *range(28, 32)])))
    if odd * 32 <= len(head):
        return False
    if head.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE, codecs.BOM_UTF32_BE)):
        text = decode(data[:8196])
        return (max(0, text.count("\0") + text.count("�") - 1)) * 100 > len(text)
    return wide_guess(data) is None
