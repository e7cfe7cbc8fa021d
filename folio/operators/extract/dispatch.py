"""One entry for all readers, with signatures checked, misnamed files read as what they are, and
every failure contained in its row."""

from __future__ import annotations

from dataclasses import dataclass

from folio.operators.extract import data as d
from folio.operators.extract import markup, office, rich
from folio.operators.extract.common import Unreadable, decode, looks_binary

TEXT_LIKE = frozenset(("text", "html", "xml", "json", "csv", "tsv", "ipynb", "unknown"))
# What a refused document was meant to be.
_NOUNS = {"pdf": "a PDF", "docx": "a Word document", "pptx": "a PowerPoint presentation", "sheet": "a spreadsheet", "odt": "an OpenDocument text", "odp": "an OpenDocument presentation", "epub": "an EPUB"}
# Magic numbers and how a note names what they start.
_MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "a PNG image"), (b"\xff\xd8\xff", "a JPEG image"), (b"GIF87a", "a GIF image"), (b"GIF89a", "a GIF image"), (b"BM", "a BMP image"), (b"%PDF", "a PDF"),
    (b"PK\x03\x04", "a zip archive"), (b"\x1f\x8b", "gzip data"), (b"BZh", "bzip2 data"), (b"\xfd7zXZ\x00", "xz data"), (b"7z\xbc\xaf\x27\x1c", "a 7z archive"), (b"Rar!\x1a\x07", "a RAR archive"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "an OLE document"), (b"\x7fELF", "an ELF executable"), (b"MZ", "a Windows executable"), (b"{\\rtf", "an RTF document"), (b"ID3", "an MP3 audio file"), (b"OggS", "an Ogg audio file"), (b"fLaC", "a FLAC audio file"),
    (b"II*\x00", "a TIFF image"), (b"MM\x00*", "a TIFF image"), (b"\x00\x00\x01\x00", "an icon"), (b"8BPS", "a Photoshop image"), (b"\x28\xb5\x2f\xfd", "zstd data"), (b"\x04\x22\x4d\x18", "LZ4 data"), (b"\x5d\x00\x00", "LZMA data"),
    (b"\xca\xfe\xba\xbe", "a Java class or Mach-O file"), (b"\xcf\xfa\xed\xfe", "a Mach-O executable"), (b"\x00asm", "a WebAssembly module"), (b"!<arch>\n", "a library archive"), (b"SQLite format 3\x00", "a SQLite database"), (b"PAR1", "a Parquet file"),
    (b"ARROW1", "an Arrow file"), (b"\x89HDF\r\n\x1a\n", "HDF5 data"), (b"SIMPLE  =", "a FITS file"), (b"wOFF", "a web font"), (b"wOF2", "a web font"), (b"OTTO", "a font"), (b"\x00\x01\x00\x00\x00", "a font"), (b"\x1a\x45\xdf\xa3", "a Matroska video"), (b"FLV\x01", "a Flash video"), (b"MThd", "a MIDI file"), (b"\x93NUMPY", "a NumPy array"),
)


@dataclass(frozen=True)
class Extracted:
    status: str  # extracted, unreadable, error, skipped_binary
    text: str | None
    detail: str | None = None


def sniff(head: bytes) -> str | None:
    """Kind by magic number; bare gzip is not expanded."""
    if head.startswith(b"%PDF"):
        return "pdf"
    if head.startswith(b"{\\rtf"):
        return "rtf"
    if head.startswith(b"PK\x03\x04"):
        for mark, kind in ((b"word/", "docx"), (b"ppt/", "pptx"), (b"xl/", "sheet"), (b"application/epub+zip", "epub"), (b"opendocument.text", "odt"), (b"opendocument.presentation", "odp"), (b"opendocument.spreadsheet", "sheet")):
            if mark in head[:4096]:
                return kind
        return "zip"
    if head[257:262] == b"ustar":
        return "tar"
    if head[:4] == b"RIFF" and head[8:12] in (b"WAVE", b"WEBP", b"AVI ") or head[4:8] == b"ftyp":
        return "binary"
    low = head[:256].lstrip().lower()
    if low.startswith((b"<!doctype html", b"<html")):
        return "html"
    if low.startswith(b"<?xml"):
        return "xml"
    if head.startswith(b"\x93NUMPY"):
        return "npy"
    return "binary" if any(head.startswith(m) for m, _ in _MAGIC) else None


def classify_bytes(head: bytes) -> str:
    return sniff(head) or ("binary" if looks_binary(head) else "text")


def contents(raw: bytes) -> str:
    """What bytes hold, as a note says it."""
    if not raw:
        return "the file is empty"
    low = raw[:512].lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    if low.startswith((b"<!doctype html", b"<html", b"<head", b"<body", b"<title", b"<script", b"<div", b"<table", b"<p", b"<h1", b"<!--")) or (low.startswith(b"<?xml") and b"<html" in low):
        title = markup.page_title(decode(raw[: 64 << 10]))
        return f'it holds an HTML page ("{title}")' if title else "it holds an HTML page"
    for magic, noun in _MAGIC:
        if raw.startswith(magic):
            return f"it holds {noun}"
    return "it holds binary data of an unknown type" if looks_binary(raw) else "it holds plain text"


def refusal(raw: bytes, kind: str) -> str | None:
    """Why the bytes cannot be a document of the kind; null if they can."""
    if kind == "pdf":
        ok = b"%PDF-" in raw[:1028]
    elif kind == "sheet":
        ok = raw.startswith((b"PK\x03\x04", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"))
    elif kind in _NOUNS:
        ok = raw.startswith(b"PK\x03\x04")
    else:
        return None
    return None if ok else f"not {_NOUNS[kind]}: {contents(raw)}"


def read(raw: bytes, kind: str, notebook_outputs: bool = False, source_mode: bool = False) -> str:
    if source_mode and kind in ("html", "xml", "json"):
        return decode(raw)
    readers = {"html": markup.html_text, "xml": markup.xml_text, "json": d.json_text, "csv": d.table_text, "npy": d.npy_text, "npz": d.npz_text, "docx": office.docx_text, "pptx": office.pptx_text, "sheet": office.sheet_text, "odt": office.opendocument_text, "odp": office.opendocument_text, "epub": office.epub_text, "rtf": rich.rtf_text, "pdf": rich.pdf_text}
    if kind == "tsv":
        return d.table_text(raw, "\t")
    if kind == "ipynb":
        return d.notebook_text(raw, notebook_outputs)
    return readers.get(kind, decode)(raw)


def extract(raw: bytes, kind: str, skip_binaries: bool = True, notebook_outputs: bool = False, source_mode: bool = False) -> Extracted:
    """Text of a file, or its status and the reason; never raises."""
    try:
        if kind in TEXT_LIKE and looks_binary(raw):
            kind = "binary"
        if kind == "binary":
            return Extracted("skipped_binary", None) if skip_binaries else Extracted("extracted", f"[binary file, {len(raw)} bytes]")
        why = refusal(raw, kind)
        if why:
            low = contents(raw)
            actual = "html" if "HTML" in low else "text" if low == "it holds plain text" else None
            if raw and actual is None:
                return Extracted("unreadable", None, why)
            return Extracted("extracted", f"[{why}]" + (f"\n{read(raw, actual, notebook_outputs, source_mode)}" if actual else ""))
        return Extracted("extracted", read(raw, kind, notebook_outputs, source_mode))
    except Unreadable as e:
        return Extracted("unreadable", None, str(e))
    except Exception as e:  # noqa: BLE001 - one bad file must not end the pack
        return Extracted("error", None, f"{type(e).__name__}: {e}")
