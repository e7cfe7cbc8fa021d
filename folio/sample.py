"""A small project of our own making, written out to try things on: text and, in base64, binary files."""

from __future__ import annotations

import base64
import io
import os
import zipfile


def _zip(members: dict[str, str]) -> str:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in members.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
    return base64.b64encode(out.getvalue()).decode()


def _paragraphs(*texts: str) -> str:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    return f'<w:document xmlns:w="{w}"><w:body>' + "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts) + "</w:body></w:document>"


def files() -> list[dict[str, str]]:
    """path and text, or path and base64, of each file."""
    notebook = '{"cells": [{"cell_type": "markdown", "source": "# Counts"}, {"cell_type": "code", "source": "sum(counts)"}]}'
    return [
        {"path": "readme.md", "text": "# Orchard\n\nCounts trees and the fruit on them.\n"},
        {"path": "orchard.toml", "text": 'name = "orchard"\nrows = 12\n'},
        {"path": "src/main.py", "text": "from rows import count\n\nprint(count(12))\n"},
        {"path": "src/rows.py", "text": "def count(rows: int) -> int:\n    return rows * 40\n"},
        {"path": "data/harvest.csv", "text": "row,kg\n1,310\n2,295\n"},
        {"path": "data/station.json", "text": '{"station": "north gate", "sensors": [3, 5]}'},
        {"path": "site/index.html", "text": "<!doctype html><title>Orchard</title><h1>Orchard</h1><p>Open <em>daily</em>.</p>"},
        {"path": "notebooks/counts.ipynb", "text": notebook},
        {"path": "docs/letter.rtf", "text": "{\\rtf1\\ansi Dear pickers,\\par the ladders are in the shed.}"},
        {"path": "docs/plan.docx", "base64": _zip({"word/document.xml": _paragraphs("Planting plan", "Two rows of quince.")})},
        {"path": "data/older.zip", "base64": _zip({"2023.csv": "row,kg\n1,280\n", "notes/frost.txt": "Late frost in May.\n"})},
        {"path": "data/icon.bin", "base64": base64.b64encode(bytes(range(64))).decode()},
        {"path": ".gitignore", "text": "*.tmp\n"},
    ]


def materialize(parent: str, name: str = "orchard") -> str:
    """Writes the project below a folder; files that are there with other contents are left alone."""
    root = os.path.join(parent, name)
    for f in files():
        path = os.path.join(root, f["path"])
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if not os.path.exists(path):
            with open(path, "wb") as out:
                out.write(f["text"].encode() if "text" in f else base64.b64decode(f["base64"]))
    return root
