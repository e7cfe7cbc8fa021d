"""One immutable request of a pack, with the published defaults."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass


def parse_size(text: str) -> int:
    """Bytes of '8MiB', '1m', '500k'; 1024-based, '_' allowed."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:([kmg])(?:i?b)?)?\s*", text.replace("_", "").lower())
    if not m:
        raise ValueError(f"invalid size {text}")
    return int(m[1]) << {None: 0, "k": 10, "m": 20, "g": 30}[m[2]]


@dataclass(frozen=True)
class Options:
    roots: tuple[str, ...] = (".",)
    gitignore: bool = True
    hidden: bool = False
    follow_links: bool = False
    max_file_size: int = 8 << 20
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    default_excludes: bool = True
    follow_archives: bool = False
    skip_binaries: bool = True
    tree: str = "selected"  # selected, full, none
    format: str = "plain"
    notebook_outputs: bool = False
    source_mode: bool = False
    selection: tuple[str, ...] | None = None  # None: all; an empty one selects nothing
    max_entries: int = 0
    max_total_bytes: int = 1 << 30
    isolate: bool = False
    timeout_s: int = 30

    def fingerprint(self) -> str:
        """Of the settings that change what a file reads as."""
        keys = ("hidden", "max_file_size", "include", "exclude", "default_excludes", "follow_archives", "skip_binaries", "notebook_outputs", "source_mode", "isolate", "timeout_s")
        return hashlib.sha256(json.dumps({k: asdict(self)[k] for k in keys}, sort_keys=True).encode()).hexdigest()
