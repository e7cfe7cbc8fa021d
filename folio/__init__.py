"""A PySpark-native document-corpus engine: folders and tables of files in, clean text out."""

from folio.functions.classify import default_selected, kind_from_name, language, looks_binary
from folio.incremental import VersionedTable, pending_files
from folio.operators.budget import apply_budgets
from folio.operators.pack import admit, pack_df, read_rows, scan_df
from folio.operators.render import chunks, directory_map, sections, write_atomic
from folio.operators.stats import finished, pack_stats
from folio.operators.tree import tree_lines
from folio.options import Options, parse_size
from folio.results import Results, SteppedPack
from folio.sources.files import scan, with_bytes
from folio.streaming.repack import repack, watch, watched

__all__ = [
    "Options", "Results", "SteppedPack", "VersionedTable", "admit", "apply_budgets", "chunks", "default_selected", "directory_map", "finished",
    "kind_from_name", "language", "looks_binary", "pack_df", "pack_stats", "parse_size", "pending_files", "read_rows", "repack", "scan", "scan_df",
    "sections", "tree_lines", "watch", "watched", "with_bytes", "write_atomic",
]
