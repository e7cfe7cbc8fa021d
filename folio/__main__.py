"""python -m folio PATHS [-o FILE]: pack folders into one dump."""

from __future__ import annotations

import argparse
import os
import stat
import sys
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import display_path, expand_home
from folio.operators import render, stats, tree
from folio.operators.pack import admit, read_rows, scan_df
from folio.options import Options, parse_size
from folio.plans.shared import materialized
from folio.sources.files import head_bytes, labels, scan_all, warnings, with_bytes


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folio", description="Pack folders of mixed files into one text dump.")
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("-o", "--output")
    p.add_argument("-f", "--format", choices=["plain", "txt", "markdown", "md", "xml"])
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--max-file-size", type=parse_size, default=8 << 20)
    p.add_argument("--max-total-bytes", type=parse_size, default=1 << 30)
    p.add_argument("--max-entries", type=int, default=0)
    p.add_argument("--tree", action="store_true", help="map all files, not only those read")
    p.add_argument("--no-tree", action="store_true")
    p.add_argument("--tree-only", action="store_true", help="write the map and no file")
    for flag in ("hidden", "follow-links", "archives", "binaries", "notebook-outputs", "source", "list", "tokens", "isolate"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--no-gitignore", action="store_true")
    p.add_argument("--no-default-excludes", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-j", "--jobs", type=int, default=0)
    return p


@dataclass
class Output:
    """Where a dump goes and what the walk has to leave out for it."""

    target: str | None = None  # a regular file, replaced whole
    place: str | None = None  # a device or pipe, written in place
    paths: list[str] = field(default_factory=list)
    identities: list[tuple[int, int]] = field(default_factory=list)


def prepare_output(out: str | None, roots: list[str]) -> Output:
    """Settles the destination before any work: it must take a file and must be no input."""
    if out is None:
        st = os.fstat(sys.stdout.fileno()) if hasattr(sys.stdout, "fileno") and not sys.stdout.closed and _has_descriptor() else None
        return Output(identities=[(st.st_dev, st.st_ino)] if st and stat.S_ISREG(st.st_mode) else [])
    target = os.path.realpath(out)
    skip = list(dict.fromkeys([os.path.abspath(out), target]))
    try:
        st = os.stat(out)
    except OSError:
        st = None
    if st and stat.S_ISDIR(st.st_mode):
        raise ValueError(f"output {out} is a directory")
    if st and not stat.S_ISREG(st.st_mode):
        return Output(place=out, paths=skip, identities=[(st.st_dev, st.st_ino)])
    if st and any(os.path.isfile(r) and os.path.samestat(os.stat(r), st) for r in roots):
        raise ValueError(f"output {out} is also an input; writing it would destroy the input")
    folder = os.path.dirname(target)
    if not os.path.exists(folder):
        raise ValueError(f"output directory {folder} does not exist")
    if not os.path.isdir(folder):
        raise ValueError(f"{folder} is not a directory")
    try:
        handle, probe = tempfile.mkstemp(prefix=".folio-", dir=folder)
    except OSError as e:
        raise ValueError(f"cannot create a file in output directory {folder}: {e.strerror}") from e
    os.close(handle)
    os.unlink(probe)
    return Output(target=target, paths=skip, identities=[(st.st_dev, st.st_ino)] if st else [])


def _has_descriptor() -> bool:
    try:
        sys.stdout.fileno()
    except (OSError, ValueError):
        return False
    return True


def left_out(files: DataFrame, out: Output) -> DataFrame:
    """Files that are not the output, by path or by device and inode."""
    keep = ~F.col("absolute").isin(out.paths) if out.paths else F.lit(True)
    for dev, ino in out.identities:
        keep = keep & ~((F.col("dev") == dev) & (F.col("ino") == ino))
    return files.where(keep)


def _write(out: Output, parts: Iterator[str]) -> None:
    if out.target:
        render.write_atomic(out.target, parts)
        return
    try:
        if out.place:
            with open(out.place, "w", encoding="utf-8", newline="") as f:
                for part in parts:
                    f.write(part)
        else:
            for part in parts:
                sys.stdout.write(part)
            sys.stdout.flush()
    except BrokenPipeError:  # the reader has enough
        pass


def ui(argv: list[str]) -> int:
    """python -m folio ui [--port N]: serves the HTTP layer until it is interrupted."""
    from folio.serve import serve

    p = argparse.ArgumentParser(prog="folio ui", description="Serve scans and packs on this machine.")
    p.add_argument("--port", type=int, default=0)
    a = p.parse_args(argv)
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    server, session = serve(spark, a.port)
    print(f"http://127.0.0.1:{server.server_address[1]} (X-Folio-Secret: {session.secret})", file=sys.stderr)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        server.shutdown()
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["ui"] and not os.path.exists("ui"):
        return ui(argv[1:])
    a = parser().parse_args(argv)
    began = time.time()
    fmt = {"txt": "plain", "md": "markdown"}.get(a.format, a.format)
    opts = Options(
        roots=tuple(map(expand_home, a.paths)), gitignore=not a.no_gitignore, hidden=a.hidden, follow_links=a.follow_links, max_file_size=a.max_file_size, include=tuple(a.include), exclude=tuple(a.exclude),
        default_excludes=not a.no_default_excludes, follow_archives=a.archives, skip_binaries=not a.binaries, tree="none" if a.no_tree else "full" if a.tree else "selected",
        format=fmt or render.format_of(a.output or ""), notebook_outputs=a.notebook_outputs, source_mode=a.source, max_entries=a.max_entries, max_total_bytes=a.max_total_bytes, isolate=a.isolate,
    )
    try:
        out = prepare_output(a.output, list(opts.roots))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.master(f"local[{a.jobs or '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        walked = materialized(scan_all(spark, opts))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    say = (lambda *lines: None) if a.quiet else (lambda *lines: print(*lines, sep="\n", file=sys.stderr))
    total, kept = warnings(walked)
    if total:
        say(*stats.warning_lines(total, kept))
    files, cut = admit(left_out(walked.where("warning IS NULL").drop("warning"), out), opts)
    label = ", ".join(labels(list(opts.roots)))
    if a.list:
        rows = scan_df(head_bytes(files), opts).where("kind <> 'binary'" if opts.skip_binaries else "true").orderBy("relative").select(display_path("relative")).toLocalIterator()
        lines = [f"{r[0]}\n" for r in rows]
        _write(out, iter(lines))
        say(f"listed {len(lines)} files in {int((time.time() - began) * 1000)}ms" + (", truncated" if cut else ""))
        return 0
    if a.tree_only:
        _write(out, iter([render.directory_map(files, label, opts.format)]))
        return 0
    packed = materialized(read_rows(with_bytes(files, opts.max_file_size), opts))
    totals = stats.with_summary(stats.finished(packed, cut)).head()
    if a.tokens:
        print(f"~{totals['tokens_est']} tokens")
        return 0
    mapped = files if opts.tree == "full" else packed.where("status = 'extracted'")
    text = "" if opts.tree == "none" else tree.tree_text(tree.tree_lines(mapped), label)
    _write(out, render.in_chunks(render.chunks(packed, opts.format, text, opts.source_mode)))
    say(totals["summary"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
