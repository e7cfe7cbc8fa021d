"""Packing: rows of named bytes in, rows of text and status out.

Names are filtered and budgets spent on narrow rows, by the sizes the scan found, before any byte is
read; bytes meet Python only in one Arrow stage, where an archive is expanded under one budget and
every member read.  Nothing in that stage is shuffled, so a row's cost stays where its bytes are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import classify, paths, tables, text
from folio.operators import budget
from folio.operators.archive import MAX_DEPTH, Budget, members, unsafe_name
from folio.operators.extract.dispatch import classify_bytes, extract
from folio.operators.isolate import extract_isolated
from folio.options import Options
from folio.plans.shared import materialized, ranked
from folio.sources.files import GONE

SCHEMA = "id string, relative string, kind string, size bigint, text string, status string, status_limit bigint, status_detail string, archive_cut boolean"
COLUMNS = ["id", "relative", "kind", "size", "text", "status", "status_limit", "status_detail", "archive_cut"]

FLUSH_CHARS = 4 << 20  # text a batch may hold before it is handed on

_KINDS = tables.kind_of_extension()


def kind_of_name(path: str) -> str | None:
    """The Python twin of ``classify.kind_from_name``, for members inside an archive."""
    low = path.lower()
    name = low.rsplit("/", 1)[-1]
    if name in tables.TEXT_NAMES:
        return "text"
    if low.endswith((".tar.gz", ".tgz")):
        return "targz"
    if low.endswith(".tar"):
        return "tar"
    ext = name.rsplit(".", 1)[1] if "." in name[1:] else ""
    return "text" if re.fullmatch(r"[0-9]{1,4}", ext) else _KINDS.get(ext)


def _join(parent: str, child: str) -> str:
    return "/".join(p for p in f"{parent}/{child}".split("/") if p not in ("", "."))


class Packer:
    """Reads one file or all members of one archive; picklable, no Spark inside."""

    def __init__(self, opts: Options) -> None:
        self.opts = opts
        ex = (*paths.default_excludes(), *opts.exclude) if opts.default_excludes else opts.exclude
        self.drop = re.compile(rx) if (rx := paths.globs_regex(ex)) else None
        self.want = re.compile(rx) if (rx := paths.globs_regex(opts.include)) else None

    def keeps(self, path: str, archive: bool) -> bool:
        base = path.rsplit("/", 1)[-1]
        if not self.opts.hidden and any(p.startswith(".") and p not in (".", "..") for p in path.split("/")):
            return False
        if self.drop and (self.drop.match(path) or self.drop.match(base)):
            return False
        return archive or not self.want or bool(self.want.match(path) or self.want.match(base))

    def pack(self, id_: str, rel: str, raw: bytes | None, depth: int = 0, spent: Budget | None = None, kind: str | None = None, size: int | None = None, root: bool = False) -> list[tuple]:
        """Rows of a file: itself, or the members of an archive.  A note is left to ``text.note``.
        ``raw`` is null for a file over the cap that was not read, whose ``size`` is given."""
        o = self.opts
        kind = kind or kind_of_name(rel) or (classify_bytes(raw) if raw is not None else "unknown")
        size = len(raw) if raw is not None else size or 0
        if raw is None or size > o.max_file_size:
            return [(id_, rel, kind, size, None, "too_large", o.max_file_size, None, False)]
        if kind in tables.ARCHIVE_KINDS:
            if depth < MAX_DEPTH and (o.follow_archives or root):
                return self._expand(id_, rel, raw, kind, depth, spent or Budget())
            detail = f"not expanded: nested more than {MAX_DEPTH} archives deep" if o.follow_archives else None
            return [(id_, rel, kind, size, None, "skipped_archive", None, detail, False)]
        flags = {"skip_binaries": o.skip_binaries, "notebook_outputs": o.notebook_outputs, "source_mode": o.source_mode}
        got = extract_isolated(raw, kind, o.timeout_s, **flags) if o.isolate and kind in tables.HEAVY_KINDS else extract(raw, kind, **flags)
        if got.status == "skipped_binary":
            kind = "binary"
        return [(id_, rel, kind, size, got.text, got.status, None, got.detail, False)]

    def _expand(self, id_: str, rel: str, raw: bytes, kind: str, depth: int, spent: Budget) -> list[tuple]:
        def want(name: str) -> str:
            child = _join(rel, name)
            named = kind_of_name(child)
            if unsafe_name(name) or not self.keeps(child, named is None or named in tables.ARCHIVE_KINDS):
                return "nothing"
            return "size" if named == "binary" and self.opts.skip_binaries else "bytes"

        out: list[tuple] = []
        ids: set[str] = set()
        try:
            for m in members(raw, kind, self.opts.max_file_size, spent, want):
                child = _join(rel, m.name)
                named = kind_of_name(child) or (classify_bytes(m.data) if m.tag == "file" else "unknown")
                if not self.keeps(child, named in tables.ARCHIVE_KINDS):
                    continue
                base = new = f"{id_}!{child}"
                n = 2
                while new in ids:
                    new, n = f"{base}#{n}", n + 1
                ids.add(new)
                if m.tag == "file":
                    out += self.pack(new, child, m.data, depth + 1, spent, named)
                elif m.tag == "too_large":
                    out.append((new, child, named, m.size, None, "too_large", self.opts.max_file_size, None, False))
                elif m.tag == "unread":
                    out.append((new, child, named, m.size, None, "skipped_binary", None, None, False))
                else:
                    out.append((new, child, named, m.size, None, "unreadable", None, m.detail, False))
        except Exception as e:  # noqa: BLE001 - an archive its reader rejects keeps a note
            if not out:
                return [(id_, rel, kind, len(raw), None, "unreadable", None, str(e) or type(e).__name__, False)]
            spent.cut = True  # what was read before stays
        return [(*r[:-1], spent.cut) for r in out] if depth == 0 else out


def lasts(status: str) -> bool:
    """Whether an outcome would be the same next time: errors and changed files are tried again."""
    return status not in ("error", "changed")


def pack_df(files: DataFrame, opts: Options = Options(), owner: bool = False) -> DataFrame:  # noqa: B008
    """Packs rows (id, relative, bytes[, size, root_relative, is_root, gone]): filters, selection,
    budgets in path order, readers.

    Defined results: null bytes are status 'changed' ('gone' says why), or 'too_large' where the size
    is over the cap; repeated ids are kept apart by their rows; empty tables give an empty result;
    other columns are ignored.  With ``owner`` each row also names the id of the file it came from
    and whether all that came from it may be cached.
    """
    return read_rows(admitted(files, opts), opts, owner)


def with_unique_ids(files: DataFrame) -> DataFrame:
    """Rows that repeat an id get '#2', '#3' and so on, in path order; all other rows pass untouched.

    Which ids repeat is found on the ids alone, so the bytes of rows that do not are never moved.
    A null id is left as it is.
    """
    again = materialized(files.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 AND id IS NOT NULL").select("id"))
    if again.isEmpty():
        return files
    order = F.struct(paths.path_order("relative").alias("p"), F.xxhash64("bytes").alias("h")) if "bytes" in files.columns else F.struct(paths.path_order("relative").alias("p"))
    repeated = ranked(files.join(again, "id", "left_semi"), "id", [order], "_rank")
    renamed = repeated.withColumn("id", F.when(F.col("_rank") == 1, F.col("id")).otherwise(F.concat("id", F.lit("#"), F.col("_rank").cast("string")))).drop("_rank")
    return files.join(again, "id", "left_anti").unionByName(renamed.select(*files.columns))


def admitted(files: DataFrame, opts: Options) -> DataFrame:
    """The rows that filters, selection and budgets let through, all their columns kept."""
    return admit(files, opts)[0]


def admit(files: DataFrame, opts: Options) -> tuple[DataFrame, int]:
    """As ``admitted``, and how many files the budgets cut off.

    A size is the column's, if there is one, else that of the bytes.
    """
    under = "root_relative" if "root_relative" in files.columns else None
    named = files.where(paths.keep_path("relative", opts.include, opts.exclude, opts.hidden, opts.default_excludes, under_root=under, unpacking=opts.follow_archives))
    if opts.selection is not None:
        named = _selected(named, opts.selection)
    if not (opts.max_entries or opts.max_total_bytes < 1 << 62):
        return named, 0
    own = "_size" if "size" not in named.columns else "size"
    sized = named if own == "size" else named.withColumn("_size", F.octet_length("bytes").cast("bigint"))
    kept, cut = _within_budget(sized, opts, own)
    return kept.drop("_size"), cut


def read_rows(files: DataFrame, opts: Options, owner: bool = False) -> DataFrame:
    """Reads admitted rows; one Arrow stage, and the notes are put in by the JVM."""
    packer = Packer(opts)
    columns = [*COLUMNS, "owner", "lasting"] if owner else COLUMNS
    wanted = {"size": "bigint", "is_root": "boolean", "gone": "string"}
    given = [F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows: list[tuple] = []
            held = 0
            for i, rel, raw, size, root, gone in zip(pdf["id"], pdf["relative"], pdf["bytes"], pdf["size"], pdf["is_root"], pdf["gone"]):
                size = None if pd.isna(size) else int(size)
                if raw is None and (gone is not None or size is None or size <= opts.max_file_size):
                    got = [(i, rel, kind_of_name(rel) or "unknown", size or 0, None, "changed", None, gone or GONE, False)]
                else:
                    got = packer.pack(i, rel, None if raw is None else bytes(raw), size=size, root=root is True)
                if owner:
                    lasting = all(lasts(r[5]) for r in got)
                    rows += [(*r, i, lasting) for r in got]
                else:
                    rows += got
                held += sum(len(r[4] or "") for r in got)
                if held > FLUSH_CHARS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    out = files.select("id", "relative", "bytes", *given).mapInPandas(run, f"{SCHEMA}, owner string, lasting boolean" if owner else SCHEMA)
    return out.withColumn("text", shown_text())


def _selected(named: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows a request's names select: by id, and by path for names that are nobody's id.  The
    names come from the driver, so the sides sent to the executors are bounded by them."""
    spark = named.sparkSession
    wanted = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "id string")
    ids = {r[0] for r in named.select("id").join(F.broadcast(wanted), "id", "left_semi").distinct().collect()}
    loose = spark.createDataFrame([(n,) for n in dict.fromkeys(names) if n not in ids], "relative string")
    flagged = named.join(F.broadcast(wanted.withColumn("_id", F.lit(True))), "id", "left").join(F.broadcast(loose.withColumn("_rel", F.lit(True))), "relative", "left")
    return flagged.where("_id OR _rel").select(*named.columns)


def _within_budget(named: DataFrame, opts: Options, size: str) -> tuple[DataFrame, int]:
    """Rows up to the last one the budget keeps, and how many it cuts.  What is kept is a prefix of
    the path order, so one row, its end, decides for all; the bytes are neither sorted nor joined."""
    fit = budget.apply_budgets(named.select("id", "relative", F.col(size).alias("size")), opts.max_total_bytes, opts.max_entries, opts.max_file_size)
    key = F.struct(paths.path_order("relative").alias("p"), F.col("id"))
    got = fit.agg(F.max(F.when(F.col("kept"), key)).alias("last"), F.count_if(~F.col("kept")).alias("cut")).head()
    if not got["cut"]:
        return named, 0
    if got["last"] is None:
        return named.where(F.lit(False)), got["cut"]
    order, end = paths.path_order("relative"), F.array(*map(F.lit, got["last"]["p"]))
    return named.where((order < end) | ((order == end) & (F.col("id") <= F.lit(got["last"]["id"])))), got["cut"]


def scan_df(files: DataFrame, opts: Options = Options()) -> DataFrame:  # noqa: B008
    """The manifest of rows (id, relative, size[, head, root_relative]): kind, language, default_on, oversized.

    Only rows whose name does not decide the kind are sniffed; they go their own branch, since a
    condition does not keep Spark from evaluating a Python function.
    """
    base = files.withColumn("kind", classify.kind_from_name("relative"))
    if "head" in files.columns:
        sniffed = base.where("kind IS NULL").select(*files.columns, F.when(F.col("head").isNull(), "unknown").otherwise(_sniff("head")).alias("kind"))
        base = base.where("kind IS NOT NULL").select(*files.columns, "kind").unionByName(sniffed)
    else:
        base = base.withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    return (
        base.where(paths.keep_path("relative", opts.include, opts.exclude, opts.hidden, opts.default_excludes, under_root="root_relative" if "root_relative" in files.columns else None, unpacking=opts.follow_archives))
        .withColumn("language", classify.language("relative", "kind"))
        .withColumn("default_on", classify.default_on("relative", "kind", "size", opts.max_file_size, opts.follow_archives))
        .withColumn("oversized", F.coalesce(F.col("size") > opts.max_file_size, F.lit(False)))
        .drop("head")
    )


def _sniff(column: str):  # noqa: ANN202
    @F.pandas_udf("string")
    def run(heads: pd.Series) -> pd.Series:
        return heads.map(lambda h: classify_bytes(bytes(h)) if h is not None else "unknown")

    return run(column)


def shown_text() -> Column:
    """Text or note of a packed row."""
    return F.coalesce("text", text.note("status", "relative", "kind", "size", "status_limit", "status_detail"))
