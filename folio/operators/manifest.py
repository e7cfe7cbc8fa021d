"""What a request does with a manifest before packing and with outcomes after: ticks, selections,
keep lists, batches, outcome lists.

Defined results: null paths match nothing, null sizes count as 0, null ticks are off; an empty
table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folio.functions import classify, paths, tables, text
from folio.options import Options

BATCH_FILES, BATCH_BYTES = 256, 16 << 20  # of the files read together; heavy ones and archives go alone

# ---- ticks -------------------------------------------------------------------------------------


def _tickable() -> Column:
    return ~F.coalesce(F.col("oversized"), F.lit(False))


def tick(files: DataFrame, on: bool, where: Column) -> DataFrame:
    """Sets ticked for the rows that a condition names; files over the cap stay as they are."""
    old = F.coalesce(F.col("ticked") if "ticked" in files.columns else F.col("default_on"), F.lit(False))
    return files.withColumn("ticked", F.when(_tickable() & F.coalesce(where, F.lit(False)), F.lit(on)).otherwise(old))


def tick_all(files: DataFrame, on: bool) -> DataFrame:
    return tick(files, on, F.lit(True))


def tick_folder(files: DataFrame, folder: str, on: bool) -> DataFrame:
    """Ticks or unticks all that lies below a folder."""
    return tick(files, on, F.col("relative").startswith(folder.rstrip("/") + "/"))


def tick_pattern(files: DataFrame, pattern: str, on: bool) -> DataFrame:
    """Ticks or unticks what a screen pattern matches."""
    return tick(files, on, paths.matches_screen("relative", pattern))


def toggle_languages(files: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Each language is unticked if all its tickable files are ticked, else ticked; the flags are
    counted first, a row a language."""
    ticked = F.coalesce(F.col("ticked") if "ticked" in files.columns else F.col("default_on"), F.lit(False))
    label = F.coalesce("language", F.lit("text"))
    full = files.where(_tickable()).where(label.isin(*languages)).groupBy(label.alias("_l")).agg(F.bool_and(ticked).alias("_full"))
    rows = files.join(F.broadcast(full), label == F.col("_l"), "left")  # as many rows as languages are named
    return rows.withColumn("ticked", F.when(_tickable() & F.col("_l").isNotNull(), ~F.col("_full")).otherwise(ticked)).select(*files.columns, *(["ticked"] if "ticked" not in files.columns else []))


def same_selection(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two lists name the same ids."""
    left, right = (x.select(F.col(x.columns[0]).alias("id")).distinct().withColumn(side, F.lit(1)) for x, side in ((a, "a"), (b, "b")))
    return left.join(right, left["id"].eqNullSafe(right["id"]), "full").agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("same"))


def selected_manifest(manifest: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """The entries of a stored manifest that a selection names, by id or by path."""
    return paths.select_files(manifest, names, name_col)


# ---- names and roots ---------------------------------------------------------------------------


def keep_list(names: DataFrame, opts: Options = Options(), under_root: str | None = None) -> DataFrame:  # noqa: B008
    """The names that a scan's filters keep; sizes and bytes are not looked at."""
    return names.where(paths.keep_path("relative", opts.include, opts.exclude, opts.hidden, opts.default_excludes, under_root=under_root, unpacking=opts.follow_archives))


def may_enter(folder: str | Column, opts: Options = Options()) -> Column:  # noqa: B008
    """Whether the filters keep anything a folder could hold; the empty path is the root."""
    f = F.rtrim(paths._col(folder), F.lit("/"))
    probe = F.concat(f, F.lit("/\x01probe\x01"))
    return (f == "") | paths.keep_path(probe, (), opts.exclude, opts.hidden, opts.default_excludes)


def under_root(relative: str | Column, root: str | Column) -> Column:
    """A path without the folder that all paths of a grant share; '.' or null strips nothing."""
    p, r = paths._col(relative), F.concat(paths._col(root), F.lit("/"))
    return F.when(F.coalesce(p.startswith(r) & (paths._col(root) != "."), F.lit(False)), F.substr(p, F.length(r) + 1)).otherwise(p)


def manifest_bytes(manifest: DataFrame, *by: str) -> DataFrame:
    """n_files and total_bytes, of all entries or by group."""
    return manifest.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def in_id_order(manifest: DataFrame) -> DataFrame:
    """A manifest as it is listed: sorted by id over all partitions."""
    return manifest.orderBy("id")


# ---- reuse -------------------------------------------------------------------------------------


def reusable(files: DataFrame, cached: DataFrame, text_key: str, member_key: str) -> DataFrame:
    """Ids of the files whose cached outcome may be used again.

    ``cached`` (id, relative, size, modified, archive, text_key, member_key): the outcome was read
    under the same text settings; that of an archive under the same member settings too.
    """
    c = cached.where(F.col("text_key") == text_key).where(~F.col("archive") | (F.col("member_key") == member_key))
    return files.where("modified IS NOT NULL").join(c, ["id", "relative", "size", "modified"], "left_semi").select("id")


def cached_positions(cache: DataFrame) -> DataFrame:
    """id, place, position: where in the pack the rows of each cached entry stand."""
    return cache.select("id", F.posexplode("positions").alias("place", "position"))


# ---- batches -----------------------------------------------------------------------------------


def batches(files: DataFrame, max_files: int = BATCH_FILES, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """Adds batch: heavy files and archives alone, the rest in path order, at most ``max_files`` and
    ``max_bytes`` in one (a larger file is a batch of its own).

    The rule is greedy, so it is one pass over each range of the path order; a batch never spans
    two ranges, whose number is the first part of its name.
    """
    kind = F.coalesce(F.col("kind"), F.lit("unknown"))
    narrow = files.withColumns({"_alone": kind.isin(*tables.HEAVY_KINDS, *tables.ARCHIVE_KINDS), "_bytes": F.coalesce(F.col("size"), F.lit(0)).cast("bigint")})
    key = [paths.path_order("relative"), F.col("id")]
    placed = narrow.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_p", F.spark_partition_id())
    columns = list(files.columns)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, n, size = 0, 0, 0
        for b in rows:
            names = []
            for p, alone, own in zip(b.column("_p").to_pylist(), b.column("_alone").to_pylist(), b.column("_bytes").to_pylist()):
                if n and (alone or n >= max_files or size + own > max_bytes):
                    batch, n, size = batch + 1, 0, 0
                names.append(f"{p}.{batch}")
                n, size = n + 1, size + own
                if alone:
                    batch, n, size = batch + 1, 0, 0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(names, pa.string())], [*columns, "batch"])

    return placed.mapInArrow(run, StructType([*files.schema.fields, StructField("batch", StringType())]))


# ---- outcomes ----------------------------------------------------------------------------------


def outcomes(packed: DataFrame) -> DataFrame:
    """id, relative, status, kind, language, size, message of every packed file."""
    return packed.select(
        "id", "relative", "status", "kind", classify.language("relative", "kind").alias("language"), "size",
        text.status_message("status", "size", "status_limit", "status_detail").alias("message"),
    )


def nothing_extracted(packed: DataFrame, shown: int = 5) -> DataFrame:
    """One row: the error of a pack that read nothing, with its first outcomes in dump order; null otherwise."""
    rows = outcomes(packed)
    line = F.concat("relative", F.lit(" ["), "status", F.lit("]: "), F.coalesce("message", F.lit("")))
    sample = rows.orderBy("relative", "id").limit(shown).select(F.struct("relative", "id", line.alias("line")).alias("r"))
    joined = sample.agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), ", ").alias("sample"))
    read = rows.agg(F.count_if(F.col("status") == "extracted").alias("n"))
    note = F.concat(F.lit("Nothing extracted. Check size limits / binaries / archives. Sample: "), F.col("sample"))
    return read.join(joined).select(F.when(F.col("n") == 0, note).alias("error"))  # a row each


def preview(packed: DataFrame, owner: str, limit: int = 32_768) -> DataFrame:
    """One row about a file: text (of all members of an archive), whether it was cut, status, message.

    Text that was read comes back, otherwise none and the reason; a file that leaves nothing gives
    empty text."""
    mine = packed.where((F.col("id") == owner) | F.col("id").startswith(owner + "!"))
    rows = outcomes(mine).join(mine.select("id", "text"), "id").where(F.col("id").isNotNull())
    body = F.when(F.col("status") == "extracted", F.col("text"))
    shown = F.when(F.col("id") == owner, body).otherwise(F.concat(F.lit("== "), text.display_path("relative"), F.lit("\n"), F.coalesce(F.col("text"), F.lit("")), F.lit("\n")))
    ordered = F.array_sort(F.collect_list(F.struct("relative", "id", shown.alias("shown"))))
    one = rows.agg(
        F.array_join(F.transform(ordered, lambda r: F.coalesce(r["shown"], F.lit(""))), "").alias("full"),
        F.bool_or(F.col("status") == "extracted").alias("any"), F.max("status").alias("worst"), F.max("message").alias("why"), F.count(F.lit(1)).alias("n"),
    )
    cut = text.cap_utf8("full", limit)
    empty = F.col("n") == 0
    return one.select(
        F.when(empty, "").otherwise(cut).alias("text"), (F.octet_length("full") > limit).alias("cut"),
        F.when(empty | F.col("any"), "extracted").otherwise(F.col("worst")).alias("status"),
        F.when(empty, "Nothing in this file goes into the dump.").when(F.col("any"), "").otherwise(F.col("why")).alias("message"),
    )


WIRE = "id string, relative string, kind string, size bigint, text string, status string, detail string, limit bigint"


def to_wire(packed: DataFrame) -> DataFrame:
    """One JSON object a row, as it travels between instances; empty fields are left out."""
    return packed.select(F.to_json(F.struct("id", "relative", "kind", "size", "text", "status", F.nullif(F.col("status_detail"), F.lit("")).alias("detail"), F.col("status_limit").alias("limit"))).alias("wire"))


def from_wire(rows: DataFrame) -> DataFrame:
    """Packed rows of their JSON; what is no such object is dropped."""
    f = F.from_json("wire", WIRE).alias("f")
    return rows.select(f).where("f.id IS NOT NULL").select("f.id", "f.relative", "f.kind", "f.size", "f.text", "f.status", F.col("f.limit").alias("status_limit"), F.col("f.detail").alias("status_detail"), F.lit(False).alias("archive_cut"))
