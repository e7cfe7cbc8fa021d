"""Directory maps and folder roll-ups from paths, by exploding ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import display_path

MAX_DEPTH, SALTS = 64, 16


def components(path: str | Column) -> Column:
    """Path components without empty, '.' and '..'; beyond MAX_DEPTH the rest stays one name."""
    p = F.filter(F.split(F.col(path) if isinstance(path, str) else path, "/"), lambda c: ~c.isin("", ".", ".."))
    deep = F.concat(F.slice(p, 1, MAX_DEPTH - 1), F.array(F.array_join(F.slice(p, MAX_DEPTH, F.greatest(F.size(p) - MAX_DEPTH + 1, F.lit(0))), "/")))
    return F.when(F.size(p) > MAX_DEPTH, deep).otherwise(p)


def tree_lines(files: DataFrame, path_col: str = "relative") -> DataFrame:
    """One row a line of the map: key (components in order), depth, line.

    A path that is also a folder is a folder.  The last sibling is found by a grouped maximum,
    not a window, so a folder with very many files is combined before the shuffle.  Only folders are
    above anything; each is repeated ``SALTS`` times, so that the many nodes below one folder
    meet it in as many tasks.
    """
    paths = files.select(components(path_col).alias("p"), F.col(path_col).endswith("/").alias("d")).where(F.size("p") > 0)
    nodes = (
        paths.select(F.col("p"), F.col("d"), F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
        .select(F.slice("p", F.lit(1), F.col("k")).alias("key"), ((F.col("k") < F.size("p")) | F.col("d")).alias("is_dir"))
        .groupBy("key")
        .agg(F.max("is_dir").alias("is_dir"))
        .withColumn("depth", F.size("key"))
        .withColumn("parent", F.slice("key", F.lit(1), F.col("depth") - 1))
    )
    last = nodes.groupBy("parent").agg(F.max(F.element_at("key", -1)).alias("last_name"))
    marked = nodes.join(last, "parent").select("key", "is_dir", "depth", (F.element_at("key", -1) == F.col("last_name")).alias("is_last"))
    # the bars before a name say which of its ancestors were last
    above = marked.where("depth > 1").select("key", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k")).select("key", "k", F.slice("key", F.lit(1), F.col("k")).alias("a"))
    folders = marked.where("is_dir").select(F.col("key").alias("a"), F.col("is_last").alias("a_last"), F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    bars = above.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).join(folders, ["a", "salt"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("a_last"), "    ").otherwise("│   ").alias("bar")))).alias("bars"))
    out = marked.join(bars, "key", "left")
    prefix = F.coalesce(F.array_join(F.transform("bars", lambda b: b["bar"]), ""), F.lit(""))
    line = F.concat(prefix, F.when(F.col("is_last"), "└── ").otherwise("├── "), display_path(F.element_at("key", -1)), F.when(F.col("is_dir"), "/").otherwise(""))
    return out.select("key", F.col("depth").cast("bigint").alias("depth"), line.alias("line"))


def tree_text(lines: DataFrame, label: str) -> str:
    """The whole map as text on the driver, streamed in order."""
    head = label if label.endswith("/") else label + "/"
    return head + "\n" + "".join(r[0] + "\n" for r in lines.orderBy("key").select("line").toLocalIterator())


def folder_rollup(files: DataFrame, path_col: str = "relative") -> DataFrame:
    """Counts of every folder: files below it, those that can be ticked and those that are."""
    p = F.split(F.col(path_col), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.array_join(F.slice(p, F.lit(1), k), "/"))
    rows = files.where(F.size(p) > 1).select(F.explode(folders).alias("folder"), F.coalesce("oversized", F.lit(False)).alias("o"), F.coalesce("default_on", F.lit(False)).alias("t"), F.coalesce("size", F.lit(0)).alias("size"))
    return rows.groupBy("folder").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(~F.col("o")).alias("n_tickable"),
        F.count_if(F.col("t") & ~F.col("o")).alias("n_ticked"),
        F.sum(F.when(F.col("t") & ~F.col("o"), F.col("size")).otherwise(0)).alias("ticked_bytes"),
    )


def language_chips(files: DataFrame) -> DataFrame:
    """Tickable and ticked files of each language."""
    o, t = F.coalesce("oversized", F.lit(False)), F.coalesce("default_on", F.lit(False))
    return files.groupBy(F.coalesce("language", F.lit("text")).alias("language")).agg(F.count_if(~o).alias("n_tickable"), F.count_if(t & ~o).alias("n_ticked"))
