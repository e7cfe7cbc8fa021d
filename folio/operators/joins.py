"""Joins of the packing pipeline: cache reuse, owners of batch entries, shared first folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reuse_cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds reused: the cache holds the file under the same id, path, size and time.

    An unknown time never matches.  The cache side is made distinct, so no row is repeated.
    """
    known = cache.select("id", "absolute", "size", "modified").where("modified IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    return files.join(known, ["id", "absolute", "size", "modified"], "left").withColumn("reused", F.coalesce("_hit", F.lit(False))).drop("_hit").select(*files.columns, "reused")


def is_settled(modified: str, began: Column, seconds: int = 2) -> Column:
    """Old enough at the start of the pack to be cached; unknown times are not."""
    return F.coalesce(F.col(modified) + F.expr(f"INTERVAL {seconds} SECONDS") <= began, F.lit(False))


def owners(entries: DataFrame, inputs: DataFrame) -> DataFrame:
    """The input that each batch entry belongs to: the longest id that is the entry's id or is
    followed by '!' in it; null if none.

    The candidates of an entry are its own id and its prefixes before '!', so this is an equi
    join on exploded prefixes, not a theta join.
    """
    cut = F.split("id", "!")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(cut)), lambda k: F.array_join(F.slice(cut, F.lit(1), k), "!"))
    tried = entries.select("id", F.explode(prefixes).alias("owner"))
    hit = tried.join(inputs.select(F.col("id").alias("owner")).distinct(), "owner").groupBy("id").agg(F.max_by("owner", F.length("owner")).alias("owner"))
    return entries.select("id").distinct().join(hit, "id", "left")


def shared_root(paths: DataFrame, col: str = "relative", by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each group: the first component if all paths share it and none is a file there, else null."""
    p = F.split(F.col(col), "/")
    return paths.groupBy(*by).agg(F.when((F.min(p[0]) == F.max(p[0])) & (F.min(F.size(p)) > 1), F.min(p[0])).alias("root"))
