"""Prefix budgets: files in path order are kept until the first that does not fit, then none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.paths import path_order
from folio.plans.shared import ranked, running


def apply_budgets(files: DataFrame, max_total_bytes: int = 1 << 30, max_entries: int = 0, max_file_size: int = 8 << 20) -> DataFrame:
    """Adds cum_bytes, ordinal and kept.  A file over the per-file cap costs no bytes but one
    entry; null sizes cost nothing; ties in path order go by id."""
    cost = F.when(F.coalesce(F.col("size"), F.lit(0)) > max_file_size, F.lit(0)).otherwise(F.coalesce(F.col("size"), F.lit(0)))
    out = running(files, [path_order("relative"), F.col("id")], {"cum_bytes": cost, "ordinal": F.lit(1)})
    kept = F.col("cum_bytes") <= max_total_bytes
    if max_entries:
        kept = kept & (F.col("ordinal") <= max_entries)
    return out.withColumn("kept", kept)


def unique_ids(files: DataFrame, order: str) -> DataFrame:
    """Adds unique_id: the first of equal ids keeps it, the others get '#2', '#3' and so on; null stays null."""
    n = F.col("_rank")
    return ranked(files, "id", [F.col(order)], "_rank").withColumn("unique_id", F.when(n == 1, F.col("id")).otherwise(F.concat("id", F.lit("#"), n.cast("string")))).drop("_rank")
