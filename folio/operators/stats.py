"""Totals of a pack and the lines that report them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import human_bytes, token_estimate_sum



def pack_stats(packed: DataFrame, *by: str) -> DataFrame:
    """Files read and skipped, bytes, characters and estimated tokens; one pass, combined early."""
    text = F.when(F.col("status") == "extracted", F.col("text"))
    return packed.groupBy(*by).agg(
        F.count_if(F.col("status") == "extracted").alias("files_extracted"),
        F.count_if(F.coalesce(F.col("status"), F.lit("")) != "extracted").alias("files_skipped"),
        F.count_if(F.col("status") == "unreadable").alias("files_unreadable"),
        F.coalesce(F.sum(F.when(F.col("status") == "extracted", F.col("size"))), F.lit(0)).alias("bytes_read"),
        F.coalesce(F.sum(F.length(text).cast("bigint")), F.lit(0)).alias("chars_emitted"),
        token_estimate_sum(text).alias("tokens_est"),
    )


def finished(packed: DataFrame, cut: int = 0, cancelled: bool = False) -> DataFrame:
    """The totals of a whole pack with truncated (budgets, archives or a cancel cut something off) and cancelled."""
    totals = pack_stats(packed)
    truncated = packed.agg(F.coalesce(F.bool_or("archive_cut"), F.lit(False)).alias("archive_cut"))
    return totals.join(truncated).select(*totals.columns, (F.col("archive_cut") | F.lit(cut > 0 or cancelled)).alias("truncated"), F.lit(cancelled).alias("cancelled"))  # a row each


def with_summary(stats: DataFrame) -> DataFrame:
    """Adds the summary line of each row of totals."""
    skipped = F.col("files_skipped") - F.col("files_unreadable")
    return stats.withColumn(
        "summary",
        F.concat(
            F.format_string("packed %d files (", "files_extracted"), human_bytes("bytes_read"), F.format_string(" read, %d chars, ~%d tokens)", "chars_emitted", "tokens_est"),
            F.when(F.col("files_unreadable") > 0, F.format_string(", %d unreadable", "files_unreadable")).otherwise(""),
            F.when(skipped > 0, F.format_string(", %d skipped", skipped)).otherwise(""),
            *(F.when(F.col(c), F.lit(f", {c}")).otherwise("") for c in ("truncated", "cancelled") if c in stats.columns),
        ),
    )


def warning_lines(total: int, kept: list[str], shown: int = 10) -> list[str]:
    """The first warnings of a walk and a count of the rest."""
    lines = [f"warning: {x}" for x in kept[:shown]]
    return lines + ([f"warning: {total - len(lines)} more paths could not be walked"] if total > len(lines) else [])
