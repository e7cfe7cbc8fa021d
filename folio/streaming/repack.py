"""Incremental packing: outcomes are reused while a file's id, path, size and time are unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folio.incremental import VersionedTable, latest
from folio.operators.joins import is_settled
from folio.operators.pack import COLUMNS, admitted, pack_df, read_rows
from folio.options import Options


def lasting(packed: DataFrame) -> DataFrame:
    """Outcomes that may be cached: errors and changed files are read again next time."""
    return packed.where(F.coalesce("status", F.lit("error")).isin("extracted", "skipped_binary", "too_large", "skipped_archive", "unreadable"))


def repack(spark: SparkSession, files: DataFrame, cache_path: str, opts: Options) -> DataFrame:
    """Packs files (id, relative, bytes, size, modified), reusing what the cache holds; the result is
    that of a fresh pack.

    Filters, selection and budgets are applied to the whole input first, the cache is asked
    after.  The cache holds one row for each file or archive member, keyed by the file it came from,
    so no archive is gathered in one row.  Files modified less than two seconds before the start
    are packed and not cached; rows that repeat an id are packed each for itself and not cached.
    """
    table = VersionedTable(spark, f"{cache_path.rstrip('/')}/{opts.fingerprint()[:16]}", "owner", ["path", "size_then", "modified_then"])
    began = F.lit(spark.sql("SELECT current_timestamp()").head()[0])
    kept = admitted(files.select("id", "relative", "bytes", F.col("size").alias("size_then"), F.col("modified").alias("modified_then")), opts)
    repeated = kept.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    single = kept.join(repeated, "id", "left_anti").withColumnsRenamed({"id": "owner", "relative": "path"})

    def process(changed: DataFrame) -> DataFrame:
        settled = changed.where(is_settled("modified_then", began))
        packed = read_rows(settled.select(F.col("owner").alias("id"), F.col("path").alias("relative"), "bytes"), opts, owner=True)
        return packed.where("lasting").drop("lasting").join(settled.select("owner", "path", "size_then", "modified_then"), "owner")

    table.run(single, process)
    known = table.rows()
    assert known is not None
    newest = latest(known, ["owner"], ["_version"], ["path", "size_then", "modified_then"])
    versions = known.groupBy("owner").agg(F.max("_version").alias("_version"))
    hit = single.select("owner", "path", "size_then", "modified_then").join(newest, ["owner", "path", "size_then", "modified_then"], "left_semi").select("owner")
    reused = known.join(versions, ["owner", "_version"], "left_semi").join(hit, "owner", "left_semi").select(*COLUMNS)
    missing = kept.join(hit.withColumnRenamed("owner", "id"), "id", "left_anti")
    return reused.unionByName(read_rows(missing.select("id", "relative", "bytes"), opts))


def watch(spark: SparkSession, folder: str, schema: StructType, target: str, checkpoint: str, opts: Options) -> StreamingQuery:
    """Packs rows (id, relative, bytes) as files of them arrive; each batch is published once.

    Every row of the target carries its owner's id, path and a digest of the owner's bytes, so a
    file or archive delivered again is packed again only if its path or bytes differ.  Of several
    deliveries in one batch the one that arrived last counts (then the largest ``modified``, if
    there is that column, then the largest digest).  A file that leaves no row, and one whose
    outcome may not be cached, has a null digest and is packed whenever it is delivered;
    ``watched`` reads what the target holds now.
    """
    table = VersionedTable(spark, target, "owner", ["path", "digest"])
    stream = spark.readStream.schema(schema).parquet(folder).select("*", F.col("_metadata.file_modification_time").alias("_arrived"))
    order = ["_arrived", *(c for c in ("modified",) if c in schema.fieldNames()), "digest"]

    def process(changed: DataFrame) -> DataFrame:
        packed = pack_df(changed.select(F.col("owner").alias("id"), F.col("path").alias("relative"), "bytes"), opts, owner=True)
        rows = changed.select("owner", "path", "digest").join(packed.withColumnRenamed("owner", "_owner"), F.col("owner") == F.col("_owner"), "left").drop("_owner")
        known = F.when(F.col("lasting"), F.col("digest"))
        return rows.withColumns({"digest": known, "id": F.coalesce("id", "owner"), "relative": F.coalesce("relative", "path")}).drop("lasting")

    def publish(batch: DataFrame, _number: int) -> None:
        keyed = batch.withColumnsRenamed({"id": "owner", "relative": "path"}).withColumn("digest", F.sha2("bytes", 256))
        table.run(latest(keyed, ["owner"], order, ["path", "bytes", "digest"]), process)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watched(spark: SparkSession, target: str) -> DataFrame | None:
    """The rows of each file's newest delivery; members that an archive no longer holds are gone."""
    parts = VersionedTable(spark, target, "owner", []).published()
    if not parts:
        return None
    rows = spark.read.parquet(*(f"{target.rstrip('/')}/{d}" for _, d in parts))
    newest = rows.groupBy("owner").agg(F.max("_version").alias("_version"))
    return rows.join(newest, ["owner", "_version"], "left_semi").where("status IS NOT NULL").select(*COLUMNS)
