"""Process only new or changed records: the target is the state.

A target table is a folder of immutable versions.  Every row carries its source key and the
source's version columns.  A run reduces the source to the newest row of each key, anti-joins it
with the newest published row of each key, hands what is left to the caller's transformation,
writes the result as the next version's folder and publishes it by one marker file that appears
whole or not at all: it is written under another name and linked or renamed to its own, which
fails if that version exists.  A run that dies before leaves only an unpublished folder that
nothing reads; of two runs that race for a version one fails.  No record is skipped or repeated.
(An object store whose rename is a copy needs a committer that makes it conditional.)

Defined results: null version values never equal, so such records are always processed; of several
rows of a key the newest counts (``order``, then the version columns; null is oldest), once; an
empty source publishes an empty version; a null key is a key of its own.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The row of each key with the largest ``order``; ties go to the largest kept values.

    A grouped maximum of a struct: it is combined before the shuffle and a hot key never
    gathers in one task.
    """
    best = F.max(F.struct(*order, *(c for c in keep if c not in order))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in keep))


def changed_rows(now: DataFrame, known: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Rows of ``now`` whose key and version are not among the ``known``; a null equals nothing."""
    return now.join(known.select(*keys, *version), [*keys, *version], "left_anti")


def pending_files(walked: DataFrame, cache: DataFrame, runs: DataFrame) -> DataFrame:
    """Files of the pending run's scan that are new or changed against successful runs.

    The newest row of a file (``seen_at``) is anti-joined with the file's newest cache entry
    (``run_id``) of the runs that succeeded with the pending run's fingerprint, on path, size
    and modification time; an unknown time equals nothing.
    """
    pending = runs.where("run_status = 'pending'").select("scan_no", "fingerprint").distinct()
    done = runs.where("run_status = 'succeeded'").join(pending.select("fingerprint"), "fingerprint", "left_semi").select("run_id").distinct()
    now = latest(walked.join(pending.select("scan_no"), "scan_no", "left_semi"), ["id"], ["seen_at"], ["absolute", "size", "modified"])
    known = latest(cache.join(done, "run_id", "left_semi"), ["id"], ["run_id", "written_at"], ["path", "size", "modified"])
    return changed_rows(now, known.withColumnRenamed("path", "absolute"), ["id"], ["absolute", "size", "modified"])


class VersionedTable:
    """A folder of published versions; readers see only what a marker names.

    ``key`` and ``version`` are columns of the source and of every row written; ``order`` are columns
    of the source that say which of a key's rows is the newest.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, version: Sequence[str], order: Sequence[str] = ()) -> None:
        self.spark, self.path, self.key, self.version, self.order = spark, path.rstrip("/"), key, list(version), list(order)
        self._jvm = spark.sparkContext._jvm

    def _fs(self, path: str):  # noqa: ANN202
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _markers(self) -> list[str]:
        fs, p = self._fs(f"{self.path}/_published")
        return sorted(n for s in (fs.listStatus(p) if fs.exists(p) else ()) if (n := s.getPath().getName()).startswith("v"))

    def published(self) -> list[tuple[int, str]]:
        """(version, data folder) in order, from the last compacted one on."""
        out: list[tuple[int, str]] = []
        for n in self._markers():
            fs, marker = self._fs(f"{self.path}/_published/{n}")
            stream = fs.open(marker)
            try:
                folder, _, whole = bytes(stream.readNBytes(4096)).decode().partition("\n")
            finally:
                stream.close()
            out = [*([] if whole else out), (int(n[1:]), folder)]
        return out

    def rows(self) -> DataFrame | None:
        """All published rows."""
        parts = self.published()
        return self.spark.read.parquet(*(f"{self.path}/{d}" for _, d in parts)) if parts else None

    def state(self) -> DataFrame | None:
        """The newest published row of every key."""
        rows = self.rows()
        return None if rows is None else latest(rows, [self.key], ["_version"], [c for c in rows.columns if c not in (self.key, "_version")])

    def changed(self, source: DataFrame) -> DataFrame:
        """The newest source row of each key whose version is not the target's, once.

        Which rows these are is found on key and version alone, so what has not changed is
        never shuffled with its other columns.
        """
        narrow = latest(source, [self.key], self.order or self.version, [*self.version, *(c for c in self.order if c not in self.version)])
        rows = self.rows()
        if rows is not None:
            narrow = changed_rows(narrow, latest(rows, [self.key], ["_version"], self.version), [self.key], self.version)
        named = [self.key, *dict.fromkeys((*self.order, *self.version))]
        todo = narrow.select(*(F.col(c).alias(f"_n_{c}") for c in named))
        same = F.lit(True)
        for c in named:
            same = same & source[c].eqNullSafe(todo[f"_n_{c}"])
        return source.join(todo, same, "left_semi").dropDuplicates([self.key])

    def run(self, source: DataFrame, process: Callable[[DataFrame], DataFrame]) -> int:
        """Process what changed and publish it; returns the published version."""
        number = self._next()
        return self._write(process(self.changed(source)).withColumn("_version", F.lit(number).cast("bigint")), number)

    def compact(self, by: Sequence[str] = ()) -> int | None:
        """Publishes a version that holds every key's newest rows and replaces all before it.

        ``by``: columns that tell a key's rows apart where a source row becomes several.
        """
        rows = self.rows()
        if rows is None:
            return None
        newest = rows.groupBy(self.key).agg(F.max("_version").alias("_newest")).select(F.col(self.key).alias("_k"), "_newest")
        kept = rows.join(newest, rows[self.key].eqNullSafe(newest["_k"]) & (rows["_version"] == newest["_newest"]), "left_semi")
        return self._write(kept.dropDuplicates([self.key, *by]), self._next(), whole=True)

    def _next(self) -> int:
        return max((int(n[1:]) for n in self._markers()), default=0) + 1

    def _write(self, rows: DataFrame, number: int, whole: bool = False) -> int:
        folder = f"data/{number:08d}-{uuid.uuid4().hex}"
        rows.write.mode("error").parquet(f"{self.path}/{folder}")
        self._publish(number, folder + ("\nwhole" if whole else ""))
        return number

    def _publish(self, number: int, text: str) -> None:
        """Makes the marker appear with its text, or fails if the version has one."""
        name, hidden = f"{self.path}/_published/v{number:08d}", f"{self.path}/_published/.{uuid.uuid4().hex}"
        fs, temp = self._fs(hidden)
        if fs.getUri().getScheme() == "file":  # a link is exclusive and whole; a local rename overwrites
            local, target = (self._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath() for p in (hidden, name))
            os.makedirs(os.path.dirname(local), exist_ok=True)
            with open(local, "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(local, target)
            finally:
                os.unlink(local)
            return
        stream = fs.create(temp, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._rename(fs, hidden, name)

    def _rename(self, fs, old: str, new: str) -> None:  # noqa: ANN001
        """Fails if the new name is taken; atomic where the file system's rename is."""
        hadoop = self._jvm.org.apache.hadoop.fs
        keep = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        keep[0] = getattr(hadoop, "Options$Rename").NONE
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(hadoop.Path(old), hadoop.Path(new), keep)
