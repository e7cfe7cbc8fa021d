"""Packs that are kept: stored results and their redraws, packs in steps, progress and cancelling."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Generic, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.incremental import VersionedTable
from folio.operators import render, stats, tree
from folio.operators.pack import pack_df
from folio.options import Options

T = TypeVar("T")
MAX_ITEMS, MAX_BYTES = 8, 64 << 20


class Lru(Generic[T]):
    """The most recent values, within a number and a size; the newest always stays."""

    def __init__(self, max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES) -> None:
        self.max_items, self.max_bytes, self.held = max_items, max_bytes, 0
        self.items: OrderedDict[str, tuple[T, int]] = OrderedDict()

    def push(self, key: str, value: T, size: int) -> list[str]:
        """Stores a value as the newest; returns the keys that had to go."""
        if key in self.items:
            self.held -= self.items.pop(key)[1]
        self.items[key] = (value, size)
        self.held += size
        gone = []
        while len(self.items) > 1 and (len(self.items) > self.max_items or self.held > self.max_bytes):
            old, (_, freed) = self.items.popitem(last=False)
            self.held -= freed
            gone.append(old)
        return gone

    def get(self, key: str) -> T | None:
        if key not in self.items:
            return None
        self.items.move_to_end(key)
        return self.items[key][0]


class Results:
    """Packs stored as tables below a folder, by id; drawing one again reads its texts, not the files."""

    def __init__(self, spark: SparkSession, folder: str, max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.kept: Lru[str] = Lru(max_items, max_bytes)

    def store(self, packed: DataFrame) -> str:
        """Writes a pack and returns its id; the oldest ones go when number or size are over the caps."""
        key = uuid.uuid4().hex
        packed.write.parquet(f"{self.folder}/{key}")
        size = self.spark.read.parquet(f"{self.folder}/{key}").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
        for old in self.kept.push(key, f"{self.folder}/{key}", size):
            self._remove(f"{self.folder}/{old}")
        return key

    def packed(self, key: str) -> DataFrame | None:
        path = self.kept.get(key)
        return None if path is None else self.spark.read.parquet(path)

    def redraw(self, key: str, fmt: str = "plain", label: str | None = None) -> Iterator[str]:
        """A stored pack as a dump in any format, with its map if there is a label."""
        packed = self.packed(key)
        if packed is None:
            raise KeyError(key)
        head = tree.tree_text(tree.tree_lines(packed.where("status = 'extracted'")), label) if label else ""
        return render.chunks(packed, fmt, head)

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class SteppedPack:
    """A pack whose files come in steps: begin, add as often as needed, then finish or abort.

    Each step is published as a version of a table, so a step is in it whole or not at all and a
    step sent again adds nothing; only ``finish`` hands the rows out.
    """

    def __init__(self, spark: SparkSession, folder: str, opts: Options) -> None:
        self.spark, self.opts, self.done, self.total = spark, opts, 0, 0
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
        self._table = VersionedTable(spark, self.path, "owner", ["digest"])
        self.open = True

    def add(self, files: DataFrame) -> int:
        """Packs files (id, relative, bytes); returns the files that have been handed in so far."""
        if not self.open:
            raise RuntimeError("the pack is over")
        keyed = files.select(F.col("id").alias("owner"), "relative", "bytes", F.sha2("bytes", 256).alias("digest"))

        def process(changed: DataFrame) -> DataFrame:
            packed = pack_df(changed.select(F.col("owner").alias("id"), "relative", "bytes"), self.opts, owner=True).drop("lasting")
            return packed.join(changed.select("owner", "digest"), "owner")

        self._table.run(keyed, process)
        self.done += files.count()
        return self.done

    def rows(self) -> DataFrame | None:
        rows = self._table.rows()
        if rows is None:
            return None
        newest = rows.groupBy("owner").agg(F.max("_version").alias("_version"))
        return rows.join(newest, ["owner", "_version"], "left_semi").drop("owner", "digest", "_version")

    def finish(self) -> tuple[DataFrame, DataFrame]:
        """The packed rows and their totals."""
        self.open = False
        rows = self.rows()
        if rows is None:
            rows = pack_df(self.spark.createDataFrame([], "id string, relative string, bytes binary"), self.opts)
        return rows, stats.pack_stats(rows)

    def abort(self) -> None:
        self.open = False
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs of the block can be watched and cancelled by the tag."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stops the running jobs of a tag; what they have not written is not there."""
    spark.interruptTag(tag)


def progress(spark: SparkSession) -> tuple[int, int]:
    """(tasks done, tasks) of the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    infos = [i for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s))]
    return sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos)

