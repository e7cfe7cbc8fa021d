"""Results written once to the folder all executors share, and ordering without one hot task."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def materialized(df: DataFrame) -> DataFrame:
    """checkpoint() into the folder that spark.checkpoint.dir names.

    Only a local session may go without: there a folder of our own will do.  Spark removes a
    checkpoint with its last reference if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="folio-checkpoint-"))
    return df.checkpoint()


def _ranged(df: DataFrame, keys: Sequence[Column], extra: dict[str, Column]) -> DataFrame:
    """The rows and ``extra`` columns in order over range partitions, written once; _p numbers them."""
    keyed = df.select("*", *(c.alias(f"_o{i}") for i, c in enumerate(keys)), *(v.alias(k) for k, v in extra.items()))
    names = [F.col(f"_o{i}") for i in range(len(keys))]
    placed = keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*(f"_o{i}" for i in range(len(keys))))
    return materialized(placed.withColumn("_p", F.spark_partition_id()))


def _with_longs(df: DataFrame, names: Sequence[str]) -> StructType:
    return StructType([*df.schema.fields, *(StructField(n, LongType()) for n in names)])


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds inclusive running sums (name -> value) along a total order of the whole table; columns
    of the same names are replaced.  Give it narrow rows: they are sorted and written.

    Range partitioning spreads the order over tasks; what the partitions before a partition add up
    to, a row a partition, goes to the executors, and each partition is summed in its order where
    it lies, so nothing is shuffled again.
    """
    df = df.drop(*sums)
    values = {f"_v_{k}": F.coalesce(v.cast("bigint"), F.lit(0)) for k, v in sums.items()}
    parts = _ranged(df, order, values)
    totals = {r[0]: r[1:] for r in parts.groupBy("_p").agg(*(F.sum(v) for v in values)).collect()}
    skips: dict[int, list[int]] = {}
    at = [0] * len(sums)
    for p in sorted(totals):
        skips[p] = at
        at = [a + b for a, b in zip(at, totals[p])]
    columns, names, results = list(df.columns), list(values), list(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: list[int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            reached = list(skips[b.column("_p")[0].as_py()]) if reached is None else reached
            added = []
            for k, v in enumerate(names):
                added.append(pc.cumulative_sum(b.column(v), start=pa.scalar(reached[k], pa.int64())))
                reached[k] = added[-1][-1].as_py()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *added], [*columns, *results])

    return parts.mapInArrow(run, _with_longs(df, list(sums)))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """Numbers the rows from 1 along a total order."""
    return running(df, order, {name: F.lit(1)})


def ranked(df: DataFrame, by: str, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Numbers the rows of each ``by`` from 1; a group that spans partitions is counted on from one to
    the next, so it may hold any share of the rows.  Null is a group."""
    df = df.drop(name)
    key = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    parts = _ranged(df, [key, *order], {"_by": key})
    ends = parts.groupBy("_p").agg(F.min("_by").alias("lo"), F.max("_by").alias("hi"))
    counts = parts.select("_p", "_by").join(F.broadcast(ends), "_p").groupBy("_p").agg(F.max("lo"), F.max("hi"), F.count_if(F.col("_by") == F.col("hi")))
    carried: dict[int, int] = {}  # rows of a partition's first group in the partitions before it
    last, seen = None, 0
    for p, lo, hi, n_hi in sorted(map(tuple, counts.collect())):  # a row a partition
        carried[p] = seen if lo == last else 0
        seen = n_hi + (carried[p] if lo == hi else 0)
        last = hi
    columns = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ranks = []
            for key in b.column("_by").to_pylist():
                if key != group:
                    n = carried[b.column("_p")[0].as_py()] if group is None else 0
                    group = key
                n += 1
                ranks.append(n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(ranks, pa.int64())], [*columns, name])

    return parts.mapInArrow(run, _with_longs(df, [name]))
