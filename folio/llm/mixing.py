"""Mix sources to target shares of all tokens by systematic sampling.

The largest total T that every source can feed (share * T <= repeats * tokens) gives each source
its expected copies a record.  Records of a source stand in one line, ordered by size class,
sub-bucket and id; a prefix sum of the expected copies runs along it, one random offset is added,
and a record is emitted once for each whole number its interval crosses.  The prefix sum has two
levels: sums of small buckets, then positions inside a bucket, so that a source with a third of
all rows is spread over many tasks.

Defined results: a source without a target gets no copies and is reported with share 0; a target
whose source has no records cannot be met and is reported with nothing used, and the others keep
their proportions to each other, so their shares grow by what is missing; a record
without tokens gets none; the same text delivered under several ids is one record, its smallest
id; null or differently spelled sources are brought to one spelling ('unknown' for null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.tokens import VOCABULARY, spelled, token_count
from folio.plans.shared import materialized

SEED, BUCKET_ROWS = 20_240_601, 1 << 20  # records of a size class that one sub-bucket may hold, about


def counted(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens; exact repeats of a text are one record (the smallest id).

    The narrow rows are written once, so the texts are read and counted once.
    """
    rows = docs.where(F.length("text") > 0).select("doc_id", spelled("source").alias("source"), F.sha2("text", 256).alias("h"), token_count("text", path).alias("n_tokens"))
    return materialized(rows.groupBy("h").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("r")).select("r.doc_id", "r.source", "r.n_tokens").where("n_tokens > 0"))


def copies(records: DataFrame, targets: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, n_tokens, copies (0 or more) of every record whose source has a target.

    A size class is divided into as many sub-buckets as the number of all records asks for, so a
    bucket, the largest group that one task sorts, does not grow with the data.
    """
    sub_buckets = -(-records.count() // bucket_rows) or 1
    targets = targets.select(spelled("source").alias("source"), "target_share", "max_repeats").where("target_share > 0")
    bucket = F.struct(F.floor(F.log2("n_tokens") * 4).cast("int").alias("c"), F.pmod(F.xxhash64("doc_id"), F.lit(sub_buckets)).cast("int").alias("s"))
    placed = records.withColumn("b", bucket)
    per_bucket = placed.groupBy("source", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    have = per_bucket.groupBy("source").agg(F.sum("t").alias("have"))
    # a row a source: the tightest source fixes the total
    plan = have.join(targets, "source").withColumn("total", F.min(F.col("max_repeats") * F.col("have") / F.col("target_share")).over(Window.partitionBy(F.lit(0))))
    plan = plan.select("source", (F.col("target_share") * F.col("total") / F.col("have")).alias("each"), "max_repeats")
    line = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.withColumn("skip", F.coalesce(F.sum("n").over(line), F.lit(0))).join(plan, "source").select("source", "b", "skip", "each", "max_repeats")
    inside = F.row_number().over(Window.partitionBy("source", "b").orderBy("doc_id"))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    place = F.col("skip") + F.col("rn") - 1
    out = placed.withColumn("rn", inside).join(before, ["source", "b"])
    n = F.floor((place + 1) * F.col("each") + offset) - F.floor(place * F.col("each") + offset)
    return out.select("doc_id", "source", "n_tokens", F.least(n, F.col("max_repeats")).cast("bigint").alias("copies"))


def shares(mixed: DataFrame, records: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: what it has, what was used, its target and the share really reached."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
    have = records.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("have_tokens"))
    want = targets.select(spelled("source").alias("source"), "target_share", F.col("max_repeats").cast("bigint").alias("max_repeats"))
    all_ = have.join(used, "source", "full").join(want, "source", "full").fillna(0, ["n_records", "have_tokens", "used_tokens", "n_copies", "most_copies", "max_repeats"]).fillna(0.0, ["target_share"])
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    return all_.select("source", "n_records", "have_tokens", "n_copies", "most_copies", "max_repeats", "used_tokens", "target_share", F.round(F.coalesce(F.col("used_tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)), 6).alias("reached_share"))
