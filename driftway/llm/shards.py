"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly over shards, and within a shard over buckets that fit in memory, by seeded hashes of
the id. Pass two reads one bucket at a time, puts it into a Fisher-Yates order drawn from the bucket's own seed, and
writes it. A shard is its buckets one after the other. Shards are dealt by the law ``key``: each record goes to the shard
with the largest hash of (id, shard), so one more shard takes records only into itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftway.llm.common import shipped, work_folder
from driftway.session import broadcast_if_small

SHARDS = 24
SEED = 7
#: UTF-8 bytes that a bucket should hold, and what a record counts beside its text.
BUCKET_BYTES = 16 << 20
OVERHEAD = 8
#: Rows with one id and text above which each has a hash of its own.
HOT_COPIES = 1_000


def shard_of(key: F.Column, shards: int, seed: int = SEED) -> F.Column:
    """The shard with the largest hash of (key, shard, seed); the first one, on ties."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    drawn = [F.struct(F.xxhash64(key, F.lit(k), F.lit(seed)).alias("h"), F.lit(-k).alias("k")) for k in range(shards)]
    return (-F.greatest(*drawn)["k"]).cast("int") if shards > 1 else F.lit(0)


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, text and size; UTF-8 bytes of the text and the overhead."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
    )


def scatter(
    docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, hot_copies: int = HOT_COPIES
) -> DataFrame:
    """Pass one: doc_id, text, size, shard, bucket. The number of buckets follows the total size of all records.

    Records go to the bucket of the seeded hash of their id and text. Of a record that is there more than ``HOT_COPIES``
    times each copy has a hash of its own, by where it is read, so that copies fill buckets like any other records; copies
    are equal, so only the number of them in each bucket depends on the input's partitions.
    """
    sized = _sized(docs)
    total = sized.agg(F.sum("size").alias("total")).first()["total"] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    text_hash = F.xxhash64("text")
    many = sized.groupBy("doc_id", text_hash.alias("_text")).count().filter(F.col("count") > hot_copies)
    many = broadcast_if_small(many.select(F.col("doc_id").alias("_id"), "_text", F.lit(True).alias("_many")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_hash == F.col("_text"))
    copy = F.when(F.col("_many"), F.col("_copy")).otherwise(F.lit(-1).cast("long"))
    # the text takes part too, so that rows which repeat one id still spread over the buckets of its shard
    bucket = F.pmod(F.xxhash64("doc_id", "text", copy, F.lit(seed + 1)), F.lit(buckets)).cast("int")
    placed = sized.withColumn("_copy", F.monotonically_increasing_id()).join(many, same, "left")
    return placed.select("doc_id", "text", "size", shard_of(F.col("doc_id"), shards, seed).alias("shard"), bucket.alias("bucket"))


def fisher_yates(n: int, seed: int, shard: int, bucket: int) -> np.ndarray:
    """A uniform order of 0..n-1: each place, from the last on, swaps with a place drawn at or before it."""
    rng = np.random.Generator(np.random.PCG64([seed, shard, bucket]))
    order = np.arange(n)
    drawn = rng.integers(0, np.arange(1, n + 1)) if n else order
    for k in range(n - 1, 0, -1):
        j = drawn[k]
        order[k], order[j] = order[j], order[k]
    return order


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> None:
    """Both passes: Parquet rows (doc_id, text, size, shard, bucket, position) in shuffled order below ``folder``.

    Before a bucket is shuffled its rows are ordered by id and text, so the outcome does not depend on how they arrived.
    Null texts count as no bytes and stay null; null ids are hashed as empty; repeated rows stay.
    """
    dealt = scatter(docs, shards, bucket_bytes, seed)
    fields = dealt.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def shuffled(keys, rows):
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("text", "ascending")]))
        rows = rows.take(pa.array(fisher_yates(rows.num_rows, seed, keys[0].as_py(), keys[1].as_py())))
        return rows.append_column("position", pa.array(range(rows.num_rows), pa.int64()))

    shipped(docs.sparkSession)
    out = dealt.groupBy("shard", "bucket").applyInArrow(shuffled, f"{fields}, position bigint")
    out.write.parquet(folder)


def placed(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, folder: str | None = None) -> DataFrame:
    """Writes the shards and returns their rows as read back: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` counts the records of a shard from 0, bucket after bucket.
    """
    spark = docs.sparkSession
    folder = folder or work_folder(spark, "shards")
    write_shards(docs, folder, shards, bucket_bytes, seed)
    rows = spark.read.parquet(folder)
    counts = rows.groupBy("shard", "bucket").count()  # one row per bucket
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return rows.join(base, ["shard", "bucket"]).select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"), F.lit("key").alias("law"),
        "shard", (F.col("base") + F.col("position")).cast("long").alias("slot"),
        shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
    )
