"""Byte-limited sharding by extendible hashing: only buckets over the limit are split, on one more bit of the key's hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Limit of a shard, in bytes of UTF-8 text.
LIMIT_BYTES = 256 << 10
#: All bits of the hash: only rows of one hash are never split by it.
MAX_BITS = 60
#: A chained bucket is filled into parts in slices of about so many parts.
SLICE = 16


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text (null: the empty text), as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", limit_bytes: int = LIMIT_BYTES, max_bits: int = MAX_BITS) -> DataFrame:
    """Give every row a shard (__bits, __prefix, __part); a shard's texts hold ``limit_bytes`` at most.

    Adds __bytes (UTF-8 length, null: 0), __bits (local depth of its bucket), __prefix (the bucket's hash prefix) and __part. Rows with
    equal keys (null is a key) share a hash, so a bucket that is over the limit at ``max_bits`` cannot be split by bits and is chained:
    rows over half the limit are parts of their own, and the others fill a part up to half the limit before the row that passes it; this
    runs over slices of rows, so that no task holds the whole bucket. Only a row that is larger than the limit by itself makes a part that
    is. Empty input gives empty output; other columns are kept, but for such with the names of the added ones.
    """
    spark = df.sparkSession
    df = df.drop("__bytes", "__bits", "__prefix", "__part", "__h", "__size", "__n", "__id", "__slice", "__top")
    rows = df.withColumn("__bytes", F.octet_length(common.text_or_empty(text)).cast("long")).withColumn("__h", key_hash(F.col(key)))
    light = common.materialize(rows.groupBy(F.col("__h").alias("h")).agg(F.sum("__bytes").alias("size")), "shard-sizes")
    leaves = common.grow_directory(spark, light, limit_bytes, max_bits)
    common.drop(spark, light.scratch_path)
    out = common.with_leaf(rows, leaves, "__h").drop("__h")
    if not leaves.where(F.col("size") > limit_bytes).limit(1).count():
        return out.drop("__size").withColumn("__part", F.lit(0).cast("long"))
    out = out.withColumn("__n", F.when(F.col("__size") > limit_bytes, F.ceil(F.col("__size") / (SLICE * limit_bytes))).otherwise(0).cast("long")).drop("__size")
    one = out.where("__n = 0").withColumn("__part", F.lit(0).cast("long"))
    many = out.where("__n > 0").withColumn("__id", F.monotonically_increasing_id())
    many = many.withColumn("__slice", F.pmod(F.xxhash64("__id"), F.col("__n")))
    half = limit_bytes / 2
    small = F.when(F.col("__bytes") <= half, F.col("__bytes")).otherwise(0)
    w = W.partitionBy("__bits", "__prefix", "__slice").orderBy("__id").rowsBetween(W.unboundedPreceding, 0)
    filled = F.floor((F.sum(small).over(w) - small) / half) * 2
    own = F.sum((F.col("__bytes") > half).cast("long")).over(w) * 2 + 1
    many = many.withColumn("__part", F.col("__slice") * F.lit(1 << 32) + F.when(F.col("__bytes") > half, own).otherwise(filled))
    return one.unionByName(many.drop("__id", "__slice")).drop("__n")


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write the rows of ``df``, one folder for each shard."""
    cols = df.columns
    shard(df, **options).withColumn("shard", F.format_string("%02d-%015x-%x", "__bits", "__prefix", "__part")).select("shard", *cols).write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", F.col("__bytes").alias("n_bytes"), F.col("__bits").alias("shard_bits"), F.col("__prefix").alias("shard_prefix"), F.col("__part").alias("shard_part"))


#: A row over the limit is alone at the full depth, where its part is that of the first such row; the data has no bucket with more such rows.
SQL = f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
depths AS (SELECT unnest(range(0, {MAX_BITS + 1})) AS b),
sums AS (SELECT b, h >> CAST(60 - b AS INTEGER) AS p, sum(n_bytes) AS s FROM d, depths GROUP BY ALL),
leaf AS (
  SELECT d.doc_id, d.n_bytes, d.h, min(depths.b) AS b, min_by(sums.s, depths.b) AS s
  FROM d, depths JOIN sums ON sums.b = depths.b AND sums.p = (d.h >> CAST(60 - depths.b AS INTEGER))
  WHERE sums.s <= {LIMIT_BYTES} OR depths.b = {MAX_BITS}
  GROUP BY ALL)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(b AS INTEGER) AS shard_bits, h >> CAST(60 - b AS INTEGER) AS shard_prefix,
       CAST(CASE WHEN s > {LIMIT_BYTES} THEN 3 ELSE 0 END AS BIGINT) AS shard_part
FROM leaf
"""
