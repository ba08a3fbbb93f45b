"""Shared pieces of the training-data operators: the shared scratch folder, materialised tables, directories."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship

#: Rows of a lookup table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
#: A key with more rows than this is dealt over several tasks where rows are joined by it.
HOT_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a fresh folder.

    A cluster must name the folder: executors could not see one that the driver makes up.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="quaystone-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``cleanup`` deletes it."""
    path = f"{shared_dir(spark)}/quaystone/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


_MADE: list[str] = []


def cleanup(spark: SparkSession) -> None:
    """Delete all scratch tables of this driver. Operators write some while a query is built, and their results read them: call it last."""
    drop(spark, *_MADE)
    _MADE.clear()


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch paths that no later step reads."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if p in _MADE:
            _MADE.remove(p)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Lower the session's limit of bytes in an Arrow batch to ``size``, so that long texts do not add up in workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b")) if spark.conf.get(key).rstrip("b").lstrip("-").isdigit() else 0
    if now <= 0 or now > size:
        spark.conf.set(key, str(size))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from arrays or lists, by name."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lookup_join(df: DataFrame, small: DataFrame, on: str, rows: int) -> DataFrame:
    """Inner join with a lookup table: broadcast below BROADCAST_ROWS, else a shuffle join that AQE can split."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on)


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each key and, in column ``n``, how many of the ``total`` rows have it.

    The rows of a frequent key are dealt over several tasks, and its row of the table is sent to each of them. Frequent means over
    HOT_ROWS rows, or more in a table so large that over BROADCAST_ROWS keys could be that frequent: the keys broadcast are never more.
    """
    most = F.lit(max(HOT_ROWS, total // BROADCAST_ROWS))
    ways = F.ceil(F.col(n) / most).cast("int")
    hot = table.where(F.col(n) > most).select(key, ways.alias("__ways"))
    dealt = rows.join(F.broadcast(hot), key, "left")
    dealt = dealt.withColumn("__way", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce("__ways", F.lit(1))).cast("int")).drop("__ways")
    sent = table.withColumn("__way", F.explode(F.sequence(F.lit(0), F.greatest(ways, F.lit(1)) - 1))).drop(n)
    return dealt.join(sent, [key, "__way"]).drop("__way")


def with_row(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add __r, a number of its own for each row.

    Where the keys are unique and none is null they are the numbers; else the rows are numbered and written before the numbers are used,
    since a task that runs again may number otherwise.
    """
    docs = docs.drop("__r")
    if docs.groupBy(F.col(key).cast("long").alias("k")).agg(F.count("*").alias("n")).where("n > 1 or k is null").limit(1).count():
        return materialize(docs.withColumn("__r", F.monotonically_increasing_id()), "numbered")
    return docs.withColumn("__r", F.col(key).cast("long"))


def sample_by_hash(df: DataFrame, n: int, by: list[str], total: int) -> DataFrame:
    """The ``n`` rows of ``df``, of ``total`` rows, with the smallest hashes of the columns ``by``, ties by the columns themselves.

    Only rows under a hash that leaves about twice as many are ordered, so that tasks hand on few rows, however many there are.
    """
    h = F.xxhash64(*by)
    drawn = df if total <= 4 * n else df.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 2 * n / total))
    return drawn.orderBy(F.pmod(h, F.lit(1 << 40)), *by).limit(n)


def hash_prefix(h: Column, bits: int) -> Column:
    """The first ``bits`` bits of a 60-bit hash, as a number."""
    return F.shiftrightunsigned(h, 60 - bits)


def grow_directory(spark: SparkSession, sizes: DataFrame, limit: int, max_bits: int = 60, step: int = 8) -> DataFrame:
    """Extendible-hash directory over ``sizes(h: 60-bit long, size: long)``, as a written table of leaves (bits, prefix, size).

    A bucket is split on one more bit of the hash while its total size is over ``limit``, until ``max_bits``; so a leaf is a prefix whose
    total is within the limit while that of one bit less is not. Empty leaves are left out; an empty table has none. No leaf comes to
    the driver: totals are kept by prefix, first to a depth that the whole size asks for, and farther only below prefixes that are still
    over the limit.
    """
    whole = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    above, depth = -1, min(max_bits, max(0, int(whole) // max(1, limit)).bit_length() + 3)
    rows, leaves, part, made = sizes, None, None, []
    while True:
        totals = rows.groupBy(hash_prefix(F.col("h"), depth).alias("p")).agg(F.sum("size").alias("size"))
        up = totals.select("p", "size", F.explode(F.sequence(F.lit(max(above, 0)), F.lit(depth))).alias("bits"))
        nodes = up.groupBy("bits", F.expr(f"shiftrightunsigned(p, {depth} - bits)").alias("prefix")).agg(F.sum("size").alias("size"))
        nodes = materialize(nodes, "directory-nodes")
        made.append(nodes.scratch_path)
        over = nodes.where(F.col("size") > limit)
        fits = nodes.where((F.col("size") <= limit) | (F.col("bits") == max_bits)).where(F.col("bits") > above)
        split = over.select((F.col("bits") + 1).alias("bits"), F.col("prefix").alias("parent"))
        part = fits.withColumn("parent", F.shiftrightunsigned("prefix", 1)).join(split, ["bits", "parent"], "left_semi").select("bits", "prefix", "size")
        if above < 0:
            part = part.union(fits.where("bits = 0").select("bits", "prefix", "size"))
        leaves = part if leaves is None else leaves.union(part)
        left = over.where(F.col("bits") == depth).select(F.col("prefix").alias("p"))
        n = left.count() if depth < max_bits else 0
        if not n:
            break
        rows = lookup_join(sizes.withColumn("p", hash_prefix(F.col("h"), depth)), left, "p", n).drop("p")
        above, depth = depth, min(max_bits, depth + step)
    out = materialize(leaves, "directory")
    drop(spark, *made)
    return out


def with_leaf(df: DataFrame, leaves: DataFrame, h: str) -> DataFrame:
    """Add __bits, __prefix and __size of the leaf that the hash column ``h`` falls in.

    Leaves of one prefix of the least depth travel together, in order of their lower bounds; rows join them by that prefix, and the leaf is
    the last one whose bound is not above the hash. The table is broadcast only where its size allows it.
    """
    base, n = leaves.agg(F.min("bits"), F.count("*")).first()
    base = base or 0
    low = F.expr("shiftleft(prefix, 60 - bits)")
    tops = leaves.select(F.expr(f"shiftrightunsigned(prefix, bits - {base})").alias("__top"), F.struct(low.alias("low"), "bits", "prefix", "size").alias("leaf"))
    tops = tops.groupBy("__top").agg(F.sort_array(F.collect_list("leaf")).alias("__leaves"))
    joined = lookup_join(df.withColumn("__top", hash_prefix(F.col(h), base)), tops, "__top", n)
    one = F.when(F.size("__leaves") == 1, F.element_at("__leaves", 1)).otherwise(F.element_at(F.filter("__leaves", lambda x: x["low"] <= F.col(h)), -1))
    named = joined.withColumn("__leaf", one)
    return named.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__leaf.bits").alias("__bits"), F.col("__leaf.prefix").alias("__prefix"), F.col("__leaf.size").alias("__size"))
