"""Connected components by alternating large-star and small-star steps, without a link or a node on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Of links ``edges(u long, v long)``: (node, root), root the least node of the component. Nodes without links are not listed.

    Each round writes its links to the shared folder, so that a lost executor costs one round; the loop ends when a round changes none.
    Minima are combined before they are shuffled, and the links of a node with many of them are dealt over several tasks.
    """
    spark = edges.sparkSession
    now = common.materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = _mark(now)
    for _ in range(most_rounds):
        both = _undirected(now)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = common.spread_join(both.where("v > u"), least, "u", "n", 2 * seen[0])
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = common.spread_join(down, least, "u", "n", 2 * seen[0])
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = common.materialize(small.where("u <> v").distinct(), "cc")
        mark = _mark(after)
        common.drop(spark, now.scratch_path)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
