"""Connected components of links, by labels that jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that no later step makes it anew."""
    path = shared.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of the nodes of ``links(u, v)``: root is the least node that can be reached. Nodes with null take no part.

    Each round a node takes the least root among its own and its neighbours', and then that root's root; so a chain's length halves with
    each round. Rounds are written to the shared folder. Minima are taken before they are shuffled, so a node with many neighbours is no
    burden to one task.
    """
    both = links.where("u is not null and v is not null").select("u", "v").union(links.where("u is not null and v is not null").select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = kept(both.distinct(), "links")
    now = kept(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "roots")
    for _ in range(most):
        near = both.join(now.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        least = now.join(near, "node").select("node", F.least("root", "near").alias("to"), "root")
        over = now.select(F.col("node").alias("to"), F.col("root").alias("far"))
        after = kept(least.join(over, "to", "left").select("node", F.least("to", "far").alias("root"), (F.least("to", "far") != F.col("root")).alias("moved")), "roots")
        now = after.select("node", "root")
        if not after.where("moved").limit(1).count():
            return now
    raise RuntimeError(f"components did not settle in {most} rounds")
