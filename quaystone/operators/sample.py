"""Samples, windows and array operators: stratified samples, CTC decoding, boxes, n-gram hashes, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stratified(df: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    """``limit`` rows: an equal quota of the first of each stratum, stratum by stratum, then the first rows that are left.

    Only ranks within the quota pass the shuffle (Spark cuts them per task), and top-ups come from the first 2 * limit rows, so that no
    task sees a whole stratum.
    """
    rows = df.select(F.col(order), F.coalesce(by, F.lit("?")).alias("bucket"))
    n = rows.agg(F.count_distinct("bucket").alias("n")).first()["n"]
    quota = max(1, limit // max(1, n))
    chosen = rows.withColumn("k", F.row_number().over(W.partitionBy("bucket").orderBy(order))).where(F.col("k") <= quota).drop("k")
    spare = rows.orderBy(order).limit(2 * limit).join(chosen, [order], "left_anti").orderBy(order).limit(limit)
    both = chosen.withColumn("late", F.lit(0)).unionByName(spare.withColumn("late", F.lit(1)))
    place = F.row_number().over(W.orderBy("late", F.when(F.col("late") == 0, F.col("bucket")).otherwise(""), order))
    return both.withColumn("place", place).where(F.col("place") <= limit).select(order, "bucket", "place")


def changes(steps: DataFrame) -> DataFrame:
    """Steps whose class differs from the step before, within a line."""
    prev = F.lag("k", 1, -1).over(W.partitionBy("line_id").orderBy("t"))
    return steps.withColumn("prev", prev).where("k <> prev")


def ctc_decode(steps: DataFrame, chars: str) -> DataFrame:
    """Greedy CTC: repeats collapsed, blanks (0) dropped, class k as character k - 1; confidence is the mean over what is kept, or 0."""
    kept = F.when((F.col("k") != F.col("prev")) & (F.col("k") != 0), F.struct("t", F.substring(F.lit(chars), F.col("k"), F.lit(1)).alias("c"), "prob"))
    prev = F.lag("k", 1, -1).over(W.partitionBy("line_id").orderBy("t"))
    lines = steps.withColumn("prev", prev).groupBy("line_id").agg(F.array_sort(F.collect_list(kept)).alias("s"), F.round(F.avg(kept["prob"]), 9).alias("m"))
    return lines.select("line_id", F.array_join(F.col("s.c"), "").alias("text"), F.coalesce("m", F.lit(0.0)).alias("confidence"))


def unclip(boxes: DataFrame, ratio: float, width: int, height: int) -> DataFrame:
    """Boxes grown by a part of their sides, within the image."""
    pad = lambda a, b: F.floor(F.greatest(F.col(b) - F.col(a), F.lit(1)) * (ratio - 1) / 2).cast("int")
    px, py = pad("x0", "x1"), pad("y0", "y1")
    zero = F.lit(0)
    return boxes.withColumns({"x0": F.greatest(zero, F.col("x0") - px), "y0": F.greatest(zero, F.col("y0") - py), "x1": F.least(F.lit(width), F.col("x1") + px), "y1": F.least(F.lit(height), F.col("y1") + py)})


def reading_order(boxes: DataFrame) -> DataFrame:
    """Place of each box of a page: by lines of a tolerance that the page's median height gives, then from the left."""
    tol = boxes.groupBy("page_id").agg(F.greatest(F.lit(8), F.floor(F.median(F.col("y1") - F.col("y0")) * 0.6).cast("int")).alias("tol"))
    line = F.bround(F.col("y0") / F.col("tol"))
    return boxes.join(tol, "page_id").withColumn("place", F.row_number().over(W.partitionBy("page_id").orderBy(line, "x0", "tie", "text", "x1", "y1", "confidence")))


def text_from_boxes(ordered: DataFrame) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("place", "text")))
    return ordered.where("trim(text) <> ''").groupBy("page_id").agg(F.array_join(cells["text"], "\n").alias("text"), F.round(F.avg("confidence"), 6).alias("confidence"))


def ngram_slots(ids: Column, order: int, seed: int, prime: int, slots: int) -> Column:
    """Slot of the n-gram that ends at each position: XOR and multiply over the trailing ids (0 before the start), in 32 bits."""
    mask = F.lit(0xFFFFFFFF)
    shifted = [F.slice(F.concat(F.array_repeat(F.lit(0).cast("long"), k), ids), F.lit(1), F.greatest(F.size(ids), F.lit(0))) if k else ids for k in range(order)]
    zipped = F.arrays_zip(*[x.alias(f"t{k}") for k, x in enumerate(shifted)])

    def one(z: Column) -> Column:
        acc = F.lit(seed).cast("long")
        for k in range(order):
            acc = (acc.bitwiseXOR(z[f"t{k}"]) * prime).bitwiseAND(mask)
        return F.get(F.transform(F.array(acc), lambda a: F.pmod(a.bitwiseXOR(F.shiftright(a, 15)), F.lit(slots))), F.lit(0))

    return F.transform(zipped, one)


def gate(x: Column, y: Column, tables: int) -> Column:
    """Sigmoid of the cosine over the square root of the number of tables."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cosine = dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    return 1 / (1 + F.exp(-cosine / F.sqrt(F.lit(float(tables)))))
