"""What a training run needs around its model: masked sequences, batches of one width, held-out loss, accuracy and separation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship

#: Label of a position that adds nothing to the loss, id of a padded position, ids before the bytes, the longest sequence.
IGNORED, PAD, SPECIALS, LONGEST = -100, 0, 7, 256
#: About so many rows of one width are ranked in one window; entries of one position that are summed in one list.
BLOCK, LIST = 4096, 1024

SEQUENCE = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32())), ("dropped", pa.string())])


class Bytes:
    """Ids of a text's UTF-8 bytes, after the special ids: the alphabet that every byte-level vocabulary begins with."""

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode(), np.uint8).astype(np.int32) + SPECIALS


class Vocabulary:
    """Ids of a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)


_OPEN: dict[str, Vocabulary] = {}


def masked(encoder: Bytes | Vocabulary, prompt: str, whole: str, longest: int) -> tuple[np.ndarray | None, np.ndarray | None, str | None]:
    """Ids and labels of a sequence, its prompt's positions ignored, or why it is dropped: too long, or nothing left to learn."""
    ids = encoder.encode(whole)
    if len(ids) > longest:
        return None, None, "too long"
    labels = ids.copy()
    labels[: len(encoder.encode(prompt))] = IGNORED
    return (ids, labels, None) if (labels != IGNORED).any() else (None, None, "all masked")


def encode_mask(examples: DataFrame, vocabulary: str | None = None, longest: int = LONGEST) -> DataFrame:
    """(id, ids, labels, dropped) of ``examples(id, prompt, answer)``: the sequence is the prompt and then the answer.

    ``dropped`` says why a row has no sequence: ``too long`` (more than ``longest`` ids), ``all masked`` (no answer), null if it has one. Null
    texts count as empty; null and repeated ids are rows each; other columns are ignored. ``vocabulary`` is a file of the tokenizers library,
    None takes bytes. A prompt whose last characters merge with the answer's first masks as many positions as it has ids alone.
    """
    ship(examples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary is not None and vocabulary not in _OPEN:
            _OPEN[vocabulary] = Vocabulary(vocabulary)
        encoder = Bytes() if vocabulary is None else _OPEN[vocabulary]
        for b in batches:
            made = [masked(encoder, p, p + a, longest) for p, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[k] for m in made], SEQUENCE.field(k + 1).type) for k in range(3))], schema=SEQUENCE)

    texts = examples.select(F.col("id").cast("long").alias("id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("prompt", "answer")))
    return texts.mapInArrow(run, "id long, ids array<int>, labels array<int>, dropped string")


def batches(sequences: DataFrame, size: int = 16, multiple: int = 8) -> DataFrame:
    """``sequences(id, ids, labels)`` dealt into batches of at most ``size`` rows of one width: with width and batch (from 0 in each width).

    A row's width is its length rounded up to ``multiple``, so a batch holds at most size * width positions, of which under ``multiple`` a
    row are padding. Rows of a width follow each other by id, null first; no row is in two batches. The rank in a width is one within a
    block of ids and the sum of the blocks before it, so no window holds a whole width. Equal ids are ranked by their ids array.
    """
    rows = sequences.where("ids is not null").withColumn("width", (F.ceil(F.size("ids") / multiple) * multiple).cast("int")).withColumn("__block", F.coalesce(F.floor(F.col("id") / BLOCK), F.lit(-(1 << 62))))
    counts = rows.groupBy("width", "__block").count()
    before = counts.withColumn("before", F.sum("count").over(W.partitionBy("width").orderBy("__block")) - F.col("count")).drop("count")
    place = F.row_number().over(W.partitionBy("width", "__block").orderBy(F.col("id").asc_nulls_first(), "ids")) - 1
    ranked = rows.withColumn("place", place).join(before, ["width", "__block"])
    return ranked.withColumn("batch", F.floor((F.col("place") + F.col("before")) / size)).drop("place", "before", "__block")


def padded(rows: DataFrame) -> DataFrame:
    """The rows of ``batches`` with ids and labels filled up to the width."""
    fill = lambda c, value: F.concat(c, F.array_repeat(F.lit(value), F.col("width") - F.size(c)))
    return rows.withColumns({"ids": fill("ids", PAD), "labels": fill("labels", IGNORED)})


def held_out(logits: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Loss and accuracy of next-token logits: (by..., positions, loss, accuracy).

    ``logits(seq, position, class, logit)`` has a row for each class; ``labels(seq, position, label)``, with the columns ``by``, what stands at
    a position. The logits of a position are held against the label of the next one; ignored labels (-100) and positions without logits or a
    label count for nothing. The loss is the mean of log(sum(exp(logit))) - logit of the label, with the greatest logit taken out first, so
    that no exponential overflows; of equal greatest logits the lower class is the guess. Null logits are none. A position's classes
    are summed in lists of LIST entries, these in one list more.
    """
    by = by or []
    target = labels.where((F.col("label") != IGNORED) & F.col("label").isNotNull()).select("seq", (F.col("position") - 1).alias("position"), "label", *by)
    rows = logits.where("logit is not null").select("seq", "position", "class", "logit").join(target, ["seq", "position"])
    part = rows.groupBy("seq", "position", "label", *by, F.floor(F.col("class") / LIST).alias("part")).agg(
        F.collect_list("logit").alias("x"), F.max(F.struct(F.col("logit").alias("m"), (-F.col("class")).alias("k"))).alias("top"), F.max(F.when(F.col("class") == F.col("label"), F.col("logit"))).alias("own")
    )
    part = part.withColumn("s", F.aggregate("x", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top.m"))))
    whole = part.groupBy("seq", "position", "label", *by).agg(F.collect_list(F.struct(F.col("top.m").alias("m"), "s")).alias("parts"), F.max("top").alias("top"), F.max("own").alias("own"))
    summed = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["s"] * F.exp(p["m"] - F.col("top.m")))
    each = whole.where("own is not null").select(*by, (F.col("top.m") + F.log(summed) - F.col("own")).alias("loss"), (-F.col("top.k") == F.col("label")).cast("double").alias("hit"))
    return each.groupBy(*by).agg(F.count("*").alias("positions"), F.avg("loss").alias("loss"), F.avg("hit").alias("accuracy"))


def centroid_head(rows: DataFrame, features: str, label: Column, train: Column) -> DataFrame:
    """``rows`` where not ``train``, with y and score: how much nearer a vector lies to the mean of the right (1) than of the wrong (0) ones.

    The means are those of the training rows, as many numbers as a vector has components.
    """
    known = rows.where(train).select(label.cast("int").alias("y"), F.posexplode(features).alias("k", "x")).where("y is not null")
    means = known.groupBy("y", "k").agg(F.avg("x").alias("m")).groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("mean"))
    mean = {r.y: [F.lit(m) for m in r["mean"]] for r in means.collect()}
    far = lambda y: F.aggregate(F.zip_with(features, F.array(*mean.get(y, [])), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return rows.where(~train).withColumns({"y": label.cast("int"), "score": far(0) - far(1)})


def separation(rows: DataFrame, parts: int = 256) -> DataFrame:
    """One row of ``rows(score, y)``: n, base_rate, separation (difference of mean scores of right and wrong) and auc.

    auc is the chance that a right row scores above a wrong one, ties half: rank sums over distinct scores. These are cut into ranges at
    approximate quantiles, ranked within each range by a window, and the ranges' totals, at most ``parts``, are added up. Null scores and
    labels count for nothing; auc and separation are null where one kind is missing.
    """
    known = rows.where("score is not null and y is not null and not isnan(score)").select(F.col("score").cast("double").alias("score"), F.col("y").cast("int").alias("y"))
    scores = known.groupBy("score").agg(F.sum("y").alias("right"), F.sum(1 - F.col("y")).alias("wrong"), F.sum("score").alias("total"))
    cuts = scores.agg(F.percentile_approx("score", [k / parts for k in range(1, parts)], 10_000).alias("cuts"))
    cut = scores.crossJoin(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("score")))).drop("cuts")  # one row of at most `parts` cuts
    totals = cut.groupBy("range").agg(F.sum("wrong").alias("w")).withColumn("before", F.sum("w").over(W.orderBy("range")) - F.col("w")).drop("w")
    below = F.sum("wrong").over(W.partitionBy("range").orderBy("score")) - F.col("wrong")
    won = cut.withColumn("below", below).join(F.broadcast(totals), "range").select("right", "wrong", (F.col("right") * (F.col("before") + F.col("below") + F.col("wrong") / 2)).alias("won"), "score")
    right, wrong = F.sum("right"), F.sum("wrong")
    mean = lambda c, n: F.sum(F.col("score") * F.col(c)) / F.nullif(n, F.lit(0))
    return won.agg(
        F.coalesce(right + wrong, F.lit(0)).alias("n"), (right / F.nullif(right + wrong, F.lit(0))).alias("base_rate"), (mean("right", right) - mean("wrong", wrong)).alias("separation"),
        (F.sum("won") / F.nullif(right * wrong, F.lit(0))).alias("auc"),
    )
