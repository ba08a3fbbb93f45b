"""Scoring of extractions against the truth, field by field in the row, then by document, difficulty and over all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import validators as V


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def rate(a: Column, b: Column, places: int = 6) -> Column:
    """a / b, 0 where b is 0, rounded."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), places)


def score(docs: DataFrame, prefix: str = "got_") -> DataFrame:
    """Add correct, expected, n_wrong, n_invented, the lists wrong and invented, and each definition of a straight-through document."""
    want = {k: F.coalesce(F.col(k), F.lit("")) for k in C.KEYS}
    got = {k: F.coalesce(F.col(f"{prefix}{k}"), F.lit("")) for k in C.KEYS}
    expected = {k: want[k] != "" for k in C.KEYS}
    right = {k: expected[k] & (got[k] == want[k]) for k in C.KEYS}
    names = lambda tests: F.array_remove(F.array(*[F.when(t, F.lit(k)).otherwise("") for k, t in tests.items()]), "")
    out = docs.withColumns({
        "expected": total([expected[k].cast("int") for k in C.KEYS]),
        "correct": total([right[k].cast("int") for k in C.KEYS]),
        "wrong": names({k: expected[k] & ~right[k] for k in C.KEYS}),
        "invented": names({k: ~expected[k] & (got[k] != "") for k in C.KEYS}),
    })
    return out.withColumns({"n_wrong": F.size("wrong"), "n_invented": F.size("invented")}).withColumns({
        "stp_strict": (F.col("n_wrong") == 0) & (F.col("n_invented") == 0),
        "stp_loose": F.col("n_wrong") == 0,
    })


def by_level(scored: DataFrame, *more: str) -> DataFrame:
    """Totals by difficulty and, in the same pass, over all ('all')."""
    sums = [F.count("*").alias("docs"), F.sum(F.col("stp_strict").cast("int")).alias("stp_docs"), F.sum("expected").alias("expected"), F.sum("correct").alias("correct"), F.sum("n_invented").alias("spurious")]
    grouped = scored.groupingSets([[*more, "difficulty"], [*more]], *more, "difficulty")
    return grouped.agg(*sums).withColumn("difficulty", F.coalesce("difficulty", F.lit("all")))


def with_rates(report: DataFrame) -> DataFrame:
    """Rates by document and by field; spurious fields are by document."""
    return report.select(
        "*",
        rate(F.col("stp_docs"), F.col("docs")).alias("stp_rate"),
        F.round(1 - rate(F.col("stp_docs"), F.col("docs"), 12), 6).alias("exception_rate"),
        rate(F.col("correct"), F.col("expected")).alias("field_accuracy"),
        rate(F.col("spurious"), F.col("docs")).alias("spurious_per_doc"),
    )


def cells(scored: DataFrame, *keep: str, prefix: str = "got_") -> DataFrame:
    """Long form of a score: (kept columns, field, want, got, expected, correct, spurious), one row for each field stated or found."""
    made = [F.struct(F.lit(k).alias("field"), F.coalesce(F.col(k), F.lit("")).alias("want"), F.coalesce(F.col(f"{prefix}{k}"), F.lit("")).alias("got")) for k in C.KEYS]
    rows = scored.select(*keep, F.explode(F.array(*made)).alias("c")).select(*keep, "c.*").where("want <> '' or got <> ''")
    return rows.withColumns({"expected": (F.col("want") != "").cast("int"), "correct": ((F.col("want") != "") & (F.col("got") == F.col("want"))).cast("int"), "spurious": (F.col("want") == "").cast("int")})


def by_field(scored: DataFrame, *keys: str) -> DataFrame:
    """Recall, precision (invented values only count against it) and F1 of each field."""
    sums = cells(scored, *keys).groupBy(*keys, "field").agg(*[F.sum(x).cast("long").alias(x) for x in ("expected", "correct", "spurious")])
    p, r = rate(F.col("correct"), F.col("correct") + F.col("spurious"), 12), rate(F.col("correct"), F.col("expected"), 12)
    return sums.select(*keys, "field", "expected", "correct", "spurious", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def action(build_ok: Column | None = None) -> Column:
    """What is left for a person: nothing (STP), to check (VERIFY), or to key (KEY)."""
    ok = F.lit(True) if build_ok is None else build_ok
    return (
        F.when((F.col("n_wrong") == 0) & (F.col("n_invented") == 0) & ok, "STP")
        .when((F.col("n_invented") > 0) | ~ok | (F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("expected").cast("double")), F.lit(0.0)) < 0.6), "KEY")
        .otherwise("VERIFY")
    )


def cause(damage: DataFrame) -> Column:
    """Why a field is wrong: missing; a value of the same document in another field (role); passed by a checksum (silent); or caught."""
    return F.when(F.col("got") == "", "missing").when(F.array_contains("truths", F.col("got")), "role").when(V.plausible(F.col("field"), F.col("got")), "silent").otherwise("caught")


def damages(scored: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, field, want, got, cause) of each stated field that came out wrong."""
    rows = cells(scored.withColumn("truths", F.filter(F.array(*[F.col(k) for k in C.KEYS]), lambda x: F.coalesce(x, F.lit("")) != "")), *keep, "truths").where("expected = 1 and correct = 0")
    return rows.withColumn("cause", cause(rows)).select(*keep, "field", "want", "got", "cause")
