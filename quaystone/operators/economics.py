"""What exceptions, formats and options cost, from measured rates, volumes and shares; parameters are the constants' unless others are given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C

O, X, RULES, MODEL, EFFORT = C.OPERATIONS, C.COSTS, C.RULE_COST, C.MODEL_COST, C.EFFORT


def hours(volume: Column, stp: Column, minutes: Column | float = O["minutes_per_exception"]) -> Column:
    """Hours of work a month on the messages that do not go straight through."""
    return volume * (1 - stp) * minutes / 60


def exceptions(rates: DataFrame) -> DataFrame:
    """``rates(volume, stp)`` with exceptions and hours a month, cost a year, and people."""
    h = hours(F.col("volume"), F.col("stp"))
    return rates.withColumns({"exceptions": F.col("volume") * (1 - F.col("stp")), "hours": h, "annual": h * O["hourly_cost"] * 12, "fte": h / O["hours_per_fte_month"]})


def point_value(volume: Column) -> Column:
    """What one hundredth more straight through is worth in a year."""
    return hours(volume, F.lit(0.99)) * O["hourly_cost"] * 12


def break_even(price: Column) -> Column:
    """Calls a month above which running a model oneself costs less than its price a call."""
    return F.when(price <= 0, float("inf")).otherwise((X["build"] + X["maintenance"]) / 12 / price)


def grid(rates: DataFrame, minutes: tuple[float, ...], hourly: tuple[float, ...]) -> DataFrame:
    """The cost a year of each of ``rates(volume, stp)`` for every number of minutes and every price of an hour."""
    each = rates.withColumn("minutes", F.explode(F.array(*map(F.lit, minutes)))).withColumn("hourly", F.explode(F.array(*map(F.lit, hourly))))
    return each.withColumn("annual", hours(F.col("volume"), F.col("stp"), F.col("minutes")) * F.col("hourly") * 12)


def options(rates: DataFrame) -> DataFrame:
    """``rates(volume, stp, better)``: what hosting saves and what a better rate saves in a year, and the points of rate that pay for the model."""
    infra = (F.col("volume") * X["api_price"] - (X["hosting"] + X["maintenance"] / 12)) * 12
    gain = (hours(F.col("volume"), F.col("stp")) - hours(F.col("volume"), F.col("better"))) * O["hourly_cost"] * 12
    return rates.withColumns({"infra_delta": infra, "stp_delta": gain, "ratio": F.try_divide(gain, infra), "payback_points": F.lit(X["build"] + X["maintenance"]) / point_value(F.col("volume"))})


def coverage(counts: DataFrame, by: str, covered: int = 3) -> DataFrame:
    """(by, formats, share): of a group's formats ``counts(by, format, n)``, commonest first, what the first ``covered`` have of the first ``formats``.

    Windows are over the formats of one group, not over messages.
    """
    order = W.partitionBy(by).orderBy(F.col("n").desc(), "format")
    run = counts.withColumn("formats", F.row_number().over(order)).withColumn("total", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    first = F.sum(F.when(F.col("formats") <= covered, F.col("n"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    return run.select(by, "formats", (first / F.col("total")).alias("share"))


def compared(shares: DataFrame, volume: float = O["messages_per_month"]) -> DataFrame:
    """``shares(formats, share)`` with the first year's cost of rules, written for each format, and of a model that needs none."""
    def human(stp: Column, verified: Column) -> Column:
        return volume * 12 * (1 - stp) * (verified * EFFORT["VERIFY"] + (1 - verified) * EFFORT["KEY"]) / 60 * O["hourly_cost"]

    rules = F.col("formats") * RULES["days_per_format"] * RULES["day"] + human(F.col("share"), F.lit(0.0))
    model = F.lit((MODEL["build_days"] + MODEL["integration_days"]) * MODEL["day"]) + human(F.lit(0.85), F.lit(0.15))
    return shares.withColumns({"rules_year_one": rules, "model_year_one": model})
