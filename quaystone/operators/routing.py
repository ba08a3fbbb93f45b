"""Routing checks of payments: country agreement in the row, then a directory by a left join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import routing as R
from ..functions import validators as V

#: Rows of a directory that may be broadcast.
BROADCAST_ROWS = 100_000


def pairs(p: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, party, bic, iban): each party's BIC with its own account, where both are stated."""
    sides = [("creditor", "CdtrAgt_BICFI", "CdtrAcct_IBAN"), ("debtor", "DbtrAgt_BICFI", "DbtrAcct_IBAN")]
    made = [F.struct(F.lit(s).alias("party"), (F.col(b) if b in p.columns else F.lit(None).cast("string")).alias("bic"), F.col(i).alias("iban")) for s, b, i in sides]
    return p.select(*keep, F.explode(F.array(*made)).alias("c")).select(*keep, "c.*").where("coalesce(bic, '') <> '' and coalesce(iban, '') <> ''")


def observed(confirmed: DataFrame, order: str) -> DataFrame:
    """Directory (iban, expected): the last BIC seen with each account, by ``order``. Combined before the shuffle."""
    rows = confirmed.select(V.compact(F.col("iban")).alias("iban"), V.compact(F.col("bic")).alias("bic"), F.col(order).alias("at")).where("iban <> '' and bic <> ''")
    return rows.groupBy("iban").agg(F.max_by("bic", "at").alias("expected"))


def cross_check(p: DataFrame, directory: DataFrame | None = None, small: bool = False, keep: str = "payment_id") -> DataFrame:
    """(key, party, check, verdict): country agreement for each pair, and where it passed the directory.

    ``small`` says that the directory is known to have at most BROADCAST_ROWS rows; else it is joined by a shuffle.
    """
    base = pairs(p, keep).withColumn("c", R.country_check(F.col("bic"), F.col("iban")))
    first = base.select(keep, "party", "c.check", "c.verdict")
    passed = base.where("c.verdict = 'passed'").select(keep, "party", "bic", V.compact(F.col("iban")).alias("iban"))
    if directory is None:
        second = passed.withColumn("expected", F.lit(None).cast("string"))
    else:
        second = passed.join(F.broadcast(directory) if small else directory, "iban", "left")
    second = second.select(keep, "party", F.lit("bic_matches_directory").alias("check"), R.directory_verdict(F.col("bic"), F.col("expected")).alias("verdict"))
    return first.unionByName(second)
