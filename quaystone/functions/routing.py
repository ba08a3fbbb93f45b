"""Bank identifiers against account numbers, as column expressions with a three-valued verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import validators as V


def iban_country(c: Column) -> Column:
    x = V.compact(c)
    return F.regexp_extract(x, "^[A-Z]{2}", 0)


def bic_country(c: Column) -> Column:
    x = V.compact(c)
    return F.when(F.length(x) >= 6, F.substring(x, 5, 2)).otherwise("")


def bic_bank_code(c: Column) -> Column:
    x = V.compact(c)
    return F.when(F.length(x) >= 4, F.substring(x, 1, 4)).otherwise("")


def normalise_bic(c: Column, to_mx: bool) -> Column:
    """Without the primary-office branch XXX (MX), or with it (MT)."""
    x = F.upper(F.trim(c))
    if to_mx:
        return F.when((F.length(x) == 11) & x.endswith("XXX"), F.substring(x, 1, 8)).otherwise(x)
    return F.when(F.length(x) == 8, F.concat(x, F.lit("XXX"))).otherwise(x)


def logical_terminal(c: Column) -> Column:
    x = F.upper(F.trim(c))
    return F.concat(F.substring(x, 1, 8), F.lit("A"), F.when(F.length(x) >= 11, F.substring(x, 9, 3)).otherwise("XXX"))


def country_check(bic: Column, iban: Column) -> Column:
    """(check, verdict): shape of the BIC, then the account's checksum, then an assigned country, then the same country."""
    verdict = lambda check, v: F.struct(F.lit(check).alias("check"), F.lit(v).alias("verdict"))
    name = "bic_country_matches_iban"
    return (
        F.when(~V.bic_valid(bic), verdict("bic_shape", "failed"))
        .when(~V.iban_valid(iban), verdict(name, "unverifiable"))
        .when(~V.bic_country_valid(bic), verdict(name, "failed"))
        .when(bic_country(bic) != iban_country(iban), verdict(name, "failed"))
        .otherwise(verdict(name, "passed"))
    )


def directory_verdict(bic: Column, expected: Column) -> Column:
    return F.when(expected.isNull(), "unverifiable").when(expected == bic, "passed").otherwise("failed")


def audit_line(check: Column, verdict: Column) -> Column:
    mark = F.when(verdict == "passed", "ok  ").when(verdict == "unverifiable", "??  ").otherwise("FAIL")
    return F.format_string("  [%s] %s", mark, check)
