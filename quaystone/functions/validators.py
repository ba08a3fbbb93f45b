"""Deterministic validators as column expressions. Null counts as not valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` uses it; keeps expressions from growing when they are nested."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def compact(c: Column) -> Column:
    """Without white space, in upper case."""
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def alnum(c: Column) -> Column:
    """Only letters and digits, in upper case."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]+", ""))


def mod97(c: Column) -> Column:
    """Remainder modulo 97 of the number that a string of A-Z and 0-9 spells, letters as 10 to 35.

    Up to 30 digits, two letters and two digits, the common case, are worked out in whole numbers of at most 18 digits; else it is folded,
    so that no number is built. A fold is a lambda, which Spark interprets.
    """
    n, at = F.length(c), lambda k: F.ascii(F.substring(c, n - k, F.lit(1))).cast("long") - 55
    head = F.lpad(F.substring(c, F.lit(1), n - 4), 30, "0")
    left, right = F.substring(head, 1, 15).cast("long"), F.substring(head, 16, 15).cast("long")
    digits = (left % 97 * (10**15 % 97) + right) % 97
    whole = (((digits * 100 + at(3)) * 100 + at(2)) * 100 + F.substring(c, n - 1, F.lit(2)).cast("long")) % 97
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    step = lambda a, x: F.when(x < 58, (a * 10 + x - 48) % 97).otherwise((a * 100 + x - 55) % 97)
    return F.when(c.rlike("^[0-9]{1,30}[A-Z]{2}[0-9]{2}$"), whole).otherwise(F.aggregate(codes, F.lit(0).cast("long"), step))


def iban_valid(c: Column) -> Column:
    test = lambda x: F.when(x.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}$"), mod97(F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))) == 1)
    return F.coalesce(let(compact(c), test), F.lit(False))


def bic_valid(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).rlike(C.BIC_SHAPE), F.lit(False))


def bic_country_valid(c: Column) -> Column:
    return bic_valid(c) & F.coalesce(F.substring(F.upper(F.trim(c)), 5, 2).isin(*C.ISO_3166), F.lit(False))


def uetr_valid(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(C.UETR), F.lit(False))


def lei_valid(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).rlike(C.LEI), F.lit(False))


def currency_valid(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).rlike("^[A-Z]{3}$"), F.lit(False))


def minor_units_ok(amount: Column, currency: Column) -> Column:
    """Whether an amount's text has as many decimals as its currency; no point means none."""
    table = F.create_map(*[F.lit(x) for kv in C.MINOR_UNITS.items() for x in kv])
    text = F.trim(amount)
    at = F.instr(text, ".")
    decimals = F.when(at > 0, F.length(text) - at).otherwise(0)
    return F.coalesce(decimals == F.coalesce(table[F.upper(F.trim(currency))], F.lit(2)), F.lit(False))


def findings(name: Column, value: Column) -> Column:
    """The rules that a field's value breaks, by what its name says it is."""
    n = F.upper(name)
    rules = [
        (n.contains("IBAN") & ~iban_valid(value), "IBAN-mod97"),
        (n.contains("BIC") & ~bic_valid(value), "BIC-format"),
        (n.contains("UETR") & ~uetr_valid(value), "UETR-uuid4"),
        (n.contains("LEI") & ~lei_valid(value), "LEI-format"),
        ((n.isin("CCY", "CURRENCY") | n.endswith("CCY")) & ~currency_valid(value), "ISO4217-shape"),
    ]
    return F.filter(F.array(*[F.when(broken, F.lit(rule)) for broken, rule in rules]), lambda x: x.isNotNull())


def plausible(key: Column, value: Column) -> Column:
    """Whether a checksum or shape would let a wrong value pass."""
    return F.when(key.contains("IBAN"), iban_valid(value)).when(key.contains("BIC"), bic_valid(value)).otherwise(False)


def check_digits(country: Column, bban: Column) -> Column:
    return F.lpad((98 - mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")
