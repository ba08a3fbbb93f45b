"""Rule extraction of payment fields: narrow column expressions, no shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..functions import validators as V
from ..functions.once import once

#: Fields that a label can give.
LABELLED = tuple(C.LABELS)


def label_pattern(label: str, separators: str = r"[:\-]") -> str:
    escaped = label.replace("-", r"\-")
    return rf"(?im)^\s*{escaped}\s*{separators}\s*(.+?)\s*$"


def _labelled(text: Column, low: Column, label: str, then, separators: str = r"[:\-]") -> Column:
    """``then`` of what follows the label on its first line, '' where the text (``low``: in lower case) does not hold the label at all.

    Most labels are in no line of a text, and to look for a string takes far less than a pattern with a case.
    """
    return F.when(low.contains(label.lower()), then(F.trim(F.regexp_extract(text, label_pattern(label, separators), 1)))).otherwise("")


def found(value: Column, method: str) -> Column:
    return F.struct(value.alias("value"), F.lit(method).alias("method"))


def by_label(text: Column, key: str, low: Column | None = None) -> Column:
    """(value, method) of a field from the first of its labels whose first line gives one; null if none does.

    Without a lambda, which Spark would interpret together with all that feeds it.
    """
    low = F.lower(text) if low is None else low
    tries, methods = [], {}
    for label in C.LABELS[key]:
        method = "label-ambiguous" if label.lower() in C.AMBIGUOUS_LABELS else "label"
        methods[method] = None
        tries.append(found(F.coalesce(_labelled(text, low, label, lambda raw: T.coerce(key, raw)), F.lit("")), method))
    left = F.array(*tries)
    for method in methods:
        left = F.array_remove(left, found(F.lit(""), method))
    return F.get(left, F.lit(0))


def first_amount(text: Column) -> Column:
    """The first number of at most 7 whole digits, with two decimals; ''."""
    short = lambda x: (x != "") & (F.length(F.regexp_replace(F.substring_index(x, ".", 1), "^0+", "")) <= 7)
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(C.AMOUNT), 0), T.norm_amount), short)
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def valid_ibans(text: Column) -> Column:
    """Distinct valid account numbers, in order, of the text without its spaces."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.replace(text, F.lit(" "), F.lit("")), F.lit(C.IBAN), 0), V.iban_valid))


def first_date(text: Column) -> Column:
    found = F.filter(F.transform(F.split(text, "\n"), T.date_in), lambda x: x != "")
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def by_pattern(text: Column) -> dict[str, Column]:
    """(value, method) of fallbacks for fields without a label; account numbers go to the creditor, then the debtor. '' if there is none."""
    ibans = valid_ibans(text)
    return {
        "Amt_InstdAmt_Ccy": found(T.currency_from(text), "pattern"),
        "Amt_InstdAmt": found(first_amount(text), "pattern"),
        "CdtrAcct_IBAN": found(F.coalesce(F.get(ibans, F.lit(0)), F.lit("")), "pattern-guess"),
        "DbtrAcct_IBAN": found(F.coalesce(F.get(ibans, F.lit(1)), F.lit("")), "pattern-guess"),
        "CdtrAgt_BICFI": found(F.regexp_extract(text, C.BIC, 0), "pattern-guess"),
        "ReqdExctnDt_Dt": found(first_date(text), "pattern"),
        "PmtId_EndToEndId": found(F.regexp_extract(text, C.REFERENCE, 0), "pattern"),
    }


def rules_v2(text: Column, low: Column | None = None) -> dict[str, Column]:
    """(value, method) of each field, labels first, then patterns; null or '' where absent. ``low`` is the text in lower case."""
    patterns = by_pattern(text)
    out = {}
    for key in C.KEYS:
        tries = ([by_label(text, key, low)] if key in C.LABELS else []) + ([patterns[key]] if key in patterns else [])
        out[key] = F.coalesce(*tries)
    return out


def rules_v1(text: Column, low: Column | None = None) -> dict[str, Column]:
    """The first rule set: each field's first label with a colon, the currency from the amount's line."""
    out, low = {}, F.lower(text) if low is None else low
    for key in C.KEYS:
        value = _labelled(text, low, C.LABELS["Amt_InstdAmt" if key == "Amt_InstdAmt_Ccy" else key][0], lambda raw, key=key: T.coerce_strict(key, raw), ":")
        out[key] = found(value, "canonical-label-inline" if key == "Amt_InstdAmt_Ccy" else "canonical-label")
    return out


EXTRACTORS = {"rules_v1": rules_v1, "rules_v2": rules_v2}


@once
def fields(rules: str, text: str) -> dict[str, Column]:
    """(value, method) of each field by a rule set, from the column ``text`` and, in lower case, ``__low`` (see ``lowered``)."""
    return EXTRACTORS[rules](F.col(text), F.col("__low"))


def lowered(docs: DataFrame, text: str) -> DataFrame:
    """Add the text in lower case, worked out once for all labels."""
    return docs.withColumn("__low", F.lower(F.col(text)))


def extract(docs: DataFrame, rules: str = "rules_v2", text: str = "text", prefix: str = "got_", methods: bool = False) -> DataFrame:
    """Add a column for each field ('' if absent), and if asked for its method (null if absent)."""
    held = fields(rules, text)
    out = lowered(docs, text).withColumns({f"__{k}": x for k, x in held.items()})
    out = out.withColumns({f"{prefix}{k}": F.coalesce(F.col(f"__{k}.value"), F.lit("")) for k in held})
    if methods:
        out = out.withColumns({f"how_{k}": F.when(F.col(f"__{k}.value") != "", F.col(f"__{k}.method")) for k in held})
    return out.drop("__low", *[f"__{k}" for k in held])


def extract_each(docs: DataFrame, by: str, text: str = "text", prefix: str = "got_") -> DataFrame:
    """Add a column for each field ('' if absent) by the rules that the row's column ``by`` names."""
    held = {name: fields(name, text) for name in EXTRACTORS}

    def one(key: str) -> Column:
        out = None
        for name, found in held.items():
            out = F.when(F.col(by) == name, found[key]["value"]) if out is None else out.when(F.col(by) == name, found[key]["value"])
        return F.coalesce(out, F.lit(""))

    return lowered(docs, text).withColumns({f"{prefix}{k}": one(k) for k in C.KEYS}).drop("__low")


def long_form(docs: DataFrame, rules: str = "rules_v2", key: str = "payment_id") -> DataFrame:
    """(key column, field, value, method), one row for each field found."""
    held = fields(rules, "text")
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), x.alias("x")) for k, x in held.items()]))
    return lowered(docs, "text").select(key, made.alias("c")).select(key, "c.field", "c.x.value", "c.x.method").where("value <> ''")
