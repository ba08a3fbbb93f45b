"""Amounts, dates, currencies and other values as they stand in documents, as column expressions. '' means absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from . import validators as V

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def norm_amount(c: Column) -> Column:
    """Two decimals of an amount with either kind of separators; '' if it is no number.

    With both kinds, the later one is decimal. A lone comma kind groups if three digits follow the last; a lone point kind if three digits
    follow the last of several.
    """
    bare = F.replace(F.replace(F.trim(c), F.lit("\u00a0"), F.lit("")), F.lit(" "), F.lit(""))
    without = lambda x, what: F.replace(x, F.lit(what), F.lit(""))
    to_point = lambda x: F.replace(x, F.lit(","), F.lit("."))

    def plain(t: Column) -> Column:
        comma, dot = t.contains(","), t.contains(".")
        after_comma, after_dot = F.length(F.substring_index(t, ",", -1)), F.length(F.substring_index(t, ".", -1))
        return (
            F.when(comma & dot, F.when(after_comma < after_dot, to_point(without(t, "."))).otherwise(without(t, ",")))
            .when(comma, F.when((after_comma == 3) & (F.length(t) > 4), without(t, ",")).otherwise(to_point(t)))
            .when(dot & (after_dot == 3) & (F.length(t) - F.length(without(t, ".")) > 1), without(t, "."))
            .otherwise(t)
        )

    shown = lambda x: F.when(x.rlike(NUMBER), F.call_function("format_number", x.try_cast("double"), F.lit("0.00")))
    return F.coalesce(V.let(V.let(bare, plain), shown), F.lit(""))


def norm_date(c: Column) -> Column:
    """ISO date of a text that is a date; day first unless that cannot be. ISO dates pass as they are, out of range or not."""
    text = r"(?i)^(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(\d{4})$"
    dmy = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")

    def iso(t: Column) -> Column:
        month = (F.instr(F.lit("".join(C.MONTHS).lower()), F.lower(F.regexp_extract(t, text, 2))) + 2) / 3
        a, b = F.regexp_extract(t, dmy, 1).try_cast("int"), F.regexp_extract(t, dmy, 2).try_cast("int")
        swap = (a <= 12) & (b > 12)
        return (
            F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
            .when(t.rlike(text), F.concat_ws("-", F.regexp_extract(t, text, 3), two(month), two(F.regexp_extract(t, text, 1).try_cast("int"))))
            .when(t.rlike(dmy), F.concat_ws("-", F.regexp_extract(t, dmy, 3), two(F.when(swap, a).otherwise(b)), two(F.when(swap, b).otherwise(a))))
        )

    return F.coalesce(V.let(F.trim(c), iso), F.lit(""))


def date_in(c: Column) -> Column:
    """The first date in a text: an ISO one, else one with a month's name, else one in numbers."""
    found = [F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in (C.DATE_ISO, C.DATE_TEXT, C.DATE_DMY)]
    return F.coalesce(norm_date(F.coalesce(*found)), F.lit(""))


def currency_from(c: Column) -> Column:
    """The first token, between white space and commas, of three capital letters."""
    return F.regexp_extract(c, r"(?:^|[\s,])([A-Z]{3})(?:$|[\s,])", 1)


def last_token(c: Column) -> Column:
    return F.regexp_extract(c, r"(\S+)\s*$", 1)


def first_token(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"^\s*(\S+)", 1), r"^[,;]+|[,;]+$", "")


def coerce(key: str, raw: Column) -> Column:
    """A labelled value as its field wants it; '' if it cannot be."""
    bare = F.replace(raw, F.lit(" "), F.lit(""))
    if key == "Amt_InstdAmt":
        return norm_amount(last_token(raw))
    if key == "Amt_InstdAmt_Ccy":
        return currency_from(raw)
    if key == "ReqdExctnDt_Dt":
        return V.let(raw, lambda x: F.coalesce(F.nullif(norm_date(x), F.lit("")), date_in(x)))
    if key in ("CdtrAcct_IBAN", "DbtrAcct_IBAN"):
        return F.regexp_extract(bare, C.IBAN, 0)
    if key.endswith("_BICFI"):
        return F.regexp_extract(bare, C.BIC, 0)
    if key == "PmtId_EndToEndId":
        return first_token(raw)
    return raw


def coerce_strict(key: str, raw: Column) -> Column:
    """The clean-up of the first rule set: dates whole, accounts from the compacted text, BICs unchecked."""
    if key == "ReqdExctnDt_Dt":
        return norm_date(raw)
    if key in ("CdtrAcct_IBAN", "DbtrAcct_IBAN"):
        return F.regexp_extract(V.compact(raw), r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", 0)
    if key.endswith("_BICFI"):
        return raw
    return coerce(key, raw)


def canonicalise(key: str, raw: Column) -> Column:
    """A teacher's value as its field wants it; '' (drop it) if it cannot be."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    bare = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    if key == "Amt_InstdAmt":
        return norm_amount(last_token(text))
    if key == "Amt_InstdAmt_Ccy":
        letters = F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
        return F.when(F.length(letters) == 3, letters).otherwise("")
    if key == "ReqdExctnDt_Dt":
        return norm_date(text)
    if key in ("CdtrAcct_IBAN", "DbtrAcct_IBAN"):
        return F.when(V.iban_valid(bare), bare).otherwise("")
    if key.endswith("_BICFI"):
        return F.when(V.bic_valid(bare), bare).otherwise("")
    return text


def format_amount(amount: Column, european: Column) -> Column:
    shown = F.call_function("format_number", amount.cast("double"), F.lit("#,##0.00"))
    return F.when(european, F.translate(shown, ",.", ".,")).otherwise(shown)


def html_to_text(c: Column) -> Column:
    """Text of a page: block ends as new lines, scripts and styles gone (after that), tags gone, entities decoded in order, lines trimmed."""
    t = F.regexp_replace(c, r"(?i)</(?:p|div|tr|li|h[1-6]|table|br)\s*>|<br\s*/?>", "\n")
    for tag in ("script", "style"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}>", "")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for entity, char in C.ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, "[ \\t]+", " ")
    return F.array_join(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "\n")


STRING = r'"(?:[^"\\]++|\\.)*+'
#: A first object without objects in it; and one of that kind that the text ends within, so that it never closes. Neither takes a step back.
FLAT = rf'^[^{{]*+(\{{(?:[^{{}}"]++|{STRING}")*+\}})'
OPEN = rf'^[^{{]*+\{{(?:[^{{}}"]++|{STRING}")*+(?:{STRING}\\?+)?\z'


def first_object(c: Column) -> Column:
    """The first balanced {...} of a text, aware of strings and escapes; '' if it never closes. One without braces inside needs no fold."""
    whole = lambda x: V.let(F.regexp_extract(x, FLAT, 1), lambda flat: F.when(flat != "", flat).when(x.rlike(OPEN), "").otherwise(_balanced(x)))
    return V.let(c, whole)


def _balanced(c: Column) -> Column:
    start = F.instr(c, "{")
    chars = F.filter(F.split(F.substring(c, start, F.length(c)), ""), lambda x: x != "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("text"), F.lit(False).alias("esc"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        inside, esc = s["text"], s["esc"]
        depth = F.when(inside, s["depth"]).when(x == "{", s["depth"] + 1).when(x == "}", s["depth"] - 1).otherwise(s["depth"])
        text = F.when(inside & esc, True).when(x == '"', ~inside).otherwise(inside)
        now_esc = inside & ~esc & (x == "\\")
        at = s["at"] + 1
        end = F.when(s["end"] > 0, s["end"]).when(~inside & (x == "}") & (depth == 0), at).otherwise(0)
        return F.struct(depth.alias("depth"), text.alias("text"), now_esc.alias("esc"), at.alias("at"), end.alias("end"))

    length = F.aggregate(chars, zero, step, lambda s: s["end"])
    return F.coalesce(F.when(start > 0, F.substring(c, start, length)), F.lit(""))


def duplicate_keys(c: Column) -> Column:
    """How many keys of the first object are repeats, counted on the text."""
    keys = lambda body: F.regexp_extract_all(F.substring(body, F.lit(2), F.greatest(F.length(body) - 2, F.lit(0))), F.lit(r'"([^"\\]+)"\s*:'), 1)
    return V.let(V.let(first_object(c), keys), lambda k: F.size(k) - F.size(F.array_distinct(k)))


def value_key(columns: list[str]) -> Column:
    """k=v of all fields, by key, as one text."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.col(k)) for k in sorted(columns)])


def bucket(key: Column, seed: int, of: int) -> Column:
    """A draw in [0, of) that only the seed and the key decide."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256), 1, 8), 16, 10).cast("long"), F.lit(of)).cast("int")
