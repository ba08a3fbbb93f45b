"""MT103 messages: rendering, parsing and translation, as column expressions."""

from __future__ import annotations

import re
import xml.parsers.expat

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..shipping import ship
from . import routing as R
from . import validators as V

TAG = r"(?m)^:(\d{2}[A-Z]?):"


def sender(text: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(text, r"\{1:([^}]*)\}", 1), "F01([A-Z0-9]{8,11})", 1)


def receiver(text: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(text, r"\{2:([^}]*)\}", 1), "I103([A-Z0-9]{8,11})", 1)


def uetr(text: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(text, r"(?s)\{3:\{(.*?)\}\}", 1), r"121:([0-9a-fA-F\-]+)", 1)


def body(text: Column) -> Column:
    """What stands in block 4, up to the last terminator."""
    tail = F.when(F.instr(text, "{4:") > 0, F.substring(text, F.instr(text, "{4:") + 3, F.length(text))).otherwise("")
    cut = lambda t, mark: F.substring(t, F.lit(1), F.length(t) - F.length(F.substring_index(t, mark, -1)) - len(mark))
    return V.let(tail, lambda t: F.when(t.contains("\n-}"), cut(t, "\n-}")).when(t.contains("-}"), cut(t, "-}")).otherwise(t))


def tags(text: Column) -> Column:
    """(tag, value) of each tag in order; following lines that are not blank belong to the tag before them."""
    parts = F.filter(F.split(F.regexp_replace(body(text), TAG, "\u0001$1\u0002"), "\u0001"), lambda x: x.contains("\u0002"))

    def one(x: Column) -> Column:
        lines = F.split(F.substring_index(x, "\u0002", -1), "\n")
        rest = F.filter(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda y: F.trim(y)), lambda y: y != "")
        return F.struct(F.substring_index(x, "\u0002", 1).alias("tag"), F.array_join(F.concat(F.array(F.trim(F.get(lines, F.lit(0)))), rest), "\n").alias("value"))

    return F.transform(parts, one)


def tag(found: Column, name: str) -> Column:
    """The last value of a tag; ''."""
    of = F.filter(found, lambda x: x["tag"] == name)
    return F.coalesce(F.get(of, F.size(of) - 1)["value"], F.lit(""))


def amount(raw: Column) -> tuple[Column, Column]:
    """Currency and amount of a field 32A."""
    ok = F.length(raw) >= 10
    return F.when(ok, F.substring(raw, 7, 3)).otherwise(""), F.when(ok, F.replace(F.substring(raw, F.lit(10), F.length(raw)), F.lit(","), F.lit("."))).otherwise("")


def settlement_date(raw: Column) -> Column:
    """ISO date of a field 32A; years 69 to 99 are of the last century; '' if it is no date."""
    y = F.substring(raw, 1, 2)
    full = F.concat(F.when(y.try_cast("int") >= 69, "19").otherwise("20"), F.substring(raw, 1, 6))
    return F.coalesce(F.when(raw.rlike(r"^\d{6}"), F.date_format(F.try_to_date(full, "yyyyMMdd"), "yyyy-MM-dd")), F.lit(""))


def end_to_end(field72: Column) -> Column:
    return F.regexp_extract(field72, r"/EToE/([A-Za-z0-9\-]+)", 1)


def party(block: Column) -> tuple[Column, Column]:
    """Account and name of a party field."""
    lines = F.filter(F.transform(F.split(block, "\n"), lambda y: F.trim(y)), lambda x: x != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    has = first.startswith("/")
    return F.when(has, F.trim(F.regexp_replace(first, "^/+", ""))).otherwise(""), F.when(has, F.coalesce(F.get(lines, F.lit(1)), F.lit(""))).otherwise(first)


def message_fields(text: Column, found: Column) -> dict[str, Column]:
    """The message's fields by name; '' where absent. ``found`` is a column of ``tags(text)``."""
    raw = tag(found, "32A")
    ccy, value = amount(raw)
    debtor, creditor = party(tag(found, "50K")), party(tag(found, "59"))
    charges = F.create_map(*[F.lit(x) for kv in C.CHARGES_TO_MX.items() for x in kv])
    charge = F.upper(F.trim(tag(found, "71A")))
    return {
        "Amt_IntrBkSttlmAmt_Ccy": ccy, "Amt_IntrBkSttlmAmt": value, "IntrBkSttlmDt": settlement_date(raw), "PmtId_InstrId": tag(found, "20"), "PmtId_EndToEndId": end_to_end(tag(found, "72")), "PmtId_UETR": uetr(text),
        "DbtrAcct_IBAN": debtor[0], "Dbtr_Nm": debtor[1], "CdtrAcct_IBAN": creditor[0], "Cdtr_Nm": creditor[1],
        "InstgAgt_BICFI": R.normalise_bic(sender(text), True), "InstdAgt_BICFI": R.normalise_bic(receiver(text), True),
        "ChrgBr": F.coalesce(charges[charge], charge), "RmtInf_Ustrd": tag(found, "70"),
    }


def render(v: dict[str, Column], as_of: str = "2026-01-01") -> Column:
    """An MT103 from message fields ('' or missing where absent); ``as_of`` stands in for a missing or unreadable date."""
    get = lambda k, default="": F.coalesce(F.nullif(v[k], F.lit("")), F.lit(default)) if k in v else F.lit(default)
    charges = F.create_map(*[F.lit(x) for kv in C.CHARGES_TO_MT.items() for x in kv])
    day = F.coalesce(F.date_format(F.try_to_date(get("IntrBkSttlmDt", as_of), "yyyy-MM-dd"), "yyMMdd"), F.date_format(F.lit(as_of).cast("date"), "yyMMdd"))
    value = F.replace(F.call_function("format_number", get("Amt_IntrBkSttlmAmt", "0.00").cast("double"), F.lit("0.00")), F.lit("."), F.lit(","))
    account = lambda field, mt: F.when(get(field) != "", F.concat(F.lit(f":{mt}:/"), get(field))).otherwise(f":{mt}:")
    optional = lambda field, mt: F.when(get(field) != "", F.concat(F.lit(f":{mt}:"), get(field)))
    lines = [
        F.concat(F.lit("{1:F01"), R.logical_terminal(get("InstgAgt_BICFI", "BANKDEFF")), F.lit("0000000000}{2:I103"), F.substring(F.upper(F.trim(get("InstdAgt_BICFI", "BANKFRPP"))), 1, 8), F.lit("XXXXN}{3:{121:"), get("PmtId_UETR", "00000000-0000-4000-8000-000000000000"), F.lit("}}{4:")),
        F.concat(F.lit(":20:"), get("PmtId_InstrId", "NOTPROVIDED")),
        F.lit(":23B:CRED"),
        F.concat(F.lit(":32A:"), day, get("Amt_IntrBkSttlmAmt_Ccy", "EUR"), value),
        account("DbtrAcct_IBAN", "50K"), get("Dbtr_Nm", "UNKNOWN"),
        account("CdtrAcct_IBAN", "59"), get("Cdtr_Nm", "UNKNOWN"),
        optional("RmtInf_Ustrd", "70"),
        F.concat(F.lit(":71A:"), F.coalesce(charges[get("ChrgBr", "SHAR")], F.lit("SHA"))),
        F.when(get("PmtId_EndToEndId") != "", F.concat(F.lit(":72:/EToE/"), get("PmtId_EndToEndId"))),
        F.lit("-}"),
    ]
    return F.concat_ws("\n", *lines)


MX_PATHS = {
    "PmtId_EndToEndId": "PmtId/EndToEndId", "PmtId_InstrId": "PmtId/InstrId", "PmtId_UETR": "PmtId/UETR", "IntrBkSttlmDt": "IntrBkSttlmDt", "Amt_IntrBkSttlmAmt": "IntrBkSttlmAmt", "Amt_IntrBkSttlmAmt_Ccy": "IntrBkSttlmAmt/@Ccy",
    "Dbtr_Nm": "Dbtr/Nm", "DbtrAcct_IBAN": "DbtrAcct//IBAN", "DbtrAgt_BICFI": "DbtrAgt//BICFI", "Cdtr_Nm": "Cdtr/Nm", "CdtrAcct_IBAN": "CdtrAcct//IBAN", "CdtrAgt_BICFI": "CdtrAgt//BICFI", "ChrgBr": "ChrgBr", "RmtInf_Ustrd": "RmtInf/Ustrd",
}


def _parses(text: str | None) -> bool:
    """Whether a text is one well-formed XML document, without a document type, whose entities the JVM would not read either."""
    if not text:
        return False
    parser = xml.parsers.expat.ParserCreate()

    def stop(*_):
        raise ValueError("document type")

    parser.StartDoctypeDeclHandler = stop
    try:
        parser.Parse(text, True)
    except (xml.parsers.expat.ExpatError, ValueError):
        return False
    return True


def well_formed(text: Column) -> Column:
    """Whether a text is a well-formed XML document. XPath stops a query at any other text, and Spark has no function that only asks."""
    ship(SparkSession.active())
    return F.pandas_udf(lambda texts: pd.Series([_parses(t) for t in texts], dtype="boolean"), "boolean")(text)


#: For each last step of a path, the keys that end there: (key, pattern of the path of local names, attribute).
_ENDS: dict[str, list[tuple[str, re.Pattern, str | None]]] = {}
for _key, _path in MX_PATHS.items():
    _steps, _at = (_path.rsplit("/@", 1) + [None])[:2]
    _ENDS.setdefault(_steps.rsplit("/", 1)[-1], []).append((_key, re.compile("(?:.*/)?" + re.escape(_steps).replace("//", "/(?:.*/)?")), _at))


def _mx_values(text: str | None) -> dict[str, str] | None:
    """The first value of each of ``MX_PATHS``, by local names, from one pass over a document; None if it is not well-formed (see ``_parses``)."""
    if not text:
        return None
    found: dict[str, list[str]] = {}
    above: list[str] = []
    taking: list[tuple[int, list[str]]] = []
    parser = xml.parsers.expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def begin(name, attributes):
        name = name.rsplit(" ", 1)[-1]
        above.append(name)
        for key, path, attribute in _ENDS.get(name, ()):
            if key not in found and path.fullmatch("/".join(above)):
                if attribute is None:
                    found[key] = []
                    taking.append((len(above), found[key]))
                elif attribute in attributes:
                    found[key] = [attributes[attribute]]

    def end(_):
        while taking and taking[-1][0] == len(above):
            taking.pop()
        above.pop()

    def data(some):
        for _, texts in taking:
            texts.append(some)

    def stop(*_):
        raise ValueError("document type")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = begin, end, data, stop
    try:
        parser.Parse(text, True)
    except (xml.parsers.expat.ExpatError, ValueError):
        return None
    return {key: "".join(found.get(key, ())).strip(" ") for key in MX_PATHS}


def mx_values(text: Column) -> Column:
    """The fields of a credit transfer message in XML as one struct, each document parsed once; a text that is no
    well-formed document is not ``ok`` and has null fields."""

    def read(texts: pd.Series) -> pd.DataFrame:
        rows = [_mx_values(t) for t in texts]
        return pd.DataFrame({"ok": pd.Series([r is not None for r in rows], dtype="bool"), **{k: pd.Series([r and r[k] for r in rows], dtype="object") for k in MX_PATHS}})

    ship(SparkSession.active())
    return F.pandas_udf(read, "ok boolean, " + ", ".join(f"{k} string" for k in MX_PATHS))(text)


def mx_fields(xml: Column) -> dict[str, Column]:
    """Fields of a credit transfer message in XML, by local names; the first match of each path, '' where absent, null where the text is no
    well-formed document. They share one parse of it: XPath would parse it again for each field, and wherever a field is used."""
    read = mx_values(xml)
    return {key: read[key] for key in MX_PATHS}


def mx_render(v: dict[str, Column]) -> Column:
    """A small credit transfer message in XML from message fields."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    el = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    return F.concat(
        F.lit('<Document xmlns="urn:iso:std:iso:20022:tech:xsd:pacs.008.001.08"><CdtTrfTxInf>'),
        el("PmtId", el("InstrId", esc(v["PmtId_InstrId"])), el("EndToEndId", esc(v["PmtId_EndToEndId"]))),
        F.lit('<IntrBkSttlmAmt Ccy="'), v["Amt_IntrBkSttlmAmt_Ccy"], F.lit('">'), v["Amt_IntrBkSttlmAmt"], F.lit("</IntrBkSttlmAmt>"),
        el("IntrBkSttlmDt", v["IntrBkSttlmDt"]), el("ChrgBr", v["ChrgBr"]),
        el("Dbtr", el("Nm", esc(v["Dbtr_Nm"]))), el("DbtrAcct", el("Id", el("IBAN", v["DbtrAcct_IBAN"]))),
        el("CdtrAgt", el("FinInstnId", el("BICFI", v["CdtrAgt_BICFI"]))), el("Cdtr", el("Nm", esc(v["Cdtr_Nm"]))), el("CdtrAcct", el("Id", el("IBAN", v["CdtrAcct_IBAN"]))),
        el("RmtInf", el("Ustrd", esc(v["RmtInf_Ustrd"]))), F.lit("</CdtTrfTxInf></Document>"),
    )
