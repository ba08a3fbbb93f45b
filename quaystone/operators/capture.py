"""Capture of inbound documents: type, channel, route, trust of a text layer, and what comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import validators as V


def looks_like_email(text: Column) -> Column:
    """A header block, ended by an empty line within the first 4 KB, with at least two known header names."""
    head = F.substring(text, 1, 4096)
    end = F.instr(head, "\n\n")
    block = F.substring(head, F.lit(1), F.greatest(end - 1, F.lit(0)))
    names = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z][A-Za-z0-9-]*):[ \t]?"), 1), F.lower)
    return (end > 8) & (F.size(F.array_intersect(names, F.array(*[F.lit(x) for x in C.MAIL_HEADERS]))) >= 2)


EDI = r"^(?:\{|\*|ISA|UNB|MSGID)|^<\?xml[^>]*\?>\s*<(?:Document|Envelope|pain|pacs|camt|ISO20022)|^<(?:Document|Envelope|pain|pacs|camt|ISO20022)[\s>]"
PRINTABLE = r"^[\s\x20-\x7e]{32,}$"


def sniff(content: Column, filename: Column, declared: Column) -> Column:
    """Media type of bytes: leading bytes, then what was declared, then the file's name, then what the text looks like."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.decode(content, "ISO-8859-1")
    kind = F.lower(F.trim(F.substring_index(F.coalesce(declared, F.lit("")), ";", 1)))
    name = F.lower(F.coalesce(filename, F.lit("")))
    out = F.when(F.lit(False), "")
    for magic, media in C.MAGIC:
        out = out.when(head.startswith(magic), media)
    return (
        out.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(kind.isin("message/rfc822", "application/vnd.ms-outlook"), kind)
        .when(kind.rlike("^(image/|application/pdf|text/|message/)"), kind)
        .when(name.rlike(r"\.(eml|msg)$"), "message/rfc822")
        .when(name.rlike(r"\.(edi|mt101)$"), "application/edi")
        .when(looks_like_email(text), "message/rfc822")
        .when(F.substring(text, 1, 512).rlike(EDI), "application/edi")
        .when(F.substring(text, 1, 512).rlike(PRINTABLE), "text/plain")
        .otherwise("application/octet-stream")
    )


def channel(media: Column, from_email: Column) -> Column:
    return (
        F.when(media == "message/rfc822", "email-body")
        .when(from_email, "email-attachment")
        .when(media == "application/pdf", "pdf")
        .when(media == "application/edi", "edi")
        .when(media.startswith("image/"), "fax")
        .otherwise("email-body")
    )


def route(channel: Column, has_text_layer: Column, structured: Column) -> Column:
    """(path, reason); the first rule that holds."""
    to = lambda path, reason: F.struct(F.lit(path).alias("path"), F.lit(reason).alias("reason"))
    return (
        F.when(structured | (channel == "edi"), to("structured", "already a structured message"))
        .when(channel == "email-body", to("text", "body text, no raster content"))
        .when(channel.isin("fax", "email-attachment") & ~has_text_layer, to("ocr", "pixels only"))
        .when(has_text_layer, to("probe", "text layer present, trust unverified"))
        .otherwise(to("ocr", "no text layer"))
    )


def trust(text: Column, threshold: float = 0.99) -> Column:
    """Whether a text layer's checksummed fields hold: counts, score and the first failed samples."""
    ibans = F.filter(F.transform(F.regexp_extract_all(text, F.lit(C.PROBE_IBAN), 1), V.compact), lambda x: F.length(x).between(15, 34))
    bad = F.slice(F.filter(ibans, lambda x: ~V.iban_valid(x)), 1, 5)
    good = F.size(F.filter(ibans, V.iban_valid))

    def bics(s: Column) -> Column:
        found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(C.PROBE_BIC), 1), V.compact), lambda x: F.length(x).isin(8, 11) & ~F.array_contains(s["bad"], x))
        return V.let(found, lambda b: F.struct(s["ibans"].alias("ibans_found"), s["good"].alias("ibans_valid"), F.size(b).alias("bics_found"), F.size(F.filter(b, V.bic_country_valid)).alias("bics_valid"), F.slice(F.concat(s["bad"], F.filter(b, lambda x: ~V.bic_country_valid(x))), 1, 5).alias("failed_samples")))

    def scored(s: Column) -> Column:
        checked, valid = s["ibans_found"] + s["bics_found"], s["ibans_valid"] + s["bics_valid"]
        score = F.coalesce(F.try_divide(valid.cast("double"), checked.cast("double")), F.lit(0.0))
        ok = (checked > 0) & (score >= threshold)
        reason = F.when(checked == 0, "no checksummed fields to probe").when(ok, F.format_string("all %d checksummed fields valid", checked)).otherwise(F.format_string("%d of %d checksummed fields invalid", checked - valid, checked))
        return F.struct(*[s[n].alias(n) for n in ("ibans_found", "ibans_valid", "bics_found", "bics_valid", "failed_samples")], score.alias("score"), ok.alias("trustworthy"), reason.alias("reason"))

    return V.let(V.let(F.struct(F.size(ibans).alias("ibans"), good.alias("good"), bad.alias("bad")), bics), scored)


def capture(docs: DataFrame, recognised: DataFrame | None = None, key: str | list[str] = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Of (key, channel, text, has_text_layer, structured): path, text, used_ocr, note, after the probe; columns to ``carry`` come along.

    ``recognised(key, ocr_text, ocr_confidence)`` stands for a recogniser's results; where it has none, text stays unverified.
    """
    rows = docs.withColumn("__r", route(F.col("channel"), F.col("has_text_layer"), F.col("structured")))
    # no other path asks whether a text is to be trusted
    rows = rows.withColumn("__t", F.when(F.col("__r.path") == "probe", trust(F.col("text"))))
    if recognised is None:
        rows = rows.withColumn("ocr_text", F.lit(None).cast("string"))
    else:
        rows = rows.join(recognised, key, "left")
    path, ok, seen = F.col("__r.path"), F.col("__t.trustworthy"), F.col("ocr_text").isNotNull()
    rejected = (path == "probe") & ~ok
    wants = (path == "ocr") | rejected
    note = (
        F.when(path == "structured", "parsed as a message; no recognition performed")
        .when(path == "text", "")
        .when((path == "probe") & ok, "text layer accepted without OCR")
        .when(rejected & seen, F.concat(F.lit("rejected text layer: "), F.col("__t.reason")))
        .when(rejected, "text layer rejected but no OCR backend supplied; returning unverified text")
        .when(seen, "")
        .otherwise("OCR required but no backend supplied")
    )
    keys = [key] if isinstance(key, str) else key
    return rows.select(*keys, *carry, "channel", F.when(rejected, "ocr").otherwise(path).alias("path"), F.when(wants & seen, F.col("ocr_text")).otherwise(F.col("text")).alias("text"), (wants & seen).alias("used_ocr"), note.alias("note"))
