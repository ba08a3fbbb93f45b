"""Inbound files to captured text: typed by their bytes, taken apart by type, routed, with every step's notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import capture as K
from ..shipping import ship
from . import mail, pdf

MAIL = ("message/rfc822", "application/vnd.ms-outlook")
OUT = ("id", "part_no", "filename", "media_type", "channel", "text", "has_text_layer", "structured", "notes")


#: Notes on PDF files, as the reader of a text layer leaves them.
LAYER, SCAN, NO_RENDERER = "text layer extracted; nothing rendered", "no text layer: this is a scan and needs recognition", "no PDF renderer available; text is unavailable, not empty"


def _layers(rows: DataFrame) -> DataFrame:
    """``rows`` with __layer: the text layer of those that are PDF files, '' where there is none, null for others."""
    ship(rows.sparkSession)
    content = F.when(F.col("media_type") == "application/pdf", F.col("content"))
    return rows.withColumn("__layer", F.when(content.isNotNull(), pdf.layer(content)["text"]))


def _pdf_notes(notes: Column) -> Column:
    """The notes of a row, with those on its text layer before them."""
    has = F.trim("__layer") != ""
    return F.when(F.col("__layer").isNull(), notes).when(has, F.concat(F.array(F.lit(LAYER)), notes)).otherwise(F.concat(F.array(F.lit(SCAN), F.lit(NO_RENDERER)), notes))


def _typed(rows: DataFrame) -> DataFrame:
    """What a file gives by its ``media_type``: its text where it is text or has a text layer, else a note on what is needed."""
    rows, media = _layers(rows), F.col("media_type")
    edi, text, image, is_pdf = media == "application/edi", media.startswith("text/"), media.startswith("image/"), media == "application/pdf"
    note = (
        F.when(edi, "structured message: parsed, never recognised").when(image, "raster input: recognition required, no text layer exists")
        .when(~text & ~is_pdf, F.format_string("unrecognised type '%s'; refusing to guess a parser", media))
    )
    layered = F.coalesce(F.trim("__layer") != "", F.lit(False))
    shown = F.when(edi | text, F.decode("content", "UTF-8")).when(layered, F.col("__layer")).otherwise("")
    notes = _pdf_notes(F.filter(F.array(note), lambda x: x.isNotNull()))
    return rows.withColumn("text", shown).withColumn("has_text_layer", edi | text | layered).withColumn("structured", edi).withColumn("notes", notes)


def extract_bytes(files: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """Of ``files(id long, filename, mime, content binary)``: one row for each file, and one more for each attachment of a mail.

    The text layer of a PDF file's first page is read where it is. ``layers(id, part_no, layer)`` holds text layers that another reader found,
    which count instead, as for files that this one cannot read. A null file is an empty
    one, of no known type unless its name or declared type says it. A mail within a mail is an attachment of type message, kept as bytes' text.
    """
    named = files.select(F.col("id").cast("long"), F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("mime", F.lit("")).alias("mime"), F.coalesce("content", F.lit("").cast("binary")).alias("content"))
    named = named.withColumn("media_type", K.sniff(F.col("content"), F.col("filename"), F.col("mime")))
    single = _typed(named.where(~F.col("media_type").isin(*MAIL))).withColumn("part_no", F.lit(0)).withColumn("channel", K.channel(F.col("media_type"), F.lit(False)))
    taken = _layers(mail.extract(named.where(F.col("media_type").isin(*MAIL)).select("id", "content"), keep=True))
    body = F.col("kind") == "text"
    media = F.col("media_type")
    edi, text = ~body & (media == "application/edi"), media.rlike("^(text/|message/)")
    note = (
        F.when(edi, "structured message: parsed, never recognised").when(media.startswith("image/"), "raster input: recognition required, no text layer exists")
        .when(~body & ~text & (media != "application/pdf"), F.format_string("unrecognised type '%s'; refusing to guess a parser", media))
    )
    notes = _pdf_notes(F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.filter(F.array(note), lambda x: x.isNotNull())))
    layered = F.coalesce(F.trim("__layer") != "", F.lit(False))
    parts = taken.withColumn("notes", notes).withColumn("text", F.when(layered, F.col("__layer")).otherwise(F.col("text"))).withColumn("has_text_layer", body | edi | text | layered).withColumn("structured", edi)
    out = single.select(*OUT).unionByName(parts.select(*OUT))
    if layers is None:
        return out
    have = F.col("layer").isNotNull() & (F.col("media_type") == "application/pdf")
    joined = out.join(layers.select("id", "part_no", "layer"), ["id", "part_no"], "left")
    joined = joined.withColumn("text", F.when(have, F.col("layer")).otherwise(F.col("text"))).withColumn("has_text_layer", have | F.col("has_text_layer"))
    return joined.withColumn("notes", F.when(have, F.array().cast("array<string>")).otherwise(F.col("notes"))).select(*OUT)


def ingest(files: DataFrame, layers: DataFrame | None = None, recognised: DataFrame | None = None) -> DataFrame:
    """(id, part_no, filename, media_type, channel, path, text, used_ocr, notes): a captured text for each file and attachment; the body comes first.

    ``recognised(id, part_no, ocr_text, ocr_confidence)`` stands for a recogniser's results. Notes of extraction come before those of capture.
    """
    got = K.capture(extract_bytes(files, layers), recognised, ["id", "part_no"], ("filename", "media_type", "notes"))
    notes = F.filter(F.concat("notes", F.array("note")), lambda x: x != "")
    return got.select("id", "part_no", "filename", "media_type", "channel", "path", "text", "used_ocr", notes.alias("notes"))


def describe(captured: DataFrame) -> DataFrame:
    """(id, audit): a line for each part of a file with its channel, path and cost, followed by its notes."""
    cost = F.when(F.col("used_ocr"), "OCR").otherwise("free")
    line = F.format_string("  %d. %-18s %-11s %s", F.col("part_no") + 1, "channel", "path", cost)
    lines = F.concat(F.array(line), F.transform("notes", lambda n: F.concat(F.lit("       - "), n)))
    each = captured.select("id", F.struct("part_no", F.array_join(lines, "\n").alias("x")).alias("x"))
    return each.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda e: e["x"]), "\n").alias("audit"))
