"""MIME mail as a table function: one row for the body, then one for each attachment."""

from __future__ import annotations

import email
from collections.abc import Iterator
from email.policy import default
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import capture as K
from ..shipping import ship

TEXT = pa.struct([("html", pa.bool_()), ("text", pa.string())])
PART = pa.schema([("id", pa.int64()), ("part_no", pa.int32()), ("kind", pa.string()), ("filename", pa.string()), ("media_type", pa.string()), ("content", pa.binary()), ("texts", pa.list_(TEXT)), ("notes", pa.list_(pa.string()))])
PART_DDL = "id long, part_no int, kind string, filename string, media_type string, content binary, texts array<struct<html: boolean, text: string>>, notes array<string>"


#: Headers of at most so many characters are kept as parsed, and at most so many of them in a worker.
LONGEST, KEPT = 1000, 4096


@lru_cache(KEPT)
def _parsed(name: str, value: str) -> str:
    return default.header_factory(name, value)


def _header(name: str, value: str) -> str:
    """A header as the policy parses it, which depends on its name and value alone; a message parses it anew each time that it is asked."""
    return _parsed(name, value) if len(value) <= LONGEST else default.header_factory(name, value)


POLICY = default.clone(header_factory=_header)


def parts(data: bytes) -> Iterator[tuple]:
    """The body (0, 'text') with all its texts in order, then the attachments (from 1 on). What cannot be decoded leaves a note on the body."""
    msg = email.message_from_bytes(data, policy=POLICY)
    texts, notes, attached = [], [], []
    for p in msg.walk():
        kind = p.get_content_type()
        if p.is_multipart() or "attachment" in str(p.get("Content-Disposition") or "").lower() or (msg.is_multipart() and kind not in ("text/plain", "text/html")):
            continue
        try:
            content = p.get_content()
        except (LookupError, UnicodeDecodeError):
            notes.append(f"a {kind} part could not be decoded")
            continue
        text = content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")
        texts.append({"html": kind == "text/html", "text": text.encode("utf-8", "replace").decode()})
    for p in msg.iter_attachments() if msg.is_multipart() else ():
        payload = p.get_payload(decode=True)
        if isinstance(payload, bytes):
            attached.append((len(attached) + 1, "attachment", p.get_filename() or "attachment", p.get_content_type(), payload, None, []))
        else:
            notes.append("an attachment without bytes was skipped")
    if attached:
        notes.append(f"{len(attached)} attachments kept apart from the body")
    yield 0, "text", "", "message/rfc822", None, texts, notes
    yield from attached


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(i, *p) for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p in parts(data or b"")]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), PART, strict=True)], schema=PART)


def extract(mails: DataFrame, keep: bool = False) -> DataFrame:
    """Of ``mails(id long, content binary)``: (id, part_no, kind, filename, media_type, channel, text, notes).

    One row for the body, its texts joined by new lines (HTML flattened, blank ones left out), and one for each attachment, whose type is
    sniffed. A null mail has an empty body. ``keep`` adds content, an attachment's bytes.
    """
    ship(mails.sparkSession)
    rows = mails.select(F.col("id").cast("long"), "content").mapInArrow(_explode, PART_DDL)
    media = F.when(F.col("kind") == "text", F.col("media_type")).otherwise(K.sniff(F.col("content"), F.col("filename"), F.col("media_type")))
    body = F.transform("texts", lambda x: F.when(x["html"], T.html_to_text(x["text"])).otherwise(x["text"]))
    body = F.array_join(F.filter(body, lambda x: F.trim(F.translate(x, "\t\r\n", "   ")) != ""), "\n")
    attached = F.when(media.rlike("^(text/|message/|application/edi)"), F.decode("content", "UTF-8")).otherwise("")
    shown = F.when(F.col("kind") == "text", body).otherwise(attached)
    return rows.select("id", "part_no", "kind", "filename", media.alias("media_type"), K.channel(media, F.col("kind") == "attachment").alias("channel"), shown.alias("text"), "notes", *(["content"] if keep else []))
