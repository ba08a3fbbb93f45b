"""Queries over runs and files: labelling that resumes, streams in several starts, sinks and scans of files written from the tables."""

from __future__ import annotations

import zlib
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mt as M
from ..operators import payments as P
from ..sources import files as FI
from ..shipping import ship
from ..sources import jsonl, shared, teaching
from ..sources import pdf as PDF
from ..streaming import append as A
from . import duck as D
from .q_message import message
from .q_sequence import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("teacher_run", """WITH u AS (SELECT t.conv_id * 100000 + t.turn AS span_id, n.text AS reply FROM conversations t LEFT JOIN conversations n ON n.conv_id = t.conv_id AND n.turn = t.turn + 1 WHERE t.role = 'user')
 SELECT span_id, CAST(2 AS BIGINT) AS samples, CAST(2 * least(span_id % 5 + 1, 3) AS BIGINT) AS calls, CAST(CASE WHEN span_id % 5 > 2 OR reply IS NULL THEN 2 ELSE 0 END AS BIGINT) AS failed,
 CASE WHEN span_id % 5 <= 2 AND reply IS NOT NULL THEN md5(reply) ELSE '' END AS answer_md5 FROM u""")
def teacher_run(spark, d):
    """Two starts of a labelling run over the user's turns: first those of even conversations, then all. The teacher, whose reply is the turn
    that followed, is out of reach up to four times, and is asked three times at most; a reply without an object is an error."""
    turns = table(spark, d, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.to_json(F.struct(F.struct(F.col("text").alias("answer")).alias("values"))).alias("reply"))
    asked = turns.where("role = 'user'").join(after, ["conv_id", "turn"], "left").withColumn("span_id", F.col("conv_id") * 100_000 + F.col("turn"))
    asked = asked.select("conv_id", "span_id", F.col("text").alias("span"), "reply", (F.col("span_id") % 5).alias("busy"))
    out, work = shared.folder(spark, "labels"), shared.folder(spark, "requests")
    for some in (asked.where("conv_id % 2 = 0"), asked):
        teaching.run(some.drop("conv_id"), out, work, "quaystone.operators.teacher:canned", samples=2, tries=3, waves=2)
    failed, answer = F.count_if(F.col("error").isNotNull()), F.max(F.get_json_object("values", "$.answer"))
    return teaching.labels_of(spark, out).groupBy("span_id").agg(F.count("*").alias("samples"), F.sum("calls").alias("calls"), failed.alias("failed"), F.coalesce(F.md5(answer), F.lit("")).alias("answer_md5"))


@query("sink_jsonl", "SELECT doc_id, coalesce(md5(text), '') AS text_md5, lang, n_chars FROM documents")
def sink_jsonl(spark, d):
    """Documents appended as JSON lines in two runs, of which the second leaves out what the first has written, and read back."""
    docs, out = table(spark, d, "documents"), shared.folder(spark, "lines")
    jsonl.write(docs.where("doc_id % 3 > 0"), out)
    held = spark.read.schema(docs.schema).json(out)
    jsonl.write(docs.join(held.select("doc_id"), "doc_id", "left_anti"), out)
    return spark.read.schema(docs.schema).json(out).select("doc_id", F.coalesce(F.md5("text"), F.lit("")).alias("text_md5"), "lang", "n_chars")


GAP = timedelta(hours=6)


def replayed(spark: SparkSession, d: str) -> tuple[str, A.Progress]:
    """The events in six files of five days, by their time; a first start of the stream after three of them, a second after all."""
    events, base, seen = table(spark, d, "events"), shared.folder(spark, "visits"), A.Progress()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    spark.streams.addListener(seen)
    try:
        for start in range(2):
            for part in range(3 * start, 3 * start + 3):
                days = F.least(F.floor((F.dayofmonth("ts") - 1) / 5), F.lit(5))
                events.where(days == part).coalesce(1).write.mode("append").parquet(f"{base}/in")
            stream = A.visit_stream(spark, f"{base}/in", kinds, "user_id", "ts", GAP, "1 hour", f"{base}/out", f"{base}/checkpoint")
            stream.awaitTermination()
            A.settled(seen, stream)
    finally:
        spark.streams.removeListener(seen)
    return f"{base}/out", seen


@query("visit_stream", """SELECT user_id AS key, epoch_us(ts) // 1000 AS began_ms FROM (SELECT user_id, ts, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR epoch_us(ts) // 1000 - before > 21600000""")
def visit_stream(spark, d):
    """Visits of each user by a stream in two starts, the same as those of the whole table at once."""
    return spark.read.schema("key long, began_ms long").parquet(replayed(spark, d)[0])


@query("stream_progress", """SELECT CAST(start AS INTEGER) AS start, sum(n)::BIGINT AS rows_in, CAST(0 AS BIGINT) AS late_rows, true AS keys_expire FROM
 (SELECT least((day(ts) - 1) // 5, 5) // 3 AS start, count(*) AS n FROM events GROUP BY 1) GROUP BY start""")
def stream_progress(spark, d):
    """What the listener has kept of both starts: rows in, late rows, and whether fewer keys were held at a start's end than at its most."""
    rows = replayed(spark, d)[1].table(spark)
    by = rows.groupBy("run_id").agg(F.min("batch").alias("first"), F.sum("rows_in").alias("rows_in"), F.sum("late_rows").alias("late_rows"), (F.max_by("state_rows", "batch") < F.max("state_rows")).alias("keys_expire"))
    return by.select((F.col("first") > 0).cast("int").alias("start"), "rows_in", "late_rows", "keys_expire")


SUPPLIERS = "(SELECT s_suppkey AS o_orderkey, 1000 + abs(s_acctbal) AS o_totalprice, TIMESTAMP '2026-01-02' AS o_orderdate FROM supplier)"


def fixtures(spark: SparkSession, d: str, kind: str) -> str:
    """A folder with a file for each supplier: its payment as a message (mt or mx), or for every fifth a text that is none."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("o_orderkey"), (1000 + F.abs("s_acctbal")).alias("o_totalprice"), F.lit("2026-01-02 00:00:00").cast("timestamp").alias("o_orderdate"))
    p = P.payments(FI.spread(s))
    text = M.render(message(p)) if kind == "mt" else M.mx_render(message(p))
    path = shared.folder(spark, f"fixtures-{kind}")
    files = p.select(F.when(F.col("payment_id") % 5 == 0, "nothing to see").otherwise(text).alias("value"))
    # tasks move their own files into place, the driver touches none
    out = files.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    if kind == "mt":
        out.text(path)
    else:  # XML files go by their ending, which the writer of lines cannot choose; no text has a control character, so nothing is quoted
        out.option("extension", "xml").csv(path, sep="\x01", quote="", escape="\x02", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    return path


def _fields_sql() -> str:
    return f"""WITH {D.payments(SUPPLIERS)} SELECT "CdtrAcct_IBAN" AS account, "Cdtr_Nm" AS name, "PmtId_EndToEndId" AS e2e FROM p WHERE payment_id % 5 <> 0"""


def _fields(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("fields")["CdtrAcct_IBAN"].alias("account"), F.col("fields")["Cdtr_Nm"].alias("name"), F.col("fields")["PmtId_EndToEndId"].alias("e2e"))


@query("scan_fixture_text", _fields_sql())
def scan_fixture_text(spark, d):
    """Fields of the MT messages in a folder of text files; files that hold none are passed over."""
    return _fields(FI.mt_texts(spark, fixtures(spark, d, "mt")))


@query("scan_fixture_xml", _fields_sql())
def scan_fixture_xml(spark, d):
    """Fields of the MX messages in a folder of XML files."""
    return _fields(FI.mx_texts(spark, fixtures(spark, d, "mx")))


@query("scan_bytes", "SELECT octet_length(encode(html)) AS n, md5(html) AS digest, count(*) AS files FROM (SELECT coalesce(html, '') || chr(10) AS html FROM pages) GROUP BY 1, 2")
def scan_bytes(spark, d):
    """Every page as a file of its own, read as bytes."""
    path = shared.folder(spark, "pages")
    table(spark, d, "pages").select(F.coalesce("html", F.lit("")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    found = FI.bytes_of(spark, path).where("path like '%.txt'").where("length > 0")
    return found.groupBy(F.col("length").alias("n"), F.md5("content").alias("digest")).agg(F.count("*").alias("files"))


@query("scan_jsonl_tolerant", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, '' AS difficulty, coalesce(length(text), 0) AS chars, 0.0::DOUBLE AS seconds FROM documents WHERE doc_id % 4 <> 1")
def scan_jsonl_tolerant(spark, d):
    """Label records as JSON lines, every fourth of which is cut short; what cannot be read is left out and missing fields get defaults."""
    path = shared.folder(spark, "labels")
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    table(spark, d, "documents").select(F.when(F.col("doc_id") % 4 == 1, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    return FI.labels_of(spark, path).select("doc_id", "difficulty", F.length("text").cast("long").alias("chars"), "seconds")


def _page_of(text: str, kind: int) -> bytes:
    """A PDF file that shows the lines of a text: plain (0), deflated (1), deflated with a map of its codes (2 and 3), without a text (4), cut short (5)."""
    lines = text.split("\n")
    mapped = kind in (2, 3) or kind < 2 and any(ord(c) > 126 for c in text)
    if mapped:
        codes = {c: k for k, c in enumerate(sorted(set(text)), 1)}
        cmap = "1 begincodespacerange <0000> <ffff> endcodespacerange\n" + "".join(f"1 beginbfchar <{k:04x}> <{c.encode('utf-16-be').hex()}> endbfchar\n" for c, k in codes.items())
        shown = ["<" + "".join(f"{codes[c]:04x}" for c in line) + ">" for line in lines]
    else:
        cmap, shown = "", ["(" + line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").replace("\r", "\\r") + ")" for line in lines]
    body = ("BT /F1 9 Tf 40 800 Td " + "".join(f"{s} Tj T*\n" for s in shown) + "ET" if kind != 4 else "q /Im0 Do Q").encode("latin-1")

    def stream(n: int, data: bytes, squeeze: bool) -> bytes:
        data = zlib.compress(data) if squeeze else data
        return b"%d 0 obj\n<</Length %d%s>>\nstream\n%s\nendstream\nendobj\n" % (n, len(data), b"/Filter/FlateDecode" if squeeze else b"", data)

    font = b"<</Type/Font%s>>" % (b"/ToUnicode 6 0 R" if mapped else b"")
    out = b"%%PDF-1.5\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[3 0 R]/Count 1>>\nendobj\n3 0 obj\n<</Type/Page/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>\nendobj\n5 0 obj\n%s\nendobj\n" % font
    out += stream(6, cmap.encode(), True) + stream(4, body, kind != 0)
    return out if kind != 5 else out[:60]


@query("extract_pdf", """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') ELSE '' END AS shown, doc_id % 6 AS kind FROM documents)
 SELECT doc_id, CASE kind WHEN 5 THEN 'no page' ELSE '' END AS reason, length(shown) AS chars, md5(shown) AS text_md5 FROM x""")
def extract_pdf(spark, d):
    """Every document as a PDF file of one of six kinds, and the text that is read from it; blanks do not count."""
    import pandas as pd

    ship(spark)
    made = F.pandas_udf(lambda texts, kinds: pd.Series([_page_of(t, k) for t, k in zip(texts, kinds, strict=True)]), "binary")
    files = table(spark, d, "documents").select("doc_id", made(F.coalesce("text", F.lit("")), (F.col("doc_id") % 6).cast("int")).alias("content"))
    read = files.select("doc_id", PDF.layer(F.col("content")).alias("p")).withColumn("shown", F.regexp_replace("p.text", r"[\x20\x09-\x0D]", ""))
    return read.select("doc_id", F.col("p.reason").alias("reason"), F.char_length("shown").cast("long").alias("chars"), F.md5("shown").alias("text_md5"))
