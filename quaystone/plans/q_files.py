"""Queries over mails, rasters, training lines and the confidence head."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model as MO
from ..operators import ocr as OC
from ..operators import score as S
from ..sources import files as FI
from ..sources import mail as MA
from . import duck as D
from .q_extract import pay

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("extract_email", """WITH m AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE text IS NOT NULL)
SELECT id, 0 AS part_no, 'text' AS kind, 'message/rfc822' AS media_type, 'email-body' AS channel, length(text) AS chars FROM m
UNION ALL SELECT id, 1, 'attachment', 'application/edi', 'email-attachment', length('{1:F01}' || id) FROM m""")
def extract_email(spark, d):
    """Each turn as a mail with its text and one attachment, taken apart again."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    head = "From: a@example.com\nTo: b@example.com\nSubject: turn\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=\"edge\"\n\n--edge\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"
    tail = F.concat(F.lit("\n--edge\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename=\"pay.edi\"\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.concat(F.lit("{1:F01}"), F.col("id").cast("string")).cast("binary")), F.lit("\n--edge--\n"))
    mails = turns.select("id", F.concat(F.lit(head), F.base64(F.col("text").cast("binary")), tail).cast("binary").alias("content"))
    return MA.extract(mails).select("id", "part_no", "kind", "media_type", "channel", F.length("text").cast("long").alias("chars"))


@query("connected_boxes", """WITH RECURSIVE c AS MATERIALIZED (SELECT vec_id AS id, (k - 1) % 8 AS x, (k - 1) // 8 AS y FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS k, embedding FROM embeddings WHERE len(embedding) % 8 = 0) WHERE embedding[k] > 0.05),
 g(id, x, y, root) AS (SELECT id, x, y, y * 100000 + x FROM c UNION SELECT c.id, c.x, c.y, g.root FROM g JOIN c ON c.id = g.id AND abs(c.x - g.x) + abs(c.y - g.y) = 1 WHERE g.root < c.y * 100000 + c.x),
 r AS (SELECT id, x, y, min(root) AS root FROM g GROUP BY id, x, y)
 SELECT id, CAST(min(x) AS INTEGER) AS x0, CAST(min(y) AS INTEGER) AS y0, CAST(max(x) AS INTEGER) AS x1, CAST(max(y) AS INTEGER) AS y1 FROM r GROUP BY id, root""")
def connected_boxes(spark, d):
    """Vectors of 64 as 8 x 8 rasters."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").where("size(embedding) % 8 = 0").select(F.col("vec_id").alias("id"), "embedding")
    return OC.regions(rows, 8, 0.05)


TILES = """t AS (SELECT vec_id // 16 AS image, vec_id % 4 AS tx, (vec_id % 16) // 4 AS ty, embedding FROM embeddings WHERE len(embedding) = 64),
 c AS MATERIALIZED (SELECT image, tx * 8 + (k - 1) % 8 AS x, ty * 8 + (k - 1) // 8 AS y FROM (SELECT image, tx, ty, unnest(range(1, 65)) AS k, embedding FROM t) WHERE embedding[k] > 0.05)"""


@query("tiled_regions", f"""WITH RECURSIVE {TILES}, g(image, x, y, root) AS (SELECT image, x, y, y * 100000 + x FROM c
 UNION SELECT c.image, c.x, c.y, g.root FROM g JOIN c ON c.image = g.image AND abs(c.x - g.x) + abs(c.y - g.y) = 1 WHERE g.root < c.y * 100000 + c.x),
 r AS (SELECT image, x, y, min(root) AS root FROM g GROUP BY image, x, y)
 SELECT image, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS cells FROM r GROUP BY image, root""")
def tiled_regions(spark, d):
    """Vectors of 64 as tiles of 8 x 8, sixteen of them a raster of 32 x 32: regions across the tiles' edges."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").where("size(embedding) = 64")
    tiles = v.select(F.floor(F.col("vec_id") / 16).alias("image"), (F.col("vec_id") % 4).alias("tx"), F.floor(F.col("vec_id") % 16 / 4).alias("ty"), F.col("embedding").alias("values"))
    return OC.tiled_regions(tiles, 8, 0.05)


@query("confidence_head")
def confidence_head(spark, d):
    """A class-weighted fit on vectors; its separation of right from wrong is tested."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("y", (F.col("label") % 2).cast("int"))
    scored = MO.confidence(MO.fit_confidence(rows, "embedding", "y"), rows, "embedding")
    return scored.groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


@query("sink_training_jsonl", f"""WITH {D.payments()} SELECT payment_id, '{{"query":"pay ' || "PmtId_EndToEndId" || '","tools":[{{"name":"extract_payment","parameters":"s"}}],"answers":[{{"name":"extract_payment","arguments":{{"PmtId_EndToEndId":"' || "PmtId_EndToEndId" || '"}}}}],"reasoning":""}}' AS value FROM p""")
def sink_training_jsonl(spark, d):
    e = F.col("PmtId_EndToEndId")
    rows = pay(spark, d).select("payment_id", F.concat(F.lit("pay "), e).alias("span"), F.lit("s").alias("schema"), F.create_map(F.lit("PmtId_EndToEndId"), e).alias("values"), F.lit("").alias("reasoning"))
    line = FI.training_line()
    return rows.select("payment_id", line.alias("value"))


@query("directory_file", f"""WITH {D.payments()} SELECT upper("CdtrAcct_IBAN") AS iban, max("CdtrAgt_BICFI") AS expected FROM p GROUP BY 1""")
def directory_file(spark, d):
    """A directory as JSON text, read back into rows."""
    one = pay(spark, d).select(F.to_json(F.create_map(F.lower("CdtrAcct_IBAN"), "CdtrAgt_BICFI")).alias("value"))
    return FI.directory_rows(one).groupBy("iban").agg(F.max("expected").alias("expected"))


@query("sink_report_json", f"SELECT lang, count(*) AS docs, {D.rate('sum(n_chars)', 'count(*)')} AS mean_chars FROM documents GROUP BY lang")
def sink_report_json(spark, d):
    """A small report through JSON text and back."""
    r = spark.read.parquet(f"{d}/documents.parquet").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("c"))
    r = r.select("lang", "docs", S.rate(F.col("c"), F.col("docs")).alias("mean_chars"))
    return r.select(F.from_json(F.to_json(F.struct("*")), r.schema).alias("r")).select("r.*")
