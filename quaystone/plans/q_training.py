"""Queries around a training run: masked sequences, batches, held-out loss and accuracy, separation of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import training as TR
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


def examples(spark: SparkSession, d: str) -> DataFrame:
    """(id, prompt, answer): every turn with the turn before it as its prompt."""
    turns = table(spark, d, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.concat(F.lit("Q: "), F.coalesce("text", F.lit("")), F.lit("\nA: ")).alias("prompt"))
    return turns.join(before, ["conv_id", "turn"], "left").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), "prompt", F.col("text").alias("answer"))


EXAMPLES = """x AS (SELECT t.conv_id * 100000 + t.turn AS id, CASE WHEN p.conv_id IS NULL THEN '' ELSE 'Q: ' || coalesce(p.text, '') || chr(10) || 'A: ' END AS asked, coalesce(t.text, '') AS answer
 FROM conversations t LEFT JOIN conversations p ON p.conv_id = t.conv_id AND p.turn + 1 = t.turn),
 e AS (SELECT id, asked || answer AS whole, octet_length(encode(asked || answer)) AS n, octet_length(encode(asked)) AS p FROM x)"""


@query("encode_mask", f"""WITH {EXAMPLES} SELECT id, CASE WHEN n > 256 THEN 'too long' WHEN n = p THEN 'all masked' END AS dropped, CASE WHEN n <= 256 AND n > p THEN n ELSE -1 END AS n_ids,
 CASE WHEN n <= 256 AND n > p THEN p ELSE -1 END AS n_masked, CASE WHEN n <= 256 AND n > p THEN md5(whole) END AS text_md5 FROM e""")
def encode_mask(spark, d):
    """Sequences of byte ids with the prompt masked; the digest is that of the text that the ids stand for."""
    made = TR.encode_mask(examples(spark, d))
    masked = F.size(F.filter("labels", lambda x: x == TR.IGNORED)).cast("long")
    text = F.unhex(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i - TR.SPECIALS), 2, "0")), ""))
    has = F.col("ids").isNotNull()
    return made.select("id", "dropped", F.when(has, F.size("ids")).otherwise(-1).cast("long").alias("n_ids"), F.when(has, masked).otherwise(-1).cast("long").alias("n_masked"), F.when(has, F.md5(text)).alias("text_md5"))


@query("batch_pad", f"""WITH {EXAMPLES}, k AS (SELECT id, n, p, CAST(ceil(n / 8.0) * 8 AS INTEGER) AS width FROM e WHERE n <= 256 AND n > p)
 SELECT id, width, CAST((row_number() OVER (PARTITION BY width ORDER BY id) - 1) // 16 AS BIGINT) AS batch, CAST(width - n AS BIGINT) AS n_pad, CAST(width - n + p AS BIGINT) AS n_ignored FROM k""")
def batch_pad(spark, d):
    """Batches of 16 sequences of one width, filled up to it."""
    rows = TR.padded(TR.batches(TR.encode_mask(examples(spark, d))))
    count = lambda c, v: F.size(F.filter(c, lambda x: x == v)).cast("long")
    return rows.select("id", F.size("ids").alias("width"), "batch", count("ids", TR.PAD).alias("n_pad"), count("labels", TR.IGNORED).alias("n_ignored"))


@query("encode_vocabulary")
def encode_vocabulary(spark, d):
    """Sequences by a public vocabulary, at most 256 ids; held against that tokenizer in the tests."""
    import public_tokenizers

    made = TR.encode_mask(examples(spark, d), public_tokenizers.path("byte_bpe_50k.json"))
    return made.select("id", "dropped", F.size("ids").alias("n_ids"), F.size(F.filter("labels", lambda x: x == TR.IGNORED)).alias("n_masked"))


@query("token_accuracy", """WITH v AS (SELECT vec_id, label, embedding FROM embeddings), l AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS position, CASE WHEN vec_id % 5 = 0 THEN -100 ELSE label END AS label, label % 3 AS kind FROM v),
 x AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS position, [8 * e::DOUBLE for e in embedding] AS z FROM v),
 j AS (SELECT kind, label, z, list_max(z) AS m FROM x JOIN l ON x.seq = l.seq AND x.position + 1 = l.position WHERE label <> -100)
 SELECT kind, count(*) AS positions, round(avg(m + ln(list_sum([exp(e - m) for e in z])) - z[label + 1]), 6) AS loss, round(avg(CASE WHEN list_position(z, m) - 1 = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM j GROUP BY kind""")
def token_accuracy(spark, d):
    """Vectors as the logits of a position, in sequences of 16; labels as tokens, every fifth ignored."""
    v = table(spark, d, "embeddings").withColumns({"seq": F.floor(F.col("vec_id") / 16), "position": F.col("vec_id") % 16})
    logits = v.select("seq", "position", F.posexplode("embedding").alias("class", "x")).withColumn("logit", 8 * F.col("x").cast("double"))
    labels = v.select("seq", "position", F.when(F.col("vec_id") % 5 == 0, TR.IGNORED).otherwise(F.col("label")).alias("label"), (F.col("label") % 3).alias("kind"))
    return TR.held_out(logits, labels, ["kind"]).withColumns({"loss": F.round("loss", 6), "accuracy": F.round("accuracy", 6)})


@query("confidence_separation", """WITH v AS (SELECT vec_id, label % 2 AS y, embedding FROM embeddings), u AS (SELECT y, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS k FROM v WHERE vec_id % 2 = 0),
 m AS (SELECT y, list(a ORDER BY k) AS mean FROM (SELECT y, k, avg(x) AS a FROM u GROUP BY y, k) GROUP BY y),
 s AS (SELECT v.y, list_sum([(v.embedding[i]::DOUBLE - a.mean[i]) ** 2 for i in range(1, len(v.embedding) + 1)]) - list_sum([(v.embedding[i]::DOUBLE - b.mean[i]) ** 2 for i in range(1, len(v.embedding) + 1)]) AS score
 FROM v, m a, m b WHERE vec_id % 2 = 1 AND a.y = 0 AND b.y = 1), r AS (SELECT y, round(score, 3) AS score FROM s),
 k AS (SELECT y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS place FROM r)
 SELECT count(*) AS n, round(avg(y::DOUBLE), 6) AS base_rate, round(avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0), 6) AS separation,
 round((sum(place) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM k""")
def confidence_separation(spark, d):
    """A head fitted on one half of the vectors, its scores (to three places, so that some are equal) on the other half."""
    v = table(spark, d, "embeddings")
    scored = TR.centroid_head(v, "embedding", F.col("label") % 2, F.col("vec_id") % 2 == 0).withColumn("score", F.round("score", 3))
    return TR.separation(scored).withColumns({c: F.round(c, 6) for c in ("base_rate", "separation", "auc")})
