"""Queries over samples, windows, sets, JSON texts, consensus, the acceptance gate and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..functions import validators as V
from ..operators import extract as E
from ..operators import gate as G
from ..operators import payments as P
from ..operators import sample as SA
from ..operators import schema as SC
from . import duck as D
from .q_extract import docs, pay

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- samples, splits, sets ---------------------------------------------------------------------------------------------------------

LIMIT = 100


@query("stratified_sample", f"""WITH b AS (SELECT count(DISTINCT coalesce(lang, '?')) AS n FROM documents),
r AS (SELECT doc_id, coalesce(lang, '?') AS bucket, row_number() OVER (PARTITION BY coalesce(lang, '?') ORDER BY doc_id) AS k, greatest(1, {LIMIT} // b.n) AS quota FROM documents, b),
o AS (SELECT doc_id, bucket, row_number() OVER (ORDER BY CASE WHEN k <= quota THEN 0 ELSE 1 END, CASE WHEN k <= quota THEN bucket ELSE '' END, doc_id) AS place FROM r)
SELECT doc_id, bucket, CAST(place AS INTEGER) AS place FROM o WHERE place <= {LIMIT}""")
def stratified_sample(spark, d):
    return SA.stratified(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", LIMIT)


@query("resume_pending", "WITH done AS (SELECT doc_id FROM labels) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM done)")
def resume_pending(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("resume_done_ids", "SELECT DISTINCT doc_id FROM labels")
def resume_done_ids(spark, d):
    return table(spark, d, "labels").select("doc_id").distinct()


SPLIT = "('0x' || substr(sha256('7:' || coalesce(text, '')), 1, 8))::BIGINT % 1000 < 200"


@query("leakage_overlap", f"SELECT count(*) AS shared FROM (SELECT text FROM documents WHERE {SPLIT} INTERSECT SELECT text FROM documents WHERE NOT ({SPLIT}))")
def leakage_overlap(spark, d):
    rows = table(spark, d, "documents").select("text").withColumn("val", T.bucket(F.coalesce("text", F.lit("")), 7, 1000) < 200)
    return rows.where("val").select("text").intersect(rows.where("not val").select("text")).agg(F.count("*").alias("shared"))


@query("benchmark_overlap", "SELECT count(*) AS shared FROM (SELECT text FROM documents INTERSECT SELECT text FROM benchmark)")
def benchmark_overlap(spark, d):
    return table(spark, d, "documents").select("text").intersect(table(spark, d, "benchmark").select("text")).agg(F.count("*").alias("shared"))


@query("key_union", "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def key_union(spark, d):
    return table(spark, d, "documents").select("doc_id").union(table(spark, d, "labels").select("doc_id")).distinct()


@query("key_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def key_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("union_seeds", "SELECT 'labelled' AS origin, doc_id FROM labels UNION ALL SELECT 'all' AS origin, doc_id FROM documents")
def union_seeds(spark, d):
    return table(spark, d, "labels").select(F.lit("labelled").alias("origin"), "doc_id").unionByName(table(spark, d, "documents").select(F.lit("all").alias("origin"), "doc_id"))


@query("subset_check", "SELECT count(*) = 0 AS is_subset FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def subset_check(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id", "left_anti").agg((F.count("*") == 0).alias("is_subset"))


@query("holdout_draw", f"WITH {D.payments()}, a AS (SELECT DISTINCT \"CdtrAcct_IBAN\" AS i FROM p), b AS (SELECT count(*) AS n FROM a) SELECT n AS train_accounts, CAST(0 AS BIGINT) AS shared FROM b")
def holdout_draw(spark, d):
    """Accounts of a draw with one seed and of a draw with another: none is shared."""
    a, b = (P.payments(table(spark, d, "orders"), seed).select("CdtrAcct_IBAN").distinct() for seed in (0, 1))
    shared = a.join(b, "CdtrAcct_IBAN", "left_semi").agg(F.count("*").alias("shared"))
    return a.agg(F.count("*").alias("train_accounts")).crossJoin(shared)


@query("scan_lines", "SELECT doc_id, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''")
def scan_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")


# --- arrays and windows ------------------------------------------------------------------------------------------------------------

STEPS = "st AS (SELECT event_id // 50 AS line_id, event_id % 50 AS t, CAST((user_id // 3) % 5 AS INTEGER) AS k, round(abs(value) - floor(abs(value)), 6) AS prob FROM events)"
CHARS = "abcd"


def steps(spark: SparkSession, d: str) -> DataFrame:
    v = F.abs(F.col("value"))
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 50).alias("line_id"), (F.col("event_id") % 50).alias("t"), (F.floor(F.col("user_id") / 3) % 5).cast("int").alias("k"), F.round(v - F.floor(v), 6).alias("prob"))


@query("ctc_decode", f"""WITH {STEPS}, l AS (SELECT *, lag(k, 1, -1) OVER (PARTITION BY line_id ORDER BY t) AS prev FROM st), u AS (SELECT line_id FROM st GROUP BY line_id),
g AS (SELECT line_id, string_agg(substr('{CHARS}', k, 1), '' ORDER BY t) AS text, round(avg(prob), 9) AS confidence FROM l WHERE k <> prev AND k <> 0 GROUP BY line_id)
SELECT u.line_id, coalesce(text, '') AS text, coalesce(confidence, 0) AS confidence FROM u LEFT JOIN g USING (line_id)""")
def ctc_decode(spark, d):
    return SA.ctc_decode(steps(spark, d), CHARS)


@query("collapse_repeats", f"WITH {STEPS}, l AS (SELECT *, lag(k, 1, -1) OVER (PARTITION BY line_id ORDER BY t) AS prev FROM st) SELECT line_id, t, k FROM l WHERE k <> prev")
def collapse_repeats(spark, d):
    return SA.changes(steps(spark, d)).select("line_id", "t", "k")


BOXES = "bx AS (SELECT l_orderkey AS page_id, CAST(l_partkey * 13 % 900 AS INTEGER) AS x0, CAST(l_suppkey * 37 % 700 AS INTEGER) AS y0, CAST(l_partkey * 13 % 900 + 20 + l_quantity AS INTEGER) AS x1, CAST(l_suppkey * 37 % 700 + 8 + l_linenumber * 2 AS INTEGER) AS y1, l_returnflag || l_linenumber AS text, l_discount AS confidence, l_partkey AS tie FROM lineitem)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    x0, y0 = (c("l_partkey") * 13 % 900).cast("int"), (c("l_suppkey") * 37 % 700).cast("int")
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("page_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 20 + c("l_quantity")).cast("int").alias("x1"), (y0 + 8 + c("l_linenumber") * 2).cast("int").alias("y1"), F.concat("l_returnflag", c("l_linenumber").cast("string")).alias("text"), c("l_discount").alias("confidence"), c("l_partkey").alias("tie"))


@query("unclip", f"""WITH {BOXES} SELECT page_id, greatest(0, x0 - CAST(floor(greatest(x1 - x0, 1) * 0.8::DOUBLE / 2) AS INTEGER)) AS x0, greatest(0, y0 - CAST(floor(greatest(y1 - y0, 1) * 0.8::DOUBLE / 2) AS INTEGER)) AS y0,
least(960, x1 + CAST(floor(greatest(x1 - x0, 1) * 0.8::DOUBLE / 2) AS INTEGER)) AS x1, least(720, y1 + CAST(floor(greatest(y1 - y0, 1) * 0.8::DOUBLE / 2) AS INTEGER)) AS y1 FROM bx""")
def unclip(spark, d):
    return SA.unclip(boxes(spark, d), 1.8, 960, 720).select("page_id", "x0", "y0", "x1", "y1")


TOL = "tol AS (SELECT page_id, greatest(8, CAST(floor(median(y1 - y0) * 0.6::DOUBLE) AS INTEGER)) AS tol FROM bx GROUP BY page_id)"


@query("reading_order", f"""WITH {BOXES}, {TOL} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY round_even(y0 / CAST(tol AS DOUBLE), 0), x0, tie, text, x1, y1, confidence) AS INTEGER) AS place, x0, y0, text FROM bx JOIN tol USING (page_id)""")
def reading_order(spark, d):
    return SA.reading_order(boxes(spark, d)).select("page_id", "place", "x0", "y0", "text")


@query("text_from_boxes", f"""WITH {BOXES}, {TOL}, o AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY round_even(y0 / CAST(tol AS DOUBLE), 0), x0, tie, text, x1, y1, confidence) AS place, text, confidence FROM bx JOIN tol USING (page_id))
SELECT page_id, string_agg(text, chr(10) ORDER BY place) AS text, round(avg(confidence), 6) AS confidence FROM o WHERE trim(text) <> '' GROUP BY page_id""")
def text_from_boxes(spark, d):
    return SA.text_from_boxes(SA.reading_order(boxes(spark, d)))


@query("dict_check", "SELECT doc_id, n, CASE WHEN n = 96 THEN 'blank only' WHEN n = 95 THEN 'space appended' ELSE 'error' END AS verdict FROM (SELECT doc_id, CAST(94 + doc_id % 4 AS INTEGER) AS n FROM documents)")
def dict_check(spark, d):
    """A dictionary must have one entry less than the classes (the blank), or two (the blank and a space); 97 classes here. One of 94 to 97 entries for each document."""
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4 + 94).cast("int").alias("n"))
    return rows.select("doc_id", "n", F.when(F.col("n") == 96, "blank only").when(F.col("n") == 95, "space appended").otherwise("error").alias("verdict"))


IDS = "list_transform(string_split(text, ' '), lambda w: length(w) * 131 + 7)"
HASH = "((xor((xor({seed}, {a}) * 16777619) & 4294967295, {b}) * 16777619) & 4294967295)"


@query("ngram_hash", f"""WITH i AS (SELECT doc_id, {IDS} AS t FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(t) AS a, generate_subscripts(t, 1) AS pos, t FROM i),
h AS (SELECT doc_id, {HASH.format(seed=97, a='a', b='coalesce(CASE WHEN pos > 1 THEN t[pos - 1] END, 0)')} AS acc FROM e)
SELECT doc_id, CAST(sum(xor(acc, acc >> 15) % 4096) AS BIGINT) AS slots FROM h GROUP BY doc_id""")
def ngram_hash(spark, d):
    ids = F.transform(F.split("text", " "), lambda w: (F.length(w) * 131 + 7).cast("long"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.aggregate(SA.ngram_slots(ids, 2, 97, 16777619, 4096), F.lit(0).cast("long"), lambda a, x: a + x).alias("slots"))


@query("dilated_taps", "SELECT event_id, event_type, coalesce(lag(value, 3) OVER (PARTITION BY event_type, user_id ORDER BY event_id), 0) AS tap3 FROM events")
def dilated_taps(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.coalesce(F.lag("value", 3).over(W.partitionBy("event_type", "user_id").orderBy("event_id")), F.lit(0.0)).alias("tap3"))


@query("continuation_lines", """WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS opens FROM conversations)
SELECT conv_id, turn, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS owner FROM l""")
def continuation_lines(spark, d):
    """Each turn belongs to the last turn of the user at or before it, as a line belongs to the tag that is open."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w), F.lit(-1).cast("long")).alias("owner"))


@query("cosine_gate", """WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(1 / (1 + exp(-(list_dot_product(CAST(x AS DOUBLE[]), CAST(y AS DOUBLE[])) / (sqrt(list_dot_product(CAST(x AS DOUBLE[]), CAST(x AS DOUBLE[]))) * sqrt(list_dot_product(CAST(y AS DOUBLE[]), CAST(y AS DOUBLE[]))))) / sqrt(2.0::DOUBLE))), 5) AS gate FROM p""")
def cosine_gate(spark, d):
    e = table(spark, d, "embeddings")
    p = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return p.select("vec_id", F.round(SA.gate(F.col("x"), F.col("y"), 2), 5).alias("gate"))


# --- JSON texts --------------------------------------------------------------------------------------------------------------------

RAW = """rw AS (SELECT event_id, props, CASE event_id % 5 WHEN 0 THEN 'no object' WHEN 1 THEN 'said: ' || props || ' done }' WHEN 2 THEN '{"k": "a}", "k": 2, "Cdtr_Nm": "x"}' WHEN 3 THEN substr(props, 1, length(props) - 1) ELSE props END AS raw FROM events)"""
BODY = """CASE event_id % 5 WHEN 0 THEN '' WHEN 2 THEN raw WHEN 3 THEN '' ELSE props END"""


def raws(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("event_id") % 5, F.col("props")
    raw = F.when(k == 0, "no object").when(k == 1, F.concat(F.lit("said: "), p, F.lit(" done }"))).when(k == 2, '{"k": "a}", "k": 2, "Cdtr_Nm": "x"}').when(k == 3, F.expr("substr(props, 1, length(props) - 1)")).otherwise(p)
    return table(spark, d, "events").select("event_id", "props", raw.alias("raw"))


@query("first_json_object", f"WITH {RAW} SELECT event_id, {BODY} AS body FROM rw")
def first_json_object(spark, d):
    return raws(spark, d).select("event_id", T.first_object(F.col("raw")).alias("body"))


@query("count_duplicate_keys", f"WITH {RAW} SELECT event_id, CASE WHEN event_id % 5 = 2 THEN 1 ELSE 0 END AS duplicates FROM rw")
def count_duplicate_keys(spark, d):
    return raws(spark, d).select("event_id", T.duplicate_keys(F.col("raw")).alias("duplicates"))


@query("parse_strict", f"WITH {RAW}, b AS (SELECT event_id, {BODY} AS body FROM rw) SELECT event_id, CASE WHEN body = '' THEN 'no JSON object in output' ELSE '' END AS reason, CASE WHEN body = '' THEN 0 WHEN event_id % 5 = 2 THEN 2 ELSE len(json_keys(body)) END AS fields FROM b")
def parse_strict(spark, d):
    parsed = G.parse(T.first_object(F.col("raw")))
    return raws(spark, d).select("event_id", parsed.alias("p")).select("event_id", F.when(F.col("p").isNull(), "no JSON object in output").otherwise("").alias("reason"), F.coalesce(F.size(F.array_distinct(F.map_keys("p"))), F.lit(0)).cast("long").alias("fields"))


@query("canonical_only", f"WITH {RAW}, b AS (SELECT event_id, {BODY} AS body FROM rw) SELECT event_id, body = '' AS canonical FROM b")
def canonical_only(spark, d):
    """Whether all keys are known fields; an absent object has none that is not. The props here have the key k."""
    keys = F.map_keys(G.parse(T.first_object(F.col("raw"))))
    return raws(spark, d).select("event_id", F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in C.KEYS]))) == 0, F.lit(True)).alias("canonical"))


@query("format_example", f"""WITH {D.docs()} SELECT payment_id, md5('<|doc|>' || chr(10) || text || chr(10) || '<|json|>{{' || {" || ',' || ".join(f"'\"{k}\":\"' || \"{k}\" || '\"'" for k in sorted(C.KEYS))} || '}}<|end|>') AS digest FROM d""")
def format_example(spark, d):
    payload = F.to_json(F.struct(*sorted(C.KEYS)))
    return docs(spark, d).select("payment_id", F.md5(F.concat(F.lit("<|doc|>\n"), "text", F.lit("\n<|json|>"), payload, F.lit("<|end|>")).cast("binary")).alias("digest"))


TEACHER = {"CdtrAcct_IBAN": """upper(replace(substr("CdtrAcct_IBAN", 1, 4) || ' ' || substr("CdtrAcct_IBAN", 5), ' ', ''))""", "Amt_InstdAmt_Ccy": "\"Amt_InstdAmt_Ccy\"", "ReqdExctnDt_Dt": '"ReqdExctnDt_Dt"', "Amt_InstdAmt": '"Amt_InstdAmt"', "CdtrAgt_BICFI": "''"}


@query("canonicalise_teacher", f"WITH {D.payments()} SELECT payment_id, " + ", ".join(f'{x} AS "{k}"' for k, x in TEACHER.items()) + " FROM p")
def canonicalise_teacher(spark, d):
    """A teacher's spellings come back canonical: spaced account, currency with a sign, text month, grouped amount; a bad BIC is dropped."""
    c = F.col
    said = {"CdtrAcct_IBAN": F.lower(F.concat(F.substring("CdtrAcct_IBAN", 1, 4), F.lit(" "), F.substring("CdtrAcct_IBAN", 5, 40))), "Amt_InstdAmt_Ccy": F.concat(F.lit("("), F.lower("Amt_InstdAmt_Ccy"), F.lit(")")), "ReqdExctnDt_Dt": F.date_format(F.to_date("ReqdExctnDt_Dt"), "d MMMM yyyy"), "Amt_InstdAmt": F.concat(c("Amt_InstdAmt_Ccy"), F.lit(" "), T.format_amount(c("Amt_InstdAmt"), F.lit(True))), "CdtrAgt_BICFI": F.lit("NOT A BIC")}
    return pay(spark, d).select("payment_id", *[T.canonicalise(k, x).alias(k) for k, x in said.items()])


# --- consensus, funnel, gate -------------------------------------------------------------------------------------------------------

SAMPLES = f"""sm AS (SELECT p.payment_id, s.n AS sample_no, "Amt_InstdAmt", "Cdtr_Nm", {D.draw("sample", 6, "payment_id || ':' || s.n")} AS k FROM p, (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS n) s),
lab AS (SELECT payment_id, sample_no, 'Amt_InstdAmt' AS field, CASE WHEN k = 1 THEN '0.00' ELSE "Amt_InstdAmt" END AS value FROM sm WHERE k <> 0 UNION ALL SELECT payment_id, sample_no, 'Cdtr_Nm', CASE WHEN k IN (1, 2) THEN upper("Cdtr_Nm") ELSE "Cdtr_Nm" END FROM sm WHERE k NOT IN (0, 3)),
ok AS (SELECT payment_id, count(*) AS good FROM sm WHERE k <> 0 GROUP BY payment_id)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    rows = pay(spark, d).select("payment_id", "Amt_InstdAmt", "Cdtr_Nm", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("sample_no"))
    key = F.concat(F.col("payment_id").cast("string"), F.lit(":"), F.col("sample_no").cast("string"), F.lit(":sample"))
    return rows.withColumn("k", T.bucket(key, 0, 6))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).where("k <> 0")
    amt = F.struct(F.lit("Amt_InstdAmt").alias("field"), F.when(F.col("k") == 1, "0.00").otherwise(F.col("Amt_InstdAmt")).alias("value"))
    name = F.struct(F.lit("Cdtr_Nm").alias("field"), F.when(F.col("k") == 3, F.lit(None)).when(F.col("k").isin(1, 2), F.upper("Cdtr_Nm")).otherwise(F.col("Cdtr_Nm")).alias("value"))
    return s.select("payment_id", "sample_no", F.explode(F.array(amt, name)).alias("c")).select("payment_id", "sample_no", "c.*")


@query("consensus", f"""WITH {D.payments()}, {SAMPLES}, v AS (SELECT payment_id, field, value, count(*) AS votes, min(sample_no) AS first FROM lab GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY payment_id, field ORDER BY votes DESC, first) AS k, count(*) OVER (PARTITION BY payment_id, field) AS n FROM v)
SELECT payment_id, field, value, votes, round(CAST(votes AS DOUBLE) / good, 6) AS score, n > 1 AS disagreed FROM r JOIN ok USING (payment_id) WHERE k = 1""")
def consensus(spark, d):
    return G.consensus(labelled(spark, d), samples(spark, d).where("k <> 0").groupBy("payment_id").agg(F.count("*").alias("good")))


@query("agreement", f"""WITH {D.payments()}, {SAMPLES}, v AS (SELECT payment_id, field, value, count(*) AS votes, min(sample_no) AS first FROM lab GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY payment_id, field ORDER BY votes DESC, first) AS k FROM v)
SELECT payment_id, round(avg(round(CAST(votes AS DOUBLE) / good, 6)), 6) AS agreement FROM r JOIN ok USING (payment_id) WHERE k = 1 GROUP BY payment_id""")
def agreement(spark, d):
    return consensus(spark, d).groupBy("payment_id").agg(F.round(F.avg("score"), 6).alias("agreement"))


@query("token_usage", "SELECT count(*) AS calls, CAST(sum(length(text) // 4) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END) AS BIGINT) AS output_tokens FROM conversations")
def token_usage(spark, d):
    n = F.floor(F.length("text") / 4)
    return table(spark, d, "conversations").agg(F.count("*").alias("calls"), F.sum(n).alias("input_tokens"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("output_tokens"))


@query("artifact_match", "WITH a AS (SELECT lang, avg(n_chars) AS m FROM documents GROUP BY lang), b AS (SELECT lang, sum(n_chars) / CAST(count(*) AS DOUBLE) AS m FROM documents GROUP BY lang) SELECT bool_and(abs(a.m - b.m) < 1e-6) AS equal FROM a JOIN b USING (lang)")
def artifact_match(spark, d):
    x = table(spark, d, "documents").groupBy("lang")
    a, b = x.agg(F.avg("n_chars").alias("a")), x.agg((F.sum("n_chars") / F.count("*")).alias("b"))
    return a.join(b, "lang").agg(F.bool_and(F.abs(F.col("a") - F.col("b")) < 1e-6).alias("equal"))


def generations(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for a model's output: the rules' findings as JSON; some cut off, some with a key twice, some with an invented field."""
    return G.generations(E.extract(docs(spark, d)))


GEN = f"""{D.docs()},
{D.extracted("d", "rules_v2", "e")}"""
GOOD = "payment_id % 11 <> 0"


@query("acceptance_gate", f"""WITH {GEN},
g AS (SELECT *, {GOOD} AS parsed, {" + ".join(f'CAST("got_{k}" = "{k}" AS INTEGER)' for k in C.KEYS)} AS hits FROM e),
t AS (SELECT count(*) AS docs, count(*) FILTER (parsed) AS ok, count(*) FILTER (parsed AND payment_id % 13 <> 0) AS canonical, count(*) FILTER (NOT parsed OR payment_id % 7 <> 0) AS nodup, sum(CASE WHEN parsed THEN hits ELSE 0 END) AS fields, count(*) FILTER (parsed AND hits = 10) AS stp FROM g),
r AS (SELECT unnest([{{name: 'C1', value: ok / CAST(docs AS DOUBLE), need: 1.0}}, {{name: 'C2', value: canonical / CAST(docs AS DOUBLE), need: 1.0}}, {{name: 'C3', value: nodup / CAST(docs AS DOUBLE), need: 1.0}}, {{name: 'C5', value: fields / CAST(docs * 10 AS DOUBLE), need: 0.9}}, {{name: 'C5b', value: stp / CAST(docs AS DOUBLE), need: 0.5}}]) AS c FROM t)
SELECT c.name AS "check", round(c.value, 6) AS value, c.value >= c.need AS passed FROM r""")
def acceptance_gate(spark, d):
    return G.gate(generations(spark, d), ("C1", "C2", "C3", "C5", "C5b"))


@query("acceptance_gate_roles")
def acceptance_gate_roles(spark, d):
    """The checks of roles, routing and grounding; the tests hold them against cases worked out by hand."""
    return G.gate(generations(spark, d), ("C4", "C8", "C9"))


@query("role_consistency", f"""WITH {GEN},
x AS (SELECT payment_id, text, "got_DbtrAcct_IBAN" AS dba, "got_CdtrAcct_IBAN" AS cra, "got_CdtrAgt_BICFI" AS bic, "got_Amt_InstdAmt" AS amt, list_transform(regexp_extract_all(text, '{C.ROLE_LINE}', 1), lambda x: lower(trim(x))) AS labels, list_transform(regexp_extract_all(text, '{C.ROLE_LINE}', 2), lambda x: {D.alnum("x")}) AS vals FROM e),
z AS (SELECT *, list_transform(list_filter(list_zip(labels, vals), lambda x: x[2] <> '' AND regexp_matches(x[1], '{"|".join(C.DEBTOR_WORDS)}')), lambda x: x[2]) AS dv, list_transform(list_filter(list_zip(labels, vals), lambda x: x[2] <> '' AND NOT regexp_matches(x[1], '{"|".join(C.DEBTOR_WORDS)}') AND regexp_matches(x[1], '{"|".join(C.CREDITOR_WORDS)}')), lambda x: x[2]) AS cv FROM x)
SELECT payment_id, dba <> '' AND dba = cra AS self_payment, cra <> '' AND list_contains(dv, cra) AND NOT list_contains(cv, cra) AS creditor_inverted, dba <> '' AND list_contains(cv, dba) AND NOT list_contains(dv, dba) AS debtor_inverted, amt <> '' AND NOT contains(coalesce(array_to_string(list_transform(regexp_extract_all(text, '{C.AMOUNT_CONTEXT}'), lambda x: {D.alnum("x")}), ''), ''), {D.alnum("amt")}) AS amount_unanchored, bic <> '' AND NOT list_contains(list_transform(regexp_extract_all(text, '{C.BIC_LABELLED}', 1), lambda x: {D.alnum("x")}), bic) AS bic_unanchored FROM z""")
def role_consistency(spark, d):
    rows = E.extract(docs(spark, d))
    return G.with_roles(rows, "r", F.col("text"), F.col("got_DbtrAcct_IBAN"), F.col("got_CdtrAcct_IBAN"), F.col("got_CdtrAgt_BICFI"), F.col("got_Amt_InstdAmt")).select("payment_id", "r.*")


@query("filter_funnel", f"""WITH {GEN}, f AS (SELECT payment_id, "got_CdtrAcct_IBAN" AS i, payment_id % 6 = 0 AS bad, payment_id % 10 = 0 AS err FROM e),
s AS (SELECT CASE WHEN err THEN 'teacher-error' WHEN bad THEN 'ungrounded' WHEN NOT {D.iban_valid("i")} THEN 'validator' ELSE 'kept' END AS gate FROM f)
SELECT gate, count(*) AS docs FROM s GROUP BY gate""")
def filter_funnel(spark, d):
    """The first gate that an example fails, counted: teacher error, a value that is not in the text, a broken account number, or kept."""
    rows = E.extract(docs(spark, d)).select("payment_id", "text", F.col("got_CdtrAcct_IBAN").alias("i"), F.when(F.col("payment_id") % 6 == 0, "Invented Corp").otherwise("").alias("name"), (F.col("payment_id") % 10 == 0).alias("err"))
    stage = F.when(F.col("err"), "teacher-error").when((F.col("name") != "") & ~F.lower("text").contains(F.lower(F.col("name"))), "ungrounded").when(~V.iban_valid(F.col("i")), "validator").otherwise("kept")
    return rows.select(stage.alias("gate")).groupBy("gate").agg(F.count("*").alias("docs"))


@query("generation_metrics", f"""WITH {GEN}, g AS (SELECT {GOOD} AS parsed, payment_id % 7 <> 0 AS nodup, {" + ".join(f'CAST("got_{k}" = "{k}" AS INTEGER)' for k in C.KEYS)} AS hits FROM e)
SELECT round(avg(CAST(parsed AS DOUBLE)), 6) AS json_rate, round(avg(CASE WHEN parsed THEN hits / 10.0::DOUBLE ELSE 0 END), 6) AS mean_recall, round(avg(CASE WHEN parsed AND hits = 10 THEN 1.0 ELSE 0.0 END), 6) AS exact_rate FROM g""")
def generation_metrics(spark, d):
    g = G.scored(generations(spark, d))
    ok = F.col("p").isNotNull()
    return g.agg(F.round(F.avg(ok.cast("double")), 6).alias("json_rate"), F.round(F.avg(F.col("right") / len(C.KEYS)), 6).alias("mean_recall"), F.round(F.avg((F.col("right") == len(C.KEYS)).cast("double")), 6).alias("exact_rate"))


@query("top_k_reasons", "SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, reason LIMIT 3")
def top_k_reasons(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(3)


# --- message schema ----------------------------------------------------------------------------------------------------------------

PATHS_SQL = "xp AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}', {str(r).lower()}, {str(c).lower()})" for i, (p, r, c) in enumerate(SC.LEAVES)) + ") t(ord, path, required, ccy))"
LAST = "string_split(path, '/')[-1]"
PRIO = "CASE name " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(C.FIELD_PRIORITY)) + " END"
KEYX = f"array_to_string(list_reverse(list_reverse(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT list_contains([{D.values(C.BOILERPLATE)}], x)))[1:2]), '_')"


@query("xsd_paths", f"WITH {PATHS_SQL} SELECT CAST(ord AS INTEGER) AS ord, path, {LAST} AS name, required, ccy FROM xp")
def xsd_paths(spark, d):
    """Leaf paths of the built-in message schema, walked from its XML text."""
    return SC.leaf_paths(spark, SC.SCHEMA)



SPECS_SQL = f"""WITH {PATHS_SQL}, n AS (SELECT *, {LAST} AS name FROM xp), r AS (SELECT *, {PRIO} AS prio, row_number() OVER (PARTITION BY name ORDER BY ord) AS round, {KEYX} AS k FROM n
 WHERE {PRIO} IS NOT NULL AND len(list_filter(string_split(path, '/'), lambda x: list_contains([{D.values(C.CORE_ROLES)}], x))) > 0 AND NOT ({" OR ".join(f"contains(path, '{m}')" for m in C.NOISE)})),
u AS (SELECT k AS field_key, path, round, prio, 0 AS attr FROM r UNION ALL SELECT k || '_Ccy', path, round, prio, 1 FROM r WHERE ccy), f AS (SELECT *, row_number() OVER (PARTITION BY field_key ORDER BY round, prio, attr) AS dup FROM u),
o AS (SELECT field_key, path, attr = 1 AS is_attribute, row_number() OVER (ORDER BY round, prio, attr) AS place FROM f WHERE dup = 1)
SELECT CAST(place AS INTEGER) AS place, field_key, path, is_attribute FROM o WHERE place <= 24"""


SLOTS = """sl AS (SELECT payment_id, unnest([{key: 'Cdtr_Nm', value: "Cdtr_Nm"}, {key: 'DbtrAcct_IBAN', value: "DbtrAcct_IBAN"}, {key: 'Amt_InstdAmt', value: "Amt_InstdAmt"}, {key: 'Amt_InstdAmt_Ccy', value: "Amt_InstdAmt_Ccy"}, {key: 'PmtId_EndToEndId', value: "PmtId_EndToEndId"}, {key: 'RmtInf_Ustrd', value: "RmtInf_Ustrd"}]) AS c FROM p)"""


def slots(spark: SparkSession, d: str) -> DataFrame:
    keys = ("Cdtr_Nm", "DbtrAcct_IBAN", "Amt_InstdAmt", "Amt_InstdAmt_Ccy", "PmtId_EndToEndId", "RmtInf_Ustrd")
    made = F.array(*[F.struct(F.lit(k).alias("field_key"), F.col(k).alias("value")) for k in keys])
    return pay(spark, d).select("payment_id", F.explode(made).alias("c")).select("payment_id", "c.*")


@query("to_slots", f"""WITH {D.payments()}, {SLOTS}, sp AS ({SPECS_SQL}), j AS (SELECT payment_id, c.value AS v, path, is_attribute FROM sl JOIN sp ON c.key = field_key)
 SELECT payment_id, path, max(v) FILTER (NOT is_attribute) AS value, max(v) FILTER (is_attribute) AS ccy FROM j GROUP BY payment_id, path""")
def to_slots(spark, d):
    """Values at their paths in the message; keys that the schema does not give are dropped."""
    return SC.to_slots(slots(spark, d), SC.field_specs(SC.leaf_paths(spark, SC.SCHEMA)))


@query("field_key", f"""WITH t AS ({SQL["to_slots"]}) SELECT payment_id, path, {KEYX} AS field_key, coalesce(list_filter(string_split(path, '/'), lambda x: list_contains([{D.values(C.CORE_ROLES)}], x))[1], '') AS role FROM t""")
def field_key(spark, d):
    """Key and role of the path of each value in the payments' messages."""
    return to_slots(spark, d).select("payment_id", "path", SC.field_key(F.col("path")).alias("field_key"), SC.role(F.col("path")).alias("role"))


@query("field_specs", f"WITH {D.payments()}, {SLOTS}, n AS (SELECT c.key AS field_key, count(*) AS given FROM sl GROUP BY 1) SELECT sp.*, coalesce(n.given, 0) AS given FROM ({SPECS_SQL}) sp LEFT JOIN n USING (field_key)")
def field_specs(spark, d):
    """The extraction targets of the schema, and how many payments give each."""
    given = slots(spark, d).groupBy("field_key").agg(F.count("*").alias("given"))
    return SC.field_specs(SC.leaf_paths(spark, SC.SCHEMA)).join(given, "field_key", "left").select("place", "field_key", "path", "is_attribute", F.coalesce("given", F.lit(0)).alias("given"))


@query("control_sum", "SELECT l_suppkey AS batch, greatest(count(*), 1) AS transactions, printf('%.2f', sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18, 2)))) AS control_sum FROM lineitem GROUP BY l_suppkey")
def control_sum(spark, d):
    total = F.sum(F.round("l_extendedprice", 2).cast("decimal(18,2)"))
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("batch")).agg(F.greatest(F.count("*"), F.lit(1).cast("long")).alias("transactions"), total.cast("string").alias("control_sum"))


@query("parameter_count", "SELECT v * 512 AS embedding, CAST((512 * 512 + 2 * 512 * kv * 64 + 512 * 512 + 3 * 512 * ff + 2 * 512 + 1) * 20 AS BIGINT) AS body, kv, ff FROM (SELECT 2 AS kv, 1024 AS ff UNION ALL SELECT 4, 1408) s, (SELECT count(DISTINCT w) AS v FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)) n")
def parameter_count(spark, d):
    """Parameters of two models whose vocabulary is the distinct words of documents."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).agg(F.count_distinct("w").alias("v"))
    made = words.select("v", F.explode(F.array(*[F.struct(F.lit(kv).alias("kv"), F.lit(ff).alias("ff")) for kv, ff in ((2, 1024), (4, 1408))])).alias("m")).select("v", "m.*")
    body = (F.lit(512 * 512) + 2 * 512 * F.col("kv") * 64 + 512 * 512 + 3 * 512 * F.col("ff") + 2 * 512 + 1) * 20
    return made.select((F.col("v") * 512).alias("embedding"), body.cast("long").alias("body"), "kv", "ff")
