"""Queries over generated payments: generation, validators, extraction, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..functions import validators as V
from ..operators import extract as E
from ..operators import payments as P
from ..operators import score as S
from . import duck as D

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def pay(spark: SparkSession, d: str) -> DataFrame:
    return P.load_payments(spark, d)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return P.documents(pay(spark, d))


def both(spark: SparkSession, d: str) -> DataFrame:
    """Every document with both extractors' score, one row for each. A document is made and rendered once, below the rows for the extractors."""
    base = docs(spark, d).withColumn("extractor", F.explode(F.array(*map(F.lit, E.EXTRACTORS))))
    return S.score(E.extract_each(base, "extractor"))


BOTH = f"""{D.docs()},
{D.extracted("d", "rules_v1", "e1")},
{D.scored("e1", "s1")},
{D.extracted("d", "rules_v2", "e2")},
{D.scored("e2", "s2")},
s AS (SELECT *, 'rules_v1' AS extractor FROM s1 UNION ALL BY NAME SELECT *, 'rules_v2' AS extractor FROM s2)"""
V2 = f"""{D.docs()},
{D.extracted("d", "rules_v2", "e")},
{D.scored("e", "s")}"""
ALL_KEYS = ", ".join(f'"{k}"' for k in C.KEYS)


@query("generate_values", f"WITH {D.payments()} SELECT payment_id, country, {ALL_KEYS} FROM p")
def generate_values(spark, d):
    return pay(spark, d).select("payment_id", "country", *C.KEYS)


@query("render_document", f"WITH {D.docs()} SELECT payment_id, difficulty, text FROM d")
def render_document(spark, d):
    return docs(spark, d).select("payment_id", "difficulty", "text")


@query("build_corpus", f"""WITH {D.payments()},
d0 AS (SELECT p.*, l.difficulty FROM p, (SELECT unnest([{D.values(C.LEVELS)}]) AS difficulty) l),
d AS (SELECT *, {D.text()} AS text FROM d0)
SELECT difficulty, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM d GROUP BY difficulty""")
def build_corpus(spark, d):
    return P.corpus(pay(spark, d)).groupBy("difficulty").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("difficulty_cycle", f"""WITH {D.payments()},
i AS (SELECT *, row_number() OVER (ORDER BY payment_id) - 1 AS ord FROM p)
SELECT payment_id, ord, {D.level_of("ord")} AS difficulty FROM i""")
def difficulty_cycle(spark, d):
    return P.documents_by_row(pay(spark, d)).select("payment_id", "ord", "difficulty")


@query("corpus_field_counts", f"WITH {D.docs()}\n" + "\nUNION ALL ".join(f"SELECT '{k}' AS field, count(*) FILTER (\"{k}\" <> '') AS docs FROM d" for k in C.KEYS))
def corpus_field_counts(spark, d):
    stated = F.explode(F.filter(F.array(*[F.when(F.col(k) != "", F.lit(k)) for k in C.KEYS]), lambda x: x.isNotNull())).alias("field")
    return docs(spark, d).select(stated).groupBy("field").agg(F.count("*").alias("docs"))


@query("iban_valid", f"""WITH {D.payments()},
x AS (SELECT payment_id, "CdtrAcct_IBAN" AS v FROM p UNION ALL SELECT payment_id, replace("CdtrAcct_IBAN", '0', 'O') FROM p UNION ALL SELECT payment_id, lower("DbtrAcct_IBAN") FROM p UNION ALL SELECT payment_id, "CdtrAgt_BICFI" FROM p)
SELECT payment_id, v AS value, {D.iban_valid("v")} AS valid FROM x""")
def iban_valid(spark, d):
    forms = F.explode(F.array("CdtrAcct_IBAN", F.replace("CdtrAcct_IBAN", F.lit("0"), F.lit("O")), F.lower("DbtrAcct_IBAN"), "CdtrAgt_BICFI")).alias("value")
    return pay(spark, d).select("payment_id", forms).select("*", V.iban_valid(F.col("value")).alias("valid"))


@query("iban_check_digits", f"""WITH {D.payments()} SELECT payment_id, lpad(CAST(98 - {D.mod97("substr(\"DbtrAcct_IBAN\", 5) || substr(\"DbtrAcct_IBAN\", 1, 2) || '00'")} AS VARCHAR), 2, '0') AS digits, substr("DbtrAcct_IBAN", 3, 2) AS stated FROM p""")
def iban_check_digits(spark, d):
    x = F.col("DbtrAcct_IBAN")
    return pay(spark, d).select("payment_id", V.check_digits(F.substring(x, 1, 2), F.substring(x, 5, 40)).alias("digits"), F.substring(x, 3, 2).alias("stated"))


BICS = """b AS (SELECT payment_id, unnest(["CdtrAgt_BICFI", lower("CdtrAgt_BICFI"), substr("CdtrAgt_BICFI", 1, 4) || 'NI' || substr("CdtrAgt_BICFI", 7), substr("CdtrAgt_BICFI", 1, 4) || 'DL' || substr("CdtrAgt_BICFI", 7), 'ATTACHED', 'BENEFICIARY', 'PAYMENT', substr("Cdtr_Nm", 1, 8)]) AS v FROM p)"""


def bics(p: DataFrame) -> DataFrame:
    b = F.col("CdtrAgt_BICFI")
    swapped = [F.concat(F.substring(b, 1, 4), F.lit(c), F.substring(b, 7, 5)) for c in ("NI", "DL")]
    return p.select("payment_id", F.explode(F.array(b, F.lower(b), *swapped, F.lit("ATTACHED"), F.lit("BENEFICIARY"), F.lit("PAYMENT"), F.substring("Cdtr_Nm", 1, 8))).alias("value"))


@query("bic_valid", f"WITH {D.payments()}, {BICS} SELECT payment_id, v AS value, {D.bic_valid('v')} AS valid FROM b")
def bic_valid(spark, d):
    return bics(pay(spark, d)).select("*", V.bic_valid(F.col("value")).alias("valid"))


@query("bic_country_valid", f"WITH {D.payments()}, {BICS} SELECT payment_id, v AS value, {D.bic_country_valid('v')} AS valid FROM b")
def bic_country_valid(spark, d):
    return bics(pay(spark, d)).select("*", V.bic_country_valid(F.col("value")).alias("valid"))


@query("bic_in_prose", f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?')) AS v FROM documents)
SELECT doc_id, v AS value, count(*) AS n, {D.bic_country_valid("v")} AS country_valid FROM w GROUP BY doc_id, v""")
def bic_in_prose(spark, d):
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?"), 0)).alias("value")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", words).groupBy("doc_id", "value").agg(F.count("*").alias("n")).withColumn("country_valid", V.bic_country_valid(F.col("value")))


UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || v || substr(h, 14, 3) || '-' || w || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query("uetr_valid", f"""WITH x AS (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h, CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '4' END AS v, CASE WHEN o_orderkey % 5 = 0 THEN 'c' ELSE 'a' END AS w FROM orders)
SELECT o_orderkey, {UUID} AS uetr, regexp_full_match({UUID}, '{C.UETR[1:-1]}') AS valid FROM x""")
def uetr_valid(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"), F.when(F.col("o_orderkey") % 3 == 0, "1").otherwise("4").alias("v"), F.when(F.col("o_orderkey") % 5 == 0, "c").otherwise("a").alias("w"))
    return o.select("o_orderkey", F.expr(UUID).alias("uetr")).select("*", V.uetr_valid(F.col("uetr")).alias("valid"))


@query("lei_valid", """WITH x AS (SELECT c_custkey, upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 18)) || CASE WHEN c_custkey % 4 = 0 THEN 'A' ELSE '' END || lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0') AS lei FROM customer)
SELECT c_custkey, lei, regexp_full_match(lei, '[A-Z0-9]{18}[0-9]{2}') AS valid FROM x""")
def lei_valid(spark, d):
    lei = F.concat(F.upper(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 18)), F.when(F.col("c_custkey") % 4 == 0, "A").otherwise(""), F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", lei.alias("lei")).select("*", V.lei_valid(F.col("lei")).alias("valid"))


@query("currency_valid", f"""WITH {D.payments()}, x AS (SELECT payment_id, unnest(["Amt_InstdAmt_Ccy", lower("Amt_InstdAmt_Ccy"), country, '  eur ', 'EU1']) AS v FROM p)
SELECT payment_id, v AS value, regexp_full_match(upper(trim(v)), '[A-Z]{{3}}') AS valid FROM x""")
def currency_valid(spark, d):
    return pay(spark, d).select("payment_id", F.explode(F.array("Amt_InstdAmt_Ccy", F.lower("Amt_InstdAmt_Ccy"), "country", F.lit("  eur "), F.lit("EU1"))).alias("value")).select("*", V.currency_valid(F.col("value")).alias("valid"))


MINOR = ("EUR", "JPY", "KWD", "CLF")


@query("minor_units_ok", f"""WITH {D.payments()}, x AS (SELECT payment_id, unnest(["Amt_InstdAmt", string_split("Amt_InstdAmt", '.')[1], "Amt_InstdAmt" || '0', "Amt_InstdAmt" || '00']) AS amount, ([{D.values(MINOR)}])[payment_id % 4 + 1] AS ccy FROM p)
SELECT payment_id, amount, ccy, {D.minor_units_ok("amount", "ccy")} AS ok FROM x""")
def minor_units_ok(spark, d):
    a = F.col("Amt_InstdAmt")
    rows = pay(spark, d).select("payment_id", F.explode(F.array(a, F.substring_index(a, ".", 1), F.concat(a, F.lit("0")), F.concat(a, F.lit("00")))).alias("amount"), F.get(F.array(*[F.lit(x) for x in MINOR]), F.pmod("payment_id", F.lit(4)).cast("int")).alias("ccy"))
    return rows.select("*", V.minor_units_ok(F.col("amount"), F.col("ccy")).alias("ok"))


def _rules(name: str, v: str) -> str:
    return f"""array_to_string(list_filter([CASE WHEN {name} LIKE '%IBAN%' AND NOT {D.iban_valid(v)} THEN 'IBAN-mod97' END,
CASE WHEN {name} LIKE '%BIC%' AND NOT {D.bic_valid(v)} THEN 'BIC-format' END,
CASE WHEN {name} LIKE '%CCY' AND NOT regexp_full_match(upper(trim({v})), '[A-Z]{{3}}') THEN 'ISO4217-shape' END], lambda x: x IS NOT NULL), ',')"""


@query("validate_field", f"""WITH {V2},
c AS ({D.cells("s")})
SELECT payment_id, field, got AS value, {_rules("upper(field)", "got")} AS rules FROM c WHERE got <> ''""")
def validate_field(spark, d):
    rows = E.long_form(docs(spark, d)).drop("method")
    return rows.select("*", F.array_join(V.findings(F.col("field"), F.col("value")), ",").alias("rules"))


@query("normalise_alnum", f"SELECT doc_id, md5({D.alnum('text')}) AS digest FROM documents")
def normalise_alnum(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(V.alnum(F.col("text")).cast("binary")).alias("digest"))


AMOUNTS = """x AS (SELECT payment_id, unnest([format('{:,.2f}', CAST("Amt_InstdAmt" AS DOUBLE)), translate(format('{:,.2f}', CAST("Amt_InstdAmt" AS DOUBLE)), ',.', '.,'), string_split("Amt_InstdAmt", '.')[1], '1.250', '1,250', '1.234.567', ',5', 'abc', '']) AS v FROM p)"""


@query("norm_amount", f"WITH {D.payments()}, {AMOUNTS} SELECT payment_id, v AS raw, {D.norm_amount('v')} AS amount FROM x")
def norm_amount(spark, d):
    a = F.col("Amt_InstdAmt")
    us, eu = T.format_amount(a, F.lit(False)), T.format_amount(a, F.lit(True))
    raw = F.explode(F.array(us, eu, F.substring_index(a, ".", 1), *[F.lit(x) for x in ("1.250", "1,250", "1.234.567", ",5", "abc", "")])).alias("raw")
    return pay(spark, d).select("payment_id", raw).select("*", T.norm_amount(F.col("raw")).alias("amount"))


DATES = """x AS (SELECT payment_id, unnest(["ReqdExctnDt_Dt", strftime(CAST("ReqdExctnDt_Dt" AS DATE), '%d/%m/%Y'), strftime(CAST("ReqdExctnDt_Dt" AS DATE), '%m.%d.%Y'), strftime(CAST("ReqdExctnDt_Dt" AS DATE), '%d %b %Y'), '2026-13-45', '3 september 2026', 'no date']) AS v FROM p)"""


def dates(p: DataFrame) -> DataFrame:
    x = F.to_date("ReqdExctnDt_Dt")
    forms = F.array("ReqdExctnDt_Dt", F.date_format(x, "dd/MM/yyyy"), F.date_format(x, "MM.dd.yyyy"), F.date_format(x, "dd MMM yyyy"), F.lit("2026-13-45"), F.lit("3 september 2026"), F.lit("no date"))
    return p.select("payment_id", F.explode(forms).alias("raw"))


@query("norm_date", f"WITH {D.payments()}, {DATES} SELECT payment_id, v AS raw, {D.norm_date('v')} AS date FROM x")
def norm_date(spark, d):
    return dates(pay(spark, d)).select("*", T.norm_date(F.col("raw")).alias("date"))


@query("date_in", f"WITH {D.payments()}, {DATES}, y AS (SELECT payment_id, 'due by ' || v || ', at noon' AS v FROM x) SELECT payment_id, v AS raw, {D.date_in('v')} AS date FROM y")
def date_in(spark, d):
    raw = F.concat(F.lit("due by "), F.col("raw"), F.lit(", at noon"))
    return dates(pay(spark, d)).select("payment_id", raw.alias("raw")).select("*", T.date_in(F.col("raw")).alias("date"))


@query("currency_from", f"WITH {D.docs()} SELECT payment_id, {D.currency_from('text')} AS currency FROM d")
def currency_from(spark, d):
    return docs(spark, d).select("payment_id", T.currency_from(F.col("text")).alias("currency"))


FIRST_LINE = "string_split(text, chr(10))[1]"


@query("coerce_field", f"WITH {D.docs()}, l AS (SELECT payment_id, regexp_replace({FIRST_LINE}, '^[^:]*: *', '') AS raw FROM d) SELECT payment_id, raw, " + ", ".join(f'{D.coerce(k, "raw")} AS "{k}"' for k in C.KEYS) + " FROM l")
def coerce_field(spark, d):
    raw = F.regexp_replace(F.substring_index("text", "\n", 1), "^[^:]*: *", "")
    return docs(spark, d).select("payment_id", raw.alias("raw")).select("*", *[T.coerce(k, F.col("raw")).alias(k) for k in C.KEYS])


@query("normalise_v1", f"WITH {D.docs()}, l AS (SELECT payment_id, regexp_replace({FIRST_LINE}, '^[^:]*: *', '') AS raw FROM d) SELECT payment_id, raw, " + ", ".join(f'{D.coerce_strict(k, "raw")} AS "{k}"' for k in C.KEYS) + " FROM l")
def normalise_v1(spark, d):
    raw = F.regexp_replace(F.substring_index("text", "\n", 1), "^[^:]*: *", "")
    return docs(spark, d).select("payment_id", raw.alias("raw")).select("*", *[T.coerce_strict(k, F.col("raw")).alias(k) for k in C.KEYS])


@query("fmt_amount", f"""WITH {D.payments()} SELECT payment_id, format('{{:,.2f}}', CAST("Amt_InstdAmt" AS DOUBLE)) AS us, translate(format('{{:,.2f}}', CAST("Amt_InstdAmt" AS DOUBLE)), ',.', '.,') AS eu FROM p""")
def fmt_amount(spark, d):
    a = F.col("Amt_InstdAmt")
    return pay(spark, d).select("payment_id", T.format_amount(a, F.lit(False)).alias("us"), T.format_amount(a, F.lit(True)).alias("eu"))


@query("value_key", f"""WITH {D.payments()} SELECT payment_id, md5({" || '|' || ".join(f"'{k}=' || \"{k}\"" for k in sorted(C.KEYS))}) AS digest FROM p""")
def value_key(spark, d):
    return pay(spark, d).select("payment_id", F.md5(T.value_key(list(C.KEYS)).cast("binary")).alias("digest"))


SPLIT_KEY = " || '|' || ".join(f"'{k}=' || \"{k}\"" for k in sorted(C.KEYS))


@query("hash_split", f"""WITH {D.payments()}, b AS (SELECT payment_id, ('0x' || substr(sha256('13:' || {SPLIT_KEY}), 1, 8))::BIGINT % 1000 AS bucket FROM p)
SELECT payment_id, CAST(bucket AS INTEGER) AS bucket, CASE WHEN bucket < 100 THEN 'val' ELSE 'train' END AS side FROM b""")
def hash_split(spark, d):
    at = T.bucket(T.value_key(list(C.KEYS)), 13, 1000)
    return pay(spark, d).select("payment_id", at.alias("bucket")).select("*", F.when(F.col("bucket") < 100, "val").otherwise("train").alias("side"))


@query("split_leakage", f"""WITH {D.payments()}, b AS (SELECT "CdtrAcct_IBAN", ('0x' || substr(sha256('13:' || {SPLIT_KEY}), 1, 8))::BIGINT % 1000 < 100 AS val FROM p)
SELECT count(*) AS shared FROM (SELECT "CdtrAcct_IBAN" FROM b WHERE val INTERSECT SELECT "CdtrAcct_IBAN" FROM b WHERE NOT val)""")
def split_leakage(spark, d):
    rows = pay(spark, d).withColumn("val", T.bucket(T.value_key(list(C.KEYS)), 13, 1000) < 100)
    return rows.where("val").select("CdtrAcct_IBAN").intersect(rows.where("not val").select("CdtrAcct_IBAN")).agg(F.count("*").alias("shared"))


LABELS_SQL = "(VALUES " + ", ".join(f"('{k}', {i}, {j}, {D.q(x)}, {str(x.lower() in C.AMBIGUOUS_LABELS).lower()})" for i, (k, v) in enumerate(C.LABELS.items()) for j, x in enumerate(v)) + ") t(field, field_ord, label_ord, label, ambiguous)"


@query("label_index", f"WITH {D.docs()} SELECT t.*, (SELECT count(*) FROM d WHERE contains(text, t.label || ': ')) AS stated FROM {LABELS_SQL}")
def label_index(spark, d):
    """Every label of every field, and how many documents have it before a colon."""
    rows = [(k, i, j, x, x.lower() in C.AMBIGUOUS_LABELS) for i, (k, v) in enumerate(C.LABELS.items()) for j, x in enumerate(v)]
    labels = sorted({x for v in C.LABELS.values() for x in v})
    seen = F.filter(F.array(*map(F.lit, labels)), lambda x: F.contains(F.col("text"), F.concat(x, F.lit(": "))))
    stated = docs(spark, d).select(F.explode(seen).alias("label")).groupBy("label").agg(F.count("*").alias("stated"))
    index = spark.createDataFrame(rows, "field string, field_ord int, label_ord int, label string, ambiguous boolean")
    return index.join(stated, "label", "left").select("field", "field_ord", "label_ord", "label", "ambiguous", F.coalesce("stated", F.lit(0)).alias("stated"))


N_LABELS = sum(len(v) for v in C.LABELS.values())


@query("baseline_status", f"SELECT CAST({len(C.LABELS)} AS BIGINT) AS fields, CAST({N_LABELS} AS BIGINT) AS patterns, CAST({len(C.AMBIGUOUS_LABELS)} AS BIGINT) AS ambiguous_labels, CAST(sum(stated) AS BIGINT) AS stated FROM ({SQL['label_index']})")
def baseline_status(spark, d):
    made = label_index(spark, d).agg(F.count_distinct("field").alias("fields"), F.count("*").alias("patterns"), F.sum("stated").alias("stated"))
    return made.select("fields", "patterns", F.lit(len(C.AMBIGUOUS_LABELS)).cast("long").alias("ambiguous_labels"), "stated")


@query("extract_by_label", f"""WITH {D.docs()},
{D.extracted("d", "rules_v2", "e", methods=True)}
SELECT payment_id, """ + ", ".join(f"CASE WHEN \"how_{k}\" LIKE 'label%' THEN \"got_{k}\" ELSE '' END AS \"{k}\"" for k in C.LABELS) + " FROM e")
def extract_by_label(spark, d):
    return docs(spark, d).select("payment_id", *[F.coalesce(E.by_label(F.col("text"), k)["value"], F.lit("")).alias(k) for k in C.LABELS])


@query("extract_by_pattern", f"""WITH {D.docs()},
{D.extracted("d", "rules_v2", "e", methods=True)}
SELECT payment_id, """ + ", ".join(f"CASE WHEN \"how_{k}\" LIKE 'pattern%' THEN \"got_{k}\" ELSE '' END AS \"{k}\"" for k in C.KEYS) + " FROM e")
def extract_by_pattern(spark, d):
    rows = E.extract(docs(spark, d), methods=True)
    return rows.select("payment_id", *[F.when(F.coalesce(F.col(f"how_{k}"), F.lit("")).startswith("pattern"), F.col(f"got_{k}")).otherwise("").alias(k) for k in C.KEYS])


@query("extract_rules_v2", f"""WITH {D.docs()},
{D.extracted("d", "rules_v2", "e", methods=True)}
SELECT payment_id, """ + ", ".join(f'"got_{k}" AS "{k}", coalesce("how_{k}", \'\') AS "how_{k}"' for k in C.KEYS) + " FROM e")
def extract_rules_v2(spark, d):
    rows = E.extract(docs(spark, d), methods=True)
    return rows.select("payment_id", *[x for k in C.KEYS for x in (F.col(f"got_{k}").alias(k), F.coalesce(f"how_{k}", F.lit("")).alias(f"how_{k}"))])


@query("extract_rules_v1", f"""WITH {D.docs()},
{D.extracted("d", "rules_v1", "e")}
SELECT payment_id, """ + ", ".join(f'"got_{k}" AS "{k}"' for k in C.KEYS) + " FROM e")
def extract_rules_v1(spark, d):
    return E.extract(docs(spark, d), "rules_v1").select("payment_id", *[F.col(f"got_{k}").alias(k) for k in C.KEYS])


RATES = f"docs, stp_docs, expected, correct, spurious, {D.rate('stp_docs', 'docs')} AS stp_rate, round(1 - coalesce(CAST(stp_docs AS DOUBLE) / nullif(docs, 0), 0), 6) AS exception_rate, {D.rate('correct', 'expected')} AS field_accuracy, {D.rate('spurious', 'docs')} AS spurious_per_doc"
SUMS = "count(*) AS docs, count(*) FILTER (n_wrong = 0 AND n_invented = 0) AS stp_docs, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(n_invented) AS BIGINT) AS spurious"


@query("stp_by_difficulty", f"""WITH {BOTH},
r AS (SELECT extractor, coalesce(difficulty, 'all') AS difficulty, {SUMS} FROM s GROUP BY GROUPING SETS ((extractor, difficulty), (extractor)))
SELECT extractor, difficulty, {RATES} FROM r""")
def stp_by_difficulty(spark, d):
    return S.with_rates(S.by_level(both(spark, d), "extractor"))


@query("evaluate", f"""WITH {V2},
c AS ({D.cells("s", "payment_id, difficulty")})
SELECT difficulty, field, count(*) FILTER (want <> '') AS expected, count(*) FILTER (want <> '' AND want = got) AS correct, count(*) FILTER (want = '' AND got <> '') AS spurious FROM c WHERE want <> '' OR got <> '' GROUP BY difficulty, field""")
def evaluate(spark, d):
    return S.cells(S.score(E.extract(docs(spark, d))), "difficulty").groupBy("difficulty", "field").agg(*[F.sum(x).cast("long").alias(x) for x in ("expected", "correct", "spurious")])


FIELD = f"""f AS (SELECT field, count(*) FILTER (want <> '') AS expected, count(*) FILTER (want <> '' AND want = got) AS correct, count(*) FILTER (want = '' AND got <> '') AS spurious FROM c WHERE want <> '' OR got <> '' GROUP BY field),
g AS (SELECT *, coalesce(CAST(correct AS DOUBLE) / nullif(correct + spurious, 0), 0) AS p, coalesce(CAST(correct AS DOUBLE) / nullif(expected, 0), 0) AS r FROM f)"""


@query("precision_recall_f1", f"""WITH {V2},
c AS ({D.cells("s")}),
{FIELD}
SELECT field, expected, correct, spurious, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM g""")
def precision_recall_f1(spark, d):
    return S.by_field(S.score(E.extract(docs(spark, d))))


@query("worst_recall_first", f"""WITH {V2},
c AS ({D.cells("s")}),
{FIELD}
SELECT CAST(row_number() OVER (ORDER BY r, field) AS INTEGER) AS place, field, round(r, 6) AS recall FROM g""")
def worst_recall_first(spark, d):
    fields = S.by_field(S.score(E.extract(docs(spark, d))))
    # ten rows at most: one for each field
    return fields.select(F.row_number().over(W.orderBy(F.col("correct").cast("double") / F.col("expected"), "field")).alias("place"), "field", "recall")


@query("report_overall", f"""WITH {V2} SELECT coalesce(difficulty, 'all') AS difficulty, {SUMS} FROM s GROUP BY ROLLUP (difficulty)""")
def report_overall(spark, d):
    return S.by_level(S.score(E.extract(docs(spark, d))))


@query("rates", f"""WITH {V2}, r AS (SELECT difficulty, {SUMS} FROM s GROUP BY difficulty) SELECT difficulty, {RATES} FROM r""")
def rates(spark, d):
    return S.with_rates(S.by_level(S.score(E.extract(docs(spark, d))))).where("difficulty <> 'all'")


@query("score_join", f"""WITH {V2},
c AS ({D.cells("s")})
SELECT payment_id, field, CASE WHEN want = '' THEN 'spurious' WHEN want = got THEN 'correct' WHEN got = '' THEN 'missing' ELSE 'wrong' END AS verdict FROM c WHERE want <> '' OR got <> ''""")
def score_join(spark, d):
    """As a full outer join of the two long tables, both dealt by the payment."""
    base = docs(spark, d)
    truth = base.select("payment_id", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("want")) for k in C.KEYS])).alias("c")).select("payment_id", "c.*").where("want <> ''")
    found = E.long_form(base).select("payment_id", "field", F.col("value").alias("got"))
    verdict = F.when(F.col("want").isNull(), "spurious").when(F.col("want") == F.coalesce("got", F.lit("")), "correct").when(F.col("got").isNull(), "missing").otherwise("wrong")
    return truth.join(found, ["payment_id", "field"], "full").select("payment_id", "field", verdict.alias("verdict"))


ACTION = "CASE WHEN n_wrong = 0 AND n_invented = 0 THEN 'STP' WHEN n_invented > 0 OR CAST(correct AS DOUBLE) / expected < 0.6 THEN 'KEY' ELSE 'VERIFY' END"


@query("classify_action", f"WITH {BOTH} SELECT payment_id, extractor, difficulty, {ACTION} AS action FROM s")
def classify_action(spark, d):
    return both(spark, d).select("payment_id", "extractor", "difficulty", S.action().alias("action"))


@query("workflow_report", f"""WITH {BOTH}, a AS (SELECT *, {ACTION} AS action FROM s)
SELECT extractor, count(*) AS docs, count(*) FILTER (action = 'STP') AS stp, count(*) FILTER (action = 'VERIFY') AS verify, count(*) FILTER (action = 'KEY') AS "key", {D.rate("sum(correct)", "sum(expected)")} AS field_accuracy, {D.rate("sum(n_invented)", "count(*)")} AS invented_per_doc FROM a GROUP BY extractor""")
def workflow_report(spark, d):
    a = both(spark, d).withColumn("action", S.action())
    counts = [F.count_if(F.col("action") == x).alias(x.lower()) for x in C.EFFORT]
    out = a.groupBy("extractor").agg(F.count("*").alias("docs"), *counts, F.sum("correct").alias("c"), F.sum("expected").alias("e"), F.sum("n_invented").alias("i"))
    return out.select("extractor", "docs", "stp", "verify", "key", S.rate(F.col("c"), F.col("e")).alias("field_accuracy"), S.rate(F.col("i"), F.col("docs")).alias("invented_per_doc"))


@query("workflow_by_difficulty", f"""WITH {BOTH}, a AS (SELECT *, {ACTION} AS action FROM s)
SELECT extractor, difficulty, count(*) AS docs, {D.rate("count(*) FILTER (action = 'STP')", "count(*)")} AS stp, {D.rate("count(*) FILTER (action = 'VERIFY')", "count(*)")} AS verify, {D.rate("count(*) FILTER (action = 'KEY')", "count(*)")} AS "key" FROM a GROUP BY extractor, difficulty""")
def workflow_by_difficulty(spark, d):
    pivot = both(spark, d).withColumn("action", S.action()).groupBy("extractor", "difficulty").pivot("action", ["STP", "VERIFY", "KEY"]).count().na.fill(0)
    n = F.col("STP") + F.col("VERIFY") + F.col("KEY")
    return pivot.select("extractor", "difficulty", n.alias("docs"), *[S.rate(F.col(x), n).alias(x.lower()) for x in ("STP", "VERIFY", "KEY")])


@query("failure_modes", f"""WITH {BOTH},
c AS ({D.cells("s", "payment_id, extractor")})
SELECT extractor, field, count(*) AS n FROM c WHERE want <> '' AND want <> got GROUP BY extractor, field""")
def failure_modes(spark, d):
    return S.cells(both(spark, d), "extractor").where("expected = 1 and correct = 0").groupBy("extractor", "field").agg(F.count("*").alias("n"))


@query("minutes_per_doc", f"""WITH {BOTH}, a AS (SELECT *, {ACTION} AS action FROM s),
m AS (SELECT extractor, sum(CASE action WHEN 'KEY' THEN 8.0::DOUBLE WHEN 'VERIFY' THEN 1.5::DOUBLE ELSE 0::DOUBLE END) / count(*) AS m FROM a GROUP BY extractor)
SELECT extractor, round(m, 6) AS minutes_per_doc, round((8.0::DOUBLE - m) / 8.0::DOUBLE * 100, 6) AS saved_percent, round(m * 1000 / 60 * 45.0::DOUBLE, 4) AS cost_per_1000 FROM m""")
def minutes_per_doc(spark, d):
    cost = F.element_at(F.create_map(*[F.lit(x) for kv in C.EFFORT.items() for x in kv]), S.action())
    m = both(spark, d).groupBy("extractor").agg((F.sum(cost) / F.count("*")).alias("m"))
    key = C.EFFORT["KEY"]
    return m.select("extractor", F.round("m", 6).alias("minutes_per_doc"), F.round((key - F.col("m")) / key * 100, 6).alias("saved_percent"), F.round(F.col("m") * 1000 / 60 * C.OPERATIONS["hourly_cost"], 4).alias("cost_per_1000"))


@query("failure_examples", f"""WITH {V2}, f AS (SELECT payment_id, difficulty, n_wrong + n_invented AS problems, row_number() OVER (PARTITION BY difficulty ORDER BY payment_id) AS place FROM s WHERE n_wrong + n_invented > 0)
SELECT difficulty, CAST(place AS INTEGER) AS place, payment_id, problems FROM f WHERE place <= 5""")
def failure_examples(spark, d):
    """The first five failures of each difficulty: a limit that is the feature; Spark cuts the ranks per task before the shuffle."""
    failed = S.cells(S.score(E.extract(docs(spark, d))), "payment_id", "difficulty").where("correct = 0").groupBy("payment_id", "difficulty").agg(F.count("*").cast("int").alias("problems"))
    return failed.withColumn("place", F.row_number().over(W.partitionBy("difficulty").orderBy("payment_id"))).where("place <= 5")


NOISE = f"{D.draw('noise.kind', 3)}"
ROUTES = f"""{D.docs()},
n AS (SELECT * EXCLUDE (text), CASE WHEN {NOISE} = 0 THEN translate(text, '0', 'O') WHEN {NOISE} = 1 THEN translate(text, '5S', 'S5') ELSE text END AS text FROM d),
b AS (SELECT *, 'exact' AS route FROM d UNION ALL BY NAME SELECT *, 'recognised' AS route FROM n),
{D.extracted("b", "rules_v2", "e")},
{D.scored("e", "s")}"""
TRUTHS = "[" + ", ".join(f'"{k}"' for k in C.KEYS) + "]"
CAUSE = f"CASE WHEN got = '' THEN 'missing' WHEN list_contains(truths, got) THEN 'role' WHEN (field LIKE '%IBAN%' AND {D.iban_valid('got')}) OR (field LIKE '%BIC%' AND {D.bic_valid('got')}) THEN 'silent' ELSE 'caught' END"
DAMAGE = f"""t AS (SELECT *, {TRUTHS} AS truths FROM s),
c AS ({D.cells("t", "payment_id, route, truths")}),
m AS (SELECT payment_id, route, field, want, got, {CAUSE} AS cause FROM c WHERE want <> '' AND want <> got)"""


def routes(spark, d):
    """Every document by both routes, generated and rendered once."""
    return S.score(by_route(docs(spark, d))).withColumn("route", F.explode("routes")).drop("routes")


def by_route(base: DataFrame) -> DataFrame:
    """What the rules find in each text, with the ``routes`` that it came by: a text that recognition leaves as it was is read once for both."""
    rows = P.noisy(base.withColumn("__exact", F.col("text")))
    came = lambda text, *names: F.struct(F.array(*map(F.lit, names)).alias("routes"), F.col(text).alias("text"))
    each = F.when(F.col("text") == F.col("__exact"), F.array(came("text", "exact", "recognised"))).otherwise(F.array(came("__exact", "exact"), came("text", "recognised")))
    return E.extract(rows.withColumn("__came", F.explode(each)).withColumns({"routes": F.col("__came.routes"), "text": F.col("__came.text")}).drop("__came", "__exact"))


@query("damage_attribution", f"WITH {ROUTES},\n{DAMAGE}\nSELECT route, cause, field, count(*) AS n FROM m GROUP BY route, cause, field")
def damage_attribution(spark, d):
    return S.damages(routes(spark, d), "route").groupBy("route", "cause", "field").agg(F.count("*").alias("n"))


@query("damage_visibility", f"WITH {ROUTES},\n{DAMAGE}\nSELECT route, count(*) FILTER (cause IN ('missing', 'caught')) AS visible, count(*) FILTER (cause IN ('role', 'silent')) AS invisible, count(*) AS total FROM m GROUP BY route")
def damage_visibility(spark, d):
    m = S.damages(routes(spark, d), "route")
    return m.groupBy("route").agg(F.count_if(F.col("cause").isin("missing", "caught")).alias("visible"), F.count_if(F.col("cause").isin("role", "silent")).alias("invisible"), F.count("*").alias("total"))


@query("measure_routes", f"WITH {ROUTES}\nSELECT route, count(*) AS docs, CAST(sum(expected) AS BIGINT) AS fields, CAST(sum(correct) AS BIGINT) AS correct, {D.rate('sum(correct)', 'sum(expected)')} AS field_accuracy, {D.rate('count(*) FILTER (n_wrong = 0)', 'count(*)')} AS document_stp FROM s GROUP BY route")
def measure_routes(spark, d):
    out = routes(spark, d).groupBy("route").agg(F.count("*").alias("docs"), F.sum("expected").alias("fields"), F.sum("correct").alias("correct"), F.count_if("stp_loose").alias("n"))
    return out.select("route", "docs", "fields", "correct", S.rate(F.col("correct"), F.col("fields")).alias("field_accuracy"), S.rate(F.col("n"), F.col("docs")).alias("document_stp"))


@query("silent_damage_first6", f"""WITH {ROUTES},
{DAMAGE},
u AS (SELECT field, want, got, min(payment_id) AS first FROM m WHERE cause IN ('silent', 'role') AND route = 'recognised' GROUP BY field, want, got)
SELECT first, field, want, got FROM u ORDER BY first, field, got LIMIT 6""")
def silent_damage_first6(spark, d):
    m = S.damages(S.score(E.extract(P.noisy(docs(spark, d)))), "payment_id").where("cause in ('silent', 'role')")
    return m.groupBy("field", "want", "got").agg(F.min("payment_id").alias("first")).orderBy("first", "field", "got").limit(6).select("first", "field", "want", "got")


TRANSFORMS = """c AS (SELECT payment_id, original, x.name AS name, x.corrupting AS corrupting, x.value AS value FROM (SELECT payment_id, "CdtrAcct_IBAN" AS original, unnest([
  {name: 'zero_to_o', corrupting: true, value: replace(i, '0', 'O')}, {name: 'one_to_l', corrupting: true, value: replace(i, '1', 'l')},
  {name: 'five_to_s', corrupting: true, value: replace(i, '5', 'S')}, {name: 'eight_to_b', corrupting: true, value: replace(i, '8', 'B')},
  {name: 'two_to_z', corrupting: true, value: replace(i, '2', 'Z')}, {name: 'swap_12_13', corrupting: true, value: substr(i, 1, 12) || substr(i, 14, 1) || substr(i, 13, 1) || substr(i, 15)},
  {name: 'drop_9', corrupting: true, value: substr(i, 1, 9) || substr(i, 11)}, {name: 'digit_14', corrupting: true, value: substr(i, 1, 14) || coalesce(CAST((TRY_CAST(substr(i, 15, 1) AS INTEGER) + 3) % 10 AS VARCHAR), substr(i, 15, 1)) || substr(i, 16)},
  {name: 'space_9', corrupting: false, value: substr(i, 1, 9) || ' ' || substr(i, 10)}, {name: 'lower', corrupting: false, value: lower(i)}]) AS x FROM (SELECT *, "CdtrAcct_IBAN" AS i FROM p)) WHERE x.value <> original)"""


@query("corrupt", f"WITH {D.payments()}, {TRANSFORMS} SELECT payment_id, name, corrupting, value, {D.iban_valid('value')} AS valid FROM c")
def corrupt(spark, d):
    return P.corrupt(pay(spark, d)).select("payment_id", "name", "corrupting", "value", V.iban_valid(F.col("value")).alias("valid"))
