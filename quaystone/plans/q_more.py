"""Further queries: single functions by name, message assembly, scans, ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import mt as M
from ..functions import routing as R
from ..functions import text as T
from ..functions import validators as V
from ..operators import capture as K
from ..operators import content as CM
from ..operators import extract as E
from ..operators import gate as G
from ..operators import payments as P
from ..operators import schema as SC
from ..operators import score as S
from ..operators import xsd as X
from ..sources import ingest as IN
from . import duck as D
from .q_extract import BOTH, ROUTES, SPLIT_KEY, TRUTHS, V2, both, docs, pay, routes
from .q_message import MT, message, messages
from .q_sequence import PATHS_SQL, slots
from .q_sequence import SQL as SQL_S

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("iban_country", f"""WITH {D.payments()} SELECT payment_id, substr("DbtrAcct_IBAN", 1, 2) AS country, '' AS none FROM p""")
def iban_country(spark, d):
    return pay(spark, d).select("payment_id", R.iban_country(F.lower("DbtrAcct_IBAN")).alias("country"), R.iban_country(F.substring("DbtrAcct_IBAN", 3, 9)).alias("none"))


@query("logical_terminal", f"""WITH {D.payments()} SELECT payment_id, substr("CdtrAgt_BICFI", 1, 8) || 'A' || CASE WHEN length("CdtrAgt_BICFI") = 11 THEN substr("CdtrAgt_BICFI", 9, 3) ELSE 'XXX' END AS terminal FROM p""")
def logical_terminal(spark, d):
    return pay(spark, d).select("payment_id", R.logical_terminal(F.lower("CdtrAgt_BICFI")).alias("terminal"))


@query("fmt_date", f"""WITH {D.payments()} SELECT payment_id, unnest([strftime(CAST("ReqdExctnDt_Dt" AS DATE), '%d/%m/%Y'), strftime(CAST("ReqdExctnDt_Dt" AS DATE), '%d %b %Y'), strftime(CAST("ReqdExctnDt_Dt" AS DATE), '%m/%d/%Y')]) AS shown FROM p""")
def fmt_date(spark, d):
    x = F.to_date("ReqdExctnDt_Dt")
    return pay(spark, d).select("payment_id", F.explode(F.array(*[F.date_format(x, f) for f in ("dd/MM/yyyy", "dd MMM yyyy", "MM/dd/yyyy")])).alias("shown"))


@query("field_counts", f"WITH {D.docs()} SELECT difficulty, count(*) AS docs, CAST(count(*) * {len(C.KEYS)} AS BIGINT) AS fields FROM d GROUP BY difficulty")
def field_counts(spark, d):
    return S.score(E.extract(docs(spark, d), "rules_v1")).groupBy("difficulty").agg(F.count("*").alias("docs"), F.sum("expected").cast("long").alias("fields"))


@query("is_plausible", f"""WITH {V2}, c AS ({D.cells("s")}) SELECT payment_id, field, coalesce(CASE WHEN field LIKE '%IBAN%' THEN {D.iban_valid("got")} WHEN field LIKE '%BIC%' THEN {D.bic_valid("got")} ELSE false END, false) AS plausible FROM c WHERE got <> ''""")
def is_plausible(spark, d):
    return E.long_form(docs(spark, d)).select("payment_id", "field", V.plausible(F.col("field"), F.col("value")).alias("plausible"))


@query("validated_values", f"""WITH {D.payments()}, x AS (SELECT payment_id, CASE WHEN payment_id % 4 = 0 THEN "Amt_InstdAmt" || '0' ELSE "Amt_InstdAmt" END AS amount, CASE WHEN payment_id % 5 = 0 THEN 'JPY' ELSE "Amt_InstdAmt_Ccy" END AS ccy, CASE WHEN payment_id % 7 = 0 THEN replace("CdtrAcct_IBAN", '0', 'O') ELSE "CdtrAcct_IBAN" END AS iban FROM p)
SELECT payment_id, {D.iban_valid("iban")} AS iban_ok, {D.minor_units_ok("amount", "ccy")} AS strict_units_ok FROM x""")
def validated_values(spark, d):
    """The gate on an amount's decimals as it is meant: on the key that the schema gives. Under the reference's own keys it never fires."""
    k = F.col("payment_id")
    x = pay(spark, d).select("payment_id", F.when(k % 4 == 0, F.concat("Amt_InstdAmt", F.lit("0"))).otherwise(F.col("Amt_InstdAmt")).alias("a"), F.when(k % 5 == 0, "JPY").otherwise(F.col("Amt_InstdAmt_Ccy")).alias("c"), F.when(k % 7 == 0, F.replace("CdtrAcct_IBAN", F.lit("0"), F.lit("O"))).otherwise(F.col("CdtrAcct_IBAN")).alias("i"))
    return x.select("payment_id", V.iban_valid(F.col("i")).alias("iban_ok"), V.minor_units_ok(F.col("a"), F.col("c")).alias("strict_units_ok"))


def charges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.CHARGES_TO_MX.items()), "mt string, mx string")


@query("external_codes", f"SELECT o_orderkey AS payment_id, mt, mx FROM (SELECT o_orderkey, ([{D.values(C.CHARGES_TO_MX)}])[o_orderkey % {len(C.CHARGES_TO_MX)} + 1] AS mt FROM orders) o JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in C.CHARGES_TO_MX.items()) + ") t(mt, mx) USING (mt)")
def external_codes(spark, d):
    """Each order's charge code in the other standard's words; the codes go round by the key."""
    code = F.get(F.array(*[F.lit(x) for x in C.CHARGES_TO_MX]), F.pmod("o_orderkey", F.lit(len(C.CHARGES_TO_MX))).cast("int"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("payment_id"), code.alias("mt"))
    # a list of a few codes
    return rows.join(F.broadcast(charges(spark)), "mt").select("payment_id", "mt", "mx")


@query("code_list_membership", f"WITH x AS (SELECT o_orderkey, (['SHA', 'OUR', 'NOPE', 'BEN'])[o_orderkey % 4 + 1] AS code FROM orders) SELECT o_orderkey, code FROM x WHERE code NOT IN ({D.values(C.CHARGES_TO_MX)})")
def code_list_membership(spark, d):
    codes = F.get(F.array(*[F.lit(x) for x in ("SHA", "OUR", "NOPE", "BEN")]), F.pmod("o_orderkey", F.lit(4)).cast("int"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", codes.alias("code"))
    # seven codes
    return rows.join(F.broadcast(charges(spark).select(F.col("mt").alias("code"))), "code", "left_anti").select("o_orderkey", "code")


@query("params_cross", "SELECT a.x AS minutes, b.y AS hourly, o_orderstatus AS status, n, n * a.x / 60 * b.y AS cost FROM (SELECT unnest([2.0::DOUBLE, 5.0::DOUBLE, 8.0::DOUBLE]) AS x) a, (SELECT unnest([25.0::DOUBLE, 45.0::DOUBLE]) AS y) b, (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) o")
def params_cross(spark, d):
    """The cost of working on the orders of each status, over a grid of six pairs of parameters."""
    grid = F.explode(F.array(*[F.struct(F.lit(x).alias("minutes"), F.lit(y).alias("hourly")) for x in (2.0, 5.0, 8.0) for y in (25.0, 45.0)])).alias("g")
    n = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return n.select("status", "n", grid).select("g.minutes", "g.hourly", "status", "n", (F.col("n") * F.col("g.minutes") / 60 * F.col("g.hourly")).alias("cost"))


@query("grounded_rate", f"""WITH {D.docs()}, h AS (SELECT difficulty, {D.alnum("text")} || '|' || {" || '|' || ".join(D.alnum(f'"{k}"') for k in C.KEYS)} AS hay, {D.alnum('"Cdtr_Nm"')} AS v, payment_id FROM d)
SELECT difficulty, round(avg(CASE WHEN contains(hay, v) AND contains(hay, 'INVENTED') = (payment_id % 4 = 0) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM h GROUP BY difficulty""")
def grounded_rate(spark, d):
    """A name that is grounded, and for each fourth document a word that is not."""
    hay = F.concat_ws("|", V.alnum(F.col("text")), *[V.alnum(F.col(k)) for k in C.KEYS])
    ok = V.let(hay, lambda h: h.contains(V.alnum(F.col("Cdtr_Nm"))) & (h.contains("INVENTED") == (F.col("payment_id") % 4 == 0)))
    return docs(spark, d).groupBy("difficulty").agg(F.round(F.avg(ok.cast("double")), 6).alias("rate"))


def _misplaced(v: str, there: str, here: str) -> str:
    return f"{v} <> '' AND list_contains({there}, {v}) AND NOT list_contains({here}, {v})"


@query("role_lookup", f"""WITH {D.docs()}, x AS (SELECT payment_id, {D.alnum('"CdtrAcct_IBAN"')} AS c, {D.alnum('"DbtrAcct_IBAN"')} AS d, list_zip(list_transform(regexp_extract_all(text, '{C.ROLE_LINE}', 1), lambda x: lower(trim(x))), list_transform(regexp_extract_all(text, '{C.ROLE_LINE}', 2), lambda x: {D.alnum("x")})) AS l FROM d),
z AS (SELECT *, list_transform(list_filter(l, lambda x: x[2] <> '' AND regexp_matches(x[1], '{"|".join(C.DEBTOR_WORDS)}')), lambda x: x[2]) AS dv, list_transform(list_filter(l, lambda x: x[2] <> '' AND NOT regexp_matches(x[1], '{"|".join(C.DEBTOR_WORDS)}') AND regexp_matches(x[1], '{"|".join(C.CREDITOR_WORDS)}')), lambda x: x[2]) AS cv FROM x)
SELECT payment_id, list_contains(cv, c) AS under_creditor, list_contains(dv, d) AS under_debtor, {_misplaced("c", "dv", "cv")} AS creditor_inverted, {_misplaced("d", "cv", "dv")} AS debtor_inverted FROM z""")
def role_lookup(spark, d):
    """Each party's account among the values under its own labels, and whether it stands under the other party's labels only."""
    return G.with_lookup(docs(spark, d), F.col("text"), F.col("DbtrAcct_IBAN"), F.col("CdtrAcct_IBAN")).select("payment_id", "under_creditor", "under_debtor", "creditor_inverted", "debtor_inverted")


@query("model_eval", f"""WITH {BOTH} SELECT extractor, difficulty, count(*) AS docs, count(*) FILTER (n_wrong = 0 AND n_invented = 0) AS stp, {D.rate("sum(correct)", "sum(expected)")} AS recall, {D.rate("count(*) FILTER (n_invented > 0)", "count(*)")} AS hallucination_rate FROM s GROUP BY extractor, difficulty""")
def model_eval(spark, d):
    """Hallucination is counted by document here, by field in ``rates``."""
    g = both(spark, d).groupBy("extractor", "difficulty").agg(F.count("*").alias("docs"), F.count_if("stp_strict").alias("stp"), F.sum("correct").alias("c"), F.sum("expected").alias("e"), F.count_if(F.col("n_invented") > 0).alias("h"))
    return g.select("extractor", "difficulty", "docs", "stp", S.rate(F.col("c"), F.col("e")).alias("recall"), S.rate(F.col("h"), F.col("docs")).alias("hallucination_rate"))


@query("ngram_validity", "SELECT conv_id, turn, turn_no >= 2 AS order2, turn_no >= 3 AS order3 FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations)")
def ngram_validity(spark, d):
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", n.alias("n")).select("conv_id", "turn", (F.col("n") >= 2).alias("order2"), (F.col("n") >= 3).alias("order3"))


@query("split_intersection", f"""WITH {D.payments()}, b AS (SELECT "PmtId_EndToEndId" AS e, ('0x' || substr(sha256('99:' || {SPLIT_KEY}), 1, 8))::BIGINT % 1000 < 500 AS v FROM p) SELECT e FROM b WHERE v INTERSECT SELECT e FROM b WHERE NOT v""")
def split_intersection(spark, d):
    rows = pay(spark, d).select(F.col("PmtId_EndToEndId").alias("e"), (T.bucket(T.value_key(list(C.KEYS)), 99, 1000) < 500).alias("v"))
    return rows.where("v").select("e").intersect(rows.where("not v").select("e"))


@query("recognition_tax", f"WITH {ROUTES}, r AS (SELECT route, sum(correct) / CAST(sum(expected) AS DOUBLE) AS a FROM s GROUP BY route) SELECT round(max(a) FILTER (route = 'exact') - max(a) FILTER (route = 'recognised'), 6) AS tax FROM r")
def recognition_tax(spark, d):
    r = routes(spark, d).groupBy("route").agg((F.sum("correct").cast("double") / F.sum("expected")).alias("a"))
    return r.agg(F.round(F.max(F.when(F.col("route") == "exact", F.col("a"))) - F.max(F.when(F.col("route") == "recognised", F.col("a"))), 6).alias("tax"))


@query("parse_mt103", f"""WITH {D.payments()}, {MT} SELECT payment_id, regexp_extract(regexp_extract(raw, '\\{{1:([^}}]*)\\}}', 1), 'F01([A-Z0-9]{{8,11}})', 1) AS sender, 'BANKFRPPXXX' AS receiver, '00000000-0000-4000-8000-000000000000' AS uetr, 8 AS tags FROM m""")
def parse_mt103(spark, d):
    raw = F.col("raw")
    return messages(spark, d).select("payment_id", M.sender(raw).alias("sender"), M.receiver(raw).alias("receiver"), M.uetr(raw).alias("uetr"), F.size(M.tags(raw)).alias("tags"))


@query("values_from_mt", f"""WITH {D.payments()} SELECT payment_id, CASE WHEN payment_id % 3 = 0 THEN '' ELSE "CdtrAcct_IBAN" END AS account FROM p""")
def values_from_mt(spark, d):
    """A text that is no message gives nothing, and no error."""
    rows = messages(spark, d).withColumn("raw", F.when(F.col("payment_id") % 3 == 0, "not a message").otherwise(F.col("raw")))
    return rows.select("payment_id", M.party(M.tag(M.tags(F.col("raw")), "59"))[0].alias("account"))


@query("values_from_mx", f"""WITH {D.payments()} SELECT payment_id, CASE WHEN payment_id % 4 = 0 THEN "CdtrAcct_IBAN" ELSE '' END AS account, CASE WHEN payment_id % 4 = 0 THEN "PmtId_EndToEndId" ELSE '' END AS e2e FROM p""")
def values_from_mx(spark, d):
    """Texts that are cut short, no XML or null give nothing, and no error."""
    xml, k = M.mx_render(message(p := pay(spark, d))), F.col("payment_id") % 4
    rows = p.select("payment_id", F.when(k == 0, xml).when(k == 1, F.left(xml, F.length(xml) - 3)).when(k == 2, "not a message").alias("xml"))
    found = M.mx_fields(F.col("xml"))
    return rows.select("payment_id", F.coalesce(found["CdtrAcct_IBAN"], F.lit("")).alias("account"), F.coalesce(found["PmtId_EndToEndId"], F.lit("")).alias("e2e"))


@query("describe_schema", f"WITH {PATHS_SQL}, g AS (SELECT path, count(*) AS n FROM ({SQL_S['to_slots']}) GROUP BY path) SELECT count(*) AS leaves, count(*) FILTER (required) AS required, count(*) FILTER (ccy) AS amounts, count(n) AS used, CAST(coalesce(sum(n), 0) AS BIGINT) AS given FROM xp LEFT JOIN g USING (path)")
def describe_schema(spark, d):
    """The schema's leaves by kind, how many of them the payments' messages use, and their values."""
    leaves = SC.leaf_paths(spark, SC.SCHEMA)
    n = SC.to_slots(slots(spark, d), SC.field_specs(leaves)).groupBy("path").agg(F.count("*").alias("n"))
    return leaves.join(n, "path", "left").agg(F.count("*").alias("leaves"), F.count_if("required").alias("required"), F.count_if("ccy").alias("amounts"), F.count("n").alias("used"), F.coalesce(F.sum("n"), F.lit(0)).alias("given"))


@query("role_of_path", f"WITH {PATHS_SQL} SELECT path, coalesce(list_filter(string_split(path, '/'), lambda x: list_contains([{D.values(C.CORE_ROLES)}], x))[1], '') AS role FROM xp WHERE required")
def role_of_path(spark, d):
    return SC.leaf_paths(spark, SC.SCHEMA).where("required").select("path", SC.role(F.col("path")).alias("role"))


@query("json_schema_for")
def json_schema_for(spark, d):
    """The JSON Schema of the extraction targets that the payments give."""
    return SC.json_schema(SC.field_specs(SC.leaf_paths(spark, SC.SCHEMA)).join(slots(spark, d).select("field_key").distinct(), "field_key", "left_semi"))


@query("fill_system_fields", f"""WITH {D.payments()}, {PATHS_SQL}, n AS (SELECT path, string_split(path, '/')[-1] AS name FROM xp WHERE required), h AS (SELECT payment_id, upper(sha256(CAST(payment_id AS VARCHAR))) AS x FROM p),
 f AS (SELECT payment_id, path, CASE name WHEN 'MsgId' THEN 'MSG-' || substr(x, 1, 16) WHEN 'PmtInfId' THEN 'PMT-' || substr(x, 17, 12) WHEN 'CreDtTm' THEN '2026-01-01T00:00:00Z' WHEN 'NbOfTxs' THEN '1'
 WHEN 'PmtMtd' THEN 'TRF' WHEN 'SttlmMtd' THEN 'INDA' WHEN 'BtchBookg' THEN 'false' END AS value FROM h, n) SELECT * FROM f WHERE value IS NOT NULL""")
def fill_system_fields(spark, d):
    """Generated ids, counts and defaults of each message; ids are hashes of the key, the time is a parameter."""
    leaves = SC.leaf_paths(spark, SC.SCHEMA)
    return SC.system_fields(SC.to_slots(slots(spark, d), SC.field_specs(leaves)), leaves, "2026-01-01T00:00:00Z")


def _written(path: str) -> str:
    """SQL text of an element of the built-in schema and all below it, from the values of the columns named by its leaves' paths."""
    inner = [n["path"] for n in X.nodes(SC.SCHEMA) if n["parent"] == path]
    name = path.rsplit("/", 1)[-1]
    if inner:
        return f"coalesce('<{name}>' || nullif({' || '.join(_written(p) for p in inner)}, '') || '</{name}>', '')"
    text = f"replace(replace(replace(max(value) FILTER (path = '{path}'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    ccy = f"coalesce(' Ccy=\"' || max(ccy) FILTER (path = '{path}') || '\"', '')"
    return f"coalesce('<{name}' || {ccy} || '>' || {text} || '</{name}>', '')"


@query("build_message", f"""WITH a AS (SELECT payment_id, path, value, ccy FROM ({SQL_S["to_slots"]}) UNION ALL SELECT payment_id, path, value, NULL FROM ({SQL["fill_system_fields"]}))
 SELECT payment_id, {_written("Document")} AS xml, false AS ok, 'choice Document/CstmrCdtTrfInitn/PmtInf/ReqdExctnDt' AS errors FROM a GROUP BY payment_id""")
def build_message(spark, d):
    """Each message's XML in schema order, from its values and system fields, and what the schema still asks for: the payments give no date."""
    leaves = SC.leaf_paths(spark, SC.SCHEMA)
    placed = SC.to_slots(slots(spark, d), SC.field_specs(leaves))
    rows = SC.with_system_fields(placed, leaves, "2026-01-01T00:00:00Z")
    return CM.build(rows, SC.SCHEMA).withColumn("errors", F.array_join("errors", ", "))


INBOUND = """o AS (SELECT o_orderkey AS id, o_orderkey % 7 AS m FROM orders), c AS (SELECT * FROM (VALUES
 (0, 0, 'message/rfc822', 'email-body', 'text', 'see attached', '2 attachments kept apart from the body'),
 (0, 1, 'application/edi', 'email-attachment', 'structured', '{1:F01}', 'structured message: parsed, never recognised|parsed as a message; no recognition performed'),
 (0, 2, 'image/png', 'email-attachment', 'ocr', '', 'raster input: recognition required, no text layer exists|OCR required but no backend supplied'),
 (1, 0, 'application/edi', 'edi', 'structured', '{4::20:X}', 'structured message: parsed, never recognised|parsed as a message; no recognition performed'),
 (2, 0, 'application/pdf', 'pdf', 'ocr', '', 'no text layer: this is a scan and needs recognition|no PDF renderer available; text is unavailable, not empty|OCR required but no backend supplied'),
 (3, 0, 'image/png', 'fax', 'ocr', '', 'raster input: recognition required, no text layer exists|OCR required but no backend supplied'),
 (4, 0, 'text/plain', 'email-body', 'text', 'a plain instruction that is long enough to be taken for text', ''),
 (6, 0, 'application/pdf', 'pdf', 'probe', 'IBAN DE89370400440532013000', 'text layer extracted; nothing rendered|text layer accepted without OCR'),
(5, 0, 'application/octet-stream', 'email-body', 'text', '', 'unrecognised type ''application/octet-stream''; refusing to guess a parser')) t(m, part_no, media_type, channel, path, text, notes))"""


def inbound(spark, d):
    """A file for each order: by the key's remainder of 7 a mail with two attachments, a message, a cut PDF, an image, a text, bytes of no type, or a PDF with a text."""
    m = F.col("id") % 7
    page = "BT /F1 12 Tf 72 720 Td (IBAN DE893704) Tj (00440532013000) Tj ET"
    whole = f"%PDF-1.7\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[3 0 R]/Count 1>>\nendobj\n3 0 obj\n<</Type/Page/Contents 4 0 R>>\nendobj\n4 0 obj\n<</Length {len(page)}>>\nstream\n{page}\nendstream\nendobj\n"
    part = 'Content-Type: application/octet-stream\nContent-Disposition: attachment; filename="%s"\nContent-Transfer-Encoding: base64\n\n%s\n--edge'
    head = 'From: a@example.com\nTo: b@example.com\nSubject: pay\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="edge"\n\n--edge\nContent-Type: text/plain\n\nsee attached\n--edge\n'
    letter = head + part % ("pay.edi", "ezE6RjAxfQ==") + "\n" + part % ("scan.png", "iVBORw0KGgo=") + "--\n"
    bytes_ = F.when(m == 0, F.lit(letter)).when(m == 1, "{4::20:X}").when(m == 2, "%PDF-1.7").when(m == 6, F.lit(whole)).when(m == 4, "a plain instruction that is long enough to be taken for text").otherwise("?")
    content = F.when(m == 3, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(bytes_.cast("binary"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("id"))
    return o.select("id", F.lit(None).cast("string").alias("filename"), F.lit("").alias("mime"), content.alias("content"))


@query("ingest", f"WITH {INBOUND} SELECT id, part_no, media_type, channel, path, text, false AS used_ocr, notes FROM o JOIN c USING (m)")
def ingest(spark, d):
    """Inbound files of every type to captured texts with their notes."""
    return IN.ingest(inbound(spark, d)).select("id", "part_no", "media_type", "channel", "path", F.trim("text").alias("text"), "used_ocr", F.array_join("notes", "|").alias("notes"))


@query("describe_routes", f"""WITH {INBOUND}, l AS (SELECT id, part_no, printf('  %d. %-18s %-11s free', part_no + 1, channel, path) || CASE WHEN notes = '' THEN '' ELSE chr(10) || '       - ' || replace(notes, '|', chr(10) || '       - ') END AS x
 FROM o JOIN c USING (m)) SELECT id, string_agg(x, chr(10) ORDER BY part_no) AS audit FROM l GROUP BY id""")
def describe_routes(spark, d):
    """The audit of every file's routing."""
    return IN.describe(IN.ingest(inbound(spark, d)))
