"""Queries over the schema model: elements, code lists, faults of messages, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import content as CM
from ..operators import xsd as X
from ..sources.files import spread
from .q_sequence import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


#: A small instruction with what schemas hold: code lists, a pattern, attributes, choices, a group within a group, repeats.
ORDER = (
    '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">'
    '<xs:simpleType name="Method"><xs:restriction base="xs:string"><xs:enumeration value="TRF"/><xs:enumeration value="CHK"/></xs:restriction></xs:simpleType>'
    '<xs:simpleType name="Spare"><xs:restriction base="xs:string"><xs:enumeration value="YES"/></xs:restriction></xs:simpleType>'
    '<xs:simpleType name="Ref"><xs:restriction base="xs:string"><xs:pattern value="[A-Z]{2}[0-9]{1,12}"/></xs:restriction></xs:simpleType>'
    '<xs:complexType name="Money"><xs:simpleContent><xs:extension base="xs:decimal"><xs:attribute name="Ccy" type="xs:string"/></xs:extension></xs:simpleContent></xs:complexType>'
    '<xs:complexType name="Party"><xs:sequence><xs:element name="Nm" type="xs:string"/><xs:element name="Ctry" type="xs:string" minOccurs="0"/></xs:sequence></xs:complexType>'
    '<xs:complexType name="When"><xs:choice><xs:element name="Dt" type="xs:string"/><xs:element name="Tm" type="xs:string"/></xs:choice></xs:complexType>'
    '<xs:element name="Doc"><xs:complexType><xs:sequence><xs:element name="Ins"><xs:complexType><xs:sequence>'
    '<xs:element name="Ref" type="Ref"/><xs:element name="Mtd" type="Method"/><xs:element name="When" type="When"/>'
    '<xs:element name="Pty" type="Party"/><xs:element name="Agt" type="Party" minOccurs="0"/>'
    '<xs:choice minOccurs="0"><xs:element name="Tel" type="xs:string"/><xs:element name="Mail" type="xs:string"/></xs:choice>'
    '<xs:element name="Note" type="xs:string" minOccurs="0" maxOccurs="2"/>'
    '<xs:element name="Line" maxOccurs="unbounded"><xs:complexType><xs:sequence><xs:element name="Amt" type="Money"/><xs:element name="Txt" type="xs:string" minOccurs="0"/></xs:sequence></xs:complexType></xs:element>'
    "</xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>"
)

#: The same elements as read by hand: path, least, most (0: no bound), required, in a choice, leaf, codes, attributes.
EXPECTED = (
    ("Doc", 1, 1, True, False, False, "", ""), ("Doc/Ins", 1, 1, True, False, False, "", ""), ("Doc/Ins/Ref", 1, 1, True, False, True, "", ""),
    ("Doc/Ins/Mtd", 1, 1, True, False, True, "TRF,CHK", ""), ("Doc/Ins/When", 1, 1, True, False, False, "", ""), ("Doc/Ins/When/Dt", 1, 1, False, True, True, "", ""),
    ("Doc/Ins/When/Tm", 1, 1, False, True, True, "", ""), ("Doc/Ins/Pty", 1, 1, True, False, False, "", ""), ("Doc/Ins/Pty/Nm", 1, 1, True, False, True, "", ""),
    ("Doc/Ins/Pty/Ctry", 0, 1, False, False, True, "", ""), ("Doc/Ins/Agt", 0, 1, False, False, False, "", ""), ("Doc/Ins/Agt/Nm", 1, 1, False, False, True, "", ""),
    ("Doc/Ins/Agt/Ctry", 0, 1, False, False, True, "", ""), ("Doc/Ins/Tel", 1, 1, False, True, True, "", ""), ("Doc/Ins/Mail", 1, 1, False, True, True, "", ""),
    ("Doc/Ins/Note", 0, 2, False, False, True, "", ""), ("Doc/Ins/Line", 1, 0, True, False, False, "", ""), ("Doc/Ins/Line/Amt", 1, 1, True, False, True, "", "Ccy"),
    ("Doc/Ins/Line/Txt", 0, 1, False, False, True, "", ""),
)


def _values() -> str:
    rows = ", ".join(f"('{p}', {a}, {z}, {str(r).lower()}, {str(c).lower()}, {str(f).lower()}, '{e}', '{n}')" for p, a, z, r, c, f, e, n in EXPECTED)
    return f"(VALUES {rows}) t(path, least, most, required, in_choice, is_leaf, codes, attributes)"


@query("xsd_tree", f"SELECT * FROM {_values()}")
def xsd_tree(spark, d):
    """Every element of a schema with its facets, attributes and bounds."""
    most, codes = F.coalesce("max_occurs", F.lit(0)).alias("most"), F.array_join("enumerations", ",").alias("codes")
    names = F.array_join("attribute_names", ",").alias("attributes")
    return X.node_table(spark, ORDER).select("path", F.col("min_occurs").alias("least"), most, "required", "in_choice", "is_leaf", codes, names)


@query("code_lists", """SELECT t.*, CASE WHEN code = 'TRF' THEN (SELECT count(*) FROM orders WHERE o_orderkey % 16 <> 3) ELSE 0 END AS given
 FROM (VALUES ('Method', 'TRF', true), ('Method', 'CHK', true), ('Spare', 'YES', false)) t(type_name, code, reachable)""")
def code_lists(spark, d):
    """Every code of the schema's types, and how many values of the orders' messages have it."""
    types = X.node_table(spark, ORDER).where(F.size("enumerations") > 0).select("path", "type_name")
    # as many rows as the schema has elements with codes
    values = order_rows(spark, d).where("value is not null").join(F.broadcast(types), "path").groupBy("type_name", F.col("value").alias("code")).agg(F.count("*").alias("given"))
    return X.code_lists(spark, ORDER).join(values, ["type_name", "code"], "left").select("type_name", "code", "reachable", F.coalesce("given", F.lit(0)).alias("given"))


@query("required_paths", f"""SELECT CASE WHEN path = 'Doc/Ins/When' THEN 'choice' ELSE 'required' END AS kind, path FROM {_values()}
 WHERE (is_leaf AND least > 0 AND NOT in_choice) OR path = 'Doc/Ins/When'""")
def required_paths(spark, d):
    """Leaves that must be there once their parent is, and choices."""
    kind = F.when(F.col("is_choice"), "choice").when(F.col("is_leaf") & F.col("required_here"), "required").alias("kind")
    return X.node_table(spark, ORDER).select(kind, "path").where("kind is not null")


def order_rows(spark, d):
    """(order, path, value): a message for each order; by the key's remainder of 16, one kind of fault is planted, none at 0, 10 and from 11 on."""
    m, i = F.col("o_orderkey") % 16, "Doc/Ins/"
    put = lambda path, value, when=F.lit(True): F.struct(F.lit(i + path).alias("path"), F.when(when, value).alias("value"))
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    cells = [
        put("Ref", F.concat(F.when(m == 8, "or").otherwise("OR"), F.col("o_orderkey").cast("string")), m != 1), put("Mtd", F.when(m == 3, "ZZZ").otherwise("TRF")),
        put("When/Dt", F.lit("2026-01-02"), m != 5), put("When/Tm", F.lit("10:00"), m == 2), put("Pty/Nm", F.lit("A"), m != 7), put("Agt/Ctry", F.lit("FR"), m == 6),
        put("Tel", F.lit("1"), m.isin(9, 10)), put("Mail", F.lit("a@b"), m == 9),
        put("Note", F.lit("a")), put("Note", F.lit("b")), put("Note", F.lit("c"), m == 4), put("Line[1]/Amt", price), put("Line[2]/Amt", price, m != 1),
        put("Line[2]/Txt", F.lit("t")), put("Bogus", F.lit("x"), m == 3), put("Pty", F.lit("x"), m == 5),
    ]
    return spread(table(spark, d, "orders")).select(F.col("o_orderkey").alias("payment_id"), F.explode(F.array(*cells)).alias("c")).select("payment_id", "c.*")


FAULTS = """f AS (SELECT * FROM (VALUES (1, 'missing', 'Doc/Ins/Ref'), (1, 'missing', 'Doc/Ins/Line[2]/Amt'), (2, 'branches', 'Doc/Ins/When'), (3, 'code', 'Doc/Ins/Mtd'),
 (3, 'undeclared', 'Doc/Ins/Bogus'), (4, 'repeats', 'Doc/Ins/Note'), (5, 'choice', 'Doc/Ins/When'), (5, 'shape', 'Doc/Ins/Pty'), (6, 'missing', 'Doc/Ins/Agt/Nm'), (7, 'missing', 'Doc/Ins/Pty/Nm'),
 (8, 'pattern', 'Doc/Ins/Ref'), (9, 'branches', 'Doc/Ins/(Tel|Mail)')) t(m, kind, path))"""


@query("build_errors", f"WITH {FAULTS} SELECT o_orderkey AS payment_id, kind, path FROM orders JOIN f ON o_orderkey % 16 = m")
def build_errors(spark, d):
    """Every fault of messages in which each kind is planted."""
    return X.faults(order_rows(spark, d), ORDER)


@query("build_order_message", f"""WITH {FAULTS}, e AS (SELECT m, list(kind || ' ' || path ORDER BY kind || ' ' || path) AS errors FROM f GROUP BY m),
 o AS (SELECT o_orderkey AS payment_id, o_orderkey % 16 AS m, CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS VARCHAR) AS price FROM orders)
 SELECT payment_id, '<Doc><Ins>' || CASE m WHEN 1 THEN '' WHEN 8 THEN '<Ref>or' || payment_id || '</Ref>' ELSE '<Ref>OR' || payment_id || '</Ref>' END || CASE m WHEN 3 THEN '<Mtd>ZZZ</Mtd>' ELSE '<Mtd>TRF</Mtd>' END
 || CASE m WHEN 5 THEN '' ELSE '<When><Dt>2026-01-02</Dt></When>' END || CASE m WHEN 7 THEN '' ELSE '<Pty><Nm>A</Nm></Pty>' END || CASE m WHEN 6 THEN '<Agt><Ctry>FR</Ctry></Agt>' ELSE '' END
 || CASE WHEN m IN (9, 10) THEN '<Tel>1</Tel>' ELSE '' END || '<Note>a</Note><Note>b</Note>' || CASE m WHEN 4 THEN '<Note>c</Note>' ELSE '' END || '<Line><Amt Ccy="EUR">' || price || '</Amt></Line><Line>'
 || CASE m WHEN 1 THEN '' ELSE '<Amt Ccy="EUR">' || price || '</Amt>' END || '<Txt>t</Txt></Line></Ins></Doc>' AS xml, errors IS NULL AS ok, coalesce(array_to_string(errors, ', '), '') AS errors FROM o LEFT JOIN e USING (m)""")
def build_order_message(spark, d):
    """Messages written in the schema's order, repeats by their counters and one branch of each choice, with what is wrong with them."""
    rows = order_rows(spark, d).withColumn("ccy", F.when(F.col("path").endswith("/Amt"), "EUR"))
    return CM.build(rows, ORDER).withColumn("errors", F.array_join("errors", ", "))


def placed_rows(spark, d):
    """(order, path, value, ccy, ord): a message in document order for each order; from 1 to 7, the key's remainder of 16 plants a fault of the content model."""
    m = F.col("o_orderkey") % 16
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    line = F.transform(F.sequence(F.lit(1), F.lit(1) + F.col("o_orderkey").cast("int") % 5), lambda n: F.struct(F.concat(F.lit("Doc/Ins/Line["), n, F.lit("]/Amt")).alias("path"), price.alias("value")))
    put = lambda path, value, when=F.lit(True): F.struct(F.lit(f"Doc/Ins/{path}").alias("path"), F.when(when, value).alias("value"))
    cells = F.array(
        put("Ref", F.concat(F.lit("OR"), F.col("o_orderkey").cast("string"))), put("Mtd", F.lit("TRF")), put("When/Dt", F.lit("d")), put("When/Tm", F.lit("t"), m == 5), put("Note", F.lit("a"), m == 1),
        put("Pty/Nm", F.lit("A"), m != 7), put("Pty/Ctry", F.lit("FR"), m == 7), put("Tel", F.lit("1"), m.isin(2, 6)), put("Agt/Nm", F.lit("B"), m == 6), put("Mail", F.lit("a@b"), (m == 2) | (m > 8)),
        put("Note[1]", F.lit("a"), m.isin(3, 9)), put("Note[2]", F.lit("b"), m.isin(3, 9)), put("Note[3]", F.lit("c"), m == 3),
    )
    rows = F.concat(cells, F.when(m == 4, F.array().cast("array<struct<path: string, value: string>>")).otherwise(line))
    out = spread(table(spark, d, "orders")).select(F.col("o_orderkey").alias("payment_id"), F.posexplode(rows).alias("ord", "c")).select("payment_id", "ord", "c.*")
    return out.withColumn("ccy", F.when(F.col("path").endswith("/Amt"), "EUR"))


@query("content_faults", """WITH f AS (SELECT * FROM (VALUES (1, 'unexpected', 'Doc/Ins/Note', 'Pty'), (2, 'unexpected', 'Doc/Ins/Mail', 'Line, Note'), (3, 'unexpected', 'Doc/Ins/Note[3]', 'Line'),
 (4, 'incomplete', 'Doc/Ins', 'Agt, Line, Mail, Note, Tel'), (5, 'unexpected', 'Doc/Ins/When/Tm', ''), (6, 'unexpected', 'Doc/Ins/Agt', 'Line, Note'), (7, 'unexpected', 'Doc/Ins/Pty/Ctry', 'Nm'),
 (7, 'incomplete', 'Doc/Ins/Pty', 'Nm')) t(m, kind, path, expected)) SELECT o_orderkey AS payment_id, kind, path, expected FROM orders JOIN f ON o_orderkey % 16 = m""")
def content_faults(spark, d):
    """Elements out of order, beyond a choice or a bound, and elements that end too early, by the automata of the schema."""
    return CM.violations(placed_rows(spark, d), ORDER).withColumn("expected", F.array_join("expected", ", "))


@query("content_agrees", "SELECT o_orderkey AS payment_id, o_orderkey % 16 NOT BETWEEN 1 AND 7 AS model_ok, o_orderkey % 16 NOT BETWEEN 1 AND 7 AS xsd_ok FROM orders")
def content_agrees(spark, d):
    """The automata's word on a message beside that of the JVM's validator on the same message written as XML."""
    rows = placed_rows(spark, d)
    bad = CM.violations(rows, ORDER).select("payment_id").distinct().withColumn("model_ok", F.lit(False))
    seen = X.validate(CM.render(rows), ORDER).drop("xml").join(bad, "payment_id", "left")
    return seen.select("payment_id", F.coalesce("model_ok", F.lit(True)).alias("model_ok"), "xsd_ok")


@query("xsd_validate", "SELECT o_orderkey AS payment_id, o_orderkey % 8 = 0 AS xsd_ok FROM orders")
def xsd_validate(spark, d):
    """The JVM validator's word on messages in which each kind of fault but undeclared ones is planted; at 0 none, and at 7 the text is cut."""
    m = F.col("payment_id") % 8
    el = lambda name, when, value: F.when(when, F.lit(f"<{name}>{value}</{name}>")).otherwise("")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("payment_id"))
    line = F.concat(F.lit('<Line><Amt Ccy="EUR">'), F.when(m == 1, "ten").otherwise("10.00"), F.lit("</Amt></Line>"))
    ref = F.when(m == 6, F.lit("<Ref>or</Ref>")).otherwise(F.concat(F.lit("<Ref>OR"), F.col("payment_id").cast("string"), F.lit("</Ref>")))
    xml = F.concat(
        F.lit("<Doc><Ins>"), ref, F.lit("<Mtd>"), F.when(m == 3, "ZZZ").otherwise("CHK"), F.lit("</Mtd><When>"), el("Dt", m != 5, "d"), el("Tm", m == 2, "t"), F.lit("</When><Pty><Nm>A</Nm></Pty>"),
        el("Note", F.lit(True), "a"), el("Note", m == 4, "b"), el("Note", m == 4, "c"), line, F.when(m == 7, "").otherwise("</Ins></Doc>"),
    )
    return X.validate(o.withColumn("xml", xml), ORDER).drop("xml")
