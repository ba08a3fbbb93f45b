"""Message schemas as path tables: walked once on the driver, then joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from .xsd import nodes as xsd_nodes


def _simple(name: str, kind: str, required: bool = True) -> str:
    return f'<xs:element name="{name}" type="{kind}"' + ("/>" if required else ' minOccurs="0"/>')


#: A small credit transfer initiation, of the elements that payments use.
SCHEMA = (
    '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">'
    '<xs:complexType name="Account"><xs:sequence><xs:element name="Id"><xs:complexType><xs:choice>'
    + _simple("IBAN", "Text") + '<xs:element name="Othr"><xs:complexType><xs:sequence>' + _simple("Id", "Text") + "</xs:sequence></xs:complexType></xs:element>"
    "</xs:choice></xs:complexType></xs:element></xs:sequence></xs:complexType>"
    '<xs:complexType name="Agent"><xs:sequence><xs:element name="FinInstnId"><xs:complexType><xs:sequence>' + _simple("BICFI", "Text", False) + "</xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType>"
    '<xs:complexType name="Party"><xs:sequence>' + _simple("Nm", "Text", False) + "</xs:sequence></xs:complexType>"
    '<xs:complexType name="Money"><xs:simpleContent><xs:extension base="xs:decimal"><xs:attribute name="Ccy" use="required"/></xs:extension></xs:simpleContent></xs:complexType>'
    '<xs:element name="Document"><xs:complexType><xs:sequence><xs:element name="CstmrCdtTrfInitn"><xs:complexType><xs:sequence>'
    '<xs:element name="GrpHdr"><xs:complexType><xs:sequence>' + _simple("MsgId", "Text") + _simple("CreDtTm", "Text") + _simple("NbOfTxs", "Text") + '<xs:element name="InitgPty" type="Party"/></xs:sequence></xs:complexType></xs:element>'
    '<xs:element name="PmtInf" maxOccurs="unbounded"><xs:complexType><xs:sequence>' + _simple("PmtInfId", "Text") + _simple("PmtMtd", "Text")
    + '<xs:element name="ReqdExctnDt"><xs:complexType><xs:choice>' + _simple("Dt", "Text") + _simple("DtTm", "Text") + "</xs:choice></xs:complexType></xs:element>"
    '<xs:element name="Dbtr" type="Party"/><xs:element name="DbtrAcct" type="Account"/><xs:element name="DbtrAgt" type="Agent"/>'
    '<xs:element name="CdtTrfTxInf" maxOccurs="unbounded"><xs:complexType><xs:sequence>'
    '<xs:element name="PmtId"><xs:complexType><xs:sequence>' + _simple("InstrId", "Text", False) + _simple("EndToEndId", "Text") + "</xs:sequence></xs:complexType></xs:element>"
    '<xs:element name="Amt"><xs:complexType><xs:choice><xs:element name="InstdAmt" type="Money"/></xs:choice></xs:complexType></xs:element>'
    '<xs:element name="CdtrAgt" type="Agent" minOccurs="0"/><xs:element name="Cdtr" type="Party" minOccurs="0"/><xs:element name="CdtrAcct" type="Account" minOccurs="0"/>'
    '<xs:element name="RmtInf" minOccurs="0"><xs:complexType><xs:sequence>' + _simple("Ustrd", "Text", False) + "</xs:sequence></xs:complexType></xs:element>"
    "</xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element>"
    "</xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>"
)


def walk(xsd: str) -> list[tuple[str, bool, bool]]:
    """(path, required, has a currency) of each leaf, depth first. A leaf is required if no element above it is optional or in a choice."""
    return [(n["path"], n["required"], "Ccy" in n["attribute_names"]) for n in xsd_nodes(xsd) if n["is_leaf"]]


LEAVES = walk(SCHEMA)


def leaf_paths(spark: SparkSession, xsd: str) -> DataFrame:
    """The leaves of a schema as a table: as many rows as the schema has leaves."""
    rows = [(i, p, p.rsplit("/", 1)[-1], r, c) for i, (p, r, c) in enumerate(walk(xsd))]
    return spark.createDataFrame(rows, "ord int, path string, name string, required boolean, ccy boolean")


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def field_key(path: Column) -> Column:
    """The last two steps of a path that are no boilerplate."""
    kept = F.filter(parts(path), lambda x: ~x.isin(*C.BOILERPLATE))
    return F.array_join(F.slice(kept, F.greatest(F.size(kept) - 1, F.lit(1)), F.lit(2)), "_")


def role(path: Column) -> Column:
    return F.coalesce(F.get(F.filter(parts(path), lambda x: x.isin(*C.CORE_ROLES)), F.lit(0)), F.lit(""))


def field_specs(leaves: DataFrame, limit: int = 24) -> DataFrame:
    """Extraction targets: leaves of wanted names and core roles, drawn round by round over the names, the first of each key.

    All windows here are over the leaves of one schema.
    """
    prio = F.array_position(F.array(*[F.lit(n) for n in C.FIELD_PRIORITY]), F.col("name"))
    wanted = leaves.withColumn("prio", prio).where("prio > 0").where(role(F.col("path")) != "")
    for marker in C.NOISE:
        wanted = wanted.where(~F.col("path").contains(marker))
    drawn = wanted.withColumn("round", F.row_number().over(W.partitionBy("name").orderBy("ord"))).withColumn("k", field_key(F.col("path")))
    own = drawn.select(F.col("k").alias("field_key"), "path", "round", "prio", F.lit(False).alias("is_attribute"))
    money = drawn.where("ccy").select(F.concat("k", F.lit("_Ccy")).alias("field_key"), "path", "round", "prio", F.lit(True).alias("is_attribute"))
    first = own.unionByName(money).withColumn("dup", F.row_number().over(W.partitionBy("field_key").orderBy("round", "prio", "is_attribute"))).where("dup = 1")
    return first.withColumn("place", F.row_number().over(W.orderBy("round", "prio", "is_attribute"))).where(F.col("place") <= limit).select("place", "field_key", "path", "is_attribute")


def to_slots(values: DataFrame, specs: DataFrame, key: str = "payment_id") -> DataFrame:
    """(key, path, value, ccy): each message's values at their paths, an amount with its currency."""
    placed = values.join(F.broadcast(specs), "field_key")  # specs: at most the schema's leaves
    side = lambda attr: F.max(F.when(F.col("is_attribute") == attr, F.col("value")))
    # dealt by message, so that what is done to whole messages after this moves no rows again
    return placed.repartition(F.col(key)).groupBy(key, "path").agg(side(False).alias("value"), side(True).alias("ccy"))


def _system(placed: DataFrame, leaves: DataFrame, as_of: str, key: str) -> DataFrame:
    """(key, given, made): each message's ``given`` (path, value, ccy) and the ``made`` ones that it lacks."""
    system = [*C.SYSTEM_FIELDS, *C.DEFAULT_FIELDS]
    # one row: as many entries as the schema has system leaves
    need = leaves.where("required").where(F.col("name").isin(*system)).agg(F.collect_list(F.struct("path", "name")).alias("need"))
    keys = placed.groupBy(key).agg(F.collect_list(F.struct("path", "value", "ccy")).alias("given")).crossJoin(F.broadcast(need))
    digest = F.upper(F.sha2(F.col(key).cast("string").cast("binary"), 256))

    def value(name: Column) -> Column:
        out = F.when(name == "MsgId", F.concat(F.lit("MSG-"), F.substring(digest, 1, 16))).when(name == "PmtInfId", F.concat(F.lit("PMT-"), F.substring(digest, 17, 12)))
        out = out.when(name == "CreDtTm", F.lit(as_of)).when(name == "NbOfTxs", F.lit("1"))
        for field, default in C.DEFAULT_FIELDS.items():
            out = out.when(name == field, F.lit(default))
        return out

    lacking = F.filter("need", lambda n: ~F.exists("given", lambda g: g["path"] == n["path"]))
    made = F.filter(F.transform(lacking, lambda n: F.struct(n["path"].alias("path"), value(n["name"]).alias("value"), F.lit(None).cast("string").alias("ccy"))), lambda m: m["value"].isNotNull())
    return keys.select(key, "given", made.alias("made"))


def system_fields(placed: DataFrame, leaves: DataFrame, as_of: str, key: str = "payment_id") -> DataFrame:
    """(key, path, value) of the required system and default leaves that the values do not give; ids come from a hash of the key."""
    return _system(placed, leaves, as_of, key).select(key, F.explode("made").alias("m")).select(key, "m.path", "m.value")


def with_system_fields(placed: DataFrame, leaves: DataFrame, as_of: str, key: str = "payment_id") -> DataFrame:
    """``placed`` and its system fields, of one pass over each message."""
    return _system(placed, leaves, as_of, key).select(key, F.explode(F.concat("given", "made")).alias("m")).select(key, "m.*")


def json_schema(specs: DataFrame) -> DataFrame:
    """One row: the JSON Schema of the extraction targets."""
    entry = F.struct(F.lit("string").alias("type"), F.when(F.col("is_attribute"), F.concat("path", F.lit("/Ccy"))).otherwise(F.col("path")).alias("description"))
    props = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("place", "field_key", entry.alias("e")))), lambda x: F.struct(x["field_key"], x["e"])))
    return specs.agg(F.to_json(F.struct(F.lit("object").alias("type"), props.alias("properties"), F.lit(False).alias("additionalProperties"))).alias("schema"))
