"""Payments, documents that state them, and damaged copies, all drawn from hashes of the order's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..functions import validators as V
from ..functions.once import once
from ..sources import files


def draw(field: str, of: int, key: str = "payment_id", seed: int = 0) -> Column:
    """A number in [0, of) that only the seed, the row's key and the field decide, so that a small draw is part of a large one."""
    return T.bucket(F.concat(F.col(key).cast("string"), F.lit(f":{field}")), seed, of)


def pick(options: tuple[str, ...], field: str, seed: int = 0) -> Column:
    return F.get(F.array(*[F.lit(x) for x in options]), draw(field, len(options), seed=seed))


def payments(orders: DataFrame, seed: int = 0) -> DataFrame:
    """One payment for each order: amount and date are the order's, all else is drawn. Row-local: no shuffle."""
    return orders.select(F.col("o_orderkey").alias("payment_id"), "o_totalprice", "o_orderdate").select(*_drawn(seed))


@once
def _drawn(seed: int) -> list[Column]:
    """The columns of a payment."""
    digits = lambda field: F.lpad(draw(field, 10**8, seed=seed).cast("string"), 8, "0")
    out = {"payment_id": F.col("payment_id")}
    for side, party in (("Cdtr", C.COMPANIES + C.PERSONS), ("Dbtr", C.COMPANIES)):
        at = draw(f"{side}.country", len(C.COUNTRIES), seed=seed)
        country = F.get(F.array(*[F.lit(c) for c, _, _ in C.COUNTRIES]), at)
        size = F.get(F.array(*[F.lit(n) for _, n, _ in C.COUNTRIES]), at)
        bban = F.substring(F.concat(*[digits(f"{side}.bban{i}") for i in range(3)]), F.lit(1), size)
        out[f"{side}_Nm"] = pick(party, f"{side}.name", seed)
        out[f"{side}Acct_IBAN"] = F.concat(country, V.check_digits(country, bban), bban)
        if side == "Cdtr":
            stem = F.get(F.array(*[F.lit(b) for _, _, b in C.COUNTRIES]), at)
            branch = F.when(draw("bic.branch", 2, seed=seed) == 0, F.lit("")).otherwise(F.lpad(draw("bic.digits", 1000, seed=seed).cast("string"), 3, "0"))
            out["CdtrAgt_BICFI"] = F.concat(stem, branch)
            out["country"] = country
    out["Amt_InstdAmt"] = F.call_function("format_number", F.col("o_totalprice"), F.lit("0.00"))
    out["Amt_InstdAmt_Ccy"] = F.get(F.array(*[F.lit(x) for x in C.CURRENCIES]), F.pmod("payment_id", F.lit(len(C.CURRENCIES))).cast("int"))
    out["PmtId_EndToEndId"] = F.concat(F.lit("E2E"), F.lpad(F.col("payment_id").cast("string"), 6, "0"))
    out["ReqdExctnDt_Dt"] = F.date_format("o_orderdate", "yyyy-MM-dd")
    phrase = pick(C.PHRASES, "phrase", seed)
    out["RmtInf_Ustrd"] = F.replace(phrase, F.lit("{n}"), (draw("phrase.n", 90000, seed=seed) + 10000).cast("string"))
    return [c.alias(n) for n, c in out.items()]


def load_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the JVM compiles no method of over 8000 bytes: whole stages with the long expressions here would be interpreted, split ones are not
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return payments(files.spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate")))


@once
def document_lines(seed: int) -> Column:
    """The lines of a payment's document at its difficulty, in the order of a hash for each line; null for those that it has not."""
    level = F.col("difficulty")
    varied = level != "clean"
    lines = []
    for key in C.LABELS:
        value = F.col(key)
        if key == "Amt_InstdAmt":
            value = T.format_amount(value, varied)
        if key == "ReqdExctnDt_Dt":
            y, m, d = F.substring(value, 1, 4), F.substring(value, 6, 2), F.substring(value, 9, 2)
            name = F.get(F.array(*[F.lit(x) for x in C.MONTHS]), m.cast("int") - 1)
            styles = F.array(F.concat_ws("/", d, m, y), F.concat_ws(" ", d, name, y), F.concat_ws("/", m, d, y))
            value = F.when(varied, F.get(styles, draw("date.style", 3, seed=seed))).otherwise(value)
        labels = C.LABELS[key]
        label = F.when(varied, pick(labels, f"{key}.label", seed)).otherwise(F.lit(labels[0]))
        shown = F.concat(F.col("Amt_InstdAmt_Ccy"), F.lit(" "), value) if key == "Amt_InstdAmt" else value
        line = F.concat(label, F.lit(": "), shown)
        if key in C.BURIED:
            prose = F.replace(F.replace(pick(C.PROSE, f"{key}.prose", seed), F.lit("{c}"), F.col("Amt_InstdAmt_Ccy")), F.lit("{v}"), value)
            line = F.when(level == "hostile", prose).otherwise(line)
        lines.append(line)
    for i in range(4):
        n = lambda field, low, count, i=i: (draw(f"noise{i}.{field}", count, seed=seed) + low).cast("string")
        noise = [n("a", 1000, 99000), F.concat(n("b", 10, 90), F.lit("-"), n("c", 100000, 900000)), F.concat(F.lit("+44 "), n("d", 100000000, 900000000)), F.concat(F.lit("GB"), n("e", 10, 90), F.lit("BUKB"), n("f", 10000000, 90000000))]
        style = draw(f"noise{i}.style", 4, seed=seed)
        shown = F.when(style == 0, noise[0]).when(style == 1, noise[1]).when(style == 2, noise[2]).otherwise(noise[3])
        lines.append(F.concat(pick(C.DISTRACTORS, f"noise{i}.label", seed), F.lit(": "), shown))
    keyed = []
    for i, x in enumerate(lines):
        key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("payment_id").cast("string"), F.lit(f":line{i}")).cast("binary"), 256)
        keyed.append(F.struct(key.alias("key"), x.alias("line")))
    for i, there in ((-4, varied), (-3, varied), (-2, level == "hostile"), (-1, level == "hostile")):
        keyed[i] = F.when(there, keyed[i])
    # no lambda here: Spark compiles this, while it interprets a lambda and all that feeds it
    return F.sort_array(F.array(*keyed))["line"]


def render(p: DataFrame, level: Column, seed: int = 0) -> DataFrame:
    """Add difficulty and text to payments; all fields of a payment are stated in its document. Row-local."""
    return p.withColumn("difficulty", level).withColumn("text", F.array_join(document_lines(seed), "\n"))


def level_of(i: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in C.LEVELS]), F.pmod(i, F.lit(len(C.LEVELS))).cast("int"))


def documents(p: DataFrame, seed: int = 0) -> DataFrame:
    """One document for each payment; its difficulty goes round by its key."""
    return render(p, level_of(F.col("payment_id")), seed)


def documents_by_row(p: DataFrame, seed: int = 0) -> DataFrame:
    """As ``documents``, but the difficulty goes round by the row's place in the order of keys, without a window over all rows:
    ranks within slices of the key come after the counts of the slices before."""
    width = 4096
    sliced = p.withColumn("__slice", F.floor(F.col("payment_id") / width))
    counts = sliced.groupBy("__slice").count().withColumn("__slices", F.floor(F.col("__slice") / width))
    # one row for each width * width keys goes through the last window
    whole = counts.groupBy("__slices").agg(F.sum("count").alias("n")).withColumn("far", F.sum("n").over(W.orderBy("__slices")) - F.col("n")).drop("n")
    inner = F.sum("count").over(W.partitionBy("__slices").orderBy("__slice")) - F.col("count")
    before = counts.withColumn("near", inner).join(F.broadcast(whole), "__slices").select("__slice", (F.col("near") + F.col("far")).alias("before"))
    rank = F.row_number().over(W.partitionBy("__slice").orderBy("payment_id")) - 1
    return render(sliced.withColumn("__r", rank).join(before, "__slice").withColumn("ord", F.col("__r") + F.col("before")).drop("__slice", "__r", "before"), level_of(F.col("ord")), seed)


def corpus(p: DataFrame, seed: int = 0) -> DataFrame:
    """Every payment at every difficulty."""
    levels = F.explode(F.array(*[F.lit(x) for x in C.LEVELS])).alias("level")
    return render(p.select("*", levels), F.col("level"), seed).drop("level")


#: name, corrupting, and the transform of an account number; places count from 0
def corruptions(iban: Column) -> list[tuple[str, bool, Column]]:
    swap = lambda a, b: F.replace(iban, F.lit(a), F.lit(b))
    at = lambda i, n=1: F.substring(iban, i + 1, n)
    rest = lambda i: F.substring(iban, i + 1, 64)
    bumped = F.when(at(14).rlike("[0-9]"), F.pmod(at(14).try_cast("int") + 3, F.lit(10)).cast("string")).otherwise(at(14))
    return [
        ("zero_to_o", True, swap("0", "O")),
        ("one_to_l", True, swap("1", "l")),
        ("five_to_s", True, swap("5", "S")),
        ("eight_to_b", True, swap("8", "B")),
        ("two_to_z", True, swap("2", "Z")),
        ("swap_12_13", True, F.concat(at(0, 12), at(13), at(12), rest(14))),
        ("drop_9", True, F.concat(at(0, 9), rest(10))),
        ("digit_14", True, F.concat(at(0, 14), bumped, rest(15))),
        ("space_9", False, F.concat(at(0, 9), F.lit(" "), rest(9))),
        ("lower", False, F.lower(iban)),
    ]


def corrupt(p: DataFrame, column: str = "CdtrAcct_IBAN") -> DataFrame:
    """Damaged and reformatted copies of an account number; those that change nothing are left out."""
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).alias("corrupting"), c.alias("value")) for n, b, c in corruptions(F.col(column))])).alias("c")
    return p.select("payment_id", F.col(column).alias("original"), cases).select("payment_id", "original", "c.*").where("value <> original")


def noisy(docs: DataFrame, seed: int = 0, where: Column | None = None) -> DataFrame:
    """A stand-in for recognised text: in a third of the documents (of those ``where`` holds for) digits 0, in another third the letter S, are misread."""
    kind = draw("noise.kind", 3, seed=seed)
    if where is not None:
        kind = F.when(where, kind)
    return docs.withColumn("text", F.when(kind == 0, F.translate("text", "0", "O")).when(kind == 1, F.translate("text", "5S", "S5")).otherwise(F.col("text")))
