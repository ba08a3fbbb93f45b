"""Every step of the role checks: both sides' labels, the amount's context."""

import random
import re

from pyspark.sql import functions as F

from quaystone import constants as C
from quaystone.functions import validators as V
from quaystone.operators import gate as G
from quaystone.plans import registry

TEXT = "Payer IBAN: GB29NWBK60161331926819\nBeneficiary IBAN: DE89370400440532013000\nTotal: EUR 1.250,00\nBIC: DEUTDEFF"


def test_an_amount_out_of_an_amount_context_is_a_role_error(spark, sf):
    cases = [("1250.00", False), ("29.00", True), ("", False), ("601.61", True), (None, None)]
    rows = spark.createDataFrame([(i, TEXT, a) for i, (a, _) in enumerate(cases)], "i int, t string, a string")
    args = [F.col("t"), F.lit("GB29NWBK60161331926819"), F.lit("DE89370400440532013000"), F.lit("DEUTDEFF"), F.col("a")]
    got = G.with_roles(rows, "new", *args).withColumn("old", G.roles(*args)).orderBy("i").collect()
    assert [r["new"]["amount_unanchored"] for r in got] == [w for _, w in cases] and all(r["new"] == r["old"] for r in got)
    assert not any(r["new"][n] for r in got for n in ("self_payment", "creditor_inverted", "debtor_inverted", "bic_unanchored"))
    found = registry.queries()["role_consistency"](spark, sf).groupBy("amount_unanchored").count().collect()
    assert {r["amount_unanchored"] for r in found} == {True, False}


def test_the_guarded_amount_pattern_finds_the_same(spark):
    draw = random.Random(5)
    some = [*re.findall("[A-Za-z]{3,}", C.AMOUNT_CONTEXT), "eUr", "Total", "SUM", "VALUE date", "czk", " ", "\n", "\t", "1.250,00", "29", ":", "x" * 41, "é", "ſum", "a"]
    texts = ["".join(draw.choice(some) for _ in range(draw.randrange(12))) for _ in range(4000)] + ["", None] + re.findall("[A-Za-z]{3,}", C.AMOUNT_CONTEXT)
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.array_join(F.transform(F.regexp_extract_all("t", F.lit(C.AMOUNT_CONTEXT), 0), V.alnum), "")
    both = rows.select("t", old.alias("old"), G.amount_context(F.col("t")).alias("new"))
    assert both.where("old <> ''").count() > 2000 and both.where("not old <=> new").collect() == []


def test_lookup_asks_both_sides_labels(spark):
    a, b = "GB29NWBK60161331926819", "DE89370400440532013000"
    cases = [
        (f"Payer: {a}\nPayee: {b}", (True, True, False, False)), (f"Payer: {b}\nPayee: {a}", (False, False, True, True)), (f"Debtor: {b}\nCreditor: {b}", (True, False, False, False)),
        (f"Payer of beneficiary: {b}\nPayee: {a}", (False, False, True, True)), (f"Account: {b}", (False, False, False, False)), ("", (False, False, False, False)),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = G.with_lookup(rows, F.col("t"), F.lit("GB29 NWBK 6016 1331 9268 19"), F.lit(b)).orderBy("i").collect()
    assert [tuple(r)[2:] for r in got] == [w for _, w in cases]
