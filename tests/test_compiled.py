"""Documents and labels are worked out by compiled expressions; check digits agree with the fold whatever the string."""

import random
import re

from pyspark.sql import functions as F

from quaystone.functions import validators as V
from quaystone.operators import extract as E
from quaystone.operators import payments as P


def test_lines_and_labels_have_no_lambda(spark, sf):
    docs = P.documents(P.load_payments(spark, sf))
    text = [x for x in docs._jdf.queryExecution().optimizedPlan().toString().split("+- ") if "array_join" in x]
    assert text and "lambda" not in text[0]
    named = docs.select("text").withColumn("v", E.by_label(F.col("text"), "Cdtr_Nm")["value"])
    assert "lambda" not in named._jdf.queryExecution().optimizedPlan().toString().split("+- ")[0]


def test_mod97_of_any_string(spark):
    rng = random.Random(4)
    made = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    digits, both = "0123456789", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = [made(digits, n) + made(both[10:], 2) + made(digits, 2) for n in range(34)] + [made(both, n) for n in range(1, 60)] + ["9" * 30 + "ZZ99", "0" * 30 + "AA00"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.mod97(F.col("t")).alias("m")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["m"] == int("".join(str(int(c, 36)) for c in r["t"])) % 97, r["t"]


def test_labels_in_any_case_and_order(spark):
    text = "BENEFICIARY: \nnothing\nbeneficiary name - Hollin Cross\nPay: x"
    labels = [x for x in ("Beneficiary", "Beneficiary Name")]
    got = spark.createDataFrame([(text,), (None,), ("",)], "text string").select(E._labelled(F.col("text"), F.lower("text"), labels[1], lambda x: x).alias("a"), E.by_label(F.col("text"), "Cdtr_Nm").alias("b")).collect()
    assert re.search(E.label_pattern(labels[1])[5:], text, re.I | re.M) and got[0]["a"] == "Hollin Cross"
    assert all(not r["a"] and not (r["b"] and r["b"]["value"]) for r in got[1:])
