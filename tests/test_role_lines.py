"""A text is searched once for its labelled values, and only where a label can be."""

import random

from pyspark.sql import functions as F

from quaystone import constants as C
from quaystone.functions import validators as V
from quaystone.operators import gate as G
from quaystone.plans import registry


def test_the_guarded_pattern_finds_the_same(spark):
    draw = random.Random(9)
    some = ["a", "Ab", "Payer", " ", "  ", "\t", "\n", "\r", "\x0b", ":", "#", "::", "1", "é", "-", "Beneficiary IBAN", "x" * 27, "AB12", "İ"]
    texts = ["".join(draw.choice(some) for _ in range(draw.randrange(30))) for _ in range(4000)] + ["", "abc:", "abc:\n", "abc :x", "ab:x", "abc\n\n : \n x\ny", "a" * 40 + " \n# z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.arrays_zip(F.transform(F.regexp_extract_all("t", F.lit(C.ROLE_LINE), 1), lambda x: F.lower(F.trim(x))).alias("label"), F.transform(F.regexp_extract_all("t", F.lit(C.ROLE_LINE), 2), V.alnum).alias("value"))
    both = rows.select("t", old.alias("old"), G.role_lines(F.col("t")).alias("new"))
    assert both.where("size(old) > 0").count() > 1000 and both.where("not old <=> new").collect() == []


def test_a_text_is_searched_once_for_labels(spark, sf):
    plan = registry.queries()["role_consistency"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"{C.ROLE_LINE}, 0)") == 1 and f"regexp_extract_all(text#, {C.ROLE_LINE}" not in plan, plan[:2000]


def test_the_guarded_bic_pattern_finds_the_same(spark):
    draw = random.Random(3)
    some = ["bic", "BIC", "BICFI:", "Swift", " ", "\n", ":", "#", "DEUTDEFF", "bukbgb22abc", "BANK  IDENTIFIER", "Bank identifier code", "identifier\tCODE", "x", "1", "ſwift", "ıdentifier code", "é"]
    rows = spark.createDataFrame([("".join(draw.choice(some) for _ in range(draw.randrange(12))),) for _ in range(4000)], "t string")
    both = rows.select("t", F.regexp_extract_all("t", F.lit(C.BIC_LABELLED), 1).alias("old"), F.regexp_extract_all("t", F.lit(G.BIC_LABELLED), 1).alias("new"))
    assert both.where("size(old) > 0").count() > 500 and both.where("old <> new").collect() == []


def test_role_errors_by_columns_and_by_a_lambda(spark):
    texts = ["Payer: AB12\nBeneficiary: CD34\nBIC: DEUTDEFF", "Payer: CD34\nBeneficiary: AB12", "Payer: CD34\nPayee: CD34\nSWIFT DEUTDEFF", "", None]
    rows = spark.createDataFrame([(t, d, c, b) for t in texts for d in ("AB 12", "", None) for c in ("CD34", "AB12", "", None) for b in ("DEUTDEFF", "", None)], "t string, d string, c string, b string")
    args = [F.col(n) for n in "tdcb"]
    both = G.with_roles(rows, "new", *args).withColumn("old", G.roles(*args))
    assert both.where("not old <=> new").collect() == [] and both.where("old.creditor_inverted").count() and both.where("old.bic_unanchored").count()
