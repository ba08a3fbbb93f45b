"""The gate's and the routes' cheaper steps give what the plain ones do."""

import random

from pyspark.sql import functions as F

from quaystone.functions import text as T
from quaystone.operators import extract as E
from quaystone.operators import payments as P
from quaystone.plans import q_extract as X


def balanced(s):
    at = s.find("{")
    depth, inside, esc = 0, False, False
    for i, c in enumerate(s[at:] if at >= 0 else ""):
        if inside:
            inside, esc = esc or c != '"', not esc and c == "\\"
        else:
            inside, depth = c == '"', depth + (c == "{") - (c == "}")
            if c == "}" and depth == 0:
                return s[at : at + i + 1]
    return ""


def test_first_objects_of_any_text(spark):
    draw = random.Random(8)
    some = ["{", "}", '"', "\\", "\n", "a", ":", '{"k":"v"', '"x}"', '"{"', "\\\\", "é", " "]
    texts = ["".join(draw.choice(some) for _ in range(draw.randrange(14))) for _ in range(6000)] + ["", "{", '{"', '{"\\', '{"a":"' + "b" * 20000, '{"a":"' + "b" * 20000 + '"}']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.first_object(F.col("t")).alias("o"), F.col("t").rlike(T.OPEN).alias("open")).collect()
    assert [r["o"] for r in got] == [balanced(r["t"]) for r in got]
    assert sum(r["open"] for r in got) > 500 and not any(r["open"] and r["o"] for r in got)


def test_a_text_that_recognition_leaves_is_read_once(spark, sf):
    base = P.documents(P.load_payments(spark, sf)).where("payment_id % 5 = 0").cache()
    n, same = base.count(), P.noisy(base.withColumn("was", F.col("text"))).where("text = was").count()
    rows = X.by_route(base)
    assert 0 < same < n and rows.count() == 2 * n - same
    plain = P.noisy(E.lowered(base, "text").drop("__low").withColumn("route", F.explode(F.array(F.lit("exact"), F.lit("recognised")))), where=F.col("route") == "recognised")
    cols = ["payment_id", "route", "text", *[f"got_{k}" for k in E.C.KEYS]]
    both = rows.withColumn("route", F.explode("routes")).select(cols).exceptAll(E.extract(plain).select(cols))
    assert both.count() == 0
