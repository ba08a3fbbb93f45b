"""XML messages are read in one parse each."""

import pytest
from pyspark.sql import functions as F

from quaystone.functions import mt
from quaystone.plans import registry

from oracle import assert_same, duck


def test_first_values_by_local_names(spark):
    text = (
        '<p:D xmlns:p="u"><p:A><p:Dbtr><X><Nm>no</Nm></X><Nm> a &amp;<!-- c --><![CDATA[<b>]]><i>c</i></Nm><Nm>second</Nm></p:Dbtr><DbtrAcct><Id><IBAN/></Id></DbtrAcct>'
        '<DbtrAcct><IBAN>late</IBAN></DbtrAcct><IntrBkSttlmAmt>1</IntrBkSttlmAmt><IntrBkSttlmAmt Ccy="EUR">2</IntrBkSttlmAmt></p:A></p:D>'
    )
    rows = spark.createDataFrame([(0, text), (1, "<a>"), (2, None), (3, "<p:a/>")], "i int, t string")
    got = rows.select("i", *[c.alias(k) for k, c in mt.mx_fields(F.col("t")).items()]).orderBy("i").collect()
    want = {"Dbtr_Nm": "a &<b>c", "DbtrAcct_IBAN": "", "Amt_IntrBkSttlmAmt": "1", "Amt_IntrBkSttlmAmt_Ccy": "EUR", "Cdtr_Nm": ""}
    assert {k: got[0][k] for k in want} == want
    assert all(got[n][k] is None for n in (1, 2, 3) for k in want)


@pytest.mark.parametrize("name", ["mx_to_map", "mx_to_mt103", "dual_run_diff"])
def test_a_message_is_parsed_once(spark, sf, name):
    made = registry.queries()[name](spark, sf)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "xpath" not in plan and plan.split("== Initial Plan ==")[0].count("ArrowEvalPython") == 1
    assert name != "dual_run_diff" or "Join" not in plan
    assert_same(made.toPandas(), duck(registry.oracle_sql()[name], sf))
