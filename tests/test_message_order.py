"""A message's rows are moved once to be held against the content models, and once to be written."""

import random

import pytest
from pyspark.sql import functions as F

from quaystone.operators import content as CM
from quaystone.plans import registry
from quaystone.plans.q_schema import ORDER, placed_rows

PLACED = "payment_id long, path string, value string, ccy string, ord long"


@pytest.mark.parametrize("name, moves", [("content_faults", 1), ("content_agrees", 2)])
def test_rows_of_a_message_meet_once(spark, sf, name, moves):
    """Cells of messages pass a shuffle once for each of the two results; messages of over BLOCK rows, of which there is none, add no stage."""
    df = registry.queries()[name](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    cells = [line for line in plan.splitlines() if "collect_list(" in line and "partial_collect_list(" not in line]
    assert len(cells) == moves and "array_sort" not in plan, plan


def test_small_messages_are_run_as_large_ones(spark, monkeypatch):
    """Both ways find the same, whatever the order, ties, missing places, repeats and undeclared rows."""
    draw = random.Random(5)
    paths = ["Ref", "Mtd", "When/Dt", "When/Tm", "When", "Pty/Nm", "Pty/Ctry", "Tel", "Mail", "Agt/Nm", "Note", "Note[1]", "Note[2]", "Note[10]", "Line[1]/Amt", "Line[2]/Amt", "Line[2]/Txt", "Line", "Bogus", "Bogus/x", ""]
    rows = [(k, "Doc" if draw.random() < 0.03 else f"Doc/Ins/{draw.choice(paths)}", None if draw.random() < 0.05 else "v", None, draw.choice([None, *range(6)])) for k in range(300) for _ in range(draw.randrange(2, 12))]
    given = spark.createDataFrame(rows, PLACED)
    whole = sorted(map(str, CM.violations(given, ORDER).collect()))
    monkeypatch.setattr(CM, "BLOCK", 1)
    assert whole and whole == sorted(map(str, CM.violations(given, ORDER).collect()))


def test_messages_are_written_in_their_order(spark):
    rows = [(1, "D/B[2]/C", "x<", "E\"U", 2), (1, "D/A", "&", None, None), (1, "D/B[1]/C", "y", None, 1), (1, "D/B[2]/C", "a", None, 2), (1, "D/Z", None, None, 0), (2, "D", "1", None, 0)]
    got = {r.payment_id: r.xml for r in CM.render(spark.createDataFrame(rows, PLACED)).collect()}
    assert got == {1: '<D><A>&amp;</A><B><C>y</C></B><B><C>a</C><C Ccy="E&quot;U">x&lt;</C></B></D>', 2: "<D>1</D>"}


def test_large_and_small_messages_in_one_table(spark, sf, monkeypatch):
    rows = placed_rows(spark, sf).where("payment_id < 200")
    want = sorted(map(str, CM.violations(rows, ORDER).collect()))
    monkeypatch.setattr(CM, "BLOCK", 9)
    sizes = rows.where("value is not null").groupBy("payment_id").count().agg(F.min("count"), F.max("count")).first()
    assert sizes[0] <= 9 < sizes[1] and want == sorted(map(str, CM.violations(rows, ORDER).collect()))
