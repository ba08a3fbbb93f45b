"""A message's rows are moved once to be built."""

import pytest

from quaystone.plans import registry


@pytest.mark.parametrize("name", ["build_message", "build_order_message"])
def test_rows_of_a_message_meet_once(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    by_key = [line for line in plan.split("== Initial Plan ==")[-1].splitlines() if "Exchange hashpartitioning" in line]
    assert len([line for line in by_key if "payment_id" in line or "k#" in line]) == 1, by_key
