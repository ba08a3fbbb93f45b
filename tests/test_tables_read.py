"""Queries that restate a list or a schema do so over a given table."""

import pytest

from quaystone.plans import registry

NAMES = "baseline_status channel_for code_lists describe_schema dict_check external_codes field_key field_specs json_schema_for label_index parameter_count params_cross".split()


@pytest.mark.parametrize("name", NAMES)
def test_a_given_table_is_scanned(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "CartesianProduct" not in plan


def test_cases_are_few_tasks(spark, sf):
    assert registry.queries()["route"](spark, sf).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
