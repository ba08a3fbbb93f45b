"""All queries over the reference's operators, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_economics, q_extract, q_files, q_message, q_more, q_runs, q_schema, q_sequence, q_training

_MODULES = [q_extract, q_message, q_sequence, q_files, q_more, q_schema, q_training, q_runs, q_economics]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
