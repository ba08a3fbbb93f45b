"""Columns that are built once."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def once(build: Callable) -> Callable:
    """Keep the columns that ``build`` makes for each of its arguments, which must be hashable; callers must not change what they get.

    A rule set takes thousands of calls into the JVM to build, which is seconds for a small table. Columns hold names and no data, so
    they serve every table and session of one JVM; those of a JVM that is gone are dropped.
    """
    held: dict = {}
    jvm = None

    @wraps(build)
    def get(*args):
        nonlocal jvm
        if jvm is not SparkContext._gateway:
            held.clear()
            jvm = SparkContext._gateway
        if args not in held:
            held[args] = build(*args)
        return held[args]

    return get
