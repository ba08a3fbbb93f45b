"""Teachers as an interface: a callable that labels a span, a deterministic stand-in, and parsing of replies. No network here."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship

REPLY = pa.schema([("span_id", pa.int64()), ("sample_no", pa.int32()), ("values", pa.string()), ("error", pa.string())])
Teacher = Callable[[str, int], str]


def read_reply(reply: str) -> tuple[dict, str | None]:
    """Values of a reply, from its first { to its last }, and what is wrong with it."""
    start, end = reply.find("{"), reply.rfind("}")
    if start < 0 or end <= start:
        return {}, "no JSON object in reply"
    try:
        values = json.loads(reply[start : end + 1]).get("values")
    except (json.JSONDecodeError, AttributeError) as e:
        return {}, f"bad JSON: {e}"
    return (values, None) if isinstance(values, dict) else ({}, "missing 'values' object")


def label(spans: DataFrame, teacher: Teacher, samples: int = 5) -> DataFrame:
    """``samples`` replies for each of ``spans(span_id, span)``: (span_id, sample_no, values as JSON, error). The teacher is made for many calls."""
    ship(spans.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, span in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n in range(samples):
                    values, error = read_reply(teacher(span or "", n))
                    out.append((i, n, json.dumps(values, sort_keys=True), error))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), REPLY, strict=True)], schema=REPLY)

    return spans.mapInArrow(run, "span_id long, sample_no int, values string, error string")


def canned(request: dict, sample_no: int, attempt: int) -> str:
    """A teacher without a network: the reply that a request carries; it is out of reach for the first ``busy`` attempts."""
    if attempt <= (request.get("busy") or 0):
        raise ConnectionError("busy")
    return request.get("reply") or ""
