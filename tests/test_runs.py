"""The sink's commit, labelling runs that fail and resume, streams with state that expires."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from quaystone.functions import mt
from quaystone.sources import files, jsonl, teaching
from quaystone.streaming import append

ROWS = "span_id long, reply string, busy int"


def test_an_attempt_that_does_not_count_appends_nothing(tmp_path):
    from pyspark.sql import Row

    w = jsonl.JsonLinesWriter(str(tmp_path / "out"), False)
    lost, kept = (w.write(iter([Row(a=1, b="é"), Row(a=2, b=None)])) for _ in range(2))
    empty = w.write(iter([]))
    assert lost.path != kept.path and empty.path is None and kept.rows == 2
    w.commit([kept, empty, None])
    found = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert len(found) == 1 and found[0].read_text() == '{"a": 1, "b": "é"}\n{"a": 2, "b": null}\n'


def test_a_job_that_fails_leaves_nothing_and_the_next_appends(spark, tmp_path):
    out = str(tmp_path / "lines")
    rows = spark.range(0, 40, 1, 4).withColumn("v", F.array("id", F.lit(None)))
    bad = rows.withColumn("x", F.when(F.col("id") == 35, F.raise_error(F.lit("no"))).otherwise(F.lit("y")))
    with pytest.raises(Exception, match="no"):
        jsonl.write(bad, out)
    assert not list((tmp_path / "lines").rglob("*.json"))
    jsonl.write(rows.where("id < 30"), out)
    jsonl.write(rows.where("id >= 30"), out)
    jsonl.write(rows.limit(0), out)
    back = spark.read.schema("id long, v array<long>").json(out)
    assert sorted((r.id, r.v) for r in back.collect()) == [(i, [i, None]) for i in range(40)]
    jsonl.write(rows.where("id = 7"), out, "overwrite")
    assert [r.id for r in spark.read.schema("id long").json(out).collect()] == [7]


def requests(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_runs_retry_and_resume(spark, tmp_path):
    out, work = str(tmp_path / "labels"), str(tmp_path / "work")
    ask = lambda rows: teaching.run(requests(spark, rows), out, work, "quaystone.operators.teacher:canned", samples=2, tries=3, waves=3)
    good = '{"values": {"a": 1}}'
    assert teaching.labels_of(spark, out).count() == 0
    ask([(i, good, 0) for i in range(5)] + [(None, good, 0)])
    ask([(i, good, i % 4) for i in range(12)] + [(12, None, 0), (13, "none", 0)])
    ask([(i, good, 0) for i in range(14)])
    rows = teaching.labels_of(spark, out).collect()
    assert sorted((r.span_id, r.sample_no) for r in rows) == [(i, n) for i in range(14) for n in range(2)]
    calls = {r.span_id: (r.calls, r.error, r["values"]) for r in rows}
    assert all(calls[i][0] == 1 for i in range(5)) and calls[5] == (2, None, '{"a": 1}') and calls[7][0] == 3 and calls[7][1].startswith("ConnectionError")
    assert calls[12][1] == calls[13][1] == "no JSON object in reply"


def broken(request, sample_no, attempt):
    """A teacher that stops the task, after others have been labelled."""
    if request["span_id"] == 3 and request["busy"]:
        raise ValueError("stop")
    return '{"values": {}}'


def test_a_run_that_stops_labels_nothing_twice(spark, tmp_path):
    out, work = str(tmp_path / "labels"), str(tmp_path / "work")
    run = lambda busy: teaching.run(requests(spark, [(i, None, busy) for i in range(20)]).repartition(3), out, work, "tests.test_runs:broken", waves=4)
    with pytest.raises(Exception, match="stop"):
        run(1)
    before = teaching.labels_of(spark, out).count()
    run(0)
    ids = sorted(r.span_id for r in teaching.labels_of(spark, out).collect())
    assert ids == list(range(20)) and before < 20


def test_texts_that_are_no_xml_give_nothing(spark, tmp_path):
    texts = ["<a><b>1</b></a>", "<a>", "x", "", None, "<a/>y", "<a x='1' x='2'/>", "<!DOCTYPE a [<!ENTITY e SYSTEM 'file:///etc/passwd'>]><a>&e;</a>", "<?xml version='1.0'?><p:a xmlns:p='u'/>"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.ok for r in rows.select("i", mt.well_formed(F.col("t")).alias("ok")).orderBy("i").collect()] == [True, False, False, False, False, False, False, False, True]
    (tmp_path / "bad.xml").write_text("<a>")
    assert files.mx_texts(spark, str(tmp_path)).count() == 0


def test_visits_over_starts_with_late_and_missing_times(spark, tmp_path):
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    rows = lambda *r: spark.createDataFrame([(k, None if m is None else f"2026-01-01 {m // 60:02d}:{m % 60:02d}:00") for k, m in r], "k long, t string").select("k", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.mode("append").parquet(source)
    seen = append.Progress()
    spark.streams.addListener(seen)

    def start():
        q = append.visit_stream(spark, source, "k long, t timestamp", "k", "t", timedelta(minutes=30), "10 minutes", out, at)
        q.awaitTermination()
        append.settled(seen, q)

    try:
        rows((1, 20), (1, 0), (2, 5), (None, 7), (None, 8), (3, None))
        rows((1, 45), (1, 60))
        start()
        rows((1, 120), (2, 125), (4, 1))
        start()
        start()
    finally:
        spark.streams.removeListener(seen)
    got = sorted(((r.key or -1), r.began_ms // 60_000 % 1440) for r in spark.read.schema("key long, began_ms long").parquet(out).collect())
    assert got == [(-1, 7), (1, 0), (1, 120), (2, 5), (2, 125)]
    table = seen.table(spark)
    assert table.agg(F.sum("rows_in")).first()[0] == 11 and table.orderBy(F.col("batch").desc()).first().state_rows <= 2


def test_fixture_files_are_written_by_many_tasks(spark, sf):
    from quaystone.plans import q_runs

    for kind, end in (("mt", ".txt"), ("mx", ".xml")):
        names = [r["path"].rsplit("/", 1)[-1] for r in spark.read.format("binaryFile").load(q_runs.fixtures(spark, sf, kind)).select("path").collect()]
        assert len(names) == spark.read.parquet(f"{sf}/supplier.parquet").count() and all(n.endswith(end) for n in names)
        assert len({n.split("-")[1] for n in names}) > 1
