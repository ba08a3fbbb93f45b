"""Files in and out, mails, teachers and the resumable stream."""

import json

from pyspark.sql import functions as F

from quaystone.functions import mt
from quaystone.operators import teacher
from quaystone.plans.q_message import message
from quaystone.plans.q_extract import pay
from quaystone.sources import files, mail
from quaystone.streaming import append


def test_fixture_folders(spark, sf, tmp_path):
    row = pay(spark, sf).limit(1)
    raw, xml = row.select(mt.render(message(row)), mt.mx_render(message(row))).first()
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text(raw)
    (tmp_path / "note.txt").write_text("nothing to see")
    (tmp_path / "two.xml").write_text(xml)
    out = files.seeds(spark, str(tmp_path)).collect()
    assert [r["source"] for r in out] == [0, 1]
    assert out[0]["fields"]["CdtrAcct_IBAN"] == out[1]["fields"]["CdtrAcct_IBAN"]
    assert files.bytes_of(spark, str(tmp_path)).count() == 3


def test_tolerant_labels_and_resumed_append(spark, tmp_path):
    path = str(tmp_path / "labels")
    new = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    files.append_labels(new, path)
    files.append_labels(spark.createDataFrame([("b",), ("c",)], "doc_id string"), path)
    (tmp_path / "labels" / "part-bad.json").write_text('{"doc_id": "d"}\nnot json\n\n')
    rows = files.labels_of(spark, path)
    assert sorted(r["doc_id"] for r in rows.collect()) == ["a", "b", "c", "d"]
    assert rows.where("difficulty is null or truth is null").count() == 0


def test_lines_and_directory(spark, tmp_path):
    (tmp_path / "spans.txt").write_text("  one \n\n two\n")
    assert [r[0] for r in files.lines_of(spark, str(tmp_path / "spans.txt")).collect()] == ["one", "two"]
    (tmp_path / "dir.json").write_text('{"de89 3704": "DEUTDEFF"}')
    assert [tuple(r) for r in files.directory_of(spark, str(tmp_path / "dir.json")).collect()] == [("DE893704", "DEUTDEFF")]


def test_mail_texts_are_one_body(spark):
    mail_ = (
        b"MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=m\n\n--m\nContent-Type: multipart/alternative; boundary=a\n\n"
        b"--a\nContent-Type: text/plain; charset=utf-8\n\nplain words\n--a\nContent-Type: text/html; charset=utf-8\n\n<p>marked <b>words</b></p>\n"
        b"--a\nContent-Type: text/plain; charset=no-such-charset\nContent-Transfer-Encoding: base64\n\n/w==\n--a--\n"
        b"--m\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename=x.txt\nContent-Transfer-Encoding: base64\n\naGk=\n--m--\n"
    )
    got = mail.extract(spark.createDataFrame([(1, bytearray(mail_)), (2, None)], "id long, content binary")).orderBy("id", "part_no").collect()
    assert [(r["id"], r["part_no"], r["kind"]) for r in got] == [(1, 0, "text"), (1, 1, "attachment"), (2, 0, "text")]
    assert "plain words" in got[0]["text"] and "marked words" in got[0]["text"] and "<b>" not in got[0]["text"] and got[2]["text"] == ""
    assert got[0]["notes"][-1] == "1 attachments kept apart from the body" and len(got[0]["notes"]) == 2


def test_mail_parts_stay_apart(spark):
    text = b"From: a\nTo: b\nContent-Type: text/html\n\n<p>one</p><script>x</script>two"
    rows = spark.createDataFrame([(1, bytearray(text)), (2, None)], "id long, content binary")
    assert [(r["id"], r["part_no"], r["text"].strip()) for r in mail.extract(rows).collect()] == [(1, 0, "one\ntwo"), (2, 0, "")]


def test_teacher_replies(spark):
    assert teacher.read_reply('x {"values": {"a": 1}} y') == ({"a": 1}, None)
    assert teacher.read_reply("x")[1] == "no JSON object in reply"
    assert teacher.read_reply('{"v": 1}')[1] == "missing 'values' object"
    out = teacher.label(spark.createDataFrame([(1, "s")], "span_id long, span string"), lambda span, n: json.dumps({"values": {"k": n}}), 3)
    assert [(r["sample_no"], r["values"]) for r in out.orderBy("sample_no").collect()] == [(0, '{"k": 0}'), (1, '{"k": 1}'), (2, '{"k": 2}')]


def test_stream_labels_each_document_once(spark, tmp_path):
    source, sink, at = (str(tmp_path / x) for x in ("in", "out", "cp"))
    write = lambda ids: spark.createDataFrame([(i, "2026-01-01 00:00:00") for i in ids], "doc_id string, ts string").coalesce(1).write.mode("append").json(source)
    run = lambda: append.label_stream(spark, source, "doc_id string, ts timestamp", lambda d: d.withColumn("n", F.length("doc_id")), sink, at, "ts, 1 day").awaitTermination()
    write(["a", "bb"])
    run()
    write(["bb", "ccc"])
    run()
    run()
    assert sorted(r["doc_id"] for r in spark.read.json(sink).collect()) == ["a", "bb", "ccc"]
