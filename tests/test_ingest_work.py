"""What a mail's and a PDF file's parts cost: each header and object is parsed once, and a text is probed only where its trust is asked."""

import email
from email import headerregistry
from email.policy import default

from pyspark.sql import functions as F
from test_ingest import SHOW, TREE, pdf, stream

from quaystone.operators import capture as K
from quaystone.sources import mail, pdf as P

MAIL = b"From: =?utf-8?q?J=C3=A9?= <a@b>\nTo: c@d\nSubject: x\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=e\n\n--e\nContent-Type: text/plain; charset=nowhere\n\nhello\n--e\nContent-Type: image/png\nContent-Disposition: attachment; filename*=utf-8''s%C3%A9.png\n\nx\n--e--\n"


def test_a_header_is_parsed_once(monkeypatch):
    seen, parse = [], headerregistry.HeaderRegistry.__call__
    monkeypatch.setattr(headerregistry.HeaderRegistry, "__call__", lambda self, name, value: seen.append((name, value)) or parse(self, name, value))
    mail._parsed.cache_clear()
    first, again = list(mail.parts(MAIL)), list(mail.parts(MAIL))
    assert seen and len(seen) == len(set(seen)) and first == again and first[1][2] == "sé.png"


def test_headers_are_as_the_policy_has_them():
    for data in (MAIL, MAIL.replace(b"Subject: x", b"Subject: " + b"long " * 400), MAIL.replace(b"multipart/mixed;", b"multipart/\xff;"), b"", b"Content-Type: ;\n\nx"):
        ours, plain = email.message_from_bytes(data, policy=mail.POLICY), email.message_from_bytes(data, policy=default)
        for a, b in zip(ours.walk(), plain.walk(), strict=True):
            assert a.items() == b.items() and (a.get_content_type(), a.get_filename(), a.get_params()) == (b.get_content_type(), b.get_filename(), b.get_params())


def test_an_object_is_read_once(monkeypatch):
    seen, value = [], P.value
    monkeypatch.setattr(P, "value", lambda data, at: seen.append(at) or value(data, at))
    assert P.text_layer(pdf(TREE | {4: stream(SHOW)}))[1] == "" and len(seen) == len(set(seen)) >= 4


def test_a_text_is_probed_only_where_it_counts(spark):
    rows = spark.createDataFrame([(1, "pdf", "IBAN DE89370400440532013000", True, False), (2, "pdf", "IBAN DE89370400440532013001", True, False), (3, "email-body", "IBAN DE89370400440532013001", True, False)], "doc_id int, channel string, text string, has_text_layer boolean, structured boolean")
    out = K.capture(rows)
    assert {r["doc_id"]: (r["path"], r["note"]) for r in out.collect()} == {1: ("probe", "text layer accepted without OCR"), 2: ("ocr", "text layer rejected but no OCR backend supplied; returning unverified text"), 3: ("text", "")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan.split("AS __t#")[0].split("AS __r#")[-1][:200], plan[:3000]
