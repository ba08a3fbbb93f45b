"""Files of every type, by hand-made cases."""

import base64
import random
import zlib

from pyspark.sql import functions as F

from quaystone.sources import ingest as I
from quaystone.sources import pdf as P

FILES = "id long, filename string, mime string, content binary, text string"


def test_types_layers_and_recognised_texts(spark):
    rows = [(1, "a.pdf", "", b"%PDF-1.7", "x"), (2, "b.pdf", None, b"%PDF-1.7", "x"), (3, None, "image/png", b"\x89PNG\r\n\x1a\n", "x"), (4, None, None, None, "x"), (5, "n.txt", "text/plain", b"", "x")]
    layers = spark.createDataFrame([(2, 0, "IBAN DE89370400440532013000")], "id long, part_no int, layer string")
    seen = spark.createDataFrame([(3, 0, "read", 0.9)], "id long, part_no int, ocr_text string, ocr_confidence double")
    got = {r.id: r for r in I.ingest(spark.createDataFrame(rows, FILES), layers, seen).collect()}
    assert len(got) == 5
    assert (got[1].path, got[1].text, got[1].notes[0]) == ("ocr", "", "no text layer: this is a scan and needs recognition")
    assert (got[2].path, got[2].text, got[2].used_ocr, got[2].notes) == ("probe", "IBAN DE89370400440532013000", False, ["text layer accepted without OCR"])
    assert (got[3].channel, got[3].text, got[3].used_ocr) == ("fax", "read", True)
    assert got[4].media_type == "application/octet-stream" and "refusing to guess" in got[4].notes[0]
    assert (got[5].media_type, got[5].path, got[5].text, got[5].notes) == ("text/plain", "text", "", [])


def test_empty_table_and_audit_order(spark):
    assert I.ingest(spark.createDataFrame([], FILES)).collect() == []
    mail = b"From: a@b\nTo: c@d\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=e\n\n--e\nContent-Type: text/plain\n\nhello\n--e\nContent-Type: image/png\nContent-Disposition: attachment; filename=s.png\n\nx\n--e--\n"
    lines = I.describe(I.ingest(spark.createDataFrame([(1, "m.eml", "", mail, "x")], FILES))).first().audit.split("\n")
    assert [x.split()[:4] for x in lines if x[2].isdigit()] == [["1.", "email-body", "text", "free"], ["2.", "email-attachment", "ocr", "free"]]


def pdf(objects, tail=b""):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + tail


def stream(body, head=b"", squeeze=False):
    data = zlib.compress(body) if squeeze else body
    return b"<<%s/Length %d>>\nstream\n%s\nendstream" % (head + (b"/Filter/FlateDecode" if squeeze else b""), len(data), data)


TREE = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R 9 0 R]/Count 2/Resources<</Font<</F1 5 0 R>>>>>>", 3: b"<</Type/Page/Parent 2 0 R/Contents[4 0 R]>>", 5: b"<</Type/Font/Subtype/Type1>>"}
SHOW = b"BT /F1 12 Tf 72 720 Td (a \\(b\\) \\351\\\nc) Tj 0 -14 Td [(d)-300(e)10(f)] TJ T* <414\n2> Tj ET % a remark (\nBT 1 0 0 1 0 0 Tm (g) ' ET"
CMAP = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <0061> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0078> <0020> <0021> [<0031> <00320033>] endbfrange"


def test_text_layers(spark):
    inner = b"1 0 2 33 " + b"<</Type/Catalog/Pages 2 0 R>>".ljust(33) + b"<</Type/Pages/Kids[3 0 R]/Resources<</Font<</F1 5 0 R>>>>>>"
    packed = {3: TREE[3], 4: stream(SHOW, squeeze=True), 5: TREE[5], 7: stream(inner, b"/Type/ObjStm/N 2/First 9", True)}
    mapped = TREE | {4: stream(b"BT /F1 9 Tf <00010002001100200021> Tj ET"), 5: b"<</Type/Font/ToUnicode 6 0 R>>", 6: stream(CMAP, squeeze=True)}
    want = "a (b) éc\nd ef\nAB\ng"
    cases = [
        (pdf(TREE | {4: stream(SHOW)}), want, ""), (pdf(TREE | {4: stream(SHOW, squeeze=True)}), want, ""), (pdf(packed), want, ""), (pdf(mapped), "a\U0001f600y123", ""),
        (pdf(TREE | {4: stream(SHOW)}) + pdf({4: stream(b"BT (newer) Tj ET")}), "newer", ""), (pdf(TREE | {4: stream(b"q 1 0 0 1 0 0 cm /Im0 Do Q")}), "", ""),
        (pdf(TREE | {4: stream(SHOW)}, b"trailer <</Encrypt 8 0 R>>"), "", "an encrypted file"), (pdf(TREE | {4: stream(SHOW, b"/Filter/LZWDecode")}), "", "a stream coded by LZWDecode"),
        (pdf(TREE | {4: stream(SHOW)})[:60], "", "no page"), (pdf(TREE), "", "a stream that is not there"), (pdf({1: b"<</Type/Catalog/Pages 1 0 R/Kids[1 0 R]>>"}), "", "no page"),
        (b"%PDF-1.7", "", "no page"), (b"text", "", "no PDF file"), (b"", "", "no PDF file"), (None, "", "no PDF file"), (pdf(TREE | {4: stream(b"BT (open Tj ET")}), "", "a string without an end"),
        (pdf({3: b"<</Type/Page/Contents 4 0 R>>", 4: b"<</Length 3 0 R>>\nstream\nBT (x) Tj ET\nendstream"}), "x", ""), (pdf({1: b"[" * 100}), "", "objects too deep in each other"),
    ]
    rows = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(cases)], "i int, c binary")
    got = {r.i: (r.p.text, r.p.reason) for r in rows.select("i", P.layer(F.col("c")).alias("p")).collect()}
    assert got == {i: (t, w) for i, (_, t, w) in enumerate(cases)}


def test_cut_and_changed_files_never_stop_a_query():
    rng = random.Random(3)
    whole = pdf(TREE | {4: stream(SHOW, squeeze=True), 5: b"<</ToUnicode 6 0 R>>", 6: stream(CMAP)})
    for _ in range(3000):
        data = bytearray(whole[: rng.randrange(len(whole))] if rng.random() < 0.3 else whole)
        for _ in range(rng.randrange(6)):
            data[rng.randrange(len(data) or 1) : rng.randrange(len(data) or 1) + rng.randrange(4)] = rng.choice([b"<<", b"]", b"(", b"stream", b"\x00", b"0 R", b"9" * 12, b">>"])
        text, why = P.text_layer(bytes(data))
        assert isinstance(text, str) and isinstance(why, str)


def test_layers_of_files_and_attachments(spark):
    good = pdf(TREE | {4: stream(b"BT (IBAN DE89370400440532013000) Tj ET", squeeze=True)})
    letter = b"From: a@b\nTo: c@d\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=e\n\n--e\nContent-Type: text/plain\n\nhello\n--e\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=s.pdf\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(good) + b"\n--e--\n"
    rows = [(1, "a.pdf", "", good, "x"), (2, "m.eml", "", letter, "x"), (3, "b.pdf", "", good[:40], "x")]
    got = {(r.id, r.part_no): r for r in I.ingest(spark.createDataFrame(rows, FILES)).collect()}
    for k in ((1, 0), (2, 1)):
        assert (got[k].path, got[k].text, got[k].notes) == ("probe", "IBAN DE89370400440532013000", [I.LAYER, "text layer accepted without OCR"])
    assert got[3, 0].notes[:2] == [I.SCAN, I.NO_RENDERER] and got[3, 0].path == "ocr"
