"""Literal cases of the validators, the text functions, routing and roles."""

import pytest
from pyspark.sql import functions as F

from quaystone import constants as C
from quaystone.functions import routing as R
from quaystone.functions import text as T
from quaystone.functions import validators as V
from quaystone.operators import capture as K
from quaystone.operators import gate as G
from quaystone.operators import ocr, payments, schema

GOOD = ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "NL91ABNA0417164300", "ES9121000418450200051332", "IT60X0542811101000000123456"]


def values(spark, items, f):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_good_accounts_pass_and_corrupted_ones_fail(spark):
    assert all(values(spark, GOOD, V.iban_valid))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(GOOD)], "payment_id long, CdtrAcct_IBAN string")
    out = payments.corrupt(rows).withColumn("ok", V.iban_valid(F.col("value"))).collect()
    assert {r["ok"] for r in out if r["corrupting"]} == {False}
    assert {r["ok"] for r in out if not r["corrupting"]} == {True}


def test_accounts_of_odd_shapes(spark):
    assert values(spark, ["", "DE", None, "D189370400440532013000", "DE8937040044053201300!", " de89 3704 0044 0532 0130 00 "], V.iban_valid) == [False] * 5 + [True]


def test_words_that_look_like_bics(spark):
    words = ["ATTACHED", "BENEFICIARY", "INSTRUCTION", "PAYMENT", "PLEASE", "TRANSFERRED", "RECEIVED", None]
    assert values(spark, words, V.bic_country_valid) == [True, True, True, False, False, False, False, False]


@pytest.mark.parametrize(("raw", "want"), [("1.234,56", "1234.56"), ("1,234.56", "1234.56"), ("1.250", "1.25"), ("1,250", "1250.00"), ("1.234.567", "1234567.00"), ("12,5", "12.50"), (",500", "0.50"), ("2.675", "2.67"), ("abc", ""), ("", ""), ("1 000 000", "1000000.00")])
def test_amounts(spark, raw, want):
    assert values(spark, [raw], T.norm_amount) == [want]


@pytest.mark.parametrize(("raw", "want"), [("2026-13-45", "2026-13-45"), ("3 Sep 2026", "2026-09-03"), ("3 september 2026", "2026-09-03"), ("13/02/2026", "2026-02-13"), ("02/13/2026", "2026-02-13"), ("02/03/2026", "2026-03-02"), ("soon", ""), ("", "")])
def test_dates(spark, raw, want):
    assert values(spark, [raw], T.norm_date) == [want]


@pytest.mark.parametrize(("raw", "want"), [('a {"k": {"x": "}"}} b }', '{"k": {"x": "}"}}'), ("none", ""), ('{"open": 1', ""), ('x {"a": "q\\"}"} y', '{"a": "q\\"}"}')])
def test_first_object(spark, raw, want):
    assert values(spark, [raw], T.first_object) == [want]


def test_duplicate_keys(spark):
    assert values(spark, ['{"a":1,"a":2,"b":3}', "x", '{"a":1}'], T.duplicate_keys) == [1, 0, 0]


@pytest.mark.parametrize(("channel", "layer", "path"), [("email-body", False, "text"), ("edi", False, "structured"), ("fax", False, "ocr"), ("fax", True, "probe"), ("email-attachment", False, "ocr"), ("email-attachment", True, "probe"), ("pdf", True, "probe"), ("pdf", False, "ocr")])
def test_routes(spark, channel, layer, path):
    assert spark.range(1).select(K.route(F.lit(channel), F.lit(layer), F.lit(False))["path"]).first()[0] == path


@pytest.mark.parametrize(("data", "name", "mime", "media"), [(b"%PDF-1.4", "", "", "application/pdf"), (b"\x89PNG\r\n\x1a\n..", "", "", "image/png"), (b"RIFF\0\0\0\0WEBPxx", "", "", "image/webp"), (b"x", "m.eml", "", "message/rfc822"), (b"{1:F01X}", "", "", "application/edi"), (b"x" * 40, "", "", "text/plain"), (b"x", "", "", "application/octet-stream"), (b"x", "", "image/jpeg; q=1", "image/jpeg")])
def test_sniff(spark, data, name, mime, media):
    df = spark.createDataFrame([(bytearray(data), name, mime)], "c binary, n string, m string")
    assert df.select(K.sniff(F.col("c"), F.col("n"), F.col("m"))).first()[0] == media


def test_trust_samples_and_reason(spark):
    text = "IBAN DE89370400440532013000\nAccount DE89370400440532O13000\nBIC: DEUTDLFF"
    t = spark.createDataFrame([(text,), ("nothing",)], "t string").select(K.trust(F.col("t")).alias("t")).collect()
    assert (t[0]["t"]["ibans_found"], t[0]["t"]["ibans_valid"], t[0]["t"]["bics_found"], t[0]["t"]["bics_valid"]) == (2, 1, 1, 0)
    assert t[0]["t"]["reason"] == "2 of 3 checksummed fields invalid" and not t[0]["t"]["trustworthy"]
    assert t[1]["t"]["reason"] == "no checksummed fields to probe"


def test_country_check_catches_five_of_nine(spark):
    """Of nine misread BICs the country changes in five; the directory is needed for the others."""
    pairs = [("BNPAERPP", "FR"), ("BNPAERPP", "FR"), ("ABNANI2A", "NL"), ("ABNANI2A", "NL"), ("DEUTDLFF", "DE"), ("DEUIDEFF", "DE"), ("DEUTDEEF", "DE"), ("UNCRITNN", "IT"), ("ABMANL2A", "NL")]
    iban = {x[:2]: x for x in GOOD}
    rows = spark.createDataFrame([(b, iban[c]) for b, c in pairs], "b string, i string")
    got = [r[0] for r in rows.select(R.country_check(F.col("b"), F.col("i"))["verdict"]).collect()]
    assert got.count("failed") == 5 and got.count("passed") == 4


def test_roles(spark):
    text = "Payer: Acme\nPayer IBAN: DE89370400440532013000\nBeneficiary IBAN: NL91ABNA0417164300\nBIC: ABNANL2A"
    cases = [("DE89370400440532013000", "NL91ABNA0417164300", "ABNANL2A"), ("NL91ABNA0417164300", "DE89370400440532013000", "DEUTDEFF"), ("DE89370400440532013000", "DE89370400440532013000", "")]
    rows = spark.createDataFrame([(i, text, *c) for i, c in enumerate(cases)], "i int, t string, d string, c string, b string").orderBy("i")
    got = [tuple(r[0]) for r in rows.select(G.roles(F.col("t"), F.col("d"), F.col("c"), F.col("b"))).collect()]
    assert got == [(False, False, False, False), (False, True, True, True), (True, True, False, False)]


def test_gate_counts_every_check(spark):
    truth = {k: "x" for k in C.KEYS} | {"CdtrAcct_IBAN": GOOD[3], "DbtrAcct_IBAN": GOOD[0], "CdtrAgt_BICFI": "ABNANL2A", "Amt_InstdAmt": "10.00"}
    text = f"Payer IBAN: {GOOD[0]}\nBeneficiary IBAN: {GOOD[3]}\nBIC: ABNANL2A\nAmount: EUR 10.00 x"
    raws = ['{"CdtrAcct_IBAN":"' + GOOD[3] + '","CdtrAgt_BICFI":"ABNANL2A"}', '{"CdtrAcct_IBAN":"' + GOOD[3] + '","CdtrAgt_BICFI":"DEUTDEFF"}', "no", '{"Memo":"zzz","Memo":"zzz"}']
    rows = spark.createDataFrame([(text, r, *(truth[k] for k in C.KEYS)) for r in raws], "text string, raw string, " + ", ".join(f"{k} string" for k in C.KEYS))
    got = {r["check"]: r["value"] for r in G.gate(rows).collect()}
    assert (got["C1"], got["C2"], got["C3"]) == (0.75, 0.5, 0.75)
    assert got["C4"] == 0.25 and got["C8"] == round(2 / 3, 6) and got["C9"] == round(2 / 3, 6)


def test_connected_boxes():
    import numpy as np

    mask = np.array([[1, 1, 0, 0], [0, 1, 0, 1], [0, 0, 0, 1], [1, 0, 0, 0]], bool)
    assert ocr.connected_boxes(mask) == [(0, 0, 1, 1), (3, 1, 3, 2), (0, 3, 0, 3)]


def test_schema_choices_are_not_required():
    need = {p for p, r, _ in schema.LEAVES if r}
    assert "Document/CstmrCdtTrfInitn/PmtInf/CdtTrfTxInf/PmtId/EndToEndId" in need
    assert not any(p.endswith(("/IBAN", "/Dt", "/DtTm", "/BICFI")) for p in need)


def test_slots_do_not_depend_on_the_order_of_values(spark):
    specs = schema.field_specs(schema.leaf_paths(spark, schema.SCHEMA))
    rows = [(1, "Amt_InstdAmt", "5.00"), (1, "Amt_InstdAmt_Ccy", "EUR"), (1, "PmtId_EndToEndId", "E"), (1, "Bogus", "x")]
    make = lambda r: sorted(map(tuple, schema.to_slots(spark.createDataFrame(r, "payment_id long, field_key string, value string"), specs).collect()), key=str)
    assert make(rows) == make(rows[::-1])
    assert any(r[2:] == ("5.00", "EUR") for r in make(rows)) and len(make(rows)) == 2


def test_messages_are_well_formed_and_in_schema_order(spark, sf):
    import xml.etree.ElementTree as ET

    from quaystone.plans import q_more

    order = [p for p, _, _ in schema.LEAVES]
    for r in q_more.build_message(spark, sf).limit(20).collect():
        root = ET.fromstring(r["xml"])
        found = []

        def walk(el, path):
            path = f"{path}/{el.tag}" if path else el.tag
            if len(el):
                assert len({c.tag for c in el}) == len(el)
                for c in el:
                    walk(c, path)
            else:
                found.append(path)

        walk(root, "")
        assert found == [p for p in order if p in found] and len(found) >= 9
        assert root.find(".//InstdAmt").get("Ccy") and root.find(".//NbOfTxs").text == "1"


def test_small_draw_is_part_of_a_large_one(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    small = payments.payments(orders.where("o_orderkey < 50"))
    large = payments.payments(orders)
    assert small.exceptAll(large).count() == 0
    assert large.where(~V.iban_valid(F.col("CdtrAcct_IBAN")) | ~V.iban_valid(F.col("DbtrAcct_IBAN")) | ~V.bic_country_valid(F.col("CdtrAgt_BICFI"))).count() == 0
