"""The schema model and the faults of messages, by hand-made cases."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from quaystone.operators import content as CM
from quaystone.operators import xsd as X
from quaystone.plans.q_schema import ORDER

HEAD = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">'
GIVEN = "payment_id long, path string, value string, k string"
CLEAN = [("Ref", "OR1"), ("Mtd", "TRF"), ("When/Dt", "d"), ("Pty/Nm", "A"), ("Line[1]/Amt", "1")]


def found(spark, rows):
    made = spark.createDataFrame([(p, f"Doc/Ins/{a}", v, "clash") for p, a, v in rows], GIVEN)
    return sorted((r.kind, r.path.removeprefix("Doc/Ins/")) for r in X.faults(made, ORDER).collect())


@pytest.mark.parametrize(
    "change, want",
    [
        ([], []),
        ([("Ref", None)], [("missing", "Ref")]),
        ([("Line[1]/Amt", None)], [("missing", "Line/Amt")]),
        ([("Line[2]/Txt", "t")], [("missing", "Line[2]/Amt")]),
        ([("Pty[2]/Nm", "B")], [("repeats", "Pty")]),
        ([("When/Dt", None)], [("choice", "When")]),
        ([("When/Tm", "t")], [("branches", "When")]),
        ([("Mtd/Deep", "t")], [("undeclared", "Mtd/Deep")]),
        ([("Mtd", "")], [("code", "Mtd")]),
    ],
)
def test_faults(spark, change, want):
    rows = dict(CLEAN) | dict(change)
    assert found(spark, [(1, a, v) for a, v in rows.items()]) == want


def test_repeated_rows_nulls_and_an_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, a, v) for a, v in [*CLEAN, CLEAN[0]]]) == [("repeats", "Ref")]
    assert found(spark, [(None, a, v) for a, v in CLEAN] + [(2, "Ref", None)]) == []


def test_types_within_themselves_unknown_types_and_groups_within_groups():
    xsd = HEAD + (
        '<xs:complexType name="T"><xs:sequence><xs:element name="T" type="T" minOccurs="0"/><xs:element name="U" type="None"/>'
        '<xs:sequence minOccurs="0"><xs:choice><xs:element name="A" type="xs:string"/><xs:element name="B" type="xs:string"/></xs:choice><xs:element name="C" type="xs:string"/></xs:sequence>'
        '</xs:sequence></xs:complexType><xs:complexType name="E"/><xs:element name="R" type="T"/><xs:element name="S" type="E"/></xs:schema>'
    )
    got = [(n["path"], n["required_here"], n["in_choice"], n["is_leaf"]) for n in X.nodes(xsd)]
    assert got == [
        ("R", True, False, False), ("R/T", False, False, True), ("R/U", True, False, True), ("R/A", False, True, True), ("R/B", False, True, True),
        ("R/C", False, False, True), ("S", True, False, True),
    ]


def test_validation_takes_nulls_and_broken_texts(spark):
    good = '<Doc><Ins><Ref>OR1</Ref><Mtd>TRF</Mtd><When><Dt>d</Dt></When><Pty><Nm>A</Nm></Pty><Line><Amt Ccy="EUR">1</Amt></Line></Ins></Doc>'
    rows = [(1, good), (2, None), (3, ""), (4, good[:-3]), (5, good.replace("<Pty>", "<Pty><Ctry>FR</Ctry>")), (6, good)]
    got = X.validate(spark.createDataFrame(rows, "id long, xml string"), ORDER)
    assert {r.id: r.xsd_ok for r in got.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}


PARTICLES = [
    ("rep", ("seq", [("rep", ("el", "a"), 1, 1), ("rep", ("el", "b"), 0, 2), ("rep", ("el", "c"), 1, None)]), 1, 1),
    ("rep", ("alt", [("rep", ("el", "a"), 1, 1), ("rep", ("seq", [("rep", ("el", "b"), 1, 1), ("rep", ("el", "c"), 0, 1)]), 1, 2)]), 0, 2),
    ("rep", ("seq", [("rep", ("alt", [("rep", ("el", "a"), 0, 1), ("rep", ("el", "b"), 2, 3)]), 1, 1), ("rep", ("el", "c"), 0, 1)]), 0, None),
    ("rep", ("seq", []), 1, 1),
]


def as_regex(p):
    kind, body = p[0], p[1]
    if kind == "el":
        return body
    if kind == "rep":
        return f"(?:{as_regex(body)}){{{p[2]},{'' if p[3] is None else p[3]}}}"
    return f"(?:{('|' if kind == 'alt' else '').join(as_regex(x) for x in body)})"


@pytest.mark.parametrize("model", PARTICLES)
def test_automata_accept_what_the_model_says(model):
    a, rule = CM.automaton(model), re.compile(as_regex(model))
    for n in range(6):
        for word in itertools.product("abc", repeat=n):
            state, ok = 0, True
            for c in word:
                nxt = a.step[state][a.names.index(c)] if c in a.names else -1
                ok, state = ok and nxt >= 0, max(nxt, 0)
            assert (ok and a.accept[state]) == bool(rule.fullmatch("".join(word)))


@pytest.mark.parametrize(
    "pattern, good, bad",
    [
        ("[A-Z]{2}[0-9]{1,3}", ["AB1", "ZZ123"], ["xAB1", "AB1x", "AB1234", "AB1\n"]),
        ("a|bc", ["a", "bc"], ["abc", "ac"]),
        ("^x$", ["^x$"], ["x"]),
        ("[a-z-[aeiou]]+", ["xyz"], ["xaz", "-"]),
        (r"\d{2}\s\i\c*", ["12 a.b-c", "12\t_x"], ["12 1", "1a b"]),
        (r"\p{IsBasicLatin}+[&&]", ["ab&"], ["é&", "ab"]),
        (".[^^]", ["ab"], ["a^", "\na"]),
        ("", [""], ["a"]),
    ],
)
def test_patterns_of_the_schema_language(spark, pattern, good, bad):
    rows = spark.createDataFrame([(v, v in good) for v in [*good, *bad]], "v string, want boolean")
    assert rows.where(F.regexp("v", F.lit(X.java_pattern(pattern))) != F.col("want")).collect() == []


BOUNDED = HEAD + (
    '<xs:simpleType name="Base"><xs:restriction base="xs:string"><xs:pattern value="[a-z]*"/><xs:maxLength value="4"/></xs:restriction></xs:simpleType>'
    '<xs:simpleType name="Code"><xs:restriction base="Base"><xs:pattern value="x.*"/><xs:pattern value="y.*"/><xs:minLength value="2"/></xs:restriction></xs:simpleType>'
    '<xs:simpleType name="Sum"><xs:restriction base="xs:decimal"><xs:totalDigits value="5"/><xs:fractionDigits value="2"/></xs:restriction></xs:simpleType>'
    '<xs:element name="D"><xs:complexType><xs:sequence><xs:element name="C" type="Code" minOccurs="0" maxOccurs="3"/><xs:element name="S" type="Sum" minOccurs="0" maxOccurs="2"/></xs:sequence></xs:complexType></xs:element></xs:schema>'
)


@pytest.mark.parametrize(
    "path, value, want",
    [("C", "xa", None), ("C", "ya", None), ("C", "za", "pattern"), ("C", "xA", "pattern"), ("C", "x", "length"), ("C", "xaaaa", "length"), ("S", "123.45", None), ("S", "-00123.450", None), ("S", "1.234", "digits"), ("S", "123456", "digits"), ("S", "0.00", None)],
)
def test_values_within_bounds_and_derived_types(spark, path, value, want):
    got = X.faults(spark.createDataFrame([(1, f"D/{path}", value)], "payment_id long, path string, value string"), BOUNDED).collect()
    assert [r.kind for r in got] == ([want] if want else [])


def test_bounded_repeats_are_written_out_for_the_validator(spark):
    cells = ["<C>xa</C>" * c + "<S>1</S>" * s for c in range(5) for s in range(4)] * 40
    rows = spark.createDataFrame([(i, f"<D>{c}</D>", c.count("<C>") < 4 and c.count("<S>") < 3 and bool(c)) for i, c in enumerate(cells)], "id long, xml string, want boolean").repartition(8)
    other = BOUNDED.replace('name="C" type="Code" minOccurs="0"', 'name="C" type="Code" minOccurs="1"')
    assert "maxOccurs" not in X.written_out(other)
    got = X.validate(rows.withColumn("want", F.col("want") & F.contains("xml", F.lit("<C>"))), other)
    assert got.where("xsd_ok <> want").collect() == []


PLACED = "payment_id long, path string, value string, ccy string, ord long, k string"


def placed(spark, cells, n=1):
    return spark.createDataFrame([(p, f"Doc/Ins/{a}", v, None, i, "clash") for p in range(n) for i, (a, v) in enumerate(cells)], PLACED)


def test_order_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(CM, "BLOCK", 3)
    lines = [(f"Line[{i}]/Amt", "1") for i in range(1, 12)]
    good = [("Ref", "OR1"), ("Mtd", "TRF"), ("When/Dt", "d"), ("Pty/Nm", "A"), ("Note[1]", "n"), *lines]
    assert CM.violations(placed(spark, good), ORDER).count() == 0
    late = [*good, ("Note[2]", "late"), ("Line[12]/Amt", "1"), ("Bogus", "x")]
    got = [tuple(r) for r in CM.violations(placed(spark, late, 2), ORDER).collect()]
    assert sorted(got) == [(p, "unexpected", "Doc/Ins/Note[2]", ["Line"]) for p in (0, 1)]
    early = [c for c in good if c[0] != "Pty/Nm"]
    got = {(r.kind, r.path) for r in CM.violations(placed(spark, early), ORDER).collect()}
    assert got == {("unexpected", "Doc/Ins/Note[1]"), ("incomplete", "Doc/Ins")} | {("unexpected", f"Doc/Ins/Line[{i}]") for i in range(1, 12)}


def test_order_of_odd_rows(spark):
    assert CM.violations(placed(spark, []), ORDER).count() == 0
    assert CM.violations(placed(spark, [("Ref", None)]), ORDER).count() == 0
    twice = placed(spark, [("Ref", "OR1"), ("Ref", "OR1"), ("Mtd", "TRF"), ("When/Dt", "d"), ("Pty/Nm", "A"), ("Line/Amt", "1")])
    assert [tuple(r)[1:] for r in CM.violations(twice, ORDER).collect()] == [("unexpected", "Doc/Ins/Ref", ["Mtd"])]
    unplaced = twice.where("ord <> 1").withColumn("ord", F.lit(None).cast("long"))
    assert {r.kind for r in CM.violations(unplaced, ORDER).collect()} <= {"unexpected", "incomplete"}


def test_messages_are_built_in_order_with_one_branch(spark):
    cells = [("Line[10]/Amt", "10"), ("Line[2]/Amt", "2"), ("Mail", "m<&>"), ("Tel", "1"), ("When/Tm", "t"), ("When/Dt", "d"), ("Pty/Nm", 'A"'), ("Mtd", "TRF"), ("Ref", "OR1"), ("Note", "b"), ("Note", "a"), ("Bogus", "x"), ("Pty", "x"), ("Agt/Nm", None)]
    got = CM.build(placed(spark, cells).withColumn("ccy", F.when(F.col("path").endswith("Amt"), "E\"U")), ORDER).collect()
    assert [r.xml for r in got] == [
        '<Doc><Ins><Ref>OR1</Ref><Mtd>TRF</Mtd><When><Dt>d</Dt></When><Pty><Nm>A"</Nm></Pty><Tel>1</Tel><Note>a</Note><Note>b</Note>'
        '<Line><Amt Ccy="E&quot;U">2</Amt></Line><Line><Amt Ccy="E&quot;U">10</Amt></Line></Ins></Doc>'
    ]
    assert got[0].errors == ["branches Doc/Ins/(Tel|Mail)", "branches Doc/Ins/When", "shape Doc/Ins/Pty", "undeclared Doc/Ins/Bogus"] and not got[0].ok


def test_building_from_odd_rows(spark):
    assert CM.build(placed(spark, []), ORDER).count() == 0
    only = CM.build(placed(spark, [("Bogus", "x"), ("Ref", None)]), ORDER).collect()
    assert [(r.xml, r.ok, r.errors) for r in only] == [("", False, ["undeclared Doc/Ins/Bogus"])]
    twice = CM.build(placed(spark, [("Note", "a"), ("Note", "a"), ("Ref", "OR1")]).unionByName(placed(spark, [("Mtd", "CHK")])), ORDER).collect()
    assert twice[0].xml == "<Doc><Ins><Ref>OR1</Ref><Mtd>CHK</Mtd><Note>a</Note><Note>a</Note></Ins></Doc>"


def test_an_optional_choice_within_a_required_one(spark):
    xsd = HEAD + (
        '<xs:element name="R"><xs:complexType><xs:sequence><xs:choice><xs:element name="A" type="xs:string"/><xs:sequence><xs:element name="B" type="xs:string"/><xs:element name="C" type="xs:string" minOccurs="0"/></xs:sequence></xs:choice>'
        '<xs:element name="D" type="xs:string"/></xs:sequence></xs:complexType></xs:element></xs:schema>'
    )
    look = lambda *given: sorted((r.kind, r.path) for r in X.faults(spark.createDataFrame([(1, f"R/{g}", "v") for g in given], "payment_id long, path string, value string"), xsd).collect())
    assert look("B", "C", "D") == [] and look("A", "D") == []
    assert look("D") == [("choice", "R/(A|B|C)")] and look("A", "C", "D") == [("branches", "R/(A|B|C)")]
