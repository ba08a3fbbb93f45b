"""Any message schema as a table of its elements, the faults of messages given as paths, and validation by the JVM's validator."""

from __future__ import annotations

import copy
import hashlib
import io
import os
import re
import xml.etree.ElementTree as ET

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

XS = "{http://www.w3.org/2001/XMLSchema}"
GROUPS = (f"{XS}sequence", f"{XS}choice", f"{XS}all")
NODE = (
    "ord int, path string, parent string, name string, type_name string, min_occurs int, max_occurs int, is_choice boolean, in_choice boolean, is_leaf boolean,"
    " required_here boolean, required boolean, enumerations array<string>, pattern string, attribute_names array<string>"
)


#: A schema's escapes and what stands for them in a Java pattern: name characters, and digits and spaces as the schema language has them.
ESCAPES = {
    "d": r"\p{Nd}", "D": r"\P{Nd}", "s": r"[ \t\n\r]", "S": r"[^ \t\n\r]", "w": r"[^\p{P}\p{Z}\p{C}]", "W": r"[\p{P}\p{Z}\p{C}]",
    "i": r"[\p{L}_:]", "I": r"[^\p{L}_:]", "c": r"[\p{L}\p{Nd}\p{M}._:\-]", "C": r"[^\p{L}\p{Nd}\p{M}._:\-]",
}


def java_pattern(pattern: str) -> str:
    """A schema's pattern as a Java one that must match the whole value.

    In a schema ``^`` and ``$`` are characters like others, escapes are fewer and mean other classes, a class may be lessened by another
    (``[a-z-[aeiou]]``), and blocks are called ``\\p{IsName}``.
    """
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if two in (r"\p", r"\P"):
            end = pattern.index("}", i)
            out.append(re.sub(r"\{Is", "{In", pattern[i : end + 1]))
            i = end + 1
            continue
        if c == "\\":
            out.append(ESCAPES.get(two[1:], two))
            i += 2
            continue
        if depth and two == "-[":
            out.append("&&[^" if pattern[i + 2 : i + 3] != "^" else "&&[")
            depth, i = depth + 1, i + (2 if pattern[i + 2 : i + 3] != "^" else 3)
            continue
        if depth:
            first = out[-1] in ("[", "[^", "&&[^", "&&[")
            depth -= c == "]"
            out.append({"[": r"\[", "&": r"\&", "^": "^" if first and out[-1] == "[" else r"\^"}.get(c, c))
        else:
            depth += c == "["
            out.append({"^": r"\^", "$": r"\$", ".": r"[^\n\r]"}.get(c, c))
        i += 1
    return f"\\A(?:{''.join(out)})\\z"


BOUNDS = {"length": "length", "minLength": "min_length", "maxLength": "max_length", "totalDigits": "total_digits", "fractionDigits": "fraction_digits"}


def _rules(simple: ET.Element | None, named: dict[str, ET.Element]) -> dict:
    """Codes, patterns and bounds of a simple type, with what its base types of the schema ask for; all patterns must match."""
    out: dict = {"codes": [], "patterns": []}
    seen: set[int] = set()
    while simple is not None and id(simple) not in seen:
        seen.add(id(simple))
        rule = simple.find(f"{XS}restriction")
        if rule is None:
            break
        out["codes"] = out["codes"] or [e.get("value") for e in rule.findall(f"{XS}enumeration")]
        either = [e.get("value") for e in rule.findall(f"{XS}pattern")]
        out["patterns"] += ["|".join(either)] if either else []
        for facet, name in BOUNDS.items():
            if (e := rule.find(f"{XS}{facet}")) is not None:
                out.setdefault(name, int(e.get("value")))
        simple = named.get((rule.get("base") or "").split(":")[-1]) if rule.get("base") else rule.find(f"{XS}simpleType")
    return out


def _occurs(el: ET.Element) -> tuple[int, int | None]:
    most = el.get("maxOccurs", "1")
    return int(el.get("minOccurs", "1")), None if most == "unbounded" else int(most)


def nodes(xsd: str) -> list[dict]:
    """One entry for each element below each top element, depth first; ``max_occurs`` is null where unbounded.

    An element is ``required_here`` if it must be there once its parent is: it is neither optional, nor in a choice, nor in an optional group.
    It is ``required`` if that also holds for all above it. Groups within groups are read as parts of their type. A type within itself is a leaf,
    and so is one that the schema does not define. ``model`` is the particle that an element's children follow (see ``content``), None for a
    leaf or where any element may stand. ``choice`` names the choice within a sequence that an element is in, if at most one branch of it
    may be taken, with its ``branch`` and whether one must be.
    """
    root = ET.fromstring(xsd)
    complex_, simple = ({t.get("name"): t for t in root.findall(f"{XS}{kind}Type")} for kind in ("complex", "simple"))
    tops = {e.get("name"): e for e in root.findall(f"{XS}element")}
    out: list[dict] = []
    called = lambda el: el.get("name") or el.get("ref", "").split(":")[-1]

    def particle(part: ET.Element):
        """("el", name), ("seq" or "alt", particles), ("any order", particles), each within ("rep", particle, least, most)."""
        if part.tag == f"{XS}element":
            made = ("el", called(part))
        else:
            made = ({"sequence": "seq", "choice": "alt", "all": "any order"}[part.tag.removeprefix(XS)], [particle(p) for p in part if p.tag == f"{XS}element" or p.tag in GROUPS])
        return ("rep", made, *_occurs(part))

    def members(group: ET.Element, choice: bool, loose: bool, within: tuple | None = None):
        """(element, in a choice, in an optional group, (choice, branch, must be taken)), through groups within groups."""
        for n, part in enumerate(group):
            if part.tag == f"{XS}element":
                yield part, choice, loose, within and (within[0], n if within[1] is None else within[1], within[2])
            elif part.tag in GROUPS:
                inner = within and (within[0], n if within[1] is None else within[1], within[2])
                if part.tag == GROUPS[1] and not choice:
                    names = "|".join(called(e) for e in part.iter(f"{XS}element"))
                    inner = (f"({names})", None, not loose and part.get("minOccurs") != "0" and not any(o.get("minOccurs") == "0" for o in part)) if part.get("maxOccurs", "1") == "1" else None
                yield from members(part, choice or part.tag == GROUPS[1], loose or part.get("minOccurs") == "0", inner)

    def visit(el: ET.Element, above: dict | None, choice: bool, loose: bool, within: tuple | None, seen: tuple[str, ...]) -> None:
        source = tops.get(el.get("ref", "").split(":")[-1], el)
        name, kind = called(source), (source.get("type") or "").split(":")[-1]
        least, most = _occurs(el)
        here = least > 0 and not choice and not loose
        rules = _rules(simple.get(kind) if kind else source.find(f"{XS}simpleType"), simple)
        mark = kind or (f"ref:{name}" if source is not el else "")
        body = None if mark and mark in seen else complex_.get(kind) if kind else source.find(f"{XS}complexType")
        group = None if body is None else next((g for g in body if g.tag in GROUPS), None)
        open_ = group is not None and group.find(f".//{XS}any") is not None
        node = dict(
            ord=len(out), path=f"{above['path']}/{name}" if above else name, parent=above["path"] if above else None, name=name, type_name=kind, min_occurs=least,
            max_occurs=most, is_choice=group is not None and group.tag == GROUPS[1], in_choice=choice, is_leaf=True,
            required_here=here, required=here and (above is None or above["required"]), enumerations=rules["codes"], pattern=rules["patterns"][0] if rules["patterns"] else None,
            attribute_names=[] if body is None else [a.get("name") for a in body.iter(f"{XS}attribute") if a.get("name")] if group is None else [a.get("name") for a in body.findall(f"{XS}attribute")],
            rules=rules, model=None if group is None or open_ else particle(group), choice=within,
        )
        out.append(node)
        if group is not None:
            for child, in_choice, in_loose, inner in members(group, node["is_choice"], group.get("minOccurs") == "0"):
                node["is_leaf"] = False
                visit(child, node, in_choice, in_loose, inner, (*seen, mark) if mark else seen)

    for el in tops.values():
        visit(el, None, False, False, None, ())
    return out


def node_table(spark: SparkSession, xsd: str) -> DataFrame:
    """The schema's elements as a table: as many rows as the schema has elements."""
    names = [f.strip().split(" ")[0] for f in NODE.split(",")]
    return spark.createDataFrame([tuple(n[k] for k in names) for n in nodes(xsd)], NODE)


def code_lists(spark: SparkSession, xsd: str) -> DataFrame:
    """(type_name, code, reachable): every code of every named simple type, and whether the message uses that type."""
    named = {t.get("name"): t for t in ET.fromstring(xsd).findall(f"{XS}simpleType")}
    rows = [(name, c) for name, t in named.items() for c in _rules(t, named)["codes"]]
    used = node_table(spark, xsd).where(F.size("enumerations") > 0).select("type_name").distinct().withColumn("u", F.lit(True))
    lists = spark.createDataFrame(rows, "type_name string, code string")
    return lists.join(F.broadcast(used), "type_name", "left").select("type_name", "code", F.coalesce("u", F.lit(False)).alias("reachable"))


def plain(path: Column) -> Column:
    """A path without its counters: ``Line[2]/Amt`` is ``Line/Amt``."""
    return F.when(F.contains(path, F.lit("[")), F.regexp_replace(path, r"\[\d+\]", "")).otherwise(path)


def _wanted(all_nodes: list[dict], node: dict) -> list[tuple[list[str], list[tuple[str, str]]]]:
    """What a given element asks for: (paths of which one must be there, the faults if none is), for required children and choices."""
    own = [c for c in all_nodes if c["parent"] == node["path"]]
    out = [([c["path"]], _needs(all_nodes, c)) for c in own if c["required_here"]]
    for name in dict.fromkeys(c["choice"][0] for c in own if c["choice"] and c["choice"][2]):
        out.append(([c["path"] for c in own if c["choice"] and c["choice"][0] == name], [("choice", f"{node['path']}/{name}")]))
    return out


def _needs(all_nodes: list[dict], node: dict) -> list[tuple[str, str]]:
    """What is missing where this required element is not given: itself, or what it requires in turn."""
    if node["is_choice"]:
        return [("choice", node["path"])]
    if node["is_leaf"]:
        return [("missing", node["path"])]
    return [f for _, faults in _wanted(all_nodes, node) for f in faults]


def value_fault(value: Column, rules: Column) -> Column:
    """The first rule that a leaf's value breaks: ``code``, ``pattern``, ``length`` (in characters) or ``digits``; null if none."""
    number = F.regexp_replace(F.trim(value), "^[+-]", "")
    whole, part = F.regexp_replace(F.substring_index(number, ".", 1), "^0+", ""), F.when(F.contains(number, F.lit(".")), F.regexp_replace(F.substring_index(number, ".", -1), "0+$", "")).otherwise("")
    n, yes = F.char_length(value), lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when((F.size(rules["codes"]) > 0) & ~F.array_contains(rules["codes"], value), "code").when(F.exists(rules["patterns"], lambda p: ~F.regexp(value, p)), "pattern")
        .when(yes(n != rules["length"]) | yes(n < rules["min_length"]) | yes(n > rules["max_length"]), "length")
        .when(yes(F.length(part) > rules["fraction_digits"]) | yes(F.length(part) + F.length(whole) > rules["total_digits"]), "digits")
    )


RULES = "codes array<string>, patterns array<string>, length int, min_length int, max_length int, total_digits int, fraction_digits int"


def facts(spark: SparkSession, xsd: str) -> DataFrame:
    """The schema's elements as a lookup table for values: path, leaf, most, choice, branch, rules; patterns are Java's."""
    rows = []
    for n in nodes(xsd):
        r = n["rules"]
        rules = (r["codes"], [java_pattern(p) for p in r["patterns"]], *(r.get(b) for b in ("length", "min_length", "max_length", "total_digits", "fraction_digits")))
        rows.append((n["path"], n["is_leaf"], n["max_occurs"], n["choice"] and n["choice"][0], n["choice"] and n["choice"][1], rules))
    return spark.createDataFrame(rows, f"path string, leaf boolean, most int, choice string, branch int, rules struct<{RULES.replace(' ', ':').replace(',:', ', ')}>")


def each_above(rows: DataFrame, path: str = "at") -> DataFrame:
    """``rows`` with depth and el for each element of a row's path, from the outermost (depth 1) to itself."""
    return rows.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(F.split(path, "/"))))).withColumn("el", F.expr(f"substring_index({path}, '/', depth)"))


def holder(el: Column) -> Column:
    """The element above, null for an outermost one."""
    return F.when(F.contains(el, F.lit("/")), F.left(el, F.length(el) - F.length(F.substring_index(el, "/", -1)) - 1))


def instances(given: DataFrame) -> DataFrame:
    """(k, el, above, path, n) of every element of a message given as rows ``(k, at)``: the given ones and those above them; n: rows given at it."""
    each = each_above(given.select("k", "at")).groupBy("k", "el").agg(F.count_if(F.col("at") == F.col("el")).alias("n"))
    return each.withColumn("above", holder(F.col("el"))).withColumn("path", plain(F.col("el")))


def faults(rows: DataFrame, xsd: str, key: str = "payment_id") -> DataFrame:
    """(key, kind, path) of each fault of messages given as rows ``(key, path, value)``; repeated elements carry a counter, ``Line[2]/Amt``.

    Kinds: ``missing`` a required leaf; ``choice`` no branch of a required choice; ``branches`` more than one; ``repeats`` more than the schema
    allows; ``code``, ``pattern``, ``length``, ``digits`` a value outside its code list, pattern or bounds; ``shape`` a value on an element that
    has elements; ``undeclared`` a path that the schema does not know, which counts for nothing else. A null value or path is not given. A
    message without one given row is not seen. A choice within a sequence is called by its elements, ``Ins/(Tel|Mail)``; branches are counted
    where one may be taken once. Order is the matter of ``content.violations``.
    Each message's rows meet in two aggregations; the schema, as large as it is, is broadcast.
    """
    spark, every = rows.sparkSession, nodes(xsd)
    given = rows.where("value is not null and path is not null").select(F.col(key).alias("k"), F.col("path").alias("at"), plain(F.col("path")).alias("path"), "value")
    known_paths = facts(spark, xsd)
    known = given.join(F.broadcast(known_paths), "path", "left")
    own = F.when(F.col("leaf").isNull(), "undeclared").when(~F.col("leaf"), "shape").otherwise(value_fault(F.col("value"), F.col("rules")))
    direct = known.select("k", own.alias("kind"), F.col("at").alias("path")).where("kind is not null")
    each = instances(known.where("leaf is not null").select("k", "at"))
    times = F.sum(F.greatest("n", F.lit(1)))
    children = each.groupBy("k", "above", "path").agg(times.alias("n"))
    over = children.join(F.broadcast(known_paths.select("path", "most").where("most is not null")), "path").where("n > most")
    repeats = over.select("k", F.lit("repeats").alias("kind"), F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", F.lit("/"), F.substring_index("path", "/", -1))).alias("path"))
    parents = spark.createDataFrame([(n["path"], n["is_choice"], _wanted(every, n)) for n in every if not n["is_leaf"]], "parent string, choice boolean, need array<struct<any: array<string>, faults: array<struct<kind: string, path: string>>>>")
    have = children.where("above is not null").groupBy("k", "above").agg(F.collect_set("path").alias("have")).withColumn("parent", plain(F.col("above")))
    met = have.join(F.broadcast(parents), "parent")
    lacking = F.flatten(F.transform(F.filter("need", lambda c: ~F.arrays_overlap("have", c["any"])), lambda c: c["faults"]))
    absent = met.select("k", "above", "parent", F.explode(lacking).alias("f")).select("k", F.col("f.kind").alias("kind"), F.concat("above", F.expr("substring(f.path, length(parent) + 1)")).alias("path"))
    several = met.where("choice and size(have) > 1").select("k", F.lit("branches").alias("kind"), F.col("above").alias("path"))
    inner = children.join(F.broadcast(known_paths.select("path", "choice", "branch").where("choice is not null")), "path")
    taken = inner.groupBy("k", "above", "choice").agg((F.min("branch") != F.max("branch")).alias("more")).where("more").select("k", F.lit("branches").alias("kind"), F.concat("above", F.lit("/"), "choice").alias("path"))
    return direct.unionByName(repeats).unionByName(absent).unionByName(several).unionByName(taken).withColumnRenamed("k", key)


#: The JVM counts repeats of an element in a place that all threads of a schema share, so that validations at the same time disturb each other.
#: Bounded repeats are therefore written out in the schema that it is given, up to this bound.
MOST_WRITTEN_OUT = 200


def written_out(xsd: str) -> str:
    """The schema with bounded repeats as elements one in another, so that nothing is counted: ``a{1,3}`` is ``a, (a, (a)?)?``."""
    names: list[tuple[str, str]] = [v for _, v in ET.iterparse(io.StringIO(xsd), events=("start-ns",))]
    ET.register_namespace("xs", XS[1:-1])
    root = ET.fromstring(xsd)

    def copies(part: ET.Element, least: int, most: int | None) -> list[ET.Element]:
        def one(**occurs: str) -> ET.Element:
            out = copy.deepcopy(part)
            for k in ("minOccurs", "maxOccurs"):
                out.attrib.pop(k, None)
            out.attrib.update(occurs)
            return out

        out = [one() for _ in range(least)]
        if most is None:
            return [*out, one(minOccurs="0", maxOccurs="unbounded")]
        inner: ET.Element | None = None
        for _ in range(most - least):
            outer = ET.Element(f"{XS}sequence", {"minOccurs": "0"})
            outer.append(one())
            if inner is not None:
                outer.append(inner)
            inner = outer
        return out if inner is None else [*out, inner]

    def walk(el: ET.Element) -> None:
        for at in reversed(range(len(el))):
            part = el[at]
            walk(part)
            if part.tag not in (f"{XS}element", f"{XS}sequence", f"{XS}choice"):
                continue
            least, most = _occurs(part)
            if (least > 1 or (most or 0) > 1) and max(least, most or 0) <= MOST_WRITTEN_OUT:
                made = copies(part, least, most)
                if el.tag == f"{XS}choice" or el.tag not in GROUPS:
                    held = ET.Element(f"{XS}sequence")
                    held.extend(made)
                    made = [held]
                el[at : at + 1] = made

    walk(root)
    for prefix, uri in names:
        if uri != XS[1:-1] or prefix != "xs":
            root.set(f"xmlns:{prefix}" if prefix else "xmlns", uri)
    return ET.tostring(root, encoding="unicode")


def validate(rows: DataFrame, xsd: str, xml: str = "xml") -> DataFrame:
    """``rows`` with ``xsd_ok``: whether the text is a document that the JVM's validator accepts under the schema; null and malformed are not.

    The schema goes to every executor as a file of the session, with bounded repeats written out (see ``written_out``). The top element must
    require its first element.
    """
    given, xsd = xsd, written_out(xsd)
    name = f"schema-{hashlib.sha256(xsd.encode()).hexdigest()[:16]}.xsd"
    sc = rows.sparkSession.sparkContext
    if name not in {os.path.basename(f) for f in sc.listFiles}:
        # the driver serves the file from where it lies, also to executors that come later: it stays for the session
        folder = os.path.join(SparkFiles.getRootDirectory(), "schemas")
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, name)
        with open(path, "w", encoding="utf-8") as out:
            out.write(xsd)
        sc.addFile(path)
    first = next(n for n in nodes(given) if n["parent"] and n["required"])["name"]
    read = F.from_xml(F.col(xml), f"`{first}` string", {"mode": "PERMISSIVE", "rowValidationXSDPath": name})
    return rows.withColumn("xsd_ok", F.coalesce(read[first].isNotNull(), F.lit(False)))
