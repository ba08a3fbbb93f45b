"""Content models: an automaton for the children of each element of a schema, run over the children of messages in their order."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..shipping import ship
from . import xsd as X

#: A bound on repeats above this is taken as none here; ``xsd.faults`` counts repeats of elements exactly.
UNROLL = 32
#: Children of one element in a block: blocks are run apart from each other.
BLOCK = 4096


@dataclass
class Automaton:
    """Deterministic: ``step[state][k]`` is the state after ``names[k]``, -1 if it may not come; it starts in state 0."""

    names: list[str]
    step: list[list[int]]
    accept: list[bool]

    def follow(self, state: int) -> list[str]:
        return [n for n, s in zip(self.names, self.step[state], strict=True) if s >= 0]


def automaton(model) -> Automaton:
    """Subset construction over the particle's moves. A group in any order is any sequence of its elements; their counts are checked elsewhere."""
    free: list[list[int]] = []
    moves: list[list[tuple[str, int]]] = []

    def state() -> int:
        free.append([])
        moves.append([])
        return len(free) - 1

    def put(part, start: int) -> int:
        """Add a particle from ``start``; the state after it."""
        kind, body = part[0], part[1]
        if kind == "el":
            end = state()
            moves[start].append((body, end))
            return end
        if kind == "seq":
            for p in body:
                start = put(p, start)
            return start
        if kind == "alt":
            end = state()
            for p in body:
                free[put(p, start)].append(end)
            if not body:
                free[start].append(end)
            return end
        if kind == "any order":
            return put(("rep", ("alt", [p[1] for p in body]), 0, None), start)
        least, most = min(part[2], UNROLL), part[3] if part[3] is None or part[3] <= UNROLL else None
        for _ in range(least):
            start = put(body, start)
        end = state()
        free[start].append(end)
        if most is None:
            hub = state()
            free[start].append(hub)
            after = put(body, hub)
            free[after] += [hub, end]
        else:
            for _ in range(most - least):
                start = put(body, start)
                free[start].append(end)
        return end

    first = state()
    last = put(model, first)

    def closed(some: set[int]) -> frozenset[int]:
        todo, out = list(some), set(some)
        while todo:
            for s in free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    names = sorted({n for m in moves for n, _ in m})
    states, step, at = [closed({first})], [], 0
    while at < len(states):
        row = []
        for name in names:
            to = closed({t for s in states[at] for n, t in moves[s] if n == name})
            if to and to not in states:
                states.append(to)
            row.append(states.index(to) if to else -1)
        step.append(row)
        at += 1
    return Automaton(names, step, [last in s for s in states])


def automata(xsd: str) -> dict[str, Automaton]:
    """By the path of each element with elements; not where any element may stand."""
    return {n["path"]: automaton(n["model"]) for n in X.nodes(xsd) if n["model"] is not None and not n["is_leaf"]}


def table(spark: SparkSession, xsd: str) -> DataFrame:
    """The automata as rows: as many as the schema has elements with elements; ``step`` is flat, one run of names for each state."""
    rows = [(p, a.names, len(a.names), [s for row in a.step for s in row], a.accept, [a.follow(s) for s in range(len(a.step))]) for p, a in automata(xsd).items()]
    return spark.createDataFrame(rows, "parent string, names array<string>, width int, step array<int>, accept array<boolean>, follow array<array<string>>")


def violations(rows: DataFrame, xsd: str, key: str = "payment_id") -> DataFrame:
    """(key, kind, path, expected) of what breaks the order or number of elements in messages given as rows ``(key, path, value, ord)``.

    ``ord`` is a row's place in its message; an element lies where its first row does, and one that comes back later than a sibling is at
    its first place only. Kinds: ``unexpected`` an element that its parent's content model does not allow at its place, and which is then
    passed over; ``incomplete`` an element that ends where its model asks for more. ``expected`` are the names that were allowed there. Null
    paths and values are not given, undeclared elements are left to ``xsd.faults``; rows without a place come first; equal rows are elements
    each. Elements of an unbounded number of children are cut into blocks of places, for which the state after each possible state before is
    worked out; blocks meet as these small arrays, and each is then run once from the state that it really starts in. That takes several
    shuffles, so only messages of over BLOCK rows go this way; the rows of any other meet in one, as they are, and are run where they lie.
    """
    spark = rows.sparkSession
    ship(spark)
    given = rows.where("value is not null and path is not null").select(F.col(key).alias("k"), F.col("path").alias("at"), F.coalesce(F.col("ord").cast("long"), F.lit(-1)).alias("ord")).where("k is not null")
    # at most one key for each BLOCK rows
    large = F.broadcast(given.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("k"))
    held = given.join(large, "k", "left_anti").groupBy("k").agg(F.collect_list(F.struct("at", "ord")).alias("rows"))
    schema = StructType([StructField(n, t) for n, t in (("k", given.schema["k"].dataType), ("kind", StringType()), ("path", StringType()), ("expected", ArrayType(StringType())))])
    small = held.mapInArrow(partial(_orders, xsd=xsd), schema)
    return small.unionByName(_in_blocks(given.join(large, "k", "left_semi"), xsd)).withColumnRenamed("k", key)


def _in_blocks(given: DataFrame, xsd: str) -> DataFrame:
    """(k, kind, path, expected) of messages of any size, given as rows ``(k, at, ord)``: see ``violations``."""
    spark = given.sparkSession
    models = F.broadcast(table(spark, xsd))  # as large as the schema
    leaf = X.facts(spark, xsd).select("path", "leaf")
    each = X.each_above(given).groupBy("k", "el").agg(F.min("ord").alias("ord"), F.greatest(F.count_if(F.col("at") == F.col("el")), F.lit(1)).alias("n"))
    each = each.withColumn("path", X.plain(F.col("el"))).join(F.broadcast(leaf), "path")
    each = each.withColumn("above", X.holder(F.col("el"))).withColumn("name", F.substring_index("path", "/", -1))
    inner = each.where("not leaf").select("k", F.col("el").alias("above"), X.plain(F.col("el")).alias("parent"), F.lit(-1).cast("long").alias("block"), F.array().cast("array<struct<ord: bigint, el: string, name: string>>").alias("run"))
    # equal rows at one path are as many elements
    child = each.where("above is not null").select("k", "above", X.plain(F.col("above")).alias("parent"), F.explode(F.array_repeat(F.struct("ord", "el", "name"), F.col("n").cast("int"))).alias("c"))
    runs = child.groupBy("k", "above", "parent", F.floor((F.col("c.ord") + 1) / BLOCK).alias("block")).agg(F.array_sort(F.collect_list("c")).alias("run"))
    runs = runs.unionByName(inner).join(models, "parent")
    to = lambda s, name: F.get("step", s * F.col("width") + F.array_position("names", name).cast("int") - 1)
    walk = lambda s, name: F.when(F.array_position("names", name) > 0, F.when(to(s, name) >= 0, to(s, name)).otherwise(s)).otherwise(s)
    after = F.transform(F.sequence(F.lit(0), F.size("accept") - 1), lambda s: F.aggregate("run", s, lambda at, c: walk(at, c["name"])))
    blocks = runs.withColumn("after", after)
    whole = blocks.groupBy("k", "above").agg(F.array_sort(F.collect_list(F.struct("block", "after"))).alias("chain"))
    begun = F.aggregate("chain", F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("starts")), lambda a, b: F.struct(F.get(b["after"], a["s"]).alias("s"), F.concat(a["starts"], F.array(a["s"])).alias("starts")))
    starts = whole.withColumn("b", begun).select("k", "above", F.col("b.s").alias("end"), F.posexplode(F.arrays_zip(F.col("chain.block").alias("block"), F.col("b.starts").alias("start"))).alias("i", "z"))
    starts = starts.select("k", "above", "end", F.col("z.block").alias("block"), F.col("z.start").alias("start"))
    met = blocks.drop("after").join(starts, ["k", "above", "block"])
    seen = F.aggregate(
        "run", F.struct(F.col("start").alias("s"), F.array().cast("array<struct<el: string, s: int>>").alias("bad")),
        lambda a, c: F.struct(
            walk(a["s"], c["name"]).alias("s"),
            F.when((F.array_position("names", c["name"]) > 0) & (to(a["s"], c["name"]) >= 0), a["bad"]).otherwise(F.concat(a["bad"], F.array(F.struct(c["el"].alias("el"), a["s"].alias("s"))))).alias("bad"),
        ),
    )
    bad = met.select("k", "follow", F.explode(seen["bad"]).alias("b")).select("k", F.lit("unexpected").alias("kind"), F.col("b.el").alias("path"), F.get("follow", F.col("b.s")).alias("expected"))
    ends = met.where("block = -1").where(~F.get("accept", F.col("end"))).select("k", F.lit("incomplete").alias("kind"), F.col("above").alias("path"), F.get("follow", F.col("end")).alias("expected"))
    return bad.unionByName(ends)


class _Order:
    """Runs the automata of a schema over messages given as paths in their order."""

    def __init__(self, xsd: str) -> None:
        self.declared = {n["path"] for n in X.nodes(xsd)}
        self.models = automata(xsd)
        self.at = lru_cache(1 << 16)(self._at)
        self.faults = lru_cache(1 << 12)(self._faults)

    def _at(self, path: str) -> list[tuple[str, str | None, str]]:
        """(element, the one above, name) of the declared elements of a path, from the outermost to itself."""
        out: list[tuple[str, str | None, str]] = []
        el, plain = None, ""
        for step in path.split("/"):
            above, name = el, re.sub(r"\[\d+\]", "", step, flags=re.ASCII)
            el, plain = (step, name) if above is None else (f"{above}/{step}", f"{plain}/{name}")
            if plain not in self.declared:
                break
            out.append((el, above, name))
        return out

    def _faults(self, paths: tuple[str, ...]) -> list[tuple[str, str, list[str]]]:
        """(kind, element, names allowed there) of a message: see ``violations``."""
        times: dict[str, int] = {}
        children: dict[str, list[tuple[str, str]]] = {}
        plain: dict[str, str] = {}
        for path in paths:
            for el, above, name in self.at(path):
                if el not in times:
                    times[el], children[el] = 0, []
                    plain[el] = name if above is None else f"{plain[above]}/{name}"
                    if above is not None:
                        children[above].append((el, name))
                times[el] += el == path
        out = []
        for el, below in children.items():
            if (model := self.models.get(plain[el])) is None:
                continue
            state = 0
            for child, name in below:
                for _ in range(max(times[child], 1)):
                    to = model.step[state][model.names.index(name)] if name in model.names else -1
                    if to < 0:
                        out.append(("unexpected", child, model.follow(state)))
                    else:
                        state = to
            if not model.accept[state]:
                out.append(("incomplete", el, model.follow(state)))
        return out


def _cells(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The rows of a batch's messages, and where each message's rows begin and end."""
    lists = b.column(1)
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])


def _orders(batches, xsd: str):
    held = _Order(xsd)
    for b in batches:
        cells, ends = _cells(b)
        coded = cells.field("at").dictionary_encode()
        paths, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        # the place, and within it the elements' names from the outermost on
        rank = np.empty(len(paths), np.int64)
        rank[sorted(range(len(paths)), key=lambda i: paths[i].split("/"))] = np.arange(len(paths))
        code = code[np.lexsort([rank[code], cells.field("ord").to_numpy(), np.repeat(np.arange(len(b)), np.diff(ends))])]
        # messages of the same paths in the same order have the same faults
        known: dict[bytes, list] = {}
        at, out = [], []
        for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            shape = code[lo:hi].tobytes()
            if (faults := known.get(shape)) is None:
                faults = known[shape] = held.faults(tuple(paths[c] for c in code[lo:hi]))
            at += [i] * len(faults)
            out += faults
        columns = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array([f[k] for f in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.list_(pa.string()))))]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "kind", "path", "expected"])


def render(rows: DataFrame, key: str = "payment_id") -> DataFrame:
    """(key, xml) of messages given as rows ``(key, path, value, ccy, ord)``, in the order of ``ord``, as they are. Null values are not given."""
    ship(rows.sparkSession)
    given = rows.where("value is not null and path is not null").select(F.col(key).alias("k"), F.struct(F.col("ord").cast("long").alias("ord"), F.col("path").alias("inst"), "value", "ccy").alias("r"))
    # a message is one value of the result: its rows meet in any case, as they are
    held = given.groupBy("k").agg(F.collect_list("r").alias("rows"))
    return held.mapInArrow(partial(_texts, key=key), StructType([StructField(key, given.schema["k"].dataType), StructField("xml", StringType())]))


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _currency(ccy: str | None) -> str:
    return "" if ccy is None else ' Ccy="' + _escaped(ccy).replace('"', "&quot;") + '"'


def _tags(rows) -> str:
    """The text of rows (ccy, value, elements above, names) in their order: elements open and close where a row's path leaves that of the row before it."""
    out: list[str] = []
    open_, names = [], []
    for ccy, value, above, path in rows:
        same = 0
        while same < min(len(open_), len(above)) and open_[same] == above[same]:
            same += 1
        out += [f"</{n}>" for n in reversed(names[same : len(open_)])]
        out += [f"<{n}>" for n in path[same : len(above)]]
        out.append(f"<{path[-1]}{ccy}>{value}</{path[-1]}>")
        open_, names = above, path
    return "".join(out + [f"</{n}>" for n in reversed(names[: len(open_)])])


@lru_cache(1 << 16)
def _steps(inst: str) -> tuple[list[str], list[str]]:
    """The elements above one, from the outermost on, and the names down to it."""
    steps = inst.split("/")
    return ["/".join(steps[:n]) for n in range(1, len(steps))], re.sub(r"\[\d+\]", "", inst, flags=re.ASCII).split("/")


def _texts(batches, key: str):
    for b in batches:
        cells, ends = _cells(b)
        place, inst, value, ccy = (cells.field(n).to_pylist() for n in ("ord", "inst", "value", "ccy"))
        # rows without a place come first
        rows = [((o is not None, o or 0), i, _currency(c), _escaped(v)) for o, i, v, c in zip(place, inst, value, ccy, strict=True)]
        xml = [_tags((c, v, *_steps(i)) for _, i, c, v in sorted(rows[lo:hi])) for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xml, pa.string())], names=[key, "xml"])


def build(rows: DataFrame, xsd: str, key: str = "payment_id") -> DataFrame:
    """(key, xml, ok, errors) of messages given as rows ``(key, path, value, ccy)`` in any order; repeated elements carry a counter.

    Elements come in the schema's order, repeated ones by their counters (none is before the first). Of a choice, the first branch of the schema
    that is given is written and the others are dropped; so are undeclared paths and values on elements that have elements. Everything that
    ``xsd.faults`` finds is listed in ``errors`` as ``kind path``, in order, and makes the message not ok; values outside codes, patterns and
    bounds are written as they are. Rows of one path and counter are written in the order of their values. A null value or path is not
    given; a message without a given row has no result.

    A message is one value of the result: its rows meet in one shuffle, as they are, and all else is worked out where they lie.
    """
    spark = rows.sparkSession
    ship(spark)
    given = rows.where("value is not null and path is not null").select(F.col(key).alias("k"), F.col("path").alias("inst"), X.plain(F.col("path")).alias("path"), "value", "ccy")
    told = given.join(F.broadcast(X.facts(spark, xsd).select("path", "leaf", "rules")), "path", "left")
    own = F.when(F.col("leaf").isNull(), "undeclared").when(~F.col("leaf"), "shape").otherwise(X.value_fault(F.col("value"), F.col("rules")))
    held = told.groupBy("k").agg(F.collect_list(F.struct("inst", "value", "ccy", own.alias("own"))).alias("rows"))
    schema = StructType([StructField(key, given.schema["k"].dataType), *(StructField(n, t) for n, t in (("xml", StringType()), ("ok", BooleanType()), ("errors", ArrayType(StringType()))))])
    return held.mapInArrow(partial(_messages, xsd=xsd, key=key), schema)


class _Schema:
    """What the messages of one schema are held against."""

    def __init__(self, xsd: str) -> None:
        self.every = X.nodes(xsd)
        self.node = {n["path"]: n for n in self.every}
        self.need = {n["path"]: X._wanted(self.every, n) for n in self.every if not n["is_leaf"]}
        self.choice: dict[str, tuple[str, int] | None] = {}  # of the elements that take part in one: its name by the element above, and the branch
        for n in self.every:
            by = self.node.get(n["parent"])
            named = (n["parent"], n["ord"]) if by and by["is_choice"] else (f"{n['parent']}/{n['choice'][0]}", n["choice"][1]) if by and n["choice"] else None
            self.choice[n["path"]] = named
        self.at = lru_cache(1 << 16)(self._at)

    def _at(self, inst: str) -> tuple | None:
        """Of a declared path: its elements as (element, above, plain path, holder of its choice, branch), its place, those above it, its names; else None."""
        steps, out, place, el, path = inst.split("/"), [], [], "", ""
        for step in steps:
            above, name = el or None, re.sub(r"\[\d+\]", "", step)
            el, path = f"{el}/{step}" if el else step, f"{path}/{name}" if path else name
            n = self.node.get(path)
            if n is None:
                return None
            held, branch = self.choice[path] or (None, None)
            counter = re.search(r"\[(\d+)\]$", step, re.ASCII)
            place.append((n["ord"], int(counter[1]) if counter else 0))
            out.append((el, above, path, held and f"{above}|{held}", branch))
        return out, tuple(place), [e[0] for e in out[:-1]], path.split("/"), n["is_leaf"]

    def errors(self, given: list[tuple[str, str]]) -> list[str]:
        """``kind path`` of the structural faults of a message, from its (instance, value fault) rows: see ``xsd.faults``."""
        out = [f"{own} {inst}" for inst, own in given if own is not None]
        times: dict[tuple, list] = {}
        for inst, _ in given:
            at = self.at(inst)
            if at is None:
                continue
            for e in at[0]:
                times.setdefault(e[0], [e, 0])
            times[at[0][-1][0]][1] += 1
        children: dict[tuple, int] = {}
        have: dict[str, set] = {}
        branches: dict[tuple, set] = {}
        for e, n in times.values():
            _, above, path, _, _ = e
            children[above, path] = children.get((above, path), 0) + max(n, 1)
            if above is not None:
                have.setdefault(above, set()).add(path)
                if (c := self.node[path]["choice"]) is not None:
                    branches.setdefault((above, c[0]), set()).add(c[1])
        for (above, path), n in children.items():
            most = self.node[path]["max_occurs"]
            if most is not None and n > most:
                out.append(f"repeats {path if above is None else above + '/' + self.node[path]['name']}")
        for above, names in have.items():
            parent = times[above][0][2]
            for some, faults in self.need.get(parent, ()):
                if names.isdisjoint(some):
                    out += [f"{kind} {above}{path[len(parent):]}" for kind, path in faults]
            if self.node[parent]["is_choice"] and len(names) > 1:
                out.append(f"branches {above}")
        out += [f"branches {above}/{c}" for (above, c), taken in branches.items() if len(taken) > 1]
        return sorted(out)

    def xml(self, given: list[tuple[str, str, str | None]]) -> str:
        """A message's (instance, value, ccy) rows in the schema's order, of each choice the first branch."""
        known = [(at, inst, v, c) for inst, v, c in given if (at := self.at(inst)) is not None and at[4]]
        least: dict[str, int] = {}
        for at, *_ in known:
            for e in at[0]:
                if e[3] is not None:
                    least[e[3]] = min(e[4], least.get(e[3], e[4]))
        kept = []
        for at, inst, v, c in known:
            if all(e[3] is None or e[4] == least[e[3]] for e in at[0]):
                kept.append((at[1], inst, _currency(c), _escaped(v), at[2], at[3]))
        kept.sort(key=lambda r: r[:4])
        return _tags(row[2:] for row in kept)


def _messages(batches, xsd: str, key: str):
    held = _Schema(xsd)
    for b in batches:
        cells, ends = _cells(b)
        inst, value, ccy, own = (cells.field(n).to_pylist() for n in ("inst", "value", "ccy", "own"))
        xml, errors = [], []
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            xml.append(held.xml(list(zip(inst[lo:hi], value[lo:hi], ccy[lo:hi], strict=True))))
            errors.append(held.errors(list(zip(inst[lo:hi], own[lo:hi], strict=True))))
        out = [b.column(0), pa.array(xml, pa.string()), pa.array([not e for e in errors], pa.bool_()), pa.array(errors, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(out, names=[key, "xml", "ok", "errors"])
