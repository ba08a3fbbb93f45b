"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs in a document with at most k edits shares at least m - q + 1 - k * q of its q-grams with the
document, all of them on diagonals (place in document less place in item) that span at most k. So the shared q-grams are counted in bands of
2 (k + 1) diagonals, each band overlapping the next by half; only bands that reach the bound are verified, by an alignment that is
limited to the band's diagonals. Items for whose edits q = 8 gives no bound are searched with q = 4, and those of under 8 characters
as whole words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Lengths of q-grams, for long items and for those that are too short for the first.
QS = (8, 4)
#: Items of fewer characters must occur as they are, as whole words.
LEAST = 8
#: Edits allowed for each character of an item.
RATE = 0.1
#: Characters of benchmark text in one block of the query set; a larger benchmark is searched block by block.
BLOCK_CHARS = 8 << 20
CHUNK = 1 << 20
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))

HIT = pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
HIT_DDL = "hits array<struct<item_id: long, edits: int, start: long, end: long>>"


def normalise(text: str) -> str:
    """Lower case, white space as single spaces. Items and documents are compared, and places counted, in this form."""
    return " ".join(text.lower().split())


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q (4 or 8) neighbouring code points, by doubling."""
    x = codes.astype(np.uint64) + np.uint64(1)
    for width, mult in zip((1, 2, 4)[: q.bit_length() - 1], _MULT, strict=False):
        x = x[:-width] * mult + x[width:]
        x ^= x >> np.uint64(29)
    return x


def edit_budget(m: int, rate: float, q: int) -> int:
    """Edits allowed for m characters, fewer where the bound on shared q-grams would fall below one."""
    return max(0, min(int(m * rate), (m - q) // q))


def split_items(items: list[tuple[int, str]], rate: float) -> list[Items | Words]:
    """The searches for a block of items: by long q-grams, by short ones, and as words."""
    held = [(i, t) for i, t in ((i, normalise(t or "")) for i, t in items) if t]
    long = [len(t) >= LEAST and edit_budget(len(t), rate, QS[0]) == int(len(t) * rate) for _, t in held]
    some = [x for x, ok in zip(held, long, strict=True) if ok], [x for x, ok in zip(held, long, strict=True) if not ok and len(x[1]) >= LEAST]
    out: list[Items | Words] = [Items(x, rate, q) for x, q in zip(some, QS, strict=True) if x]
    short = [x for x in held if len(x[1]) < LEAST]
    return [*out, Words(short)] if short else out


class Words:
    """Items of under LEAST characters, found where they occur as they are between spaces or the ends of a text."""

    def __init__(self, items: list[tuple[int, str]]):
        self.of: dict[str, list[int]] = {}
        for i, t in items:
            self.of.setdefault(t, []).append(i)
        self.most = max(t.count(" ") + 1 for t in self.of)

    def hits(self, text: str) -> list[dict]:
        words = text.split(" ")
        at = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
        out: dict[str, int] = {}
        for n in range(1, self.most + 1):
            for k in range(len(words) - n + 1):
                if at[k + n] - 1 - at[k] < LEAST:
                    t = " ".join(words[k : k + n])
                    if t in self.of:
                        out.setdefault(t, at[k])
        return [{"item_id": i, "edits": 0, "start": s, "end": s + len(t)} for t, s in out.items() for i in self.of[t]]


class Items:
    """A block of normalised items, and their q-grams as sorted hashes with their places."""

    def __init__(self, held: list[tuple[int, str]], rate: float, q: int):
        self.q = q
        self.ids = [i for i, _ in held]
        self.texts = [t for _, t in held]
        self.codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in self.texts]
        self.budget = np.array([edit_budget(len(t), rate, q) for t in self.texts], np.int64)
        self.bound = np.array([len(t) - q + 1 for t in self.texts], np.int64) - self.budget * q
        hashes = [grams(c, q) for c in self.codes]
        item = np.repeat(np.arange(len(held)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if held else np.zeros(0, np.int64)
        flat = np.concatenate(hashes) if held else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.bits = max(10, int(np.ceil(np.log2(len(self.keys) + 1))) + 5)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(self.keys)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * _MULT[0]) >> np.uint64(64 - self.bits)

    def shared(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``h`` whose q-gram an item has, with the item and its place there."""
        at = np.flatnonzero(self.table[self._slot(h)])
        i = np.searchsorted(self.keys, h[at])
        ok = i < len(self.keys)
        ok[ok] = self.keys[i[ok]] == h[at[ok]]
        at, i = at[ok], i[ok]
        n = self.count[i]
        row = np.repeat(self.first[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(i) else np.zeros(0, np.int64)
        return np.repeat(at, n), self.item[row], self.place[row]


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """Fewest edits between ``item`` and a stretch of ``text`` whose diagonals lie in [low, high], and its end; None if over ``most``."""
    width = high - low + 1
    pad = np.full(len(item) + width + 2, 0xFFFFFFFF, np.uint32)
    a, b = max(0, low), min(len(text), low + len(pad))
    if a < b:
        pad[a - low : b - low] = text[a:b]
    steps = np.arange(width)
    place = low + steps
    cost = np.where((place >= 0) & (place <= len(text)), 0, most + 1)
    for i in range(len(item)):
        new = cost + (pad[i : i + width] != item[i])
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        new = np.minimum.accumulate(new - steps) + steps
        at = place + i + 1
        new[(at < 0) | (at > len(text))] = most + 1
        if new.min() > most:
            return None
        cost = new
    best = int(np.argmin(cost))
    return (int(cost[best]), low + len(item) + best) if cost[best] <= most else None


def search(text: str, codes: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], items: Items) -> list[dict]:
    """Verified hits in one document, the best for each item."""
    at, item, place = found
    stride = items.budget[item] + 1
    diagonal = at - place
    band = np.floor_divide(diagonal, stride)
    # a shared q-gram counts in its own band and in the one before, which overlaps it
    key = np.concatenate([item, item]) * (1 << 40) + np.concatenate([band, band - 1]) + (1 << 39)
    where = np.concatenate([place, place])
    order = np.lexsort([where, key])
    key, where = key[order], where[order]
    # distinct places of the item: a repeated q-gram of the document counts once
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (where[1:] != where[:-1])])
    bands, n = np.unique(key[new], return_counts=True)
    which = bands >> 40
    passed = n >= items.bound[which]
    best: dict[int, dict] = {}
    for j, b in zip(which[passed].tolist(), ((bands[passed] & ((1 << 40) - 1)) - (1 << 39)).tolist(), strict=True):
        k = int(items.budget[j])
        held = best.get(j)
        if held and held["edits"] == 0:
            continue
        low, high = b * (k + 1), (b + 2) * (k + 1) - 1
        exact = text.find(items.texts[j], max(0, low), max(0, high + 1) + len(items.texts[j]))
        hit = (0, exact + len(items.texts[j])) if exact >= 0 else banded(items.codes[j], codes, low - k, high + k, k)
        if hit and (held is None or hit[0] < held["edits"]):
            end = hit[1]
            best[j] = {"item_id": items.ids[j], "edits": hit[0], "start": max(0, end - len(items.texts[j])), "end": end}
    return list(best.values())


def _scan(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Add the hits of one block of items to each row (columns: row's text first, hits second, then others as they are)."""
    searches = held.value
    for b in batches:
        texts = [normalise(t) for t in b.column(0).to_pylist()]
        hits = b.column(1).to_pylist()
        for search_ in searches:
            if isinstance(search_, Words):
                for i, t in enumerate(texts):
                    hits[i] = (hits[i] or []) + search_.hits(t)
                continue
            some, size = [], 0
            for i, t in enumerate(texts):
                some.append(i)
                size += len(t)
                if size >= CHUNK or i + 1 == len(texts):
                    _search_many(texts, hits, some, search_)
                    some, size = [], 0
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.list_(HIT)), *(b.column(i) for i in range(2, b.num_columns))], schema=b.schema.set(1, pa.field("hits", pa.list_(HIT))))


def _search_many(texts: list[str], hits: list, some: list[int], items: Items) -> None:
    """Several documents as one buffer; q-grams that hold a separator match nothing."""
    joined = "\0".join(texts[i] for i in some)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < items.q:
        return
    start = np.cumsum([0] + [len(texts[i]) + 1 for i in some])
    at, item, place = items.shared(grams(codes, items.q))
    doc = np.searchsorted(start, at, "right") - 1
    # documents with too few shared q-grams for any item need no bands
    edge = np.searchsorted(doc, np.arange(len(some) + 1))
    least = int(items.bound.min())
    for k in np.flatnonzero(np.diff(edge) >= least).tolist():
        s = slice(edge[k], edge[k + 1])
        n = np.bincount(item[s], minlength=len(items.ids))
        some_item = n >= items.bound
        if not some_item.any():
            continue
        keep = some_item[item[s]]
        lo = int(start[k])
        found = search(texts[some[k]], codes[lo : int(start[k + 1]) - 1], (at[s][keep] - lo, item[s][keep], place[s][keep]), items)
        if found:
            hits[some[k]] = (hits[some[k]] or []) + found


def blocks_of(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The query set ``benchmark(item_id, text)`` in blocks of bounded size, streamed to the driver."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        if block and size + len(r[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` (with a text column; other columns are kept) and the column __hits: for each item found, item_id, edits, and its place.

    Found means: somewhere in the document, in lower case and with white space as single spaces, the item occurs with at most ``rate``
    edits for each of its characters; an item of under LEAST characters must occur as it is, as whole words. Null or empty items match
    nothing, as do null texts; repeated item_ids are items of their own. The benchmark is a query set: it is broadcast in blocks of
    bounded size, one after another; the rows are written with their hits between two blocks. An empty table on either side is allowed.
    """
    spark = docs.sparkSession
    names = docs.columns
    rows = docs.select(common.text_or_empty().alias("__t"), F.lit(None).cast(HIT_DDL.removeprefix("hits ")).alias("hits"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("__row"))
    last = None
    for block in blocks_of(benchmark, block_chars):
        if last is not None:
            done = common.materialize(rows, "hits")
            last.unpersist()
            if hasattr(rows, "scratch_path"):
                common.drop(spark, rows.scratch_path)
            rows = done
        last = spark.sparkContext.broadcast(split_items(block, rate))
        before = getattr(rows, "scratch_path", None)
        rows = common.arrow_map(rows, lambda it, held=last: _scan(it, held), rows.schema)
        if before:
            rows.scratch_path = before
    return rows.select("__row.*", F.coalesce("hits", F.array().cast(HIT_DDL.removeprefix("hits "))).alias("__hits"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h["item_id"])))
    return found.select("doc_id", (F.size("__hits") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.array_min(F.transform("__hits", lambda h: h["edits"])).alias("edits"))
