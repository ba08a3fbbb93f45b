"""Removal of repeated 200-byte strings by sorting sampled suffixes.

A suffix per byte would multiply the corpus, so the suffixes are sampled by content: of the GRAM-byte strings in a window of 200 bytes,
the one with the least hash (the right-most of equal ones) is the window's anchor. Equal windows have equal anchors, so all that can repeat
is found among the suffixes that start at anchors; a run is a stretch of windows with one anchor.

1. Suffixes at anchors are range-partitioned by their leading bytes with splitters from a sample of documents; equal ones of one batch are
   combined first. Each bucket sorts them by multikey quicksort on (leading bytes, hash of the anchor's GRAM bytes, hashes of the run with
   its 200 bytes of context) and compares neighbours. Beyond the leading bytes this groups equal suffixes, and orders no others. Runs with equal context repeat as a whole. Runs whose anchor has other
   contexts too, or lies at a bucket's edge (where the next bucket may go on with it), are left for step 2. The others are unique.
2. Only for runs left over, every window's own suffix of 200 bytes is compared, by its hashes. Equal windows have equal anchors, so
   runs of an anchor that few runs share travel once, as their bytes, to the bucket of the anchor; where many share it, or a bucket's edge
   may cut the anchor's runs in two, each window travels by itself and is dealt by its own hash, so that no bucket gets too much.
3. Repeated windows come back to their documents as intervals; what they cover is cut out.

Strings count as equal where two independent 64-bit hashes are: among 10^14 windows, some two unequal ones agree in both with a
probability of 10^-11. Rows are told apart by a number of their own, never by id or content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, GRAM = 200, 40
SPAN = WINDOW - GRAM + 1
SEGMENT = 1 << 20
#: Documents, and anchors of each, from which splitters are taken: for balance only.
SAMPLE_DOCS, SAMPLE_ANCHORS = 2000, 64
SINGLE, DECIDED, REST = 0, 2, 3
#: Most distinct contexts of an anchor that go to one bucket as bytes.
FEW = 2000
#: About as many suffixes, or windows, are sorted in one task; more ranges, not longer ones, as the table grows.
RANGE_RUNS, RANGE_WINDOWS = 1 << 21, 1 << 22
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bases of the two hashes.
_BASES = (_BASE, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1

RUNS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("lead", pa.int64()), ("ah", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("d", pa.int64()), ("iv", pa.int64())])
RUNS_DDL = "bucket int, kind byte, lead long, ah long, fp long, fp2 long, d long, iv long"
MARKS = pa.schema([("kind", pa.int8()), ("d", pa.int64()), ("iv", pa.int64()), ("ah", pa.int64())])
MARKS_DDL = "kind byte, d long, iv long, ah long"
WINDOWS = pa.schema([("key", pa.int64()), ("key2", pa.int64()), ("kind", pa.int8()), ("d", pa.int64()), ("iv", pa.int64()), ("bytes", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = [_mix(np.arange(1, 257, dtype=U) * U(b)) for b in _BASES]
_POWERS: list[list[np.ndarray]] = []


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 2 * SEGMENT + 4 * WINDOW)
        _POWERS[:] = [[np.concatenate([np.ones(1, U), np.multiply.accumulate(np.full(size - 1, b, U))]) for b in (base, pow(base, -1, 1 << 64))] for base in _BASES]
    return _POWERS[which][0], _POWERS[which][1]


def _prefix(buf: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2^64."""
    power, _ = _powers(len(buf) + 1, which)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(_BYTE[which][buf] * power[: len(buf)], out=out[1:])
    return out


def _hashes(prefix: np.ndarray, lo: np.ndarray | slice, hi: np.ndarray | slice, which: int) -> np.ndarray:
    _, inverse = _powers(len(prefix), which)
    return _mix((prefix[hi] - prefix[lo]) * inverse[: len(prefix)][lo])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by minima over blocks from the left and from the right."""
    n = len(x)
    padded = np.full(-(-n // w) * w, U(_MASK))
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about SEGMENT bytes of whole texts, or overlapping pieces of long ones: bytes, index of text, place in text, start in buffer."""
    cur: list[tuple[int, int, bytes]] = []
    size = 0

    def close() -> tuple:
        lens = np.array([len(x[2]) for x in cur], np.int64)
        return np.frombuffer(b"".join(x[2] for x in cur), np.uint8), np.array([x[0] for x in cur]), np.array([x[1] for x in cur], np.int64), np.concatenate([[0], np.cumsum(lens)])

    for i, t in enumerate(texts):
        for s in range(0, len(t) - WINDOW + 1, SEGMENT):
            piece = t[s : s + SEGMENT + WINDOW - 1]
            if cur and size + len(piece) > SEGMENT + WINDOW:
                yield close()
                cur, size = [], 0
            cur.append((i, s, piece))
            size += len(piece)
    if cur:
        yield close()


def _runs(buf: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the windows that lie within one piece: start, count, piece, leading bytes and hash at the anchor, hashes of the context."""
    prefix, second = _prefix(buf, 0), _prefix(buf, 1)
    n = len(buf) - WINDOW + 1
    grams = _hashes(prefix, slice(0, len(buf) - GRAM + 1), slice(GRAM, len(buf) + 1), 0)
    place = np.arange(len(grams), dtype=U)
    least = _sliding_min((grams & U(_MASK ^ 0xFFFFFF)) | (U(0xFFFFFF) - place), SPAN)
    ok = np.zeros(n, bool)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        ok[a : b - WINDOW + 1] = True
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])]))
    last = np.concatenate([first[1:], [n]])
    inside = ok[first]
    first, last = first[inside], last[inside]
    anchor = (U(0xFFFFFF) - (least[first] & U(0xFFFFFF))).astype(np.int64)
    lead = np.ascontiguousarray(buf[anchor[:, None] + np.arange(8)]).view(">u8").ravel().astype(U)
    context = [_hashes(p, first, last - 1 + WINDOW, k) + (last - first).astype(U) * U(_BASES[k]) for k, p in enumerate((prefix, second))]
    return first, last - first, np.searchsorted(edge, first, "right") - 1, lead, grams[anchor], *context


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort of rows of words: three-way split on the word at a depth; equal rows go on with the next word."""
    out = np.empty(len(words[0]), np.int64)
    todo = [(np.arange(len(out)), 0, 0)]
    while todo:
        rows, depth, at = todo.pop()
        if len(rows) <= 1 or depth == len(words):
            out[at : at + len(rows)] = rows
            continue
        if len(rows) <= 2048:
            out[at : at + len(rows)] = rows[np.lexsort([w[rows] for w in reversed(words[depth:])])]
            continue
        x = words[depth][rows]
        pivot = np.sort(x[:: max(1, len(x) // 31)])[15]
        less, more = x < pivot, x > pivot
        parts = rows[less], rows[~(less | more)], rows[more]
        todo += [(parts[0], depth, at), (parts[1], depth + 1, at + len(parts[0])), (parts[2], depth, at + len(parts[0]) + len(parts[1]))]
    return out


def _iv(start: np.ndarray, count: np.ndarray, rest: np.ndarray | int = 0) -> np.ndarray:
    return (start.astype(np.int64) << 32) | (count.astype(np.int64) << 1) | rest


def _merge(key: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjoining intervals of one key, in order of (key, start), as one."""
    if not len(key):
        return key, start, count
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] != start[:-1] + count[:-1])])
    at = np.flatnonzero(new)
    return key[at], start[at], np.add.reduceat(count, at)


def _combine(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row whether its pair of values occurs again, and whether it is the first with it."""
    order = np.lexsort((two, one))
    new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    group = np.cumsum(new) - 1
    again, lead = np.zeros(len(one), bool), np.zeros(len(one), bool)
    again[order] = (np.bincount(group) > 1)[group]
    lead[order[new]] = True
    return again, lead


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some suffixes of each text, and with its first the number of them all."""
    schema = pa.schema([("lead", pa.int64()), ("ah", pa.int64()), ("fp", pa.int64()), ("n", pa.int64())])
    for b in batches:
        for buf, _, _, edge in _segments(b.column(1).to_pylist()):
            r = _runs(buf, edge)
            rank = np.arange(len(r[0])) - np.searchsorted(r[2], r[2], "left")
            whole = np.bincount(r[2], minlength=1)[r[2]]
            many = np.maximum(whole, SAMPLE_ANCHORS)
            some = (rank * SAMPLE_ANCHORS) // many != ((rank - 1) * SAMPLE_ANCHORS) // many
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x[some]).view(np.int64)) for x in r[3:6]), pa.array(np.where(rank == 0, whole, 0)[some])], schema=schema)


def _bucket_of(words: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """The range of each row among the sorted splitters, by binary search on three words."""
    lo, hi = np.zeros(len(words[0]), np.int64), np.full(len(words[0]), len(splitters), np.int64)
    while len(splitters) and (lo < hi).any():
        mid = (lo + hi) // 2
        at = np.minimum(mid, len(splitters) - 1)
        a, b, c = (splitters[at, k] for k in range(3))
        ge = (words[0] > a) | ((words[0] == a) & ((words[1] > b) | ((words[1] == b) & (words[2] >= c))))
        act = lo < hi
        lo, hi = np.where(act & ge, mid + 1, lo), np.where(act & ~ge, mid, hi)
    return lo


def _suffixes(batches: Iterator[pa.RecordBatch], splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Step 1, map side: runs with the bucket of their suffix; those that occur again in the batch are decided here, and one goes on."""
    for b in batches:
        doc = b.column(0).to_numpy(zero_copy_only=False)
        parts = []
        for buf, text, at, edge in _segments(b.column(1).to_pylist()):
            first, n, piece, *hashes = _runs(buf, edge)
            parts.append((text[piece], first - edge[piece] + at[piece], n, *hashes))
        if not parts:
            continue
        text, start, n, lead, ah, fp, fp2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        again, first = _combine(fp, fp2)
        on = ~again | first
        bucket = _bucket_of([lead[on], ah[on], fp[on]], splitters)
        signed = [np.ascontiguousarray(x[on]).view(np.int64) for x in (lead, ah, fp, fp2)]
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((bucket, np.where(again[on], REST, SINGLE).astype(np.int8), *signed, doc[text[on]], _iv(start[on], n[on])), RUNS, strict=True)], schema=RUNS)
        k, s, c = _merge(text[again], start[again], n[again])
        if len(k):
            zero = np.zeros(len(k), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((k % max(1, len(splitters) + 1), np.full(len(k), DECIDED), zero, zero, zero, zero, doc[k], _iv(s, c)), RUNS, strict=True)], schema=RUNS)


def _columns(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> list[np.ndarray]:
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    return [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, f.type.to_pandas_dtype()) for f in schema]


def _marks(kind, d, iv, ah=None) -> pa.RecordBatch:
    """Marks of runs; ah is the anchor where a run's bytes are to travel, null where its windows are or where it is decided."""
    ah = pa.nulls(len(d), pa.int64()) if ah is None else ah
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((kind, d, iv, ah), MARKS, strict=True)], schema=MARKS)


def _compare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, bucket: sort, compare neighbours, and say of each run: repeated (DECIDED), to be looked at by window, or unique (dropped)."""
    bucket, kind, lead, ah, fp, fp2, d, iv = _columns(batches, RUNS)
    if not len(kind):
        return
    done = kind == DECIDED
    if done.any():
        yield _marks(kind[done], d[done], iv[done])
    for one in np.unique(bucket[~done]).tolist():
        rows = np.flatnonzero((bucket == one) & ~done)
        rows = rows[multikey_order([x[rows].view(U) for x in (lead, ah, fp, fp2)])]
        a, f, f2, k = ah[rows], fp[rows], fp2[rows], kind[rows]
        new_a = np.concatenate([[True], (a[1:] != a[:-1]) | (lead[rows][1:] != lead[rows][:-1])])
        new_f = new_a | np.concatenate([[True], (f[1:] != f[:-1]) | (f2[1:] != f2[:-1])])
        group_f, group_a = np.cumsum(new_f) - 1, np.cumsum(new_a) - 1
        again = (np.bincount(group_f) > 1)[group_f] | np.logical_or.reduceat(k == REST, np.flatnonzero(new_f))[group_f]
        contexts = np.bincount(group_a, weights=new_f)[group_a]
        edge = (group_a == 0) | (group_a == group_a[-1])
        lonely = ~again & ((contexts > 1) | edge)
        yes = again & (k == SINGLE)
        yield _marks(np.full(yes.sum(), DECIDED), d[rows[yes]], iv[rows[yes]])
        wanted = np.bincount(group_a, weights=lonely)[group_a] > 0
        rest = again & new_f & (wanted | edge)
        whole = ~edge & (contexts <= FEW)
        for some, what in ((lonely, SINGLE), (rest, REST)):
            yield _marks(np.full(some.sum(), what), d[rows[some]], iv[rows[some]] | (what == REST), pa.array(a[some], mask=~whole[some]))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, map side: the bytes of runs, by anchor, or the hashes of their windows; windows that occur again in the batch are decided here."""
    for b in batches:
        doc = b.column(0).to_numpy(zero_copy_only=False)
        texts = b.column(1).to_pylist()
        lists: list[np.ndarray] = []
        whole: list[tuple] = []
        for i, runs in enumerate(b.column(2).to_pylist()):
            lists.append(np.array([r["iv"] for r in runs if r["ah"] is None], np.int64))
            for r in runs:
                if r["ah"] is not None:
                    p, n = r["iv"] >> 32, (r["iv"] & 0xFFFFFFFF) >> 1
                    whole.append((r["ah"], 0, REST if r["iv"] & 1 else SINGLE, doc[i], r["iv"], texts[i][p : p + n - 1 + WINDOW]))
        for at in range(0, len(whole), 8192):
            yield common.batch(WINDOWS, **dict(zip(WINDOWS.names, zip(*whole[at : at + 8192]), strict=True)))
        parts = []
        for buf, text, at, edge in _segments([t if len(x) else b"" for t, x in zip(texts, lists, strict=True)]):
            sums = [_prefix(buf, k) for k in (0, 1)]
            for i, place, lo, hi in zip(text.tolist(), at.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                p, n = lists[i] >> 32, (lists[i] & 0xFFFFFFFF) >> 1
                here = (p >= place) & (p < place + min(SEGMENT, hi - lo - WINDOW + 1))
                p, n, rest = p[here], n[here], (lists[i][here] & 1).astype(bool)
                if len(p):
                    w = np.repeat(p - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    s = w - place + lo
                    parts.append((np.full(len(w), i), w, np.repeat(rest, n), *(_hashes(sums[k], s, s + WINDOW, k) for k in (0, 1))))
        if not parts:
            continue
        text, w, rest, fp, fp2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        again, first = _combine(fp, fp2)
        on = ~again | first
        kind = np.where(again | rest, REST, SINGLE)[on]
        none = pa.nulls(int(on.sum()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((fp[on].view(np.int64), fp2[on].view(np.int64), kind, doc[text[on]], _iv(w[on], np.ones(on.sum())), none), WINDOWS, strict=True)], schema=WINDOWS)
        yes = np.flatnonzero(again & ~rest)
        yes = yes[np.lexsort([w[yes], text[yes]])]
        k, s, c = _merge(text[yes], w[yes], np.ones(len(yes), np.int64))
        if len(k):
            spread = _mix(s.astype(U) + k.astype(U)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((spread, spread, np.full(len(k), DECIDED), doc[k], _iv(s, c), pa.nulls(len(k), pa.binary())), WINDOWS, strict=True)], schema=WINDOWS)


def _compare_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, bucket: sort the windows' hashes and compare neighbours."""
    parts = []
    for b in batches:
        key, key2, kind, d, iv = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        done = kind == DECIDED
        if done.any():
            yield _marks(kind[done], d[done], iv[done])
        single = np.flatnonzero(~done & b.column(5).is_null().to_numpy(zero_copy_only=False))
        parts.append((key[single].view(U), key2[single].view(U), kind[single], d[single], iv[single] >> 32))
        for buf, row, at, edge in _segments([x or b"" for x in b.column(5).to_pylist()]):
            # every window of every run's bytes; a run is far shorter than a segment, so that each is one piece
            n = np.diff(edge) - WINDOW + 1
            w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s = w + np.repeat(edge[:-1], n)
            r = np.repeat(row, n)
            parts.append((*(_hashes(_prefix(buf, k), s, s + WINDOW, k) for k in (0, 1)), kind[r], d[r], (iv[r] >> 32) + w))
    if not parts:
        return
    fp, fp2, kind, d, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(fp):
        return
    rows = multikey_order([fp, fp2])
    new = np.concatenate([[True], (fp[rows][1:] != fp[rows][:-1]) | (fp2[rows][1:] != fp2[rows][:-1])])
    group = np.cumsum(new) - 1
    again = (np.bincount(group) > 1)[group] | np.bincount(group, weights=(kind[rows] == REST))[group].astype(bool)
    # a lone REST row is a window that occurs again already: only SINGLE rows ask
    yes = rows[again & (kind[rows] == SINGLE)]
    yes = yes[np.lexsort([start[yes], d[yes]])]
    if len(yes):
        same = np.cumsum(np.concatenate([[True], d[yes][1:] != d[yes][:-1]])) - 1
        k, s, c = _merge(same, start[yes], np.ones(len(yes), np.int64))
        at = np.searchsorted(same, k, "left")
        yield _marks(np.full(len(k), DECIDED), d[yes][at], _iv(s, c))


def cover(text: bytes, intervals: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal byte runs covered by the repeated windows, and what is left."""
    if not len(intervals):
        return [], text
    order = np.sort(intervals)
    lo, hi = order >> 32, (order >> 32) + ((order & 0xFFFFFFFF) >> 1) - 1 + WINDOW
    far = np.maximum.accumulate(hi)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > far[:-1]]))
    spans = list(zip(lo[new].tolist(), np.concatenate([far[new[1:] - 1], far[-1:]]).tolist(), strict=True))
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return spans, b"".join([*kept, text[at:]])


def _cut(batches: Iterator[pa.RecordBatch], with_spans: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, text, ivs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            spans, kept = cover(text, np.array(ivs or [], np.int64))
            out.append((doc, len(text), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in spans]))
        if out:
            schema = SPANS if with_spans else OUT
            yield common.batch(schema, **dict(zip(schema.names, zip(*out), strict=False)))


SPANS = OUT.append(pa.field("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))


def dedup(docs: DataFrame, with_spans: bool = False) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the spans if asked for.

    Every byte that lies in a 200-byte string (of the text's UTF-8) that also starts elsewhere in the table is removed. Null text counts as
    empty; texts under 200 bytes are left as they are; rows with equal doc_id (or none) are documents of their own, so repeated rows repeat
    each other. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    n = common.partitions(spark)
    rows = common.with_row(docs.select("doc_id", "text")).select(F.col("__r").alias("d"), F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().cast("binary").alias("text"))
    many = max(1, docs.count() // max(SAMPLE_DOCS, 8 * n))
    drawn = common.arrow_map(rows.where(F.pmod(F.xxhash64("d"), F.lit(many)) == 0).select("d", "text"), _sample, "lead long, ah long, fp long, n long").toArrow()
    sample = np.stack([c.to_numpy().view(U) for c in drawn.columns[:3]], axis=1)
    sample = sample[np.lexsort([sample[:, 2], sample[:, 1], sample[:, 0]])]
    ranges = max(n, int(drawn.column("n").to_numpy().sum()) * many // RANGE_RUNS)
    splitters = np.unique(sample[(np.arange(1, ranges) * len(sample)) // ranges], axis=0) if len(sample) else sample
    runs = common.arrow_map(rows.select("d", "text"), lambda it: _suffixes(it, splitters), RUNS_DDL)
    marks = common.materialize(common.arrow_map(runs.repartitionById(ranges, F.col("bucket")), _compare_runs, MARKS_DDL), "suffix-runs")
    common.release(spark)
    open_ = marks.where(F.col("kind") != DECIDED)
    left = open_.groupBy("d").agg(F.collect_list(F.struct("iv", "ah")).alias("runs"))
    asked = rows.select("d", "text").join(left, "d").select("d", "text", "runs")
    count = open_.agg(F.coalesce(F.sum(F.expr("shiftright(iv & 4294967295, 1)")), F.lit(0))).first()[0]
    windows = common.arrow_map(asked, _windows, "key long, key2 long, kind byte, d long, iv long, bytes binary")
    more = common.materialize(common.arrow_map(windows.repartition(max(n, count // RANGE_WINDOWS), "key"), _compare_windows, MARKS_DDL), "suffix-windows")
    common.release(spark)
    found = marks.where(F.col("kind") == DECIDED).select("d", "iv").union(more.select("d", "iv")).groupBy("d").agg(F.collect_list("iv").alias("ivs"))
    out = rows.join(found, "d", "left").select("doc_id", "text", "ivs")
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return common.arrow_map(out, lambda it: _cut(it, with_spans), fields + (", spans array<struct<start: long, end: long>>" if with_spans else ""))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
