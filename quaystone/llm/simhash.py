"""SimHash near duplicates by anchor-point covering.

The anchors are the words of the Hamming code (31, 26), a perfect covering code of radius 1, once over bits 0 to 30 and once over bits
31 to 61 of a fingerprint. Two fingerprints that differ in at most 2 bits differ in at most 1 bit of one of the two halves; there, the
second lies within radius + 1 = 2 of the first one's anchor. So each fingerprint is at home at its one anchor of each half, is copied to
the anchors within distance 2 (16 at most), and is compared with those at home there, over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship
from . import common, graph

BITS, HALVES = 31, 2
SEED = 42
#: Groups of more rows than this at one anchor are compared by blocks, smaller ones many at a time.
SMALL = 24
#: An anchor with more rows than this is dealt over several tasks: its homes in blocks against its rows in blocks.
CELL_ROWS = 4096

PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
COPIES = pa.schema([("anchor", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash over the word shingles of a text with A-Z lower-cased; no word: 0."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        lens = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lens + 1) - 1
        starts = (ends - lens)[: n - width + 1].tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts, ends[width - 1 :].tolist(), strict=True)])
    total = len(digests) // 8
    ones = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        part = np.frombuffer(digests, np.uint8, min(total - at, 1 << 16) * 8, at * 8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], schema=PRINTS)


def _syndrome(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for k in range(5):
        mask = np.uint64(sum(1 << (i - 1) for i in range(1, BITS + 1) if i >> k & 1))
        out |= (np.bitwise_count(x & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return out


_PAIRS = np.array([[((1 << (i - 1)) | (1 << ((i ^ s) - 1))) if s and i ^ s and i < (i ^ s) else 0 for i in range(1, BITS + 1)] for s in range(BITS + 1)], dtype=np.uint64)


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint at its home anchor and at the other anchors within distance 2, in each half."""
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for half in range(HALVES):
            part = fps >> np.uint64(BITS * half) & np.uint64((1 << BITS) - 1)
            s = _syndrome(part)
            home = part ^ np.where(s > 0, np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1)), np.uint64(0))
            flips = _PAIRS[s.astype(np.int64)]
            row, col = np.nonzero(flips)
            anchor = np.concatenate([home, part[row] ^ flips[row, col]]) | np.uint64(half << BITS)
            fp = np.concatenate([fps, fps[row]])
            at_home = np.zeros(len(fp), bool)
            at_home[: len(fps)] = True
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(at_home)], schema=COPIES)


def _large(fp: np.ndarray, home: np.ndarray, most: int) -> np.ndarray:
    """Links that span what is linked at one large anchor: all homes against all rows, in blocks, kept as a forest."""
    parent = np.arange(len(fp))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    homes = np.flatnonzero(home)
    for i in homes.tolist():
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= most)
        a = root(i)
        for j in near[parent[near] != a].tolist():
            c = root(j)
            if c != a:
                parent[c] = a
                out.append((fp[i], fp[j]))
        parent[near] = a
    return np.array(out, np.uint64).reshape(-1, 2)


def _compare(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and cell: compare per cell. The last cell of a batch is carried on to the next."""
    keep = None

    def links(anchor: np.ndarray, cell: np.ndarray, fp: np.ndarray, home: np.ndarray) -> list[np.ndarray]:
        out = []
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1]), [True]])
        edge, key = np.flatnonzero(new), np.cumsum(new[:-1])
        size = np.diff(edge)
        small = np.repeat(size <= SMALL, size)
        for lag in range(1, min(SMALL, len(key))):
            a, b = slice(0, -lag), slice(lag, None)
            i = np.flatnonzero((key[a] == key[b]) & small[a] & (home[a] | home[b]) & (fp[a] != fp[b]))
            i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= most]
            out.append(np.stack([fp[i], fp[i + lag]], axis=1))
        for g in np.flatnonzero(size > SMALL).tolist():
            s = slice(edge[g], edge[g + 1])
            if home[s].any():
                out.append(_large(fp[s], home[s], most))
        return out

    def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        e = np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)
        if len(e):
            e = np.unique(np.sort(e, axis=1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, 0])), pa.array(np.ascontiguousarray(e[:, 1]))], schema=LINKS)

    for b in batches:
        now = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64), b.column(3).to_numpy(zero_copy_only=False)]
        if keep is not None:
            now = [np.concatenate(x) for x in zip(keep, now, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[-1:].sum() + 1) if (now[0][0], now[1][0]) != (now[0][-1], now[1][-1]) else 0
        if cut:
            yield from emit(links(*(x[:cut] for x in now)))
        keep = [x[cut:] for x in now]
    if keep is not None and len(keep[0]):
        yield from emit(links(*keep))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))
    return common.materialize(common.arrow_map(rows, lambda it: _fingerprints(it, width), "doc_id long, fp long"), "simhash")


def links(prints: DataFrame, most: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``prints(fp long)`` that differ in at most ``most`` <= 2 bits, all or a forest of them.

    Where an anchor has over ``cell_rows`` rows, its homes and its rows are dealt into so many blocks that each pair of blocks, a cell, is
    of about that size. At most rows / cell_rows anchors have that many, and these are broadcast only up to the bound of a lookup table.
    """
    if not 0 <= most <= 2:
        raise ValueError("the covering is built for thresholds of 0 to 2 bits")
    spark = prints.sparkSession
    copies = common.materialize(common.arrow_map(prints, _copies, "anchor long, fp long, home boolean"), "anchor-copies")
    hot = common.materialize(copies.groupBy("anchor").count().where(F.col("count") > cell_rows).select("anchor", F.ceil(F.col("count") / cell_rows).cast("int").alias("k")), "anchor-hot")
    n = hot.count()
    few = n <= common.BROADCAST_ROWS
    plain = (copies.join(F.broadcast(hot) if few else hot, "anchor", "left_anti") if n else copies).withColumn("cell", F.lit(0))
    if n:
        rows = copies.join(F.broadcast(hot) if few else hot, "anchor").withColumn("b", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        ways = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")
        homes = rows.where("home").select("anchor", "fp", "b", "k", F.lit(True).alias("home"), ways).select("anchor", "fp", "home", (F.col("b") * F.col("k") + F.col("o")).alias("cell"))
        others = rows.select("anchor", "fp", "b", "k", F.lit(False).alias("home"), ways).select("anchor", "fp", "home", (F.col("o") * F.col("k") + F.col("b")).alias("cell"))
        plain = plain.select("anchor", "fp", "home", "cell").unionByName(homes).unionByName(others)
    dealt = plain.repartition(common.partitions(spark), "anchor", "cell").sortWithinPartitions("anchor", "cell").select("anchor", "cell", "fp", "home")
    return common.arrow_map(dealt, lambda it: _compare(it, most), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 2) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hex digits), component_id, component_size.

    Null text counts as empty; texts without words have fingerprint zero and link like others. component_id is the smallest doc_id that
    is reachable over links of at most ``most`` bits, null where all of them are null. Equal fingerprints are one node, so that copies
    are never paired. Other columns are ignored; an empty table gives no rows.
    """
    prints = fingerprints(docs, width)
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = graph.components(links(nodes.select("fp"), most))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    labelled = common.materialize(labelled, "simhash-labels")
    groups = labelled.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"), F.count("*").alias("nodes"))
    # many fingerprints may be in one component, and many rows may have one fingerprint: both joins deal such keys over several tasks
    table = common.spread_join(labelled.select("fp", "root", "n"), common.materialize(groups, "simhash-components"), "root", "nodes", labelled.count())
    table = common.materialize(table.drop("root"), "simhash-groups")
    return common.spread_join(prints, table, "fp", "n", prints.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")


# --- similarity of shingle sets -------------------------------------------------------------------------------------------------------
# Texts of similarity 0.8 on shingles differ in about 10 of 64 bits, which no covering of practical size joins. So a text gets one SimHash
# for each of GROUPS groups of its SAMPLE least shingle hashes: of about four shingles each, two out of five groups are untouched between
# texts of similarity 0.8, and all of 16 are touched with probability 2e-4. Equal group fingerprints make a candidate; sets decide.

GROUPS, SAMPLE = 16, 64
#: A bucket of equal group fingerprints of up to WHOLE members is compared whole. In a larger one each member is first compared with the
#: bucket's first. Where that leaves a bucket in several components, all pairs across them are compared in blocks of about BLOCK bytes of
#: shingle sets: first in the largest such bucket of each text, then in all that still hold several components.
WHOLE, BLOCK = 16, 16 << 20

KEYS = pa.schema([("doc", pa.int64()), ("bucket", pa.int64())])
SETS = pa.schema([("doc", pa.int64()), ("shingles", pa.binary())])


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    last = max(1, len(words) - width + 1)
    starts = (ends - lens)[:last].tolist()
    stops = ends[width - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)]), ">u8").astype(np.uint64))


def group_prints(shingles: np.ndarray) -> list[int]:
    """SimHash of each group that has shingles, with the group's number mixed in."""
    some = shingles[:SAMPLE]
    out = []
    which = some % np.uint64(GROUPS)
    for g in np.unique(which).tolist():
        bits = np.unpackbits(some[which == g].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        fp = int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big")
        out.append(xxhash.xxh64_intdigest(fp.to_bytes(8, "big"), g))
    return out


def _keys(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs, found = [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            prints = group_prints(shingle_set(text, width))
            docs += [doc] * len(prints)
            found += prints
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.array(found, np.uint64).view(np.int64))], schema=KEYS)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Shingle sets as sorted distinct 64-bit hashes."""
    for b in batches:
        yield common.batch(SETS, doc=b.column(0), shingles=[shingle_set(t, width).tobytes() for t in b.column(1).to_pylist()])


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and both >= least * (len(x) + len(y) - both) - 1e-9)
        keep = np.array(keep, bool)
        yield pa.RecordBatch.from_arrays([pa.array(b.column(k).to_numpy(zero_copy_only=False)[keep]) for k in (0, 1)], schema=LINKS)


def similar_groups(docs: DataFrame, width: int, least: float) -> DataFrame:
    """Components (node, root) of the rows of ``docs(doc long, text binary)``, doc unique, by links of at least that Jaccard similarity.

    They are those of the links of all pairs of candidates: in a large bucket, pairs within one component are not compared again.
    """
    keys = common.materialize(common.arrow_map(docs, lambda it: _keys(it, width), "doc long, bucket long"), "near-keys")
    buckets = common.materialize(keys.groupBy("bucket").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"), "near-buckets")
    total = keys.count()
    held = buckets.select("bucket", "first", "n", F.col("n").alias("of"))
    members = common.materialize(common.spread_join(keys, held, "bucket", "of", total), "near-members")
    common.drop(keys.sparkSession, keys.scratch_path, buckets.scratch_path)
    # windows hold WHOLE rows at most
    order = W.partitionBy("bucket").orderBy("doc")
    small = members.where(F.col("n") <= WHOLE).select("doc", F.array(*[F.lead("doc", k).over(order) for k in range(1, WHOLE)]).alias("others"))
    small = small.select("doc", F.explode("others").alias("other")).where("other is not null")
    star = members.where(F.col("n") > WHOLE).where("doc <> first").select("doc", F.col("first").alias("other"))
    pairs = small.union(star).select(F.least("doc", "other").alias("u"), F.greatest("doc", "other").alias("v"))
    pairs = common.materialize(pairs.distinct(), "near-pairs")
    large = members.where(F.col("n") > WHOLE).select("doc", "bucket", "n")
    asked = pairs.select(F.col("u").alias("doc")).union(pairs.select(F.col("v").alias("doc"))).distinct()
    sets = common.materialize(common.arrow_map(docs.join(asked, "doc").select("doc", "text"), lambda it: _sets(it, width), "doc long, shingles binary"), "near-sets")
    firsts = pairs.groupBy("u").agg(F.count("*").alias("n")).join(sets.select(F.col("doc").alias("u"), F.col("shingles").alias("a")), "u")
    one = common.spread_join(pairs, firsts, "u", "n", pairs.count())
    two = one.join(sets.select(F.col("doc").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")
    roots = graph.components(common.arrow_map(two, lambda it: _similar(it, least), "u long, v long"))
    if large.limit(1).count():
        top = W.partitionBy("doc").orderBy(F.col("n").desc(), "bucket")  # a text is in GROUPS buckets at most
        largest = large.withColumn("r", F.row_number().over(top)).where("r = 1").drop("r")
        for some in (largest, large):
            more = _across(some, roots, sets, least)
            if more is not None:
                roots = graph.components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    return roots


def _across(members: DataFrame, roots: DataFrame, sets: DataFrame, least: float) -> DataFrame | None:
    """Links between the components (node, root) that share a bucket of ``members(doc, bucket)``, from all pairs across components.

    The rows outside a bucket's largest component (minor) lie in blocks 0 to k - 1, those of the largest (major) in blocks from k on. Each
    minor block meets each other block in a cell of bounded size, and itself in the cell with block k. Two major rows need no comparison.
    None if no bucket holds several components.
    """
    ship(members.sparkSession)
    sized = sets.select("doc", F.octet_length("shingles").cast("long").alias("size"))
    now = members.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc")).join(sized, "doc")
    now = common.materialize(now.select("doc", "bucket", "root", "size"), "near-now")
    parts = now.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    whole = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "root", "size")).alias("major"), F.sum("size").alias("size"))
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / F.lit(BLOCK))).cast("long")
    mixed = whole.where("parts > 1").select("bucket", "n", F.col("major.root").alias("major"), blocks(F.col("size") - F.col("major.size")).alias("k"), blocks(F.col("major.size")).alias("m"))
    mixed = common.materialize(mixed, "near-mixed")
    if not mixed.limit(1).count():
        return None
    rows = common.spread_join(now, mixed, "bucket", "n", now.count()).withColumn("h", F.xxhash64("doc", "bucket"))
    minor = F.col("root") != F.col("major")
    rows = rows.withColumn("block", F.when(minor, F.pmod("h", "k")).otherwise(F.col("k") + F.pmod("h", "m")))
    met = F.sequence(F.lit(0).cast("long"), F.when(minor, F.col("k") + F.col("m")).otherwise(F.col("k")) - 1)
    rows = rows.select("bucket", "doc", "root", "k", "block", F.explode(met).alias("other")).where("block <> other")
    cells = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "k", "block", "doc", "root").join(sets, "doc")
    cells = cells.select("bucket", "i", "j", "k", "block", "doc", "root", "shingles")
    return cells.groupBy("bucket", "i", "j").applyInArrow(lambda cell: _cell(cell, least), "u long, v long")


def _cell(cell: pa.Table, least: float) -> pa.Table:
    """Links that join components within one cell: each row of block i against those of block j, and of i where j is the first major one.

    Only rows that share one of their rarest shingles (as many as the similarity asks for) are compared, so texts of one template that differ
    in their own words are not, however many they are.
    """
    i, j, k = (cell.column(c)[0].as_py() for c in ("i", "j", "k"))
    block, doc, comp = (cell.column(c).to_numpy().copy() for c in ("block", "doc", "root"))
    sets = [np.frombuffer(x, np.uint64) for x in cell.column("shingles").to_pylist()]
    size = np.array([len(x) for x in sets])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(flat, np.cumsum(size)[:-1])
    mark = np.zeros(len(known), np.int32)
    target = np.ones(len(doc), bool) if j == k else block == j
    # of each set in the order of the rarest shingles of the cell first: two sets that similar share one of so many first ones
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((np.arange(len(known)), np.bincount(flat, minlength=len(known))))] = np.arange(len(known))
    owner = np.repeat(np.arange(len(doc)), size)
    by = np.lexsort((rank[flat], owner))
    first = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
    head = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(first, size)
    heads, holders = rank[flat[by]][head], owner[head]
    starts = np.cumsum(np.bincount(holders, minlength=len(doc))) - np.bincount(holders, minlength=len(doc))
    listed = np.argsort(heads, kind="stable")
    listed = listed[target[holders[listed]]]
    keys, rows_of = heads[listed], holders[listed]
    out = []
    for r in np.flatnonzero(block == i).tolist():
        own = heads[starts[r] : starts[r] + first[r]]
        lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        met = [rows_of[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a < b]
        near = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        # sets whose sizes are further apart cannot be that similar
        near = near[(comp[near] != comp[r]) & (size[near] >= least * size[r] - 1) & (size[near] * least <= size[r] + 1)]
        if not len(near):
            continue
        mark[sets[r]] = 1
        n = size[near]
        both = np.add.reduceat(mark[np.concatenate([sets[x] for x in near.tolist()])], np.cumsum(n) - n)
        mark[sets[r]] = 0
        for x in near[(both > 0) & (both >= least * (size[r] + n - both) - 1e-9)].tolist():
            if comp[x] != comp[r]:
                out.append((doc[r], doc[x]))
                comp[comp == comp[x]] = comp[r]
    e = np.array(out, np.int64).reshape(-1, 2)
    return pa.table([pa.array(np.ascontiguousarray(e[:, c])) for c in (0, 1)], schema=LINKS)


def print_links(texts: DataFrame, most: int = 2) -> DataFrame:
    """Links (u, v) between rows of ``texts(doc, text)``, doc unique, that span those of fingerprints of at most ``most`` differing bits,
    found by the covering as in ``near_duplicates``. Texts without words, whose fingerprint is zero, link to nothing."""
    prints = fingerprints(texts.select(F.col("doc").alias("doc_id"), "text")).where("fp <> 0")
    nodes = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "near-prints")
    of = lambda side: nodes.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_doc"))
    far = links(nodes.select("fp"), most).distinct().join(of("u"), "u").join(of("v"), "v").select(F.col("u_doc").alias("u"), F.col("v_doc").alias("v"))
    same = common.spread_join(prints, nodes, "fp", "n", prints.count()).where("doc_id <> first")
    return far.union(same.select(F.col("first").alias("u"), F.col("doc_id").alias("v")))


def near_rows(rows: DataFrame, width: int = 5, least: float = 0.8, most: int | None = None) -> DataFrame:
    """__r and root of those of ``rows(__r, doc_id, text)`` that are linked to another, and __r and doc_id of the row that stays for them.

    Linked by similarity and, if ``most`` is given, by fingerprints of at most so many differing bits as well. Of each group the row with
    the smallest doc_id stays (none is last; of equal ones that with the smallest number).
    """
    texts = rows.select(F.col("__r").alias("doc"), common.text_or_empty().cast("binary").alias("text"))
    roots = similar_groups(texts, width, least)
    if most is not None:
        roots = graph.components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(print_links(texts, most)))
    roots = common.materialize(roots.select(F.col("node").alias("__r"), "root"), "near-roots")
    named = roots.join(rows.select("__r", F.col("doc_id").cast("long").alias("id")), "__r")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__r")).alias("best")
    kept = named.groupBy("root").agg(best, F.count("*").alias("n")).select("root", F.col("best.id").alias("component_id"), F.col("best.__r").alias("keep"), "n")
    return common.spread_join(roots, common.materialize(kept, "near-kept"), "root", "n", roots.count()).select("__r", "component_id", (F.col("__r") == F.col("keep")).alias("kept"))


def near_groups(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, component_id and kept of the rows of ``docs(doc_id, text)`` that are linked to another; component_id is the smallest doc_id.

    Links join texts whose sets of ``width``-word shingles (A-Z lower-cased; fewer words: the whole text) are ``least`` similar. Texts
    without words (null, empty, blank) link to nothing; rows with equal doc_id, or none, are rows of their own (component_id is null
    where no row of the group has an id). One row of each group is kept, with the smallest doc_id.
    """
    rows = common.with_row(docs.select("doc_id", "text"))
    return near_rows(rows, width, least).join(rows.select("__r", "doc_id"), "__r").select(F.col("doc_id").cast("long"), "component_id", "kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
