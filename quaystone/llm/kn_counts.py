"""The Kneser-Ney model of any number of texts as count tables in shards, and the joins of documents' n-grams with them.

Counts of trigrams, pairs and words lie in one table by 64-bit key. Tasks ask for the distinct keys of a chunk of documents, sorted and packed
by shard; the shards answer by chunk into the shared folder, where the tasks that hold the documents read them. First pairs and words are
asked for, then those trigrams whose two pairs were counted. Neither texts nor the model are moved whole, and no task holds over a shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens of the documents that ask together, and entries of the tables that answer together.
CHUNK, SHARD = 1_000_000, 1_000_000
#: At most so many turns in which the documents' partitions ask, so that not all that is asked lies on disk at once.
TURNS = 4
CODEC = "zstd"
PARTS = "shard int, chunk long, mark long, n int, size long, body binary"
PART = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("size", pa.int64()), ("body", pa.binary())])
#: What a key has: times seen (a trigram) or words before it (a pair, a word); as a context the total of those after it, how many of them have
#: 1, 2 and more; words before it among the bad texts.
COLUMNS = ("seen", "total", "c1", "c2", "c3", "bad")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    # 56 bits: an eighth byte would be a fifth of what is sent
    return (x ^ (x >> np.uint64(32))) & np.uint64(0xFFFFFFFFFFFFFF00)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


def triple_keys(pair: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mixed(pair * np.uint64(0xC2B2AE3D27D4EB4F) + w)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys, so that parts in the order of shards are in the order of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _planes(columns: list[np.ndarray]) -> tuple[int, bytes]:
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return len(raw), pa.compress(raw, CODEC, asbytes=True) if raw else b""


def _columns(body: bytes, size: int, n: int, dtype) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(body, size, CODEC), np.uint8).reshape(-1, 8, n)
    return [np.ascontiguousarray(c.T).view(dtype).ravel() for c in raw]


def _sorted_parts(keys: np.ndarray, counts: list[np.ndarray], shards: int, chunk: int, mark: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys, as differences, with their counts: a row for each shard."""
    ends = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    for s in range(shards):
        a, b = ends[s], ends[s + 1]
        if a == b and chunk < 0:
            continue
        size, body = _planes([np.diff(keys[a:b], prepend=np.uint64(0)), *(c[a:b] for c in counts)])
        yield common.batch(PART, shard=[s], chunk=[chunk], mark=[mark], n=[b - a], size=[size], body=[body])


def _entries(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, w, counts), of which u and v may be null, as parts by key."""
    held, n = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        words = [np.concatenate([h[i] for h in held]) for i in range(3)]
        order = np.argsort(keys := _keys(*words))
        yield from _sorted_parts(keys[order], [np.concatenate([h[3 + i] for h in held])[order] for i in range(len(COLUMNS))], shards, -1, 0)

    for b in batches:
        cols = [b.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(b.num_columns)]
        held.append([c.view(np.uint64) if i < 3 else c for i, c in enumerate(cols)])
        n += b.num_rows
        if n >= SHARD:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def _keys(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of words (u and v are 0), pairs (u is 0) and trigrams."""
    pair = pair_keys(np.where(u > 0, u, v), np.where(u > 0, v, w))
    return np.where(v == 0, _mixed(w), np.where(u == 0, pair, triple_keys(pair, w)))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in the order of shards, each shard's counts before what asks for them: which keys it has and their counts."""
    shard, held, table = None, [], None
    for b in batches:
        for r in b.to_pylist():
            if r["shard"] != shard:
                shard, held, table = r["shard"], [], None
            if r["chunk"] < 0:
                got = _columns(r["body"], r["size"], r["n"], np.int64)
                held.append([np.cumsum(got[0].view(np.uint64)), *got[1:]])
                continue
            if table is None:
                table, held = _merged(held), []
            n, found = r["n"], []
            if n:
                keys = np.cumsum(_columns(r["body"], r["size"], n, np.uint64)[0])
                at = np.searchsorted(table[0], keys)
                at[at == len(table[0])] = 0
                hit = table[0][at] == keys if len(table[0]) else np.zeros(n, bool)
                found = [c[at[hit]] for c in table[1:]]
                some = int(hit.sum())
                size, body = _planes(found) if some else (0, b"")
                body = some.to_bytes(4, "little") + np.packbits(hit).tobytes() + body
            else:
                size, body = 0, bytes(4)
            yield common.batch(PART, shard=[r["shard"]], chunk=[r["chunk"]], mark=[r["mark"]], n=[n], size=[size], body=[body])


def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Keys once each, with the sums of their counts."""
    if not parts:
        return [np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in COLUMNS)]
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], *(np.add.reduceat(np.concatenate([p[1 + i] for p in parts])[order], first) for i in range(len(COLUMNS)))]


def _read(path: str, chunk: int, mark: int) -> list[np.ndarray]:
    """The counts of all keys that a chunk asked for, in their order; 0 where there is none."""
    if "://" in path:
        system, at = fs.FileSystem.from_uri(path)
    else:
        system, at = fs.LocalFileSystem(), path.removeprefix("file:")
    found = [f.path for f in system.get_file_info(fs.FileSelector(f"{at}/chunk={chunk}")) if f.path.endswith(".parquet")]
    rows = sorted((r for f in found for r in pq.ParquetFile(system.open_input_file(f)).read().to_pylist()), key=lambda r: r["shard"])
    if not rows or any(r["mark"] != mark for r in rows):
        raise RuntimeError("documents were dealt otherwise than when they asked for counts")
    out = [np.zeros(sum(r["n"] for r in rows), np.int64) for _ in COLUMNS]
    first = 0
    for r in rows:
        n, some = r["n"], int.from_bytes(r["body"][:4], "little")
        if some:
            bits = (n + 7) // 8
            hit = first + np.flatnonzero(np.unpackbits(np.frombuffer(r["body"], np.uint8, bits, 4), count=n))
            for c, got in zip(out, _columns(r["body"][4 + bits :], r["size"], some, np.int64), strict=True):
                c[hit] = got
        first += n
    return out


class Chunk:
    """Documents that ask together: their words as hashes, with two starts before and an end after each document."""

    def __init__(self, chunk: int, flat: np.ndarray, sizes: np.ndarray, start: int, end: int):
        self.chunk, self.sizes = chunk, sizes
        self.first = np.cumsum(sizes + 3) - sizes - 3
        self.ids = np.full(len(flat) + 3 * len(sizes), start, np.uint64)
        self.ids[self.first + sizes + 2] = end
        self.ids[np.arange(len(flat)) + np.repeat(3 * np.arange(len(sizes)) + 2, sizes)] = flat
        self.mark = zlib.crc32(self.ids.tobytes())
        self.pairs = pair_keys(self.ids[:-1], self.ids[1:])

    def _all(self) -> np.ndarray:
        return np.concatenate([_mixed(self.ids), self.pairs])

    def keys(self) -> np.ndarray:
        """Of words and pairs, once each, in order."""
        return np.unique(self._all())

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where among the keys the words and the pairs are."""
        at = np.unique(self._all(), return_inverse=True)[1]
        return at[: len(self.ids)], at[len(self.ids) :]

    def triples(self, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the trigrams that can have been counted, and their keys."""
        follows, context = held[0] > 0, held[1] > 0
        at = self.places[1]
        some = np.flatnonzero(context[at[:-1]] & follows[at[1:]])
        return some, triple_keys(self.pairs[some], self.ids[some + 2])

    def log10(self, model: dict, held: list[np.ndarray], third: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log10 P by document, and the largest ratio of the lowest orders of bad to trusted among its words."""
        word, pair = ([c[at] for c in held] for at in self.places)
        lowest = _lowest(model["one"], word[0])
        p = lowest[2:]
        p = _level(model["two"], pair[0][1:], [c[1:-1] for c in word], p)
        seen = np.zeros(len(p), np.int64)
        some, keys = self.triples(held)
        if len(some):
            seen[some] = third[0][np.unique(keys, return_inverse=True)[1]]
        logs = np.log10(_level(model["three"], seen, [c[:-1] for c in pair], p))
        for k in (2, 1):
            logs[self.first[1:] - k] = 0.0
        far = np.full(len(self.sizes), np.nan)
        full = np.flatnonzero(self.sizes)
        if model["bad"] and len(full):
            ratio = np.log10(_lowest(model["bad"], word[5])) - np.log10(lowest)
            # between a document's words and the next one's lie an end and two starts, which do not count
            at = np.stack([self.first[full] + 2, self.first[full] + 2 + self.sizes[full]], axis=1).ravel()
            far[full] = np.maximum.reduceat(ratio, at)[::2]
        return np.add.reduceat(logs, self.first), far


def _lowest(level: dict, seen: np.ndarray) -> np.ndarray:
    return np.maximum(seen - level["cut"][np.minimum(seen, 3)], 0) / level["total"] + level["floor"]


def _level(cut: np.ndarray, seen: np.ndarray, context: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
    total = context[1]
    rest = context[2] * cut[1] + context[3] * cut[2] + context[4] * cut[3]
    return np.where(total > 0, (seen - cut[np.minimum(seen, 3)] + rest * lower) / np.maximum(total, 1), lower)


def asked(batches: Iterator[pa.RecordBatch], of, shards: int, answered: str | None, turn: int, turns: int) -> Iterator[pa.RecordBatch]:
    """What a task's documents (``of(batches)``: their chunks) ask for in its turn: pairs and words, or trigrams by the folder of the ``answered`` ones."""
    if TaskContext.get().partitionId() % turns != turn:
        for _ in batches:
            pass
        return
    for c, _ in of(batches):
        keys = c.keys() if answered is None else np.unique(c.triples(_read(answered, c.chunk, c.mark))[1])
        yield from _sorted_parts(keys, [], shards, c.chunk, c.mark)


def chunks(batches: Iterator[pa.RecordBatch], text: int, hashed, split, start: int, end: int) -> Iterator[tuple[Chunk, list[pa.RecordBatch]]]:
    """Chunks of a task's documents with their rows. Where one ends depends on the documents alone, not on batches."""
    task, k = TaskContext.get().partitionId() << 24, 0
    cache: dict[bytes, int] = {}
    rows, flat, sizes, n = [], [], [], 0
    for b in batches:
        at = 0
        for i in range(b.num_rows):
            words = split(b.column(text)[i].as_py())
            new = [w for w in set(words) if w not in cache]
            if new:
                if len(cache) + len(new) > 500_000:
                    cache.clear()
                    new = list(set(words))
                cache.update(zip(new, hashed(new).tolist(), strict=True))
            flat.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
            sizes.append(len(words))
            n += len(words) + 3
            if n >= CHUNK:
                yield Chunk(task + k, np.concatenate(flat), np.array(sizes), start, end), [*rows, b.slice(at, i + 1 - at)]
                rows, flat, sizes, n, k, at = [], [], [], 0, k + 1, i + 1
        if at < b.num_rows:
            rows.append(b.slice(at))
    if sizes:
        yield Chunk(task + k, np.concatenate(flat), np.array(sizes), start, end), rows


class Tables:
    """Counts of trusted texts (``trigrams(u, v, w, n)``) and, for the lowest order, of bad ones, as parts by shard, with the discounts."""

    def __init__(self, trigrams: DataFrame, bad: DataFrame | None, discounts):
        zero = [F.lit(0).cast("long").alias(c) for c in COLUMNS]
        spark = trigrams.sparkSession

        def entries(rows: DataFrame, words: dict, **counts: Column) -> DataFrame:
            key = [words.get(c, F.lit(None)).cast("long").alias(c) for c in "uvw"]
            return rows.select(*key, *[counts[c].cast("long").alias(c) if c in counts else z for c, z in zip(COLUMNS, zero, strict=True)])

        def levels(x: str) -> list[Column]:
            return [F.sum(x).alias("total"), *(F.count_if(F.col(x) == k if k < 3 else F.col(x) >= 3).alias(f"c{k}") for k in (1, 2, 3))]

        def cuts(rows: DataFrame, x: str) -> np.ndarray:
            return discounts([int(n) for n in rows.agg(*[F.count_if(F.col(x) == k) for k in range(1, 5)]).first()])

        def lowest(pairs: DataFrame) -> tuple[DataFrame, dict]:
            """Words by the number of words before them."""
            one = common.materialize(pairs.groupBy("w").agg(F.count("*").alias("n")), "kn-words")
            cut = cuts(one, "n")
            n = one.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(~F.col("w").isin(1, 2)), *[F.count_if(F.col("n") == k if k < 3 else F.col("n") >= 3) for k in (1, 2, 3)]).first()
            total = max(1, n[0])
            return one, {"cut": cut, "total": total, "floor": (float(cut[1:] @ np.array(n[2:5])) / total if n[0] else 1.0) / (n[1] + 2)}

        pairs = common.materialize(trigrams.groupBy("v", "w").agg(F.count("*").alias("m")), "kn-pairs")
        common.release(spark)
        one, self.model = lowest(pairs)
        self.model = {"one": self.model, "two": cuts(pairs, "m"), "three": cuts(trigrams, "n"), "bad": None}
        context = {c: F.col(c) for c in ("total", "c1", "c2", "c3")}
        words = [F.col(c) for c in "uvw"]
        made = entries(trigrams, dict(zip("uvw", words, strict=True)), seen=F.col("n"))
        low = entries(pairs, {"v": words[1], "w": words[2]}, seen=F.col("m"))
        low = low.union(entries(trigrams.groupBy("u", "v").agg(*levels("n")), {"v": words[0], "w": words[1]}, **context))
        low = low.union(entries(pairs.groupBy("v").agg(*levels("m")), {"w": words[1]}, **context))
        low = low.union(entries(one, {"w": words[2]}, seen=F.col("n")))
        if bad is not None:
            one, self.model["bad"] = lowest(bad.select("v", "w").distinct())
            low = low.union(entries(one, {"w": words[2]}, bad=F.col("n")))
        n = trigrams.count()
        # a pair comes from a trigram and a word from a pair: each table has at most two entries for each trigram
        self.shards = max(1, common.partitions(spark), n // SHARD)
        shards = self.shards
        self.parts = []
        for name, table in (("kn-low", low), ("kn-high", made)):
            self.parts.append(common.materialize(common.arrow_map(table, lambda it: _entries(it, shards), PARTS), name, "none"))
            common.release(spark)
        common.drop(spark, pairs.scratch_path, trigrams.scratch_path)
        self.turns = min(TURNS, 1 + n // (2 * SHARD))

    def answers(self, level: int, asks) -> str:
        """Answers by chunk to what ``asks(turn)`` asks of level 0 (pairs and words) or 1 (trigrams): a folder."""
        path = common.scratch(self.parts[level].sparkSession, "kn-answers")
        for turn in range(self.turns):
            self._answered(level, asks(turn), path)
        common.drop(self.parts[level].sparkSession, self.parts[level].scratch_path)
        return path

    def _answered(self, level: int, asked: DataFrame, path: str) -> None:
        spark = asked.sparkSession
        # what asks comes first in the union, so that its partitions keep the numbers that chunks are named by
        met = asked.union(self.parts[level]).repartition(self.shards, "shard").sortWithinPartitions("shard", "chunk")
        found = common.arrow_map(met, _answers, PARTS).repartition(common.partitions(spark), "chunk")
        found.write.mode("append").option("compression", "none").partitionBy("chunk").parquet(path)
        common.release(spark)
