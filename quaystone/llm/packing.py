"""Packing token sequences by shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, tokens

SEQUENCE = 1024
#: About as many pieces are ranked by one window; more blocks, not longer ones, as the table grows.
BLOCK_ROWS = 20_000
END = b"\0\0\0\0"
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def cut(batches: Iterator[pa.RecordBatch], path: str, most: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each document's ids (with the end id): full sequences, then what is left."""
    enc = tokens.encoder(path)
    for b in batches:
        out: list[tuple] = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = memoryview(enc.encode(text) + END)
            n = len(ids) // 4
            out += [(doc, at, min(most, n - at), zlib.crc32(ids[4 * at : 4 * (at + most)]), n) for at in range(0, n, most)]
        if out:
            yield common.batch(PIECE, **dict(zip(PIECE.names, zip(*out), strict=True)))


def spf_patterns(counts: dict[int, int], most: int) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first: lengths, longest first, each into the packs with the most room left; (count, lengths) of each packing pattern.

    Work and result are bounded by the number of lengths, not of pieces: all packs of one pattern are handled as one number.
    """
    room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(most + 1)]
    widest = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while widest and not room[widest]:
                widest -= 1
            if widest < length:
                room[most - length].append((left, (length,)))
                widest = max(widest, most - length)
                break
            n, pattern = room[widest].pop()
            used = min(n, left)
            if used < n:
                room[widest].append((n - used, pattern))
            room[widest - length].append((used, (*pattern, length)))
            left -= used
    merged: dict[tuple[int, ...], int] = {}
    for packs in room:
        for n, pattern in packs:
            merged[pattern] = merged.get(pattern, 0) + n
    return sorted(((n, p) for p, n in merged.items()), key=lambda x: x[1], reverse=True)


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, past the last rank, first sequence, offset, used): the pieces of a length, by rank, go to these places."""
    out, taken, first = [], {}, 0
    for n, pattern in patterns:
        offset = 0
        for length in pattern:
            lo = taken.get(length, 0)
            taken[length] = lo + n
            out.append((length, lo, lo + n, first, offset, sum(pattern)))
            offset += length
        first += n
    return out


def pack(docs: DataFrame, path: str | None = None, most: int = SEQUENCE) -> DataFrame:
    """Pack the texts of ``docs(doc_id, text)`` into sequences of at most ``most`` tokens; one row for each piece.

    Null text counts as empty (one piece of the end id alone); null and repeated doc_ids are documents like any other; other columns are
    ignored; an empty table gives no rows. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.
    """
    spark = docs.sparkSession
    path = path or tokens.default_path()
    rows = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    pieces = common.arrow_map(rows, lambda it: cut(it, path, most), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    # numbered where they are written, before the numbers are used: equal rows are pieces of their own and spread over the blocks
    pieces = common.materialize(pieces.withColumn("piece", F.monotonically_increasing_id()), "pack-pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    blocks = max(1, -(-sum(counts.values()) // BLOCK_ROWS))
    table = slots(spf_patterns(counts, most))
    places = spark.createDataFrame(table, "length long, lo long, hi long, first long, offset long, sequence_tokens long")
    # the rank of a piece among those of its length: a rank within a block of rows, after the blocks before; no window holds a whole length
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("piece"), F.lit(blocks)))
    before = dealt.groupBy("length", "block").count()
    before = before.select("length", "block", (F.sum("count").over(W.partitionBy("length").orderBy("block")) - F.col("count")).alias("before"))
    rank = F.row_number().over(W.partitionBy("length", "block").orderBy("piece")) - 1
    ranked = dealt.withColumn("rank", rank).join(before, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("before"))
    # at most a few entries for each of at most `most` lengths
    placed = ranked.join(F.broadcast(places) if len(table) <= common.BROADCAST_ROWS else places, "length").where("rank >= lo and rank < hi")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", "sequence_tokens")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
