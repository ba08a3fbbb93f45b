"""Codes of vectors by one codebook for each part, the nearest entry found by annular norm pruning.

A codebook's entries lie sorted by norm. No entry whose norm differs from a part's by more than the best distance so far can be nearer, so
the search starts at the entry of the next norm, walks outwards on both sides, and a binary search over the norms cuts off, inclusively,
what lies outside the annulus that the best distance allows; what is inside is compared exactly, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components saturate here, so that squares and their sums stay within 64 bits.
LARGEST = 1 << 26

SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def integers(vector: Column, scale: int = SCALE, largest: int = LARGEST) -> Column:
    """floor(scale * x) of each component as a double, saturated at ``largest`` either way."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(1e15)), F.lit(-1e15))), F.lit(-largest)), F.lit(largest)).cast("int"))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims) if dims else np.zeros((len(column), 0), np.int64)


def cut(rows: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """(row, part, place): vectors in equal parts; zeros fill up a dimension that is no multiple of their number."""
    n, dims = rows.shape
    width = -(-dims // parts)
    return np.pad(rows, ((0, 0), (0, width * parts - dims))).reshape(n, parts, width)


class Book:
    """One part's codebook, its entries sorted by norm."""

    def __init__(self, entries: np.ndarray):
        squares = (entries.astype(np.int64) ** 2).sum(1)
        self.order = np.lexsort((np.arange(len(entries)), squares))
        self.entries = entries[self.order]
        self.norms = np.sqrt(squares[self.order].astype(np.float64))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point: index of the nearest entry, ties to the lower one, and its squared distance."""
        norms = np.sqrt((points**2).sum(1).astype(np.float64))
        seed = np.clip(np.searchsorted(self.norms, norms), 0, len(self.norms) - 1)
        best = ((points - self.entries[seed]) ** 2).sum(1)
        at = self.order[seed]
        for step in (-1, 1):
            who, place = np.arange(len(points)), seed + step
            while True:
                # the bound that the best distance so far allows, by binary search; a hair wider than rounding can be off
                reach = np.sqrt(best[who].astype(np.float64)) * (1 + 1e-12) + 1e-6 + norms[who] * 1e-12
                if step < 0:
                    inside = place >= np.searchsorted(self.norms, norms[who] - reach, "left")
                else:
                    inside = place < np.searchsorted(self.norms, norms[who] + reach, "right")
                inside &= (place >= 0) & (place < len(self.norms))
                who, place = who[inside], place[inside]
                if not len(who):
                    break
                far = ((points[who] - self.entries[place]) ** 2).sum(1)
                index = self.order[place]
                won = (far < best[who]) | ((far == best[who]) & (index < at[who]))
                best[who[won]], at[who[won]] = far[won], index[won]
                place = place + step
        return at, best


def _assigned(rows: np.ndarray, books: list[Book]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(points, indexes, squared distances) part by part."""
    pieces = cut(rows, len(books))
    for p, book in enumerate(books):
        yield (points := pieces[:, p, :]), *book.nearest(points)


def _totals(batches: Iterator[pa.RecordBatch], books: np.ndarray, dims: int) -> Iterator[pa.RecordBatch]:
    """A task's sums for each entry of each part."""
    parts, entries, _ = books.shape
    made, n, sums = [Book(b) for b in books], np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
    for b in batches:
        for p, (points, at, _) in enumerate(_assigned(matrix(b.column(0), dims), made)):
            n[p] += np.bincount(at, minlength=entries)
            np.add.at(sums[p], at, points)
    where = np.argwhere(n)
    yield common.batch(SUMS, part=where[:, 0], entry=where[:, 1], n=n[n > 0], sums=sums[n > 0].tolist())


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray, dims: int) -> Iterator[pa.RecordBatch]:
    made = [Book(b) for b in books]
    for b in batches:
        if len(b):
            found = [(at, far) for _, at, far in _assigned(matrix(b.column(2), dims), made)]
            codes = np.stack([at for at, _ in found], 1).astype(np.uint8)
            yield common.batch(CODED, vec_id=b.column(0), label=b.column(1), code=[c.tobytes().hex() for c in codes], error=np.sum([far for _, far in found], 0))


def fit(rows: DataFrame, first: np.ndarray, dims: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) after ``rounds`` of assigning all rows' parts and taking floored means; ``first`` are the ones to begin with.

    A round is one pass; tasks hand on one sum for each entry. The codebooks, as many numbers as entries times components, come to the driver.
    """
    books = first
    for _ in range(rounds):
        now = books
        parts = common.arrow_map(rows.select("v"), lambda it, now=now: _totals(it, now, dims), "part int, entry int, n long, sums array<long>")
        places = parts.select("part", "entry", "n", F.posexplode("sums").alias("place", "x"))
        means = places.groupBy("part", "entry", "place").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        books = books.copy()
        for r in means.collect():
            books[r.part, r.entry, r.place] = r.x // r.n
    return books


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of ``vectors(vec_id, embedding, label)``: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or empty or has a null or non-finite component take no part, nor do rows of another number of dimensions than the row of
    the smallest vec_id. Components saturate at 2^26 after scaling. Codebooks begin with the rows of the smallest vec_ids (null last; rows
    of one vec_id by their components); with fewer rows than entries they are that small. Repeated rows and null vec_ids are rows like any
    other. Equal labels' errors are summed, null labels' together; a frequent label's rows are dealt over several tasks. Other columns are
    ignored; an empty table gives no rows.
    """
    kept = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), integers(F.col("embedding")).alias("v"))
    ids = [r.vec_id for r in kept.select("vec_id").orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    low = kept.where(F.col("vec_id") <= ids[-1]) if ids and ids[-1] is not None else kept
    head = low.orderBy(F.col("vec_id").asc_nulls_last(), "v").first()
    dims = len(head.v) if head else 0
    kept, low = kept.where(F.size("v") == dims), low.where(F.size("v") == dims)
    top = low.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if head and len(top) < entries:  # among the smallest were rows of another number of dimensions
        top = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    first = cut(np.array([r.v for r in top], np.int64).reshape(len(top), dims), parts).transpose(1, 0, 2)
    books = fit(kept, first, dims, rounds) if top else first
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = common.arrow_map(kept.select("vec_id", "label", "v"), lambda it: _coded(it, books, dims), "vec_id long, label string, code string, error long")
    coded = common.materialize(coded.withColumn("group", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))), "vector-codes")
    sums = coded.groupBy("group").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    joined = common.spread_join(coded, sums, "group", "n", coded.count())
    return joined.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def _sql() -> str:
    near = lambda name, source: f"""{name} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, arg_min(e, d * 1000 + e) AS e, min(d) AS d FROM (SELECT r.vec_id, r.label, r.p, r.x, b.e,
 list_sum([((r.x[i] - b.c[i]) * (r.x[i] - b.c[i]))::BIGINT for i in range(1, len(r.x) + 1)])::BIGINT AS d FROM r JOIN {source} b USING (p)) GROUP BY vec_id, p)"""  # noqa: E731
    mean = lambda name, source, assigned: f"""{name} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {source} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS c FROM
 (SELECT p, e, i, (s - ((s % n) + n) % n) // n AS c FROM (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*)::BIGINT AS n FROM {assigned}, unnest(range(1, len(x) + 1)) t(i) GROUP BY p, e, i)) GROUP BY p, e) m USING (p, e))"""  # noqa: E731
    return f"""WITH k AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 r AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM k, unnest(range({PARTS})) t(p)),
 b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM r QUALIFY e < {ENTRIES}),
 {near("a0", "b0")}, {mean("b1", "b0", "a0")}, {near("a1", "b1")}, {mean("b2", "b1", "a1")}, {near("a2", "b2")},
 c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
 SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
 (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM c"""


SQL = _sql()
