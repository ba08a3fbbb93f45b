"""Hard negatives by vantage-point trees over norm-augmented vectors.

A further component sqrt(M^2 - |x|^2) gives all rows the norm M, the largest; for an anchor q, whose own is 0, the squared distance to a row
is |q|^2 + M^2 - 2 <q, x>. So the row of the next lower score is the next farther one, and a window of scores is an annulus of distances.

Rows are dealt by the cells of a vantage-point tree over a bounded sample and written in cells. A task builds a tree over each block of a
cell, and goes through its leaves for all queries at once, each query's nearest leaf first: a leaf is visited only if its distances to the
vantage points let it meet the query's annulus, and a query is done when its next leaf lies beyond the annulus or its k-th best row.
Distances only choose leaves; scores are compared exactly, as integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .vector_codes import SCALE, integers, matrix, usable

#: Rows that the dealing tree is built from; about as many rows of a cell, most rows of a block's tree and of its leaf, rows of a task.
SAMPLE, CELL_ROWS, BLOCK_ROWS, LEAF_ROWS, TASK_ROWS = 4096, 8192, 8192, 128, 65_536
#: About as many anchors go to all tasks at once; queries that a task handles together.
ANCHORS, TOGETHER = 32_768, 4096
POSITIVES, NEGATIVES = 5, 5
#: Scores are whole numbers below this, so that doubles hold them exactly.
EXACT = 1 << 53

CELLS = pa.schema([("cell", pa.int32()), ("deal", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary())])
FOUND = pa.schema([("q", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Space:
    """Dimensions, and the largest squared norm."""

    dims: int
    square: int

    def augmented(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(np.float64)
        return np.column_stack([rows, np.sqrt(np.maximum(self.square - (rows**2).sum(1), 0))])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.square - 2 * (a @ b.T), 0))

    @property
    def slack(self) -> float:
        """More than rounding can add to a distance."""
        return 1e-6 * math.sqrt(self.square) + 1e-6


@dataclass
class Queries:
    """Queries of one kind: each asks for the k best rows of the same (or another) label with lo <= score <= hi; ``floor``: a score that k rows reach."""

    vectors: np.ndarray
    of: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    floor: np.ndarray
    same: bool
    k: int

    def __len__(self) -> int:
        return len(self.of)


class Tree:
    """Vantage-point tree of a block, as its leaves and their least and greatest distances to every vantage point."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, space: Space, leaf: int = LEAF_ROWS):
        points = space.augmented(rows)
        leaves: list[np.ndarray] = []
        chosen: list[int] = []

        def split(members: np.ndarray) -> None:
            if len(members) <= leaf:
                leaves.append(members)
                return
            chosen.append(members[0])
            far = space.between(points[members], points[members[:1]])[:, 0]
            inside = far <= np.median(far)
            if inside.all():  # as many equal points
                leaves.extend(members[i : i + leaf] for i in range(0, len(members), leaf))
            else:
                split(members[inside])
                split(members[~inside])

        split(np.arange(len(ids)))
        chosen = chosen or [0]
        self.space, self.vantage = space, rows[chosen].astype(np.float64)
        far = space.between(points, points[chosen])
        self.near = np.stack([far[m].min(0) for m in leaves])
        self.far = np.stack([far[m].max(0) for m in leaves])
        # within a leaf by id, so that a stable sort by score breaks ties by id
        self.leaves = [(ids[m], labels[m], rows[m].T.astype(np.float64)) for m in (m[np.argsort(ids[m], kind="stable")] for m in leaves)]

    def search(self, q: Queries, best: Best, some: np.ndarray) -> None:
        """Take the rows of this tree into the best of the queries ``some``."""
        space, hair = self.space, self.space.slack
        vectors = q.vectors[q.of[some]]
        reach = (vectors**2).sum(1) + space.square
        at = lambda score, who: np.sqrt(np.maximum(reach[who] - 2 * score, 0))
        every = np.arange(len(some))
        inner, outer = at(q.hi[some], every) - hair, at(q.lo[some], every) + hair
        far = np.sqrt(np.maximum(reach[:, None] - 2 * (vectors @ self.vantage.T), 0))
        least, most = np.zeros((len(some), len(self.leaves))), np.full((len(some), len(self.leaves)), np.inf)
        for v in range(len(self.vantage)):
            d = far[:, v : v + 1]
            np.maximum(least, np.maximum(d - self.far[:, v], self.near[:, v] - d), out=least)
            np.minimum(most, d + self.far[:, v], out=most)
        order = np.argsort(least, axis=1, kind="stable")
        who = every[(q.lo[some] <= q.hi[some])]
        for turn in range(len(self.leaves)):
            leaf = order[who, turn]
            limit = np.minimum(outer[who], at(best.bar(some[who]), who) + hair)
            going = least[who, leaf] <= limit
            who, leaf = who[going], leaf[going]
            if not len(who):
                return
            meets = most[who, leaf] >= inner[who]
            visit, leaf = who[meets], leaf[meets]
            by = np.argsort(leaf, kind="stable")
            visit, leaf = visit[by], leaf[by]
            cuts = np.flatnonzero(np.diff(leaf)) + 1
            for group, n in zip(np.split(visit, cuts), leaf[[0, *cuts]] if len(leaf) else [], strict=False):
                ids, labels, columns = self.leaves[n]
                asked = some[group]
                scores = vectors[group] @ columns
                mine = (labels == q.labels[asked][:, None]) == q.same
                mine &= (scores >= np.maximum(q.lo[asked], best.bar(asked))[:, None]) & (scores <= q.hi[asked][:, None]) & (ids != q.ids[asked][:, None])
                some_found = mine.any(1)
                if some_found.any():
                    best.take(asked[some_found], np.where(mine, scores, -np.inf)[some_found], ids)


class Best:
    """The k best rows of each query so far, in order of score and id."""

    def __init__(self, q: Queries):
        self.floor = q.floor
        self.scores = np.full((len(q), q.k), -np.inf)
        self.ids = np.full((len(q), q.k), np.iinfo(np.int64).max)

    def bar(self, some: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[some, -1], self.floor[some])

    def take(self, some: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        scores = np.hstack([self.scores[some], np.take_along_axis(scores, first, 1)])
        both = np.hstack([self.ids[some], ids[first]])
        by = np.lexsort((both, -scores), axis=1)[:, :k]
        self.scores[some], self.ids[some] = np.take_along_axis(scores, by, 1), np.take_along_axis(both, by, 1)

    def rows(self) -> Iterator[pa.RecordBatch]:
        who, place = np.nonzero(np.isfinite(self.scores))
        for i in range(0, len(who), 65_536):
            w, p = who[i : i + 65_536], place[i : i + 65_536]
            yield common.batch(FOUND, q=w.astype(np.int32), vec_id=self.ids[w, p], score=self.scores[w, p].astype(np.int64))


def _chunks(n: int, size: int) -> Iterator[np.ndarray]:
    for i in range(0, n, size):
        yield np.arange(i, min(i + size, n))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, rows) of at most BLOCK_ROWS rows that lie together in one cell."""
    held: list[pa.RecordBatch] = []
    size, cell = 0, None

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held)
        rows = np.frombuffer(b"".join(t.column("v").to_pylist()), np.int32).reshape(-1, dims)
        return t.column("vec_id").to_numpy(), t.column("label").to_numpy(), rows

    for b in batches:
        cells = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            while lo < hi:
                if held and (cells[lo] != cell or size == BLOCK_ROWS):
                    yield made()
                    held, size = [], 0
                cell, n = cells[lo], min(hi - lo, BLOCK_ROWS - size)
                held.append(b.slice(lo, n))
                size, lo = size + n, lo + n
    if held:
        yield made()


def _search(batches: Iterator[pa.RecordBatch], q: Queries, space: Space) -> Iterator[pa.RecordBatch]:
    best = Best(q)
    for ids, labels, rows in _blocks(batches, space.dims):
        tree = Tree(ids, labels, rows, space)
        for some in _chunks(len(q), TOGETHER):
            tree.search(q, best, some)
    yield from best.rows()


def _reached(batches: Iterator[pa.RecordBatch], q: Queries, sample: tuple, space: Space) -> Iterator[pa.RecordBatch]:
    """The k-th score among the sample's rows, of the queries that a task is given."""
    tree = None
    for b in batches:
        tree = tree or Tree(*sample, space)
        best, some = Best(q), b.column(0).to_numpy()
        for part in np.array_split(some, -(-len(some) // TOGETHER) or 1):
            tree.search(q, best, part)
        full = some[np.isfinite(best.scores[some, -1])]
        yield common.batch(FOUND, q=full.astype(np.int32), vec_id=best.ids[full, -1], score=best.scores[full, -1].astype(np.int64))


class Dealer:
    """The tree over the sample that deals rows to cells, and how many shares each cell is cut into."""

    def __init__(self, sample: np.ndarray, space: Space, rows: int):
        self.space, self.nodes, self.shares = space, [], []
        points = space.augmented(sample)
        each = rows / max(1, len(sample))

        def split(members: np.ndarray) -> int:
            far = space.between(points[members], points[members[:1]])[:, 0] if len(members) else np.zeros(0)
            inside = far <= np.median(far) if len(far) else far < 0
            if len(members) * each <= CELL_ROWS or len(members) < 8 or inside.all():
                self.shares.append(max(1, math.ceil(len(members) * each / TASK_ROWS)))
                return ~(len(self.shares) - 1)
            self.nodes.append(None)
            me = len(self.nodes) - 1
            self.nodes[me] = (points[members[0]], float(np.median(far)), split(members[inside]), split(members[~inside]))
            return me

        self.root = split(np.arange(len(sample)))

    def cells(self, rows: np.ndarray) -> np.ndarray:
        points, out = self.space.augmented(rows), np.zeros(len(rows), np.int32)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, who = todo.pop()
            if node < 0:
                out[who] = ~node
            elif len(who):
                vantage, radius, inside, outside = self.nodes[node]
                near = self.space.between(points[who], vantage[None])[:, 0] <= radius
                todo += [(inside, who[near]), (outside, who[~near])]
        return out


def _deal(batches: Iterator[pa.RecordBatch], dealer: Dealer) -> Iterator[pa.RecordBatch]:
    shares = np.array(dealer.shares)
    for b in batches:
        if len(b):
            rows, ids = matrix(b.column(2), dealer.space.dims), b.column(0).to_numpy()
            cells = dealer.cells(rows)
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield common.batch(CELLS, cell=cells, deal=(mixed % shares[cells].astype(np.uint64)).astype(np.int32), vec_id=ids, label=b.column(1), v=[r.tobytes() for r in rows.astype(np.int32)])


def _asked(rows: DataFrame, q: Queries, sample: tuple, space: Space) -> DataFrame:
    """(q, vec_id, score, rank): the k best rows of each query."""
    spark = rows.sparkSession
    tasks = max(1, min(common.partitions(spark), len(q) // 1024))
    reached = common.arrow_map(spark.range(0, len(q), 1, tasks), lambda it: _reached(it, q, sample, space), "q int, vec_id long, score long").toArrow()
    q.floor[reached.column("q").to_numpy()] = reached.column("score").to_numpy()
    found = common.arrow_map(rows.select("cell", "vec_id", "label", "v"), lambda it: _search(it, q, space), "q int, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= q.k)


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 80, high: int = 100, scale: int = SCALE) -> DataFrame:
    """Hard negatives of ``vectors(vec_id, embedding, label)`` for the rows where ``anchor`` (over vec_id) holds.

    Components become floor(scale * x), a score is their inner product. An anchor's positives are its best rows of the same label; for each,
    the negatives are the best rows of another label with low * positive_score <= 100 * score <= high * positive_score. Ties go to the smaller
    vec_id. Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows whose vec_id or label (a whole number) is null, whose vector is null or empty, has a null or non-finite component, or another number of
    dimensions than the row of the smallest vec_id, take no part. Of rows of one vec_id that of the smallest label, then smallest components,
    counts. Components saturate where the squares of a vector could add up to 2^53. Equal vectors are cut into blocks like any others. Other
    columns are ignored; an empty table, one label or one row gives no rows.

    ``ANCHORS`` anchors with their positives go through the driver at a time and meet all rows; rows never do.
    """
    spark = vectors.sparkSession
    common.bound_batches(spark)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("vec_id is not null and label is not null").where(usable(F.col("embedding")))
    first = kept.orderBy("vec_id", "label", F.size("embedding")).select(F.size("embedding").alias("n")).first()
    dims = first.n if first else 0
    largest = min(1 << 26, math.isqrt((EXACT - 1) // max(1, dims)))
    kept = kept.where(F.size("embedding") == dims).select("vec_id", "label", integers(F.col("embedding"), scale, largest).alias("v"))
    if kept.groupBy("vec_id").count().where("count > 1").limit(1).count():
        kept = common.materialize(kept.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v"), "vectors")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    total, square = kept.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0))).first()
    space = Space(dims, square)
    drawn = common.sample_by_hash(kept, SAMPLE, ["vec_id"], total).toArrow().combine_chunks()
    sample = (drawn.column("vec_id").to_numpy(), drawn.column("label").to_numpy(), matrix(drawn.column("v").combine_chunks(), dims)) if len(drawn) else (np.zeros(0, np.int64),) * 2 + (np.zeros((0, dims), np.int64),)
    dealer = Dealer(sample[2], space, total)
    rows = common.arrow_map(kept.select("vec_id", "label", "v"), lambda it: _deal(it, dealer), "cell int, deal int, vec_id long, label long, v binary")
    rows = common.materialize(rows.repartition("cell", "deal").sortWithinPartitions("cell"), "vector-cells")
    anchors = rows.where(anchor)
    blocks = -(-anchors.count() // ANCHORS)
    results: list[DataFrame] = []
    for block in range(blocks):
        got = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).select("vec_id", "label", "v").toArrow()
        ids, labels = got.column("vec_id").to_numpy(), got.column("label").to_numpy()
        values = np.frombuffer(b"".join(got.column("v").to_pylist()), np.int32).reshape(len(ids), dims).astype(np.float64)
        wide = np.full(len(ids), float(EXACT))
        near = Queries(values, np.arange(len(ids)), ids, labels, -wide, wide, -wide - 1, True, positives)
        pairs = _asked(rows, near, sample, space).orderBy("q", "rank").toArrow()
        of, score = pairs.column("q").to_numpy(), pairs.column("score").to_numpy()
        windows = Queries(values, of, ids[of], labels[of], np.array([-((-low * int(s)) // 100) for s in score], np.float64), np.array([high * int(s) // 100 for s in score], np.float64), np.full(len(of), -float(EXACT) - 1), False, negatives)
        named = pa.table({"q": pa.array(np.arange(len(of)), pa.int32()), "anchor_id": ids[of], "positive_id": pairs.column("vec_id"), "positive_score": score})
        # at most ANCHORS times the number of positives
        found = _asked(rows, windows, sample, space).join(F.broadcast(spark.createDataFrame(named)), "q")
        found = found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        results.append(common.materialize(found, "hard-negatives"))
    common.drop(spark, rows.scratch_path)
    if not results:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(results[0].schema).parquet(*[r.scratch_path for r in results])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    changed = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.expr("(label + 1) % 10")).otherwise(F.col("label")))
    return mine(changed, F.col("vec_id") % 100 == 0)


SQL = """WITH k AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS MATERIALIZED (SELECT a.vec_id AS a, r.vec_id AS id, r.label = a.label AS same, list_dot_product(a.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS score
 FROM k a JOIN k r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
 p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5),
 n AS (SELECT p.a AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.id ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
 SELECT * FROM n WHERE rank <= 5"""
