"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

Words are clustered by 2^22 hash units (nearly one word each, until there are millions), so that the class table has a fixed size at any
corpus. The exchange is the predictive one, in its published distributed form: a unit's profile counts the classes that follow its words;
each sweep moves every unit to the class under whose transitions its profile is likeliest. After each round of sweeps the likelihood of the
whole class model is taken anew, and a round that lowers it is taken back. P(w | v) = P(class w | class v) P(w | class w); emissions are
discounted by counts of counts, and just what that frees goes to unknown words.

Word counts stay distributed: texts are coded in chunks, each with its own list of distinct words. The most frequent words' counts, FREQUENT
of them at most, are broadcast; the other words of each list are joined with the counts. What the driver and a broadcast hold is
bounded by that number and by the class table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Documents with this remainder of crc32(doc_id as text) modulo FOLDS are held out.
FOLDS, HELD = 7, 2
UNITS, CLASSES = 1 << 22, 32
SEED = 42
#: Re-profilings, and sweeps over the profiles after each.
ROUNDS, SWEEPS = 2, 4
KAPPA = 2.0
BLOCK = 1 << 12
FLUSH = 2_000_000
#: A chunk of coded texts has about so many tokens (a longer text is a chunk of its own).
CHUNK = 1_000_000
#: At most so many of the most frequent words are broadcast with their counts (16 bytes each), whatever the corpus.
FREQUENT = 1 << 20
SHARDS = 16
END = b"\n"  # no word holds white space

#: A chunk: its distinct words (with spaces between) and how often its training texts have each; its texts' ids, whether they are held out,
#: their lengths in tokens, and their tokens as numbers of those words. Long lists are bytes, which the JVM passes on as they are.
TEXTS = [("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary())]
TEXTS_DDL = "ids array<long>, held array<boolean>, sizes array<int>, tokens binary"
CHUNKS = pa.schema([("chunk", pa.int64()), ("words", pa.binary()), ("train", pa.binary()), *TEXTS])
CHUNKS_DDL = f"chunk long, words binary, train binary, {TEXTS_DDL}"
#: A coded chunk has the units and training counts of its words instead.
CODED = pa.schema([*TEXTS, ("units", pa.binary()), ("counts", pa.binary())])
CODED_DDL = f"{TEXTS_DDL}, units binary, counts binary"
FIRST = pa.schema([("chunk", pa.int64()), *CODED])
FIRST_DDL = f"chunk long, {CODED_DDL}"
RARE = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("word", pa.binary())])
COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
PAIRS = pa.schema([("block", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])
PROFILE = pa.schema([("unit", pa.int32()), ("profile", pa.list_(pa.int64()))])
TOTALS = pa.schema([("cell", pa.int32()), ("n", pa.float64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def unit_of(h: np.ndarray, units: int) -> np.ndarray:
    return (h >> np.uint64(17) & np.uint64(units - 1)).astype(np.int32)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh64_digest(w, SEED) for w in words]), ">u8").astype(np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as chunks of about CHUNK tokens; each token, the end included, is the number of a word in its chunk's list."""
    for b in batches:
        ids, out = b.column(0).to_pylist(), b.column(1).to_pylist()
        at = 0
        while at < len(out):
            number: dict[bytes, int] = {}
            parts, size, first = [], 0, at
            while at < len(out) and size < CHUNK:
                words = [*b.column(2)[at].as_py().lower().split(), END]
                parts.append(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
                size += len(words)
                at += 1
            some = [p for p, h in zip(parts, out[first:at], strict=True) if not h]
            train = np.bincount(np.concatenate(some), minlength=len(number)) if some else np.zeros(len(number), np.int64)
            yield common.batch(CHUNKS, chunk=[0], words=[b" ".join(number)], train=[train.astype(np.int64).tobytes()], ids=[ids[first:at]], held=[out[first:at]], sizes=[[len(p) for p in parts]], tokens=[np.concatenate(parts).tobytes()])


def chunked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of ``docs(doc_id, held_out, text binary)``, and the counts of their training words: word, n."""
    chunks = common.arrow_map(docs, _chunks, CHUNKS_DDL).withColumn("chunk", F.monotonically_increasing_id())
    chunks = common.materialize(chunks, "brown-chunks")  # written before the numbers are used
    words = common.arrow_map(chunks.select("words", "train"), _words, "word binary, n long")
    return chunks, common.materialize(words.groupBy("word").agg(F.sum("n").alias("n")), "brown-counts")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of training texts and their counts in a chunk."""
    for b in batches:
        for words, train in zip(b.column(0), b.column(1), strict=True):
            n = np.frombuffer(train.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.as_py().split(b" "), pa.binary()), pa.array(n)], schema=COUNTS).filter(pa.array(n > 0))


class Vocabulary:
    """Counts of the most frequent training words by 64-bit hash, as sorted arrays."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        order = np.argsort(h)
        self.h, self.n = h[order], n[order]

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Counts, and zero for words that are not in it."""
        if not len(self.h):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.n[at], 0)


def _frequent(counts: DataFrame, most: int) -> tuple[int, Vocabulary]:
    """The least power of two which at most ``most`` words reach, and the counts of those words."""
    size = {r["p"]: r["n"] for r in counts.where("n > 0").groupBy(F.length(F.bin("n")).alias("p")).agg(F.count("*").alias("n")).collect()}
    power = max(size, default=0) + 1
    while power > 1 and sum(n for p, n in size.items() if p >= power - 1) <= most:
        power -= 1
    least, h = 1 << (power - 1), F.xxhash64(F.col("word"))
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for k in range(SHARDS):  # a shard at a time, so that the driver holds little more than the two arrays
        part = counts.where(F.col("n") >= least).where(F.pmod(h, F.lit(SHARDS)) == k).select(h.alias("h"), "n").toArrow()
        parts.append((part.column("h").to_numpy().view(np.uint64), part.column("n").to_numpy()))
    return least, Vocabulary(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _rare(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """The words of each chunk that are not among the frequent ones."""
    for b in batches:
        for chunk, joined in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = joined.split(b" ")
            at = np.flatnonzero(held.value.counts(hashes(words)) == 0)
            yield common.batch(RARE, chunk=np.full(len(at), chunk), at=at.astype(np.int32), word=[words[i] for i in at.tolist()])


def encode(chunks: DataFrame, counts: DataFrame, units: int) -> DataFrame:
    """The chunks with the training count and the unit of each of their words.

    A word that is not among the frequent ones is joined with its count once for each chunk that has it, which are few for such a word.
    """
    least, vocabulary = _frequent(counts, FREQUENT)
    held = chunks.sparkSession.sparkContext.broadcast(vocabulary)
    rare = common.arrow_map(chunks.select("chunk", "words"), lambda it: _rare(it, held), "chunk long, at int, word binary")
    found = rare.join(counts.where((F.col("n") > 0) & (F.col("n") < least)).select("word", "n"), "word")
    known = found.groupBy("chunk").agg(F.collect_list(F.struct("at", "n")).alias("known"))
    first = common.arrow_map(chunks.select("chunk", "words", "ids", "held", "sizes", "tokens"), lambda it: _coded(it, units, held), FIRST_DDL)
    joined = first.join(known, "chunk", "left").select(*CODED.names, F.col("known.at").alias("at"), F.col("known.n").alias("n"))
    return common.materialize(common.arrow_map(joined, _completed, CODED_DDL), "brown-coded")




def _coded(batches: Iterator[pa.RecordBatch], units: int, held) -> Iterator[pa.RecordBatch]:
    """Words become their units and training counts, those of words that are not frequent yet zero."""
    for b in batches:
        for i in range(len(b)):
            h = hashes(b.column(1)[i].as_py().split(b" "))
            added = [pa.array([x.tobytes()], pa.binary()) for x in (unit_of(h, units), held.value.counts(h).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, 1) for k in (0, 2, 3, 4, 5)), *added], schema=FIRST)


def _completed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the counts of the other words in their places."""
    for b in batches:
        for i in range(len(b)):
            n = np.frombuffer(b.column(5)[i].as_buffer(), np.int64).copy()
            if b.column(6)[i].is_valid:
                n[b.column(6)[i].values.to_numpy()] = b.column(7)[i].values.to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, 1) for k in range(5)), pa.array([n.tobytes()], pa.binary())], schema=CODED)


def _flat(b: pa.RecordBatch, train_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Of each chunk: units and counts of its tokens, where each text begins, and the texts' ids and whether they are held out."""
    for i in range(len(b)):
        ids, held, sizes = (b.column(k)[i].values for k in range(3))
        tokens, units, counts = (np.frombuffer(b.column(k)[i].as_buffer(), t) for k, t in ((3, np.int32), (4, np.int32), (5, np.int64)))
        held, sizes = held.to_numpy(zero_copy_only=False).astype(bool), sizes.to_numpy().astype(np.int64)
        if train_only:
            tokens, sizes = tokens[np.repeat(~held, sizes)], sizes[~held]
        if len(sizes):
            yield units[tokens], counts[tokens], np.cumsum(sizes) - sizes, ids, held


def _profiles(batches: Iterator[pa.RecordBatch], held, classes: int) -> Iterator[pa.RecordBatch]:
    """Counts of (unit, class of the next token) in training texts, combined by task up to FLUSH pairs."""
    of = held.value
    pending, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        key = np.concatenate([k for k, _ in pending])
        n = np.concatenate([x for _, x in pending])
        key, inverse = np.unique(key, return_inverse=True)
        n = np.bincount(inverse, weights=n).astype(np.int64)
        for i in range(0, len(key), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array((key[s] // classes // BLOCK).astype(np.int32)), pa.array(key[s]), pa.array(n[s])], schema=PAIRS)

    for units, _, first, _, _ in (x for b in batches for x in _flat(b, True)):
        if len(units) < 2:
            continue
        keep = np.ones(len(units) - 1, bool)
        keep[first[1:] - 1] = False  # what follows an end is another document
        key, n = np.unique((units[:-1].astype(np.int64) * classes + of[units[1:]])[keep], return_counts=True)
        pending.append((key, n))
        size += len(key)
        if size >= FLUSH:
            yield from flush()
            pending, size = [], 0
    if pending:
        yield from flush()


def _gather(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """Whole profiles of the units of a task's blocks."""
    blocks: dict[int, np.ndarray] = {}
    for b in batches:
        block, key, n = (b.column(i).to_numpy() for i in range(3))
        for k in np.unique(block).tolist():
            if k not in blocks:
                blocks[k] = np.zeros(BLOCK * classes, np.int64)
            s = block == k
            np.add.at(blocks[k], key[s] - k * BLOCK * classes, n[s])
    for k, table in blocks.items():
        table = table.reshape(BLOCK, classes)
        some = np.flatnonzero(table.any(axis=1))
        offsets = pa.array(np.arange(len(some) + 1) * classes, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array((some + k * BLOCK).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(table[some].ravel()))], schema=PROFILE)


def _table(b: pa.RecordBatch, classes: int) -> tuple[np.ndarray, np.ndarray]:
    return b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, classes)


def _cells(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel().astype(np.float64))], schema=TOTALS)


def _by_class(batches: Iterator[pa.RecordBatch], held, classes: int) -> Iterator[pa.RecordBatch]:
    of, total = held.value, np.zeros((classes, classes))
    for b in batches:
        unit, profile = _table(b, classes)
        np.add.at(total, of[unit], profile)
    yield _cells(total)


def _sum_cells(df: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Totals of a fixed number of cells over all tasks."""
    out = np.zeros(int(np.prod(shape)))
    for r in df.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(shape)


def _move(batches: Iterator[pa.RecordBatch], held, classes: int) -> Iterator[pa.RecordBatch]:
    """The likeliest class of each unit under the transitions."""
    logs = held.value
    for b in batches:
        unit, profile = _table(b, classes)
        yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array((profile @ logs.T).argmax(axis=1).astype(np.int32))], names=["unit", "class"])


def _start(counts: DataFrame, units: int, classes: int) -> np.ndarray:
    """The most frequent words are classes of their own; all else is in the last class."""
    of = np.full(units, classes - 1, np.uint8)
    top = counts.where("n > 0").orderBy(F.col("n").desc(), "word").limit(classes - 1).collect()
    if top:
        of[unit_of(hashes([bytes(r["word"]) for r in top]), units)] = np.arange(len(top))
    return of


def _plogp(x: np.ndarray) -> float:
    return float((x * np.log(np.maximum(x, 1))).sum())


def likelihood(total: np.ndarray) -> float:
    """The part of the class bigram model's log likelihood that depends on the classes, from the counts of neighbours by class."""
    return _plogp(total) - _plogp(total.sum(axis=1)) - _plogp(total.sum(axis=0))


def _neighbours(batches: Iterator[pa.RecordBatch], held, classes: int) -> Iterator[pa.RecordBatch]:
    """Counts of (class, class of the next token) in training texts."""
    of, total = held.value, np.zeros(classes * classes)
    for units, _, first, _, _ in (x for b in batches for x in _flat(b, True)):
        keep = np.ones(max(0, len(units) - 1), bool)
        keep[first[1:] - 1] = False
        c = of[units].astype(np.int64)
        total += np.bincount((c[:-1] * classes + c[1:])[keep], minlength=classes * classes)
    yield _cells(total)


def cluster(coded: DataFrame, counts: DataFrame, units: int, classes: int, rounds: int, sweeps: int) -> tuple[np.ndarray, list[float]]:
    """Exchange clustering: the class of each unit, and the likelihood at the start and after each round that was kept."""
    spark = coded.sparkSession

    def value(of: np.ndarray) -> float:
        now = spark.sparkContext.broadcast(of)
        return likelihood(_sum_cells(common.arrow_map(coded, lambda it: _neighbours(it, now, classes), "cell int, n double"), (classes, classes)))

    of = _start(counts, units, classes)
    trail = [value(of)]
    for _ in range(rounds):
        after = _round(coded, of, classes, sweeps)
        now = value(after)
        if now <= trail[-1]:
            break
        of, trail = after, [*trail, now]
    return of, trail


def _round(coded: DataFrame, of: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """The classes after sweeps over profiles whose following classes stay as they were; a sweep that makes the profiles less likely is undone."""
    spark = coded.sparkSession
    held = spark.sparkContext.broadcast(of)
    pairs = common.arrow_map(coded, lambda it: _profiles(it, held, classes), "block int, key long, n long")
    profiles = common.materialize(common.arrow_map(pairs.repartition(common.partitions(spark), "block"), lambda it: _gather(it, classes), "unit int, profile array<long>"), "brown-profiles")
    before, last = of, -np.inf
    for _ in range(sweeps):
        now = spark.sparkContext.broadcast(of)
        total = _sum_cells(common.arrow_map(profiles, lambda it, now=now: _by_class(it, now, classes), "cell int, n double"), (classes, classes))
        likely = _plogp(total) - _plogp(total.sum(axis=1))
        if likely <= last:
            of = before if likely < last else of
            break
        last, before = likely, of
        prior = (total.sum(axis=0) + 1) / (total.sum() + classes)
        logs = spark.sparkContext.broadcast(np.log((total + KAPPA * prior) / (total.sum(axis=1, keepdims=True) + KAPPA)))
        moved = common.arrow_map(profiles, lambda it, logs=logs: _move(it, logs, classes), "unit int, class int").toArrow()
        of = of.copy()
        of[moved.column("unit").to_numpy()] = moved.column("class").to_numpy()
        del moved
        now.unpersist()
        logs.unpersist()
    common.drop(spark, profiles.scratch_path)
    return of


class Model:
    """Transitions, emissions and discounts; class ``classes`` is the end, and context ``classes + 1`` an unknown word."""

    def __init__(self, of: np.ndarray, classes: int, discount: np.ndarray, total: np.ndarray, n: int, v: int):
        k = classes + 1
        self.of, self.classes, self.discount, self.n, self.v = of, classes, discount, n, v
        moves, mass, freed = total[: (k + 1) * k].reshape(k + 1, k), total[(k + 1) * k : (k + 2) * k], total[(k + 2) * k :]
        prior = (mass + 0.1) / (mass.sum() + 0.1 * k)
        self.trans = (moves + KAPPA * prior) / (moves.sum(axis=1, keepdims=True) + KAPPA)
        self.log_trans = np.log10(self.trans)
        self.mass = np.maximum(mass, 1.0)
        # an unknown word gets what the discounts of a class's words free, and all of a class without words
        unknown = np.where(mass > 0, freed / self.mass, 1.0)
        unknown[classes] = 0
        self.log_unknown = np.log10(self.trans @ unknown)

    def classes_of(self, units: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Class of each token; a document's last token is its end."""
        out = self.of[units].astype(np.int64)
        last = np.concatenate([first[1:] - 1, [len(units) - 1]])
        out[last] = self.classes
        return out

    def log10(self, units: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        c = self.classes_of(units, first)
        context = np.where((counts == 0) & (c != self.classes), self.classes + 1, c)
        before = np.concatenate([[self.classes], context[:-1]])
        before[first] = self.classes
        n = np.maximum(counts, 1)
        emission = np.where(c == self.classes, 1.0, (n - self.discount[np.minimum(n, 4)]) / self.mass[c])
        known = self.log_trans[before, c] + np.log10(emission)
        return np.where((counts > 0) | (c == self.classes), known, self.log_unknown[before])


def _totals(batches: Iterator[pa.RecordBatch], held, classes: int, discount: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Class transitions (and those after words seen once), mass and discounted mass of the classes, over training texts."""
    of, k = held.value, classes + 1
    moves, mass, freed = np.zeros((k + 1) * k), np.zeros(k), np.zeros(k)
    for units, counts, first, _, _ in (x for b in batches for x in _flat(b, True)):
        c = of[units].astype(np.int64)
        last = np.concatenate([first[1:] - 1, [len(units) - 1]])
        c[last] = classes
        before = np.concatenate([[classes], c[:-1]])
        before[first] = classes
        moves += np.bincount(before * k + c, minlength=(k + 1) * k)
        once = np.concatenate([[False], (counts[:-1] == 1) & (c[:-1] != classes)])
        once[first] = False
        moves += np.bincount(k * k + c[once], minlength=(k + 1) * k)
        mass += np.bincount(c, minlength=k)
        word = c != classes
        n = np.maximum(counts[word], 1)
        freed += np.bincount(c[word], weights=discount[np.minimum(n, 4)] / n, minlength=k)
    yield _cells(np.concatenate([moves, mass, freed]))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of words seen 0, 1, 2, 3 and more times, by counts of counts."""
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    d = [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]
    return np.array([0.0, d[0], d[1], d[2], d[2]])


def _score(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    model: Model = held.value
    floor = np.log10(model.n + model.v + 1)
    for units, counts, first, ids, out in (x for b in batches for x in _flat(b, False)):
        size = np.diff(np.concatenate([first, [len(units)]]))
        base = np.add.reduceat(np.log10(counts + 1.0), first) - size * floor
        known = np.add.reduceat((counts > 0).astype(np.int64), first)
        yield common.batch(SCORES, doc_id=ids, held_out=out, n_tokens=size, n_known=known, train_tokens=np.full(len(first), model.n), base_score=base, score=np.add.reduceat(model.log10(units, counts, first), first))


def score(docs: DataFrame, units: int = UNITS, classes: int = CLASSES, rounds: int = ROUNDS, sweeps: int = SWEEPS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words between white space (space, U+0009 to U+000D), A-Z lower-cased, and an end for each text; null text counts as empty.
    All texts whose crc32(doc_id as text) modulo FOLDS is not HELD train (a null doc_id is the text ''). base_score is the add-one unigram's
    log10 probability, score that of the class model; both take all unknown words as one. Repeated rows count as often as they occur.
    Other columns are ignored; an empty table gives no rows.
    """
    return fit(docs, units, classes, rounds, sweeps)[0]


def fit(docs: DataFrame, units: int, classes: int, rounds: int, sweeps: int) -> tuple[DataFrame, Model, list[float]]:
    """The scores of ``score``, the model behind them, and the likelihood after each round of its clustering."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.col("doc_id").cast("long"), (fold == HELD).alias("held_out"), common.text_or_empty().cast("binary").alias("text"))
    chunks, counts = chunked(rows)
    seen = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    facts = counts.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), *seen).first()
    coded = encode(chunks, counts, units)
    common.drop(spark, chunks.scratch_path)
    common.release(spark)
    of, trail = cluster(coded, counts, units, classes, rounds, sweeps)
    discount = discounts(*(facts[f"n{k}"] for k in (1, 2, 3, 4)))
    held = spark.sparkContext.broadcast(of)
    k = classes + 1
    total = _sum_cells(common.arrow_map(coded, lambda it: _totals(it, held, classes, discount), "cell int, n double"), ((k + 3) * k,))
    made = Model(of, classes, discount, total, facts["n"], facts["v"])
    model = spark.sparkContext.broadcast(made)
    common.release(spark)
    return common.arrow_map(coded, lambda it: _score(it, model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), made, trail


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
