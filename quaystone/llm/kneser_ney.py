"""Quality by the perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Counts, continuation counts and discounts are those of all trusted labelled documents of the half that trains; the other half, whose texts the
model has not seen, sets the thresholds, quantiles by language. Spark counts the trigrams. Up to BROADCAST_TRIGRAMS of them are fitted into
sorted arrays that tasks get by broadcast; more stay tables in shards, with which the documents' n-grams are joined (``kn_counts``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common, kn_counts

#: Models of at most so many distinct trigrams are broadcast.
BROADCAST_TRIGRAMS = 1 << 20
#: Where a caller asks for a sample, which no query does: a number of documents of each language, and the most documents in all.
SAMPLE_DOCS = 700
SAMPLE_ALL = 16 * SAMPLE_DOCS
#: A document is rejected above this quantile of its language's trusted perplexities (log10), or of its trusted toxicities.
QUANTILE = 0.99
#: Languages with fewer trusted documents than this use the threshold over all languages.
LEAST = 30
#: A document's perplexity is drawn towards its language's median as if so many more tokens had it: a few words prove little.
PRIOR = 8
START, END, BITS = 1, 2, 21
SHARDS = 16
CACHE = 150_000

SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log10_prob", pa.float64()), ("lang", pa.string()), ("toxicity", pa.float64())])


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def training_sample(docs: DataFrame, ids: DataFrame, per_lang: int) -> DataFrame:
    """doc_id of at most ``per_lang`` of that half of the documents ``ids`` which trains, for each language, by a hash of the id.

    Where all languages together have over SAMPLE_ALL of them, each gives the same number as far as it can.
    """
    some = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang")).join(ids.where(trains()), "doc_id").dropDuplicates(["doc_id"])
    # first the ids of the least hashes within slices, then of those the least: no window holds a whole language
    mark = F.xxhash64("doc_id")
    sliced = some.withColumn("m", mark).withColumn("slice", F.pmod(F.hash("doc_id", F.lit(7)), F.lit(64)))
    near = sliced.withColumn("r", F.row_number().over(W.partitionBy("lang", "slice").orderBy("m"))).where(F.col("r") <= per_lang)
    near = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("m"))).where(F.col("r") <= per_lang)
    return near.orderBy("r", "m").limit(SAMPLE_ALL).select("doc_id")


def trusted(labels: DataFrame) -> DataFrame:
    """Ids that some label calls good and none calls bad or toxic."""
    ok = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(ok.cast("int")).alias("ok")).where("ok = 1").select("doc_id")


def toxic(labels: DataFrame) -> DataFrame:
    """Ids that some label calls toxic."""
    return labels.where("doc_id is not null and toxic = 1").select("doc_id").distinct()


def trains() -> Column:
    """Whether a labelled document may train a model; the other half of the trusted ones sets the thresholds."""
    return F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)) == 0


class Model:
    """Probability tables of the three orders as sorted arrays; keys are word numbers packed in BITS bits each.

    ``vocab`` holds the sorted 64-bit hashes of the known words; the number of a word is its place there plus 3, of any other 0.
    """

    def __init__(self, vocab: np.ndarray, uni: np.ndarray, bi: tuple[np.ndarray, ...], tri: tuple[np.ndarray, ...]):
        self.vocab, self.uni = vocab, uni
        self.bi, self.tri = bi, tri

    def of_hashes(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocab, h), max(0, len(self.vocab) - 1))
        known = self.vocab[at] == h if len(self.vocab) else np.zeros(len(h), bool)
        return np.where(known, at + 3, 0)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return self.of_hashes(hashes(words)) if words else np.zeros(0, np.int64)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = max(0, len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)

    def log10(self, docs: list[list[bytes]]) -> np.ndarray:
        """Sum of log10 P of each document's words and its end."""
        return self.log10_of(self.numbers([w for d in docs for w in d]), np.array([len(d) for d in docs], np.int64))

    def log10_of(self, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same from the words' numbers, document by document."""
        first = np.cumsum(sizes + 3) - sizes - 3
        ids = np.full(len(numbers) + 3 * len(sizes), START, np.int64)
        ids[first + sizes + 2] = END
        ids[np.arange(len(numbers)) + np.repeat(3 * np.arange(len(sizes)) + 2, sizes)] = numbers
        u, v, w = ids[:-2], ids[1:-1], ids[2:]
        p = self.uni[w]
        # a pair or triple that holds an unknown word was never counted
        bi_key, bi_alpha, bi_gamma = self.bi[:3]
        ctx, ctx_gamma = self.bi[3], self.bi[4]
        c = ctx_gamma[v]
        some = np.flatnonzero((v > 0) & (w > 0) & ctx[v])
        hit = np.full(len(w), -1)
        hit[some] = self._find(bi_key, v[some] << BITS | w[some])
        p = np.where(hit >= 0, bi_alpha[hit] if len(bi_alpha) else 0, 0) + c * p
        before = np.concatenate([[-1], hit[:-1]])
        before[first] = self._find(bi_key, np.array([START << BITS | START]))[0]
        gamma = np.where(before >= 0, bi_gamma[before] if len(bi_gamma) else 1, 1)
        tri_key, tri_alpha = self.tri
        begins = np.zeros(len(w), bool)
        begins[first] = True
        some = np.flatnonzero((before >= 0) & ((hit >= 0) | begins))
        t = np.full(len(w), -1)
        t[some] = self._find(tri_key, (u[some] << BITS | v[some]) << BITS | w[some])
        p = np.where(t >= 0, tri_alpha[t] if len(tri_alpha) else 0, 0) + gamma * p
        # positions that begin with a document's third entry count: not the pair that straddles two documents
        logs = np.log10(p)
        keep = np.ones(len(logs), bool)
        for k in (2, 1):
            keep[first[1:] - k] = False
        return np.add.reduceat(np.where(keep, logs, 0.0), first)


def discounts(counts: np.ndarray) -> np.ndarray:
    """D1, D2 and D3+ of modified Kneser-Ney from the counts."""
    return discounts_of([int((counts == k).sum()) for k in range(1, 5)])


def discounts_of(n: list[int]) -> np.ndarray:
    """The same from the counts of counts 1 to 4; half where they cannot be estimated."""
    if not n[0] or not n[1]:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else k * 0.5 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05 if k > 1 else 0.95) for k, x in zip((1, 2, 3), d, strict=True))])


def fit(sample: DataFrame, shards: int = SHARDS, most_words: int = (1 << BITS) - 4) -> Model:
    """Fit on ``sample(text binary)``. Its size bounds the tables, which come to the driver by shard.

    The vocabulary holds at most 2^BITS - 3 words, the most frequent ones; trigrams with rarer words train nothing, as if unknown.
    """
    return fit_counts(count_trigrams(sample), shards, most_words)


def count_trigrams(texts: DataFrame) -> DataFrame:
    """(u, v, w, n) of ``texts(text binary)``. Rows are dealt by the first two words and kept in order, in which they pack well."""
    tri = common.arrow_map(texts.select("text"), _trigrams, "u long, v long, w long, n long")
    tri = tri.repartition(common.partitions(texts.sparkSession), "u", "v").groupBy("u", "v", "w").agg(F.sum("n").alias("n"))
    return common.materialize(tri.sortWithinPartitions("u", "v", "w"), "kn-trigrams")


def fit_counts(tri: DataFrame, shards: int = SHARDS, most_words: int = (1 << BITS) - 4) -> Model:
    parts = []
    for k in range(shards):
        part = tri.where(F.pmod(F.xxhash64("u", "v"), F.lit(shards)) == k).toArrow()
        parts.append(np.stack([part.column(c).to_numpy() for c in ("u", "v", "w", "n")], axis=1).astype(np.int64))
    rows = np.concatenate(parts)
    del parts
    marks = np.array([START, END], np.uint64)
    vocab = np.setdiff1d(np.unique(rows[:, 2]).view(np.uint64), marks)
    if len(vocab) > most_words:
        total = np.bincount(np.searchsorted(vocab, (held := rows[~np.isin(rows[:, 2].view(np.uint64), marks)])[:, 2].copy().view(np.uint64)), weights=held[:, 3])
        vocab = np.sort(vocab[np.lexsort((vocab, -total))[:most_words]])
        known = np.concatenate([marks, vocab])
        rows = rows[np.isin(rows[:, :3].copy().view(np.uint64), known).all(axis=1)]
    for i in range(3):
        h = rows[:, i].copy().view(np.uint64)
        rows[:, i] = np.where(h <= END, h, np.searchsorted(vocab, h) + 3).astype(np.int64)
    rows = rows[np.lexsort([rows[:, 2], rows[:, 1], rows[:, 0]])]
    u, v, w, n = rows.T
    # trigrams
    d = discounts(n)
    pair = u << BITS | v
    pairs, inverse = np.unique(pair, return_inverse=True)
    total = np.bincount(inverse, weights=n, minlength=len(pairs))
    cut = d[np.minimum(n, 3)]
    tri_alpha = ((n - cut) / total[inverse]).astype(np.float64) if len(n) else np.zeros(0)
    tri_gamma = np.bincount(inverse, weights=cut, minlength=len(pairs)) / total if len(pairs) else np.zeros(0)
    # pairs by the number of words before them
    follow, m = np.unique(v << BITS | w, return_counts=True)
    d = discounts(m)
    fv = follow >> BITS
    size = len(vocab) + 3
    total = np.bincount(fv, weights=m, minlength=size)
    cut = d[np.minimum(m, 3)]
    bi_alpha = (m - cut) / total[fv] if len(m) else np.zeros(0)
    seen = total > 0
    ctx_gamma = np.where(seen, np.bincount(fv, weights=cut, minlength=size) / np.where(seen, total, 1), 1.0)
    at = np.searchsorted(pairs, follow)
    at[at == len(pairs)] = 0
    bi_gamma = np.where(pairs[at] == follow, tri_gamma[at], 1.0) if len(pairs) else np.zeros(0)
    # words by the number of words before them
    one = np.bincount(follow & ((1 << BITS) - 1), minlength=size)
    d = discounts(one[one > 0])
    total = max(1, one.sum())
    floor = (d[np.minimum(one, 3)].sum() / total if one.sum() else 1.0) / (len(vocab) + 2)
    uni = np.maximum(one - d[np.minimum(one, 3)], 0) / total + floor
    # <s> <s> as a context is no counted pair: its weight is kept under the pair's own key
    start = np.int64(START << BITS | START)
    if len(pairs) and start in pairs and start not in follow:
        i = np.searchsorted(follow, start)
        follow, bi_alpha, bi_gamma = np.insert(follow, i, start), np.insert(bi_alpha, i, 0.0), np.insert(bi_gamma, i, tri_gamma[np.searchsorted(pairs, start)])
    return Model(vocab, uni, (follow, bi_alpha, bi_gamma, seen, ctx_gamma), (pair << BITS | w, tri_alpha))


TRI = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("w", pa.int64()), ("n", pa.int64())])


def hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; the few values that stand for the start and the end are kept free."""
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(w, 7) for w in found]), ">u8").astype(np.uint64)
    return np.maximum(h, np.uint64(16))


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the trigrams of each batch of texts, as hashes."""
    for b in batches:
        docs = [words(t) for t in b.column(0).to_pylist()]
        flat = iter(hashes([w for d in docs for w in d]).view(np.int64).tolist())
        ids = np.fromiter((i for d in docs for i in (START, START, *islice(flat, len(d)), END)), np.int64)
        if not len(ids):
            continue
        first = np.cumsum([len(d) + 3 for d in docs])[:-1]
        rows = np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1)
        keep = np.ones(len(rows), bool)
        keep[np.concatenate([first - 1, first - 2])] = False
        rows, n = np.unique(rows[keep], axis=0, return_counts=True)
        yield common.batch(TRI, u=rows[:, 0], v=rows[:, 1], w=rows[:, 2], n=n)


class Coder:
    """Numbers of words in both models, one look-up for each token, and the words' log10 ratio of the lowest orders of bad to trusted."""

    def __init__(self, model: Model, bad: Model | None):
        self.model, self.bad = model, bad
        self.cache: dict[bytes, int] = {}
        self.logs = np.log10(model.uni), np.log10(bad.uni) if bad else None

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Number in the trusted model, and that in the bad one from bit 32 on."""
        new = list(set(words) - self.cache.keys())
        if new:
            if len(self.cache) + len(new) > CACHE:
                self.cache.clear()
                new = list(set(words))
            h = hashes(new)
            code = self.model.of_hashes(h) | (self.bad.of_hashes(h) << 32 if self.bad else 0)
            self.cache.update(zip(new, code.tolist(), strict=True))
        return np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))

    def worst(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The largest ratio among a document's words: a word decides, in whatever prose. Not a number without words or without a bad model."""
        out = np.full(len(sizes), np.nan)
        some = np.flatnonzero(sizes)
        if self.bad and len(some):
            ratio = self.logs[1][codes >> 32] - self.logs[0][codes & 0xFFFFFFFF]
            out[some] = np.maximum.reduceat(ratio, (np.cumsum(sizes) - sizes)[some])
        return out


def _score(batches: Iterator[pa.RecordBatch], held, held_toxic) -> Iterator[pa.RecordBatch]:
    model: Model = held.value
    coder = Coder(model, held_toxic.value if held_toxic else None)
    for b in batches:
        ids, lang = b.column(0), b.column(2)
        at = 0
        while at < len(ids):
            flat, sizes, first = [], [], at
            while at < len(ids) and len(flat) < 200_000:
                before = len(flat)
                flat += words(b.column(1)[at].as_py())
                sizes.append(len(flat) - before)
                at += 1
            sizes = np.array(sizes, np.int64)
            codes = coder.codes(flat)
            far = coder.worst(codes, sizes)
            far = pa.array(far, mask=~np.isfinite(far))
            out = common.batch(SCORES, doc_id=ids.slice(first, at - first), n_tokens=sizes, log10_prob=model.log10_of(codes & 0xFFFFFFFF, sizes), lang=lang.slice(first, at - first), toxicity=far)
            for k in range(3, b.num_columns):
                out = pa.RecordBatch.from_arrays([*out.columns, b.column(k).slice(first, at - first)], schema=out.schema.append(b.schema.field(k)))
            yield out


def _score_joined(batches: Iterator[pa.RecordBatch], model: dict, paths: list[str]) -> Iterator[pa.RecordBatch]:
    """As ``_score``, from the counts that were asked for."""
    for c, rows in _chunks(batches):
        low, high = (kn_counts._read(p, c.chunk, c.mark) for p in paths)
        logs, far = c.log10(model, low, high)
        at = 0
        for b in rows:
            here = slice(at, at := at + b.num_rows)
            toxicity = pa.array(far[here], mask=~np.isfinite(far[here]))
            out = common.batch(SCORES, doc_id=b.column(0), n_tokens=c.sizes[here], log10_prob=logs[here], lang=b.column(2), toxicity=toxicity)
            for k in range(3, b.num_columns):
                out = pa.RecordBatch.from_arrays([*out.columns, b.column(k)], schema=out.schema.append(b.schema.field(k)))
            yield out


def _chunks(batches: Iterator[pa.RecordBatch], text: int = 1):
    return kn_counts.chunks(batches, text, hashes, words, START, END)


def _texts(batches: Iterator[pa.RecordBatch]):
    return _chunks(batches, 0)


def _joined(rows: DataFrame, trigrams: DataFrame, bad: DataFrame | None, shape: StructType) -> DataFrame:
    """``rows(doc_id, text, lang, ...)`` scored by joins with sharded counts."""
    tables = kn_counts.Tables(trigrams, bad, discounts_of)
    shards, turns, model, paths = tables.shards, tables.turns, tables.model, []
    for level in (0, 1):
        answered = paths[0] if level else None
        asks = lambda turn, answered=answered: common.arrow_map(rows.select("text"), lambda it: kn_counts.asked(it, _texts, shards, answered, turn, turns), kn_counts.PARTS)
        paths.append(tables.answers(level, asks))
    scored = common.materialize(common.arrow_map(rows, lambda it: _score_joined(it, model, paths), shape), "kn-scores")
    common.drop(rows.sparkSession, *paths)
    return scored


def training_texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``text`` of the documents with these ids, each id's once: of rows that share an id one trains, the least text."""
    chosen = common.lookup_join(rows.select("doc_id", "text"), ids, "doc_id", ids.count())
    again = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id").join(ids, "doc_id", "left_semi")
    n = again.count()
    if not n:
        return chosen.select("text")
    several = common.lookup_join(chosen, again, "doc_id", n).groupBy("doc_id").agg(F.min("text").alias("text"))
    return chosen.join(again, "doc_id", "left_anti").select("text").union(several.select("text"))


def quality(docs: DataFrame, labels: DataFrame, per_lang: int | None = None, quantile: float = QUANTILE, rows_too: bool = False) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, lang)``: doc_id, lang, n_tokens, log10_perplexity, score, threshold, toxicity, keep.

    Tokens are words between white space, A-Z lower-cased, and an end; perplexity is by token. The score is the log10 perplexity, drawn
    towards the median of the language as by PRIOR tokens more. A document is kept if its score and its toxicity are at most the ``quantile``
    of the trusted documents of its language (labelled good, not toxic, of the half that does not train), or of all of them where the
    language has fewer than LEAST; without any trusted document all are kept that have words. Toxicity is the worst word's log10 ratio
    of the lowest-order probability in a model of half of the documents labelled toxic to that in the trusted one, null without such labels. Documents without words (null, empty, blank)
    are not kept. Null lang is a language of its own. Repeated rows are scored each; other columns are ignored unless ``rows_too`` asks for
    the whole row as __row; an empty table gives no rows. ``labels(doc_id, quality, toxic)`` may repeat ids.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().cast("binary").alias("text"), "lang", F.struct(*[F.col("`" + n.replace("`", "``") + "`") for n in docs.columns]).alias("__row"))
    more = ["__row"] if rows_too else []

    inputs = rows.select("doc_id", "text", "lang", *more)
    if "Exchange" in inputs._jdf.queryExecution().executedPlan().toString():
        # documents are read several times, and have to be dealt alike each time
        inputs = common.materialize(inputs, "kn-documents")

    def counted(ids: DataFrame) -> DataFrame:
        chosen = ids.where(trains()) if per_lang is None else training_sample(rows, ids, per_lang)
        tri = count_trigrams(training_texts(rows, common.materialize(chosen, "kn-trains")))
        common.release(spark)
        return tri

    trigrams, bad = counted(trusted(labels)), counted(toxic(labels))
    n, n_bad = trigrams.count(), bad.count()
    shape = StructType.fromDDL("doc_id long, n_tokens long, log10_prob double, lang string, toxicity double")
    if more:
        shape = shape.add("__row", rows.schema["__row"].dataType)
    if max(n, n_bad) > BROADCAST_TRIGRAMS:
        scored = _joined(inputs, trigrams, bad if n_bad else None, shape)
    else:
        held = spark.sparkContext.broadcast(fit_counts(trigrams))
        held_toxic = spark.sparkContext.broadcast(fit_counts(bad)) if n_bad else None
        scored = common.materialize(common.arrow_map(inputs, lambda it: _score(it, held, held_toxic), shape), "kn-scores")
    common.drop(spark, trigrams.scratch_path, bad.scratch_path)
    scored = scored.withColumn("log10_perplexity", F.when(F.col("n_tokens") > 0, -F.col("log10_prob") / (F.col("n_tokens") + 1)))
    key = F.coalesce("lang", F.lit(""))
    good = scored.join(trusted(labels), "doc_id", "left_semi").where("log10_perplexity is not null")
    # what trained the model would look too easy: medians and thresholds come from the other half
    medians = _by_lang(good.where(~trains()), key, "log10_perplexity", 0.5)
    drawn = (-F.col("log10_prob") + F.lit(PRIOR) * F.col("median")) / (F.col("n_tokens") + F.lit(1 + PRIOR))
    drawn = F.when(F.col("n_tokens") > 0, F.coalesce(drawn, "log10_perplexity"))
    limits = _by_lang(_with(good, key, medians, "median").withColumn("drawn", drawn).where(~trains()), key, "drawn", quantile)
    bounds = _by_lang(good.where(~trains()), key, "toxicity", quantile)
    out = _with(_with(_with(scored, key, medians, "median"), key, limits, "limit"), key, bounds, "bound")
    out = out.withColumn("threshold", F.coalesce("limit", F.lit(float("inf")))).withColumn("score", drawn)
    return out.select("doc_id", "lang", "n_tokens", "log10_perplexity", "score", "threshold", "toxicity", (F.col("score").isNotNull() & (F.col("score") <= F.col("threshold")) & F.coalesce(F.col("toxicity") <= F.col("bound"), F.lit(True))).alias("keep"), *more)


def _by_lang(rows: DataFrame, key: Column, column: str, q: float) -> tuple[dict[str, float], float | None]:
    """A quantile by language where it has LEAST rows, and over all rows (None: there are none)."""
    value = F.percentile_approx(column, q, 10_000).alias("q"), F.count("*").alias("n")
    by = {r["k"]: float(r["q"]) for r in rows.groupBy(key.alias("k")).agg(*value).where((F.col("n") >= LEAST) & F.col("q").isNotNull()).collect()}
    whole = rows.agg(*value).first()["q"]
    return by, None if whole is None else float(whole)


def _with(rows: DataFrame, key: Column, values: tuple[dict[str, float], float | None], name: str) -> DataFrame:
    """Add the value of the row's language, else the one over all."""
    by, whole = values
    spark = rows.sparkSession
    table = spark.createDataFrame(list(by.items()), "__k string, __v double")
    # one row for each language
    joined = rows.withColumn("__k", key).join(F.broadcast(table) if len(by) <= common.BROADCAST_ROWS else table, "__k", "left")
    return joined.withColumn(name, F.coalesce("__v", F.lit(whole).cast("double"))).drop("__k", "__v")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
