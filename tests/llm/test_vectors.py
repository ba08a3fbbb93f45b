"""Operators over vectors and the store of token ids, against brute force, the tokenizer and exact round trips."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaystone.llm import common, hard_negatives, token_store, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, cell int, deal int, v string, q int, rank int"


def table(spark, rows):
    """Rows (vec_id, embedding, label) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, 7, "x", 7, 7) for r in rows], VECTORS)


def some_vectors(n=180, dims=6, seed=5):
    """Few distinct values, so that ties, equal vectors and zero vectors are frequent; some rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, dims) / 8], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, [0.25] * dims, 1) for i in range(40)] + [(900, [0.0] * dims, 2), (901, [-0.5] * dims, 0), (902, [-0.501] * dims, 0)]
    return rows + [(903, None, 1), (904, [0.1] * (dims - 1) + [None], 1), (905, [0.1] * (dims - 1) + [math.inf], 1), (906, [math.nan] * dims, 1)]


def good(rows):
    return [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def mined(rows, every, low=80, high=100):
    out = set()
    kept = [r for r in good(rows) if r[0] is not None and r[2] is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for a, v, lab in kept:
        if a % every == 0:
            scored = sorted((-dot(v, w), i, other) for i, w, other in kept if i != a)
            for ps, p, _ in [x for x in scored if x[2] == lab][:5]:
                near = [x for x in scored if x[2] != lab and low * -ps <= 100 * -x[0] <= high * -ps][:5]
                out |= {(a, p, k + 1, i, -ps, -s) for k, (s, i, _) in enumerate(near)}
    return out


@pytest.mark.parametrize("low, high", [(80, 100), (40, 60), (99, 101)])
def test_hard_negatives_are_those_of_all_pairs(spark, low, high):
    rows = some_vectors()
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 3 == 0, low=low, high=high).collect()
    assert {tuple(r) for r in got} == mined(rows, 3, low, high) and len(got) == len(set(got))


@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_tree_search_leaves_nothing_out_and_skips_leaves(leaf):
    rng = np.random.default_rng(leaf)
    rows = np.round(rng.normal(rng.integers(0, 4, 600)[:, None] * 20, 6, (600, 5))).astype(np.int64)
    rows[100:160] = rows[100]
    ids, labels = rng.permutation(600).astype(np.int64), rng.integers(0, 3, 600)
    space = hard_negatives.Space(5, int((rows**2).sum(1).max()))
    n = 50
    lo, hi = np.sort(rng.integers(-2000, 12000, (2, n)), axis=0).astype(float)
    q = hard_negatives.Queries(rows[:n].astype(float), np.arange(n), ids[:n], labels[:n], lo, hi, np.full(n, -1e15), False, 4)
    best, tree = hard_negatives.Best(q), hard_negatives.Tree(ids, labels, rows, space, leaf)
    visits = []
    tree.leaves = [type("L", (), {"__iter__": lambda s, x=x: (visits.append(1), iter(x))[1]})() for x in tree.leaves]
    for some in np.array_split(np.arange(n), 3):
        tree.search(q, best, some)
    for i in range(n):
        scores = rows @ rows[i]
        want = sorted((-s, j) for s, j, lab in zip(scores, ids, labels, strict=True) if lab != labels[i] and lo[i] <= s <= hi[i] and j != ids[i])[:4]
        got = [(-s, j) for s, j in zip(best.scores[i], best.ids[i], strict=True) if np.isfinite(s)]
        assert got == want
    assert len(visits) < n * len(tree.leaves)


def test_blocks_keep_cells_apart_and_are_bounded(monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 3)
    v = [np.array([i, i], np.int32).tobytes() for i in range(10)]
    make = lambda lo, hi, cells: hard_negatives.pa.record_batch({"cell": hard_negatives.pa.array(cells, hard_negatives.pa.int32()), "vec_id": list(range(lo, hi)), "label": [0] * (hi - lo), "v": v[lo:hi]})
    got = [ids.tolist() for ids, _, _ in hard_negatives._blocks(iter([make(0, 6, [0, 0, 0, 0, 1, 1]), make(6, 10, [1, 1, 1, 2])]), 2)]
    assert got == [[0, 1, 2], [3], [4, 5, 6], [7, 8], [9]]


def test_dealing_puts_every_row_in_a_cell_and_cuts_up_equal_rows(monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 100)
    monkeypatch.setattr(hard_negatives, "TASK_ROWS", 200)
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.integers(-50, 50, (300, 3)), np.full((300, 3), 9)])
    space = hard_negatives.Space(3, int((rows**2).sum(1).max()))
    dealer = hard_negatives.Dealer(rows, space, 6000)
    cells = dealer.cells(rows)
    assert len(set(cells.tolist())) > 4 and len(set(cells[300:].tolist())) == 1 and dealer.shares[cells[400]] >= 15


def test_hard_negatives_of_odd_tables(spark):
    all_ = F.lit(True)
    assert hard_negatives.mine(table(spark, []), all_).count() == 0
    assert hard_negatives.mine(table(spark, [(1, [1.0, 0.0], 0)]), all_).count() == 0
    assert hard_negatives.mine(table(spark, [(None, [1.0], 0), (2, [1.0], None), (3, [], 1)]), all_).count() == 0
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 0), (3, [0.9, 0.0], 1), (3, [0.9, 0.0], 1), (4, [3e38, 0.0], 5), (5, [1.0], 1)]
    got = {tuple(r) for r in hard_negatives.mine(table(spark, rows), F.col("vec_id") == 1).collect()}
    assert got == {(1, 2, 1, 3, 65536, 256 * 230)}


def coded(rows, parts, entries, rounds):
    kept = good(rows)
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    pieces = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[pieces(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            near = [(nearest(p, pieces(v)[p])[1], pieces(v)[p]) for _, v, _ in kept]
            new.append([[sum(c) // len(c) for c in zip(*[x for e2, x in near if e2 == e], strict=True)] or books[p][e] for e in range(len(books[p]))])
        books = new
    found = [(i, lab, [nearest(p, x) for p, x in enumerate(pieces(v))]) for i, v, lab in kept]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    total = {}
    for _, lab, n in found:
        total[lab] = total.get(lab, 0) + sum(d for d, _ in n)
    return sorted((str(i), "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), total[lab], sha) for i, lab, n in found)


@pytest.mark.parametrize("parts, entries, rounds", [(3, 8, 2), (2, 64, 1), (6, 5, 3), (3, 300, 2)])
def test_codes_are_those_of_a_plain_search(spark, parts, entries, rounds):
    rows = [*some_vectors(), (None, [0.3] * 6, None), (7, [0.3] * 6, None), (7, [0.3] * 6, None)]
    if entries > 255:
        rows = rows[:100]
    got = vector_codes.encode(table(spark, rows), parts, min(entries, 255), rounds).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == coded(rows, parts, min(entries, 255), rounds)


def test_annular_search_equals_a_full_one_with_ties():
    rng = np.random.default_rng(3)
    for spread in (2, 30, 1 << 24):
        entries, points = rng.integers(-spread, spread, (64, 4)), rng.integers(-spread, spread, (3000, 4))
        entries[10], points[:64] = entries[3], entries
        at, best = vector_codes.Book(entries).nearest(points)
        far = ((points[:, None, :] - entries[None]) ** 2).sum(2)
        assert (best == far.min(1)).all() and (at == far.argmin(1)).all()


def test_codes_of_odd_tables(spark):
    assert vector_codes.encode(table(spark, [])).count() == 0
    assert vector_codes.encode(table(spark, [(1, None, 1)])).count() == 0
    got = vector_codes.encode(table(spark, [(1, [1.0] * 5, None), (2, [1.0] * 5, 1), (3, [1.0], 1), (4, [3e38] * 5, 1)])).orderBy("vec_id").collect()
    assert [(r.vec_id, len(r.code), r.code[:2], r.error) for r in got] == [(1, 32, "00", 0), (2, 32, "00", 0), (4, 32, "02", 0)]


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(token_store.default_path()).encode(text or "", add_special_tokens=False).ids, 1]


def test_store_gives_back_the_ids_of_every_document(spark, odd):
    folder = common.scratch(spark, "store")
    token_store.write(odd, folder, shard_bytes=60)
    rows = token_store.read(spark, folder).collect()
    want = sorted(((r.doc_id, plain_ids(r.text)) for r in odd.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((str(d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want)
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [d for d, _ in want]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows]).tolist()[:-1]]
    assert spark.read.format("binaryFile").load(f"{folder}/shards").where("length > 0").count() > 3


def test_one_document_is_read_through_the_index(spark, odd, monkeypatch):
    folder = common.scratch(spark, "store")
    token_store.write(odd, folder)
    got = {(r.doc_id, tuple(r.ids)) for r in token_store.fetch(spark, folder, [2, 7, 77]).collect()}
    assert got == {(2, tuple(plain_ids("alpha beta  gamma\tdelta"))), (7, tuple(plain_ids("été \U0001f600 İstanbul <|endoftext|>")))}
    places = token_store.index(spark, folder).collect()
    assert len(places) == odd.count() and all(p.length > 0 for p in places)
    raw = token_store.dictionary(spark, folder)
    blob = bytes(spark.read.format("binaryFile").load(f"{folder}/shards").where("length > 0").first().content)
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.Shard(blob, raw + b"x")
    with pytest.raises(ValueError, match="not a shard"):
        token_store.Shard(blob[:-1], raw)


def test_an_empty_store(spark, empty):
    folder = common.scratch(spark, "store")
    token_store.write(empty, folder)
    assert token_store.read(spark, folder).count() == 0 and token_store.index(spark, folder).count() == 0


def test_words_and_whole_texts_give_the_same_ids(spark, sf):
    enc = token_store.encoder(token_store.default_path())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").where("text is not null").collect()]
    texts += ["a\x1cb", "ΑΣ Σ", "é", "I'LL it's 12", "\xa0x\xad", "ǅ ß ſt", "<|endoftext|>x", " a"]
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyzéèüßçñ'-.,0123456789")
    texts += ["".join(rng.choice(letters, rng.integers(1, 16))) for _ in range(5000)]
    texts += [enc.tokenizer.decode(rng.integers(0, 49406, 3).tolist()) for _ in range(5000)]
    assert token_store.fast_words(token_store.default_path()) is not None
    assert all(enc.encode(t) == enc.whole(t) for t in texts)


def test_the_dictionary_shrinks_short_documents(spark, sf):
    enc = token_store.encoder(token_store.default_path())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").where("length(text) between 200 and 3000").orderBy("doc_id").collect()]
    ids = [enc.encode(t) for t in texts]
    raw = token_store.train(ids[: len(ids) // 2])
    size = lambda d: sum(len(token_store.zstandard.ZstdCompressor(level=3, dict_data=d).compress(x)) for x in ids[len(ids) // 2 :])
    assert size(token_store._dictionary(raw)) < size(None)
