"""Each operator against a brute-force version, and on odd and empty tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from oracle import assert_same, duck
from pyspark.sql import functions as F

from quaystone.llm import brown, common, decontaminate, edit_counts, exact_dedup, graph, kneser_ney, packing, queries, sharding, simhash, suffix_dedup, tokens, warc_index

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf).toPandas(), duck(queries.SQL[name], sf))


# --- 1 -----------------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a.example/x", "same"), (3, "http://a.example/x", "same"), (9, None, "same"), (4, "bad url \r\n x", None), (7, "https://b.example", ""), (None, "http://c.example/", "same"), (8, "http://a.example/y?q=1#f", "\r\n\r\nWARC/1.1\r\né"), (3, "http://a.example/x", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "n": F.lit(2), "first": F.lit(3)})
    path = str(tmp_path / "w")
    warc_index.write_archives(pages, path, records_per_file=3)
    got = warc_index.index(spark, path).collect()
    assert len(got) == len(rows)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = Counter()
    for i, _, h in rows:
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(ids) if ids else None
        want[(i, len((h or "").encode()), digest(h), "response" if i == first else "revisit", None if i == first else first)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    keys = [(r["url_key"], r["ts"]) for r in sorted(got, key=lambda r: (r["range_no"], r["pos"]))]
    assert keys == sorted(keys)
    # every record can be read alone, at its offset
    import glob

    for r in got:
        data = open(glob.glob(f"{path}/{r['file']}")[0], "rb").read()
        fields, _ = warc_index.parse(zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31))
        assert fields["warc-type"] == r["record_type"]


def test_archives_are_read_in_splits(spark, tmp_path):
    """Splits that begin within records and within separators: every record is read once, at its own place."""
    pages = spark.range(120).select(F.col("id").alias("page_id"), F.lit("http://h.example/").alias("url"), F.concat(F.repeat(F.sha2(F.col("id").cast("string"), 512), 3), F.col("id").cast("string")).alias("html"))
    warc_index.write_archives(pages.coalesce(1), str(tmp_path / "w"), records_per_file=500)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for size in (777, 5000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = warc_index.index(spark, str(tmp_path / "w")).collect()
        for k, v in held.items():
            spark.conf.set(k, v)
        assert sorted(r["page_id"] for r in got) == list(range(120))
        for r in got:
            data = (tmp_path / "w" / r["file"]).read_bytes()
            fields, _ = warc_index.parse(zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31))
            assert fields["warc-record-id"].endswith(f":{r['page_id']}>")


def test_warc_empty(spark, tmp_path):
    path = str(tmp_path / "w")
    warc_index.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc_index.index(spark, path).count() == 0


def test_ranges_are_merged_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_index, "RANGE_ROWS", 20)
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.example/"), (F.col("id") * 7919 % 31).cast("string")).alias("url"), F.col("id").cast("string").alias("html"))
    warc_index.write_archives(pages, str(tmp_path / "w"), records_per_file=25)
    got = sorted(warc_index.index(spark, str(tmp_path / "w")).collect(), key=lambda r: (r["range_no"], r["pos"]))
    keys = [(r["url_key"], r["ts"], r["page_id"]) for r in got]
    assert keys == sorted(keys) and len(keys) == 400 and got[-1]["range_no"] > 5


@pytest.mark.parametrize("k", [0, 1, 2, 5, 8])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 50), i) for _ in range(rng.randint(0, 9))) for i in range(k)]
    assert list(warc_index.LoserTree([iter(x) for x in runs], lambda e: e)) == sorted(x for r in runs for x in r)


# --- 2, 8 --------------------------------------------------------------------------------------------------------------------------


def test_exact_dedup_of_odd_rows(odd, empty):
    got = Counter(tuple(r) for r in exact_dedup.dedup(odd, bucket_rows=2).collect())
    rows = texts(odd)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want, taken = Counter(), set()
    for i, t in rows:
        same = [(-len(u or ""), j is None, j or 0, j) for j, u in rows if norm(u) == norm(t)]
        keep = min(same)[3]
        kept = i == keep and -len(t or "") == min(same)[0] and norm(t) not in taken
        taken |= {norm(t)} if kept else set()
        want[(i, keep, len(same), kept, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert got == want and sum(n for k, n in got.items() if k[3]) == len({norm(t) for _, t in rows})
    assert exact_dedup.dedup(empty).count() == 0


def test_colliding_keys_are_chained():
    rows = [(7, 1, b"one", 1, 3, 10), (7, 2, b"two", 2, 3, 11), (7, 3, b"one", 4, 5, 12), (8, 4, b"x", 1, 1, None)]
    import pyarrow as pa

    out = pa.Table.from_batches(exact_dedup.own(iter([common.batch(exact_dedup.ENTRY, **dict(zip(exact_dedup.ENTRY.names, zip(*rows), strict=True)))]))).to_pylist()
    assert [(r["e"], r["keep_id"], r["group_size"], r["wins"]) for r in out] == [(1, 12, 5, False), (3, 12, 5, True), (2, 11, 2, True), (4, None, 1, True)]


def test_shards_fit_their_limit(spark, odd, empty):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    got = sharding.shard(df, limit_bytes=2000).groupBy("__bits", "__prefix", "__part").agg(F.sum("__bytes").alias("b"), F.count("*").alias("n")).collect()
    assert max(r["b"] for r in got) <= 2000 and sum(r["n"] for r in got) == 3000
    same = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.repeat(F.lit("y"), 100), F.col("id").cast("string")).alias("text"))
    same = same.union(spark.createDataFrame([(1, "z" * 3500), (1, "z" * 9000), (2, "w")], "doc_id long, text string"))
    hot = sharding.shard(same, limit_bytes=4000, max_bits=12).groupBy("__bits", "__prefix", "__part").agg(F.sum("__bytes").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in hot) == 403 and len(hot) < 40
    assert sorted(r["b"] for r in hot)[-1] == 9000 and sorted(r["b"] for r in hot)[-2] <= 4000
    assert sharding.shard(odd).count() == odd.count() and sharding.shard(empty).count() == 0


# --- 3, 5 --------------------------------------------------------------------------------------------------------------------------


def test_edits_count_like_encoding_anew(spark, odd, empty):
    enc = tokens.encoder(tokens.default_path())
    rng = random.Random(3)
    base = ["", "a", "Ελλάδα 12€ и мир  日本語 😀\n\n don't " * 40, "  x", "don't stop 123 times!!\n\n  ok", "one two  three\tfour's " * 60, "word " * 3000]
    for text in base * 6:
        tree, now = edit_counts.PieceTree.of(text, enc), text
        for _ in range(5):
            s = rng.randint(0, len(now) + 2)
            e, t = s + rng.choice([0, 1, 3, 40, 900]), rng.choice(["", " ", "'s", "\n", "12", "ж", "語 ", "foo bar ", "re " * 300])
            tree.edit(s, e, t)
            cut = min(s, len(now))
            now = now[:cut] + t + now[max(cut, min(e, len(now))) :]
            assert tree.text() == now and tree.count == len(enc.whole(now)) // 4
    def after(text, edits):
        for e in edits:
            s = min(max(e["start"], 0), len(text))
            text = text[:s] + e["text"] + text[max(s, min(e["end"], len(text))) :]
        return text

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (odd, docs):
        rows = edit_counts.with_edits(df).select("doc_id", "text", "edits").collect()
        want = Counter((r["doc_id"], len(enc.whole(r["text"] or "")) // 4, len(enc.whole(after(r["text"] or "", r["edits"]))) // 4) for r in rows)
        for got in (edit_counts.edited_counts(edit_counts.with_edits(df)), edit_counts.apply_edits(edit_counts.with_edits(edit_counts.trees(df)))):
            assert Counter((r["doc_id"], r["tokens_before"], r["tokens_after"]) for r in got.collect()) == want
    # two batches of edits against stored trees; few pre-tokens are encoded anew
    once = edit_counts.apply_edits(edit_counts.with_edits(edit_counts.trees(docs)), trees_too=True)
    texts_ = {r["doc_id"]: r["text"] for r in once.select("doc_id", "text").collect()}
    twice = {r["doc_id"]: r for r in edit_counts.apply_edits(edit_counts.with_edits(once)).collect()}
    again = {r["doc_id"]: r["edits"] for r in edit_counts.with_edits(once).select("doc_id", "edits").collect()}
    for i, t in texts_.items():
        assert twice[i]["tokens_before"] == len(enc.whole(t)) // 4 and twice[i]["tokens_after"] == len(enc.whole(after(t, again[i]))) // 4
    assert sum(r["pieces_encoded"] for r in twice.values()) < 0.3 * sum(r["pieces"] for r in twice.values())
    assert edit_counts.edited_counts(odd.withColumn("edits", F.lit(None))).where("tokens_before <> tokens_after").count() == 0
    assert edit_counts.edited_counts(edit_counts.with_edits(empty)).count() == 0


def test_fast_ids_are_the_tokenizers(docs):
    enc = tokens.encoder(tokens.default_path())
    assert enc.fast is not None
    assert all(enc.encode(t) == enc.whole(t) for _, t in texts(docs))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    enc = tokens.encoder(tokens.default_path())
    rows = packing.pack(df).collect()
    want = Counter()
    for i, t in texts(df):
        want[(i, len(enc.whole(t or "")) // 4 + 1)] += 1
    assert Counter({k: n for k, n in want.items()}) == Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert sum(r["length"] for r in rows) == sum(k[1] * n for k, n in want.items())
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 1024
    if which == "docs":
        ids = {(i, t): np.frombuffer(enc.whole(t) + b"\0\0\0\0", "<u4") for i, t in texts(df)}
        one = {i: x for (i, _), x in ids.items()}
        assert all(zlib.crc32(one[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in rows)
        pad = sum(0 if n & (n - 1) == 0 else 1024 - n for n in (sum(x[1] for x in s) for s in by.values()))
        assert pad < 0.03 * sum(r["length"] for r in rows)


def test_packing_nothing(empty):
    assert packing.pack(empty).count() == 0


def test_patterns_hold_every_piece():
    counts = {1024: 3, 700: 5, 324: 2, 300: 9, 1: 4}
    got = Counter()
    for n, p in packing.spf_patterns(counts, 1024):
        assert sum(p) <= 1024
        for x in p:
            got[x] += n
    assert got == counts


# --- 4 -----------------------------------------------------------------------------------------------------------------------------


def test_class_model(docs, odd, empty, monkeypatch):
    got = brown.score(docs, units=1 << 16).toPandas().set_index("doc_id")
    tok = lambda t: (t or "").encode().lower().split() + [brown.END]
    rows = texts(docs)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in tok(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tok(t)), sum(c[w] > 0 for w in tok(t)), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), rel_tol=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > 0.9 * out.base_score.sum() and (out.score > out.base_score).mean() > 0.8
    monkeypatch.setattr(brown, "FREQUENT", 40)
    monkeypatch.setattr(brown, "CHUNK", 900)
    few = brown.fit(docs, 1 << 16, brown.CLASSES, brown.ROUNDS, brown.SWEEPS)[0].toPandas().set_index("doc_id").loc[got.index]
    assert np.allclose(few.score, got.score, rtol=1e-9) and (few.n_known == got.n_known).all()
    some = brown.score(odd, units=1 << 12, rounds=1, sweeps=1).toPandas()
    assert len(some) == odd.count() and np.isfinite(some.score).all()
    assert brown.score(empty, units=1 << 12, rounds=1, sweeps=1).count() == 0


def test_class_scores_are_those_of_a_direct_computation(docs):
    """Given the classes, every score from plain counts; the likelihood rises with every round that is kept."""
    frame, model, trail = brown.fit(docs, 1 << 16, 6, 2, 3)
    got = {r["doc_id"]: r for r in frame.collect()}
    assert len(trail) > 1 and all(a < b for a, b in zip(trail, trail[1:], strict=False))
    tok = lambda t: (t or "").encode().lower().split()
    rows = [(i, tok(t), zlib.crc32(str(i).encode()) % 7 == 2) for i, t in texts(docs)]
    train = [w for _, w, h in rows if not h]
    n = Counter(w for t in train for w in [*t, brown.END])
    of = {w: int(model.of[brown.unit_of(brown.hashes([w]), 1 << 16)[0]]) for w in n}
    by = Counter(n.values())
    d = brown.discounts(*(by[k] for k in (1, 2, 3, 4)))
    mass, freed, moves = Counter(), Counter(), defaultdict(Counter)
    for w in n:
        if w != brown.END:
            mass[of[w]] += n[w]
            freed[of[w]] += d[min(n[w], 4)]
    for t in train:
        last, rare = 6, False
        for w in [*t, brown.END]:
            c = 6 if w == brown.END else of[w]
            moves[last][c] += 1
            if rare:
                moves[7][c] += 1
            last, rare = c, n[w] == 1
    mass[6] = len(train)
    prior = {c: (mass[c] + 0.1) / (sum(mass.values()) + 0.7) for c in range(7)}
    trans = lambda b, c: (moves[b][c] + 2 * prior[c]) / (sum(moves[b].values()) + 2)
    for i, t, _ in rows:
        last, total = 6, 0.0
        for w in t:
            if n[w]:
                total += math.log10(trans(last, of[w]) * (n[w] - d[min(n[w], 4)]) / mass[of[w]])
                last = of[w]
            else:
                total += math.log10(sum(trans(last, c) * (freed[c] / mass[c] if mass[c] else 1) for c in range(6)))
                last = 7
        assert math.isclose(got[i]["score"], total + math.log10(trans(last, 6)), rel_tol=1e-9)


def test_class_model_is_a_distribution():
    """Over the vocabulary, the end and the unknown word, the probabilities after any class add up to 1."""
    classes, k = 2, 3
    of = np.array([0, 0, 1, 1], np.uint8)
    n = np.array([5, 1, 3, 1])
    d = brown.discounts(2, 1, 1, 0)
    moves = np.arange(1, (k + 1) * k + 1, dtype=float)
    mass = np.array([6.0, 4.0, 10.0])
    freed = np.array([d[min(5, 4)] + d[1], d[3] + d[1], 0.0])
    m = brown.Model(of, classes, d, np.concatenate([moves, mass, freed]), 20, 5)
    for c in range(k + 1):
        known = sum(m.trans[c, of[w]] * (n[w] - d[min(n[w], 4)]) / m.mass[of[w]] for w in range(4))
        assert math.isclose(known + m.trans[c, classes] + 10 ** m.log_unknown[c], 1.0, rel_tol=1e-9)
    # a class that frees little, and one without words
    of = np.array([0, 0, 0, 0], np.uint8)
    small = brown.Model(of, classes, np.full(5, 0.05), np.concatenate([moves, [10.0, 0.0, 10.0], [0.2, 0.0, 0.0]]), 20, 5)
    for c in range(k + 1):
        known = sum(small.trans[c, 0] * (n[w] - 0.05) / 10 for w in range(4))
        assert math.isclose(known + small.trans[c, classes] + 10 ** small.log_unknown[c], 1.0, rel_tol=1e-9)


# --- 6 -----------------------------------------------------------------------------------------------------------------------------


def brute_spans(rows):
    n = Counter(b[p : p + 200] for _, b in rows for p in range(len(b) - 199))
    out = []
    for i, b in rows:
        covered = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 199):
            if n[b[p : p + 200]] > 1:
                covered[p] += 1
                covered[p + 200] -= 1
        gone = np.cumsum(covered)[: len(b)] > 0
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("few", [2000, 0])
def test_repeated_strings(spark, few, monkeypatch):
    """Repeats within and across texts, periodic texts, edges, and passages that many texts share; with anchors whole and by window."""
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    rng = random.Random(few)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(80):
        own = " ".join(word() for _ in range(rng.randint(5, 150)))
        kind = i % 8
        rows.append((i, [own, own + passage[:190] + own[:50], own + passage[:200], passage[5:] + own, own + own, "ab" * rng.randint(90, 300), (rows[-1][1] if rows else ""), passage[:150] + own][kind]))
    rows += [(None, passage), (None, None), (80, "x" * 199), (81, "y" * 200), (82, "z" * 201), (83, "é" * 150), (83, "é" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in suffix_dedup.dedup(df).collect())
    assert got == brute_spans([(i, (t or "").encode()) for i, t in rows])


def test_rows_without_an_id_of_their_own_are_told_apart(spark, monkeypatch):
    """Null and repeated ids, whatever their texts have in common: a repeat in one row says nothing of another; and many ranges agree with few."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    rows = [(None if i % 2 else 7, (passage if i % 3 == 0 else "") + " ".join(word() for _ in range(70))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_spans([(i, t.encode()) for i, t in rows])
    assert Counter(tuple(r) for r in suffix_dedup.dedup(df).collect()) == want
    monkeypatch.setattr(suffix_dedup, "RANGE_RUNS", 50)
    monkeypatch.setattr(suffix_dedup, "RANGE_WINDOWS", 200)
    assert Counter(tuple(r) for r in suffix_dedup.dedup(df).collect()) == want


def test_repeated_strings_of_odd_rows(odd, empty, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 14)
    got = suffix_dedup.dedup(odd, with_spans=True).collect()
    assert sorted(r["n_removed"] for r in got)[-2:] == [300_000, 300_000] and all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in got)
    assert suffix_dedup.dedup(empty).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 5, 9000).astype(np.uint64) for _ in range(3)]
    order = suffix_dedup.multikey_order(words)
    rows = np.stack(words, axis=1)[order]
    assert (np.lexsort(rows.T[::-1]) == np.arange(len(rows))).all() or (rows == np.stack(words, axis=1)[np.lexsort(words[::-1])]).all()


# --- 7 -----------------------------------------------------------------------------------------------------------------------------


def test_planted_items_are_found(spark, sf, odd, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    rng = random.Random(5)
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    rows, want = [], {}
    filler = lambda n: " ".join("".join(rng.choice("qwertzuiop") for _ in range(rng.randint(3, 8))) for _ in range(n))
    for k, (i, t) in enumerate(items):
        t = list(decontaminate.normalise(t))
        for _ in range((k % 3) * len(t) // 60):
            t[rng.randrange(len(t))] = rng.choice(["", "#", "zz"])
        rows.append((k, filler(40) + " " + "".join(t).upper() + "\n" + filler(30)))
        want[k] = i
    rows += [(1000 + k, filler(120)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chars in (decontaminate.BLOCK_CHARS, 500):
        got = {r["doc_id"]: {h["item_id"] for h in r["__hits"]} for r in decontaminate.matches(df, bench, block_chars=chars).collect()}
        assert all(want[k] in got[k] for k in want) and not any(got[k] for k in got if k >= 1000)
    out = decontaminate.matches(odd.drop("hits"), bench)
    assert out.columns == [*odd.drop("hits").columns, "__hits"] and out.count() == odd.count()
    assert decontaminate.matches(odd, bench.limit(0)).where("size(__hits) > 0").count() == 0
    assert decontaminate.matches(empty, bench).count() == 0


def fewest_edits(item, text):
    """Least edit distance between the item and a stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for i, x in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (t != ord(x)))
        new = np.concatenate([[i], new])
        new = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        row = new
    return int(row.min())


def test_hits_are_those_of_aligning_everything(spark):
    """Items of all lengths, repeated ones and near misses: the very pairs within the budget, with their fewest edits, in one block and in many."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 3, 4, 5, 6, 8, 10, 12, 20, 30, 45])]
    items += [(3, items[3][1]), (50, "ab"), (51, "abcdefg"), (52, ""), (53, None), (54, "Ab  cd")]
    rows = []
    for k in range(160):
        t = list(rng.choice(items[:13])[1])
        for _ in range(rng.randint(0, 1 + len(t) // 7)):
            at = rng.randrange(len(t))
            t[at] = rng.choice(["", "z", t[at] + "y"])
        rows.append((k, " ".join(word() for _ in range(rng.randint(0, 12))) + " " + "".join(t) + " " + " ".join(word() for _ in range(rng.randint(0, 12)))))
    rows += [(200, "x ab cd y"), (201, "xab cdy ab"), (202, None), (203, "")]
    want = Counter()
    for d, t in rows:
        t = decontaminate.normalise(t or "")
        for i, x in items:
            x = decontaminate.normalise(x or "")
            if 0 < len(x) < 8:
                if f" {x} " in f" {t} ":
                    want[(d, i, 0)] += 1
            elif x and (e := fewest_edits(x, t)) <= len(x) // 10:
                want[(d, i, e)] += 1
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chars in (decontaminate.BLOCK_CHARS, 150):
        got = Counter((r["doc_id"], h["item_id"], h["edits"]) for r in decontaminate.matches(df, bench, block_chars=chars).collect() for h in r["__hits"])
        assert got == want
    assert len({i for _, i, _ in want}) > 10 and any(e > 2 for _, _, e in want)


def test_banded_alignment_is_edit_distance():
    rng = random.Random(2)
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    for _ in range(200):
        p, t = ("".join(rng.choice("ab") for _ in range(n)) for n in (rng.randint(1, 12), rng.randint(0, 25)))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        got = decontaminate.banded(code(p), code(t), -len(p), len(t), 50)
        assert got[0] == min(row)


# --- 9 -----------------------------------------------------------------------------------------------------------------------------


def test_quality_rejects_noise_and_keeps_prose(spark, odd, empty):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("aeioulrnst") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    prose = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(60, 200)))
    noise = lambda: " ".join("".join(rng.choice("#$%&xyz") for _ in range(6)) for _ in range(80))
    rows = [(i, noise() if i % 5 == 0 else prose(), "en") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in kneser_ney.quality(df, labels).collect()}
    assert sum(got[i] for i in got if i % 5) >= 0.98 * sum(1 for i in got if i % 5) and not any(got[i] for i in got if i % 5 == 0)
    some = kneser_ney.quality(odd, labels, rows_too=True).collect()
    assert len(some) == odd.count() and all(not r["keep"] for r in some if r["n_tokens"] == 0)
    assert kneser_ney.quality(empty, labels).count() == 0
    assert kneser_ney.quality(odd, labels.limit(0)).where("keep").count() == odd.where("trim(text) <> ''").where("doc_id <> 5 or doc_id is null").count()


def test_quality_rejects_toxic_words_in_clean_prose(spark):
    rng = random.Random(10)
    vocab = ["".join(rng.choice("aeioulrnst") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    prose = lambda: [rng.choice(vocab) for _ in range(rng.randint(60, 200))]
    rows = []
    for i in range(600):
        w = prose()
        if i % 6 == 0:
            for at in rng.sample(range(len(w)), 3):
                w[at] = rng.choice(["vile", "scum"])
        rows.append((i, " ".join(w), "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in kneser_ney.quality(df, labels).collect()}
    assert not any(got[i] for i in got if i % 6 == 0) and sum(got[i] for i in got if i % 6) >= 0.96 * sum(1 for i in got if i % 6)


def test_long_texts_train_whole():
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(9000)).encode()
    out = list(kneser_ney._trigrams(iter([pa.record_batch([pa.array([text])], names=["text"])])))
    assert sum(sum(b.column(3).to_pylist()) for b in out) == 9001


def slow_kneser_ney(texts_, words):
    """log10 P of words and an end by interpolated modified Kneser-Ney from plain counts; what was never seen shares the lowest order's rest."""
    tri, one = Counter(), lambda c: {k: sum(v == k for v in c.values()) for k in (1, 2, 3, 4)}
    for t in texts_:
        w = ["<s>", "<s>", *t.split(), "</s>"]
        tri.update(zip(w, w[1:], w[2:], strict=False))

    def cuts(c):
        n = one(c)
        if not n[1] or not n[2]:
            return lambda k: 0.5
        y = n[1] / (n[1] + 2 * n[2])
        raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2] if n[3] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] and n[4] else 1.5]
        held = [min(max(raw[0], 0.05), 0.95), min(max(raw[1], 0.05), 1.95), min(max(raw[2], 0.05), 2.95)]
        return lambda k: held[min(k, 3) - 1]

    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)
    d3, d2, d1 = cuts(tri), cuts(bi), cuts(uni)
    vocab = {w for _, _, w in tri} - {"</s>"}

    def level(table, context, w, cut, lower):
        held = {k[-1]: n for k, n in table.items() if k[:-1] == context}
        total = sum(held.values())
        if not total:
            return lower
        return (held[w] - cut(held[w]) if w in held else 0) / total + sum(map(cut, held.values())) / total * lower

    out, w = 0.0, ["<s>", "<s>", *words.split(), "</s>"]
    total = sum(uni.values())
    for u, v, x in zip(w, w[1:], w[2:], strict=False):
        lowest = (uni[x] - d1(uni[x]) if uni[x] else 0) / total + sum(map(d1, uni.values())) / total / (len(vocab) + 2)
        out += math.log10(level(tri, (u, v), x, d3, level(bi, (v,), x, d2, lowest)))
    return out


def test_probabilities_are_those_of_a_direct_computation(spark):
    rng = random.Random(31)
    text = lambda: " ".join(rng.choice("a b c d e f g hh ii jj kk ll".split()[: rng.randint(3, 12)]) for _ in range(rng.randint(0, 25)))
    train = [text() for _ in range(60)]
    m = kneser_ney.fit(spark.createDataFrame([(bytearray(t.encode()),) for t in train], "text binary"))
    asked = [text() for _ in range(40)] + ["", "zz", "a zz b", "zz zz a b c"]
    got = m.log10([t.encode().split() for t in asked])
    assert np.allclose(got, [slow_kneser_ney(train, t) for t in asked], rtol=1e-9)


def test_all_trusted_texts_of_the_training_half_train(spark):
    rows = [(i, f"some prose with own{i} word", "en") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    got = kneser_ney.quality(df, labels).where(kneser_ney.trains()).select(F.round("log10_perplexity", 9).alias("p")).collect()
    # every one has a word of its own, which the model knows in each of them
    assert len(got) > 2 * 450 and len({r["p"] for r in got}) == 1


@pytest.mark.parametrize("toxic", [0, 1])
def test_joined_counts_give_the_scores_of_the_broadcast_model(spark, monkeypatch, odd, empty, toxic):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("aeioulrnst") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None])) for i in range(400)] + [(7, "twice there", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0) * toxic) for i in range(300)], "doc_id long, quality int, toxic int")
    for docs in (df, odd, empty) if toxic else (df,):
        order = lambda q: sorted((tuple(r) for r in q.select("doc_id", "lang", "n_tokens", "log10_perplexity", "score", "threshold", "toxicity", "keep", F.col("__row.text")).collect()), key=lambda r: str((r[0], r[1], r[8])))
        monkeypatch.setattr(kneser_ney, "BROADCAST_TRIGRAMS", 1 << 20)
        whole = order(kneser_ney.quality(docs, labels, rows_too=True))
        monkeypatch.setattr(kneser_ney, "BROADCAST_TRIGRAMS", -1)
        joined = order(kneser_ney.quality(docs, labels, rows_too=True))
        assert len(whole) == len(joined) == docs.count()
        for a, b in zip(whole, joined, strict=True):
            assert (a[:3], a[7:]) == (b[:3], b[7:])
            assert all(x == y if x is None or y is None else x == pytest.approx(y, rel=1e-9, abs=1e-12) for x, y in zip(a[3:7], b[3:7], strict=True))


def test_many_languages_and_words_stay_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SAMPLE_ALL", 50)
    rows = [(i, f"w{i} common words here {i % 7}", f"l{i}") for i in range(300)] + [(1, "again", "l1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    assert kneser_ney.training_sample(df, kneser_ney.trusted(labels), 5).count() == 50
    assert kneser_ney.quality(df, labels).count() == 301
    m = kneser_ney.fit(df.select(F.col("text").cast("binary").alias("text")), most_words=20)
    assert len(m.vocab) == 20 and np.isfinite(m.log10([[b"common", b"words", b"w5"]])).all()


def test_kneser_ney_is_a_distribution(spark):
    texts_ = ["a b c a b d", "a b c", "c a b b", "d d a c"]
    df = spark.createDataFrame([(bytearray(t.encode()),) for t in texts_], "text binary")
    m = kneser_ney.fit(df, shards=3)
    words = [b"a", b"b", b"c", b"d"]

    def p(context, w):
        base = m.log10([context])[0]
        return m.log10([[*context, w]])[0] - base, base

    # P(next word or end | context): a sum over continuations of the probability of the text so far
    for context in ([], [b"a"], [b"a", b"b"], [b"zz", b"a"], [b"c", b"zz"]):
        end = m.log10([context])[0]
        ids = [*context]
        total = 0.0
        prefix = prefix_log(m, ids)
        for w in [*words, b"unknown"]:
            total += 10 ** (prefix_log(m, [*ids, w]) - prefix)
        total += 10 ** (end - prefix)
        assert math.isclose(total, 1.0, abs_tol=2e-2)


def prefix_log(m, words):
    """log10 P of the words without an end, from texts that go on: P(words) = P(words + end) / P(end | words), by the model's own parts."""
    full = m.log10([words])[0]
    ids = [kneser_ney.START, kneser_ney.START, *m.numbers(words).tolist()] if words else [kneser_ney.START, kneser_ney.START]
    u, v, w = ids[-2], ids[-1], kneser_ney.END
    bk, ba, bg, seen, cg = m.bi
    p = cg[v] * m.uni[w]
    i = np.searchsorted(bk, v << kneser_ney.BITS | w)
    if v and i < len(bk) and bk[i] == v << kneser_ney.BITS | w:
        p += ba[i]
    j = np.searchsorted(bk, u << kneser_ney.BITS | v)
    if u and v and j < len(bk) and bk[j] == u << kneser_ney.BITS | v:
        p *= bg[j]
        key = (u << kneser_ney.BITS | v) << kneser_ney.BITS | w
        t = np.searchsorted(m.tri[0], key)
        if t < len(m.tri[0]) and m.tri[0][t] == key:
            p += m.tri[1][t]
    return full - math.log10(p)


# --- 10 ----------------------------------------------------------------------------------------------------------------------------


def slow_print(t):
    w = WORD.findall(lower(t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_fingerprints(request, which):
    df = request.getfixturevalue(which)
    got = Counter((r["doc_id"], r["fingerprint"]) for r in simhash.near_duplicates(df).collect())
    rows = [(i, t) for i, t in texts(df) if len(t or "") < 4000]
    for i, t in rows:
        assert got[(i, f"{slow_print(t):016x}")] > 0
    assert sum(got.values()) == df.count()


def test_links_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(40):
        c = rng.getrandbits(64)
        fps.add(c)
        for _ in range(60):
            x = c
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 31) - 1}
    arr = np.array(sorted(fps), np.uint64)
    rows = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(rows)).collect()}
    parent = list(range(len(arr)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    want, have = defaultdict(set), defaultdict(set)
    for i, x in enumerate(arr.view(np.int64).tolist()):
        want[find(i)].add(x)
        have[roots.get(x, x)].add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    blank = {r["component_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert len(got) == odd.count() and blank == {3}
    alone = spark.createDataFrame([(None, "one two three")], "doc_id long, text string")
    assert simhash.near_duplicates(alone).first()["component_id"] is None
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_texts(spark, odd, empty):
    rng = random.Random(6)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(8, 400))]
        for k in range(rng.choice([1, 2, 3, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5, 20]) if k else 0):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i in parent}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [i for i in want if want[i] != got.get(i, i)]
    assert len(wrong) <= 0.01 * len(rows)
    some = simhash.near_groups(odd).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in some) == [(1, 1, True), (2, 1, False), (2, 1, False), (6, 6, False), (6, 6, True), (8, 8, True), (9, 8, False)]
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("copies, block, whole", [(600, 4 << 20, True), (600, 200_000, False), (3000, 1 << 20, True)])
def test_large_groups_have_the_components_of_all_pairs(spark, copies, block, whole, monkeypatch):
    """Copies of one text with 1 to 6 edits each, many of them similar to few others: the components are those of all pairs.

    Every edit puts in a word of its own, so that two copies share just those shingles of the original that neither has lost.
    """
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(copies)
    base = [f"w{i}" for i in range(200)]
    rows, kept = [], np.ones((copies, 196), np.float32)
    for i in range(copies):
        w = list(base)
        for at in rng.sample(range(200), rng.randint(1, 6)):
            w[at] = f"x{i}y{at}"
            kept[i, max(0, at - 4) : at + 1] = 0
        rows.append((copies - i if whole else i, " ".join(w)))
    both = kept @ kept.T
    linked = both >= 0.8 * (2 * 196 - both) - 1e-6
    np.fill_diagonal(linked, True)
    root = np.arange(copies)
    while True:
        new = np.array([root[linked[i]].min() for i in range(copies)])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    ids = np.array([i for i, _ in rows])
    want = {ids[i]: min(ids[root == root[i]]) for i in range(copies)}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want.values())) > 10
    assert {int(i): int(c) for i, c in want.items()} == {i: got.get(i, i) for i in ids.tolist()}


def test_hot_anchors_are_compared_in_cells(spark):
    """Thousands of fingerprints with one half in common: the links found in cells join what all pairs join."""
    rng = random.Random(8)
    fps = sorted({(rng.getrandbits(9) << 40) | 12345 | (rng.getrandbits(2) << 31) for _ in range(900)})
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    whole = {r["node"]: r["root"] for r in graph.components(simhash.links(rows)).collect()}
    cells = {r["node"]: r["root"] for r in graph.components(simhash.links(rows, cell_rows=64)).collect()}
    arr = np.array(fps, np.uint64)
    root = np.arange(len(arr))
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 2
    for _ in range(len(arr)):
        new = np.array([root[near[i]].min() for i in range(len(arr))])
        if (new == root).all():
            break
        root = new
    assert whole == cells == {fps[i]: fps[root[i]] for i in range(len(fps)) if near[i].sum() > 1}


@pytest.mark.parametrize("copies, block", [(100, 4 << 20), (300, 4096)])
def test_large_groups_whose_hub_is_not_the_first(spark, copies, block, monkeypatch):
    """One original and copies that are similar to it but hardly to each other: all are found, whatever the original's id."""
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng = random.Random(copies)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(copies + 1):
        w = list(base)
        for at in rng.sample(range(5, 195), 4) if i != copies // 2 else ():
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(5000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(200))) for i in range(20)]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(196)} for i, t in rows}
    hub = sets[copies // 2]
    linked = {i for i in range(copies + 1) if len(sets[i] & hub) >= 0.8 * len(sets[i] | hub)}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(linked) > 0.9 * copies and {got.get(i) for i in linked} == {min(linked)} and not any(i >= 5000 for i in got)
