"""The pipeline's stages: each against its rule, and all of them on odd tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quaystone.llm import kneser_ney, simhash, tokens


def test_run_ends_in_full_pieces(spark, sf):
    out = P.run(spark, sf).toPandas()
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and len(out)
    assert (out.groupby("sequence_id").length.sum() <= 1024).all()


def test_every_stage_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = P.common.materialize(stage(spark, docs, sf), "t")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in docs.collect()]
    assert len({hashlib.md5(t.encode()).digest() for t in norm}) == len(norm)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in " ".join(r["text"].lower().split()) for r in docs.collect() for i in items)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, sf, odd, k):
    name, stage = P.STAGES[k]
    out = stage(spark, odd, sf)
    if k < 4:
        assert out.columns == odd.columns
        assert 0 < out.count() <= odd.count()
        assert stage(spark, odd.limit(0), sf).count() == 0
    else:
        assert out.count() >= odd.count()


def test_exact_stage_keeps_one_of_repeated_rows(spark, sf, odd):
    left = P.exact(spark, odd, sf).select("doc_id", "text").collect()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in left]
    assert len(norm) == len(set(norm))
    assert odd.where(F.col("text").isNotNull()).count() > len(left)


def fewest_edits(item, text):
    """Least edit distance between the item and a stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for i, x in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (t != ord(x)))])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def made_rows():
    """Copies, near copies, benchmark passages and clean texts; ids that repeat and null ones."""
    rng = random.Random(77)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    rows = []
    for g in range(24):
        base = [word() for _ in range(rng.randint(20, 120))]
        for k in range(rng.choice([1, 2, 3])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 9]) if k else 0):
                w[rng.randrange(len(w))] = word()
            rows.append((None if len(rows) % 11 == 5 else 3 if len(rows) % 7 == 1 else len(rows), rng.choice([" ", "  ", "\n"]).join(w), "en"))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((3, 8, 20))]
    for i, t in items:
        rows.append((900 + i, " ".join(word() for _ in range(30)) + " " + t.replace("a", "A", 1) + " " + word(), "fr"))
    return rows, items


def held(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in df.collect())


def test_exact_near_and_decontaminating_stages_against_brute_force(spark, sf, tmp_path):
    rows, items = made_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = lambda r: (r[0] is None, r[0] or 0)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r)
    want = [min(g, key=lambda r: (-len(r[1]), *key(r))) for g in groups.values()]
    assert held(P.exact(spark, df, sf)) == sorted((-1 if r[0] is None else r[0], r[1]) for r in want) and len(want) < len(rows)

    sets = []
    for _, t, _ in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    kept = [min((rows[i] for i in range(len(rows)) if root[i] == g), key=key) for g in set(root)]
    got = held(P.near(spark, df, sf))
    # of rows that share the smallest id, any one may stay
    assert [i for i, _ in got] == sorted(-1 if r[0] is None else r[0] for r in kept)
    where = {}
    for i, r in enumerate(rows):
        where.setdefault((-1 if r[0] is None else r[0], r[1]), set()).add(root[i])
    assert len(set().union(*(where[x] for x in got))) == len(got) == len(set(root)) < len(rows)

    flat = lambda t: " ".join(t.lower().split())
    clean = [r for r in rows if not any(fewest_edits(flat(x), flat(r[1])) <= len(flat(x)) // 10 for _, x in items)]
    assert held(P.decontaminated(spark, df, str(tmp_path))) == sorted((-1 if r[0] is None else r[0], r[1]) for r in clean) and len(clean) == len(rows) - 3


def test_quality_and_packing_stages_apply_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = kneser_ney.quality(docs.select("doc_id", "text", "lang"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(r["doc_id"] for r in found.where("keep").collect()) == sorted(r["doc_id"] for r in P.quality(spark, docs, sf).collect())
    enc = tokens.encoder(tokens.default_path())
    sizes = {r["doc_id"]: r["n"] for r in P.packed(spark, docs, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sizes == {r["doc_id"]: len(enc.whole(r["text"] or "")) // 4 + 1 for r in docs.collect()}


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_columns_of_any_name(spark, sf, odd, k):
    names = ["__r", "__hits", "a.b", "__row", "keep", "x`y", "best", "component_id", "doc"]
    rows = odd.select("doc_id", "text", "lang", *(F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names))
    out = P.STAGES[k][1](spark, rows, sf)
    if k < 4:
        assert out.columns == rows.columns
        kept = out.collect()
        assert kept and all(r[3 + i] == f"{n} {'none' if r['doc_id'] is None else r['doc_id']}" for r in kept for i, n in enumerate(names))
    else:
        assert out.count() >= rows.count()


def test_near_stage_links_near_fingerprints(spark, sf):
    """Texts whose SimHash agrees while they share few distinct shingles: the covering links them, similarity alone does not."""
    same = " ".join(["a b c d e"] * 300)
    rows = [(i, f"{same} " + " ".join(f"w{i}x{k}" for k in range(40))) for i in (5, 4, 9)] + [(1, "quite another text of some words"), (2, ""), (3, None)]
    prints = [simhash.fingerprint(t.encode()) for _, t in rows[:3]]
    assert all((x ^ y).bit_count() <= 2 for x in prints for y in prints)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in P.near(spark, df, sf).collect()) == [1, 2, 3, 4]
    assert simhash.near_groups(df).count() == 0
