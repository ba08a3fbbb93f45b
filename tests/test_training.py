"""Sequences, batches, held-out loss and separation, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaystone.operators import training as T


def examples(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "id long, prompt string, answer string, ids string, width int")


ODD = [(1, "Q: a\nA: ", "été"), (None, None, "x"), (2, "Q", None), (2, None, None), (3, "", ""), (4, "p" * 300, "a"), (5, "p" * 250, "a" * 6), (6, "p" * 250, "a" * 7), (7, "x", "\x00\U0001f600"), (7, "x", "\x00\U0001f600")]


def test_sequences_of_bytes(spark):
    got = sorted(((str(r.id), r.dropped, r.ids, r["labels"]) for r in T.encode_mask(examples(spark, ODD)).collect()), key=str)
    want = []
    for i, p, a in ODD:
        ids = [b + 7 for b in ((p or "") + (a or "")).encode()]
        n = len((p or "").encode())
        why = "too long" if len(ids) > 256 else "all masked" if n == len(ids) else None
        want.append((str(i), why, None if why else ids, None if why else [-100] * n + ids[n:]))
    assert got == sorted(want, key=str)
    assert T.encode_mask(examples(spark, [])).count() == 0


def test_sequences_by_a_public_vocabulary(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quaystone.plans import q_training

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = q_training.examples(spark, sf)
    made = {r.id: r for r in T.encode_mask(rows, path).collect()}
    for r in rows.collect():
        p, w = r.prompt or "", (r.prompt or "") + (r.answer or "")
        ids, n = t.encode(w, add_special_tokens=False).ids, len(t.encode(p, add_special_tokens=False).ids)
        m = made[r.id]
        if len(ids) > 256 or n >= len(ids):
            assert m.ids is None and m.dropped == ("too long" if len(ids) > 256 else "all masked")
        else:
            assert m.ids == ids and m["labels"] == [-100] * n + ids[n:]


def test_batches_are_bounded_and_of_one_width(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 10)
    rng = np.random.default_rng(2)
    rows = [(int(i), [1] * int(n), [1] * int(n)) for i, n in zip(rng.permutation(300), rng.choice([3, 8, 9, 20], 300, p=[0.6, 0.2, 0.1, 0.1]), strict=True)]
    rows += [(None, [1, 2], [1, 2]), (5, [9], [9]), (5, [9], [9]), (1, None, None)]
    df = spark.createDataFrame(rows, "id long, ids array<int>, labels array<int>")
    got = T.padded(T.batches(df, size=7)).collect()
    assert len(got) == len(rows) - 1
    by = {}
    for r in got:
        assert len(r.ids) == len(r["labels"]) == r.width and r.width % 8 == 0
        by.setdefault((r.width, r.batch), []).append(r.id)
    for (w, b), ids in by.items():
        last = max(x for v, x in by if v == w)
        assert len(ids) == 7 or b == last
        assert b == last or max(i or -1 for i in ids) <= min(i or 10**9 for i in by[w, b + 1] if i is not None)
    assert T.batches(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [3, 1024])
def test_loss_and_accuracy_do_not_overflow(spark, monkeypatch, most):
    monkeypatch.setattr(T, "LIST", most)
    rng = np.random.default_rng(4)
    z = rng.normal(0, 900, (4, 6, 11)).round(1)
    z[0, 0, 3:6] = z[0, 0].max() + 5
    lab = rng.integers(0, 11, (4, 7))
    lab[:, 2] = -100
    lab[1, 4], lab[0, 1] = z[1, 3].argmax(), 3
    logits = [(s, p, c, float(z[s, p, c])) for s in range(4) for p in range(6) for c in range(11)] + [(9, 0, 0, 1.0), (0, 5, 99, None)]
    labels = [(s, p, int(lab[s, p]), s % 2) for s in range(4) for p in range(7)] + [(8, 1, 2, 0), (0, 9, 1, 0), (9, 1, 7, 0)]
    frame = (spark.createDataFrame(logits, "seq long, position long, class int, logit double"), spark.createDataFrame(labels, "seq long, position long, label int, kind int"))
    got = {r.kind: r for r in T.held_out(*frame, ["kind"]).collect()}
    for kind in (0, 1):
        loss, hits = [], []
        for s in range(kind, 4, 2):
            for p in range(6):
                if lab[s, p + 1] != -100:
                    x = z[s, p]
                    loss.append(x.max() + math.log(np.exp(x - x.max()).sum()) - x[lab[s, p + 1]])
                    hits.append(x.argmax() == lab[s, p + 1])
        assert got[kind].positions == len(loss) and got[kind].loss == pytest.approx(np.mean(loss)) and got[kind].accuracy == pytest.approx(np.mean(hits))


def auc(rows):
    right, wrong = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in right for b in wrong) / (len(right) * len(wrong))


@pytest.mark.parametrize("parts", [2, 256])
def test_area_under_the_curve_with_ties(spark, parts):
    rng = np.random.default_rng(6)
    rows = [(float(s), int(y)) for s, y in zip(rng.integers(0, 30, 200) / 7, rng.integers(0, 2, 200), strict=True)] + [(1e9, 1), (-1e9, 0)]
    odd = [(None, 1), (0.5, None), (math.nan, 1)]
    got = T.separation(spark.createDataFrame(rows + odd, "score double, y int"), parts).first()
    right, wrong = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert got.n == len(rows) and got.auc == pytest.approx(auc(rows)) and got.separation == pytest.approx(np.mean(right) - np.mean(wrong)) and got.base_rate == pytest.approx(len(right) / len(rows))


@pytest.mark.parametrize("rows, n", [([], 0), ([(1.0, 1)], 1), ([(1.0, 0), (1.0, 0)], 2)])
def test_separation_where_one_kind_is_missing(spark, rows, n):
    got = T.separation(spark.createDataFrame(rows, "score double, y int")).first()
    assert got.n == n and got.auc is None and got.separation is None


def test_the_head_separates_what_it_has_not_seen(spark, sf):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(0, 1, 5) + (i % 2) * 2).tolist(), i % 2) for i in range(400)]
    v = spark.createDataFrame(rows, "id long, x array<double>, label int")
    scored = T.centroid_head(v, "x", F.col("label"), F.col("id") < 200)
    assert scored.count() == 200 and T.separation(scored).first().auc > 0.95
