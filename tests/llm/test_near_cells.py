"""Cells of near copies: the links of all pairs, found without comparing all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quaystone.llm import simhash as S


def cell(sets, block, root, i, j, k):
    n = len(sets)
    return pa.table({"bucket": [0] * n, "i": [i] * n, "j": [j] * n, "k": [k] * n, "block": list(map(int, block)), "doc": list(range(n)), "root": list(map(int, root)), "shingles": [x.tobytes() for x in sets]})


def components(root, links):
    parent = {int(c): int(c) for c in root}

    def top(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for u, v in links:
        parent[top(int(root[u]))] = top(int(root[v]))
    return [top(int(c)) for c in root]


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("i, j", [(0, 1), (0, 2), (1, 2), (1, 3)])
def test_components_are_those_of_all_pairs(seed, i, j):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 60, rng.integers(3, 25)) for _ in range(8)]
    sets = []
    for _ in range(60):
        b = base[rng.integers(8)].copy()
        m = rng.integers(0, 3)
        b[rng.integers(0, len(b), m)] = rng.integers(0, 60, m)
        sets.append(np.unique(b).astype(np.uint64))
    block, root = rng.choice([i, j], len(sets)), rng.integers(0, len(sets), len(sets))
    got = S._cell(cell(sets, block, root, i, j, 2), 0.8)
    jaccard = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    pairs = [(x, y) for x in range(len(sets)) if block[x] == i for y in range(len(sets)) if (j == 2 or block[y] == j) and jaccard(sets[x], sets[y]) >= 0.8 - 1e-9]
    a, b = components(root, pairs), components(root, zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    assert all((a[x] == a[y]) == (b[x] == b[y]) for x in range(len(a)) for y in range(x))


def test_texts_of_one_template_are_not_compared(monkeypatch):
    rng = random.Random(1)
    page = [f"t{i}" for i in range(30)]

    def text():
        words = list(page)
        for _ in range(6):
            words.insert(rng.randrange(len(words)), f"own{rng.randrange(10**9)}")
        return " ".join(words).encode()

    sets = [S.shingle_set(text(), 5) for _ in range(1500)]
    compared = []
    plain = np.add.reduceat
    monkeypatch.setattr(S.np, "add", type("Add", (), {"reduceat": staticmethod(lambda x, at: (compared.append(len(at)), plain(x, at))[1])}))
    assert S._cell(cell(sets, [0] * 1500, range(1500), 0, 1, 1), 0.8).num_rows == 0
    assert sum(compared) < 1500
