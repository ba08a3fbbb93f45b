"""Components of links, and regions across tiles, against plain versions."""

import numpy as np
import pytest

from quaystone.operators import components, ocr


def plain(mask):
    """Boxes and cell counts of 4-connected regions by a flood."""
    left, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)}, []
    while left:
        todo, cells = [min(left)], set()
        while todo:
            c = todo.pop()
            if c in left:
                left.remove(c)
                cells.add(c)
                todo += [(c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)]
        ys, xs = zip(*cells, strict=True)
        out.append((min(xs), min(ys), max(xs), max(ys), len(cells)))
    return sorted(out)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_runs_and_tiles_give_the_regions_of_the_whole(spark, share):
    rng = np.random.default_rng(int(share * 10))
    images = rng.random((2, 24, 24)) < share
    images[1, 3] = True  # one line through all tiles
    assert [sorted(b[:4] for b in plain(m)) == sorted(ocr.connected_boxes(m)) for m in images] == [True, True]
    tiles = [(i, x, y, [float(v) for v in images[i, 4 * y : 4 * y + 4, 4 * x : 4 * x + 4].ravel()], 1) for i in range(2) for x in range(6) for y in range(6)]
    df = spark.createDataFrame(tiles, "image long, tx int, ty int, values array<double>, x0 int")
    got = ocr.tiled_regions(df, 4, 0.5).collect()
    for i in range(2):
        assert sorted((r.x0, r.y0, r.x1, r.y1, r.cells) for r in got if r.image == i) == plain(images[i])


def test_tiles_with_gaps(spark):
    rows = [(1, 0, 0, [1.0, None, float("nan"), 1.0]), (1, 1, 0, [None]), (1, None, 0, [1.0]), (2, 0, 0, None), (1, 0, 1, [0.0, 1.0]), (1, 5, 5, [])]
    df = spark.createDataFrame(rows, "image long, tx int, ty int, values array<double>")
    assert sorted(tuple(r)[1:] for r in ocr.tiled_regions(df, 2, 0.5).collect()) == [(0, 0, 0, 0, 1), (1, 1, 1, 2, 2)]
    assert ocr.tiled_regions(df.limit(0), 2, 0.5).count() == 0


def test_components_of_chains_stars_and_odd_links(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 60)] + [(900, 900), (None, 3), (3, None), (7, 6), (7, 6)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500 + i: 500 for i in range(60)} | {900: 900}
