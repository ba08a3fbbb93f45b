"""Connected regions of rasters: of small ones image by image, of large ones tile by tile and then across the tiles' edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import components as CO

BOX = pa.schema([("id", pa.int64()), ("x0", pa.int32()), ("y0", pa.int32()), ("x1", pa.int32()), ("y1", pa.int32())])
PIECE = pa.schema([("image", pa.int64()), ("node", pa.string()), ("x0", pa.int64()), ("y0", pa.int64()), ("x1", pa.int64()), ("y1", pa.int64()), ("cells", pa.int64()), ("edge", pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())])))])
PIECE_DDL = "image long, node string, x0 long, y0 long, x1 long, y1 long, cells long, edge array<struct<x: long, y: long>>"


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, column after the last, region) of each run of set cells, in reading order; a region is the number of its first run."""
    h, w = mask.shape
    wide = np.zeros((h, w + 2), np.int8)
    wide[:, 1:-1] = mask
    rows, begin = np.nonzero(np.diff(wide, axis=1) == 1)
    end = np.nonzero(np.diff(wide, axis=1) == -1)[1]
    parent = np.arange(len(rows))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    for y in range(h - 1):
        a, b = first[y], first[y + 1]
        while a < first[y + 1] and b < first[y + 2]:
            if begin[a] < end[b] and begin[b] < end[a]:
                u, v = top(a), top(b)
                parent[max(u, v)] = min(u, v)
            if end[a] <= end[b]:
                a += 1
            else:
                b += 1
    return rows, begin, end, np.array([top(i) for i in range(len(rows))], np.int64)


def connected_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (inclusive) of 4-connected regions of a mask, by their first cell in reading order."""
    rows, begin, end, region = runs_of(mask)
    return [(int(begin[k].min()), int(rows[k].min()), int(end[k].max()) - 1, int(rows[k].max())) for r in np.unique(region) for k in [np.flatnonzero(region == r)]]


def regions(images: DataFrame, width: int, threshold: float) -> DataFrame:
    """Of ``images(id, values array<float>)`` in rows of ``width``: a row for each region over the threshold."""
    ship(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *box) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if v for box in connected_boxes(np.array(v).reshape(-1, width) > threshold)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), BOX, strict=True)], schema=BOX)

    return images.mapInArrow(run, "id long, x0 int, y0 int, x1 int, y1 int")


def tiled_regions(tiles: DataFrame, side: int, threshold: float) -> DataFrame:
    """(image, x0, y0, x1, y1, cells) of each 4-connected region of rasters given as ``tiles(image, tx, ty, values)``, side x side cells each.

    A tile's own regions are found where it lies; only those that touch an edge of their tile go on, with their edge cells, and cells that lie
    next to each other across an edge link them. Regions are the components of these links. A tile's values are its rows one after another;
    a null or NaN value is not over the threshold, values that are missing at a tile's end are none, and a null tile, image or place is left
    out. Of tiles at one place the regions lie over each other.
    """
    ship(tiles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for image, tx, ty, values in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                cells = np.full(side * side, np.nan)
                cells[: len(values)] = np.array(values[: side * side], np.float64)
                rows, begin, end, region = runs_of((cells > threshold).reshape(side, side))
                for r in np.unique(region):
                    k = np.flatnonzero(region == r)
                    x, y = tx * side, ty * side
                    edge = {(c, int(rows[i])) for i in k for c in range(begin[i], end[i]) if rows[i] in (0, side - 1) or c in (0, side - 1)}
                    out.append((image, f"{image}:{ty}:{tx}:{r}", x + int(begin[k].min()), y + int(rows[k].min()), x + int(end[k].max()) - 1, y + int(rows[k].max()), int((end[k] - begin[k]).sum()), [{"x": x + int(c), "y": y + q} for c, q in sorted(edge)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), PIECE, strict=True)], schema=PIECE)

    known = tiles.where("image is not null and tx is not null and ty is not null and values is not null").select(*(F.col(c).cast("long").alias(c) for c in ("image", "tx", "ty")), "values")
    pieces = CO.kept(known.mapInArrow(run, PIECE_DDL), "raster-pieces")
    edges = pieces.select("image", "node", F.explode("edge").alias("c")).select("image", "node", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    beside = F.explode(F.array(F.struct((F.col("x") + 1).alias("x"), F.col("y").alias("y")), F.struct(F.col("x").alias("x"), (F.col("y") + 1).alias("y")))).alias("c")
    moved = edges.select("image", F.col("node").alias("other"), beside).select("image", "other", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    links = edges.join(moved, ["image", "x", "y"]).where("node <> other").select(F.col("node").alias("u"), F.col("other").alias("v")).distinct()
    whole = pieces.join(CO.components(links), "node", "left").groupBy("image", F.coalesce("root", "node").alias("root"))
    return whole.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("cells").alias("cells")).drop("root")
