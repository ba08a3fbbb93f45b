"""Token counts that follow edits: a segment tree over the pre-tokens of a document.

A byte-level BPE never merges across pre-tokens, so a count is a sum over pre-tokens. An edit changes only pre-tokens that it touches and a
few around them: scanning starts at a pre-token that ends at least LOOK characters before the edit (the pattern looks no farther ahead), and
stops where a boundary after the edit falls on an old one, since from a boundary on the pattern knows nothing of what came before.

Trees are kept as a table: a text, its pre-tokens' lengths and token counts in leaves, and the sums above them. A batch of edits reads a tree,
unpacks only the leaves that it touches, and can give back the tree as it is then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

LEAF, LOOK = 64, 3
TREE = [("text", pa.string()), ("lens", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("leaves", pa.list_(pa.int32())), ("chars", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))]
TREES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *TREE])
TREES_DDL = "row long, doc_id long, text string, lens array<int>, counts array<int>, leaves array<int>, chars array<long>, sums array<long>"
COUNTS = pa.schema([("doc_id", pa.int64()), ("tokens_before", pa.int64()), ("tokens_after", pa.int64()), ("pieces", pa.int64()), ("pieces_encoded", pa.int64()), ("edits", pa.int32())])


class PieceTree:
    """Pre-tokens in leaves of about LEAF, and sums of characters and tokens in a tree of arrays above them."""

    def __init__(self, pieces: list[str], encoder: tokens.Encoder):
        self.encoder = encoder
        self._build(pieces, [len(encoder[p]) // 4 for p in pieces])
        self.encoded = len(pieces)

    @classmethod
    def of(cls, text: str, encoder: tokens.Encoder) -> PieceTree:
        return cls([text[a:b] for a, b in encoder.spans(text)], encoder)

    @classmethod
    def load(cls, encoder: tokens.Encoder, text: str, lens: np.ndarray, counts: np.ndarray, leaves: np.ndarray, chars: np.ndarray, sums: np.ndarray) -> PieceTree:
        """A stored tree; its leaves are unpacked when they are asked for."""
        tree = cls.__new__(cls)
        tree.encoder, tree.encoded = encoder, 0
        tree.leaves, tree.sizes, tree.width = [None] * len(leaves), leaves.tolist(), len(chars) // 2
        tree.chars, tree.sums = chars.tolist(), sums.tolist()
        place = chars[tree.width : tree.width + len(leaves)]
        tree.stored = text, lens, counts, np.cumsum(leaves) - leaves, np.cumsum(place) - place
        return tree

    def dump(self) -> tuple[str, list[int], list[int], list[int], list[int], list[int]]:
        every = [self.leaf(i) for i in range(len(self.leaves))]
        return self.text(), [len(x) for p, _ in every for x in p], [x for _, c in every for x in c], self.sizes, self.chars, self.sums

    def leaf(self, i: int) -> tuple[list[str], list[int]]:
        if self.leaves[i] is None:
            text, lens, counts, first, place = self.stored
            a, n, at = int(first[i]), self.sizes[i], int(place[i])
            edge = [at, *(at + np.cumsum(lens[a : a + n])).tolist()]
            self.leaves[i] = [text[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)], counts[a : a + n].tolist()
        return self.leaves[i]

    def _build(self, pieces: list[str], counts: list[int]) -> None:
        self.leaves = [(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])]
        self.sizes = [0] * len(self.leaves)
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.width), [0] * (2 * self.width)
        for i in range(len(self.leaves)):
            self._leaf(i)
        for i in range(self.width - 1, 0, -1):
            self._node(i)

    def _leaf(self, i: int) -> None:
        pieces, counts = self.leaves[i]
        self.sizes[i] = len(pieces)
        self.chars[self.width + i], self.sums[self.width + i] = sum(map(len, pieces)), sum(counts)

    def _node(self, i: int) -> None:
        self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def count(self) -> int:
        return self.sums[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def size(self) -> int:
        return sum(self.sizes)

    def text(self) -> str:
        return "".join(x for i in range(len(self.leaves)) for x in self.leaf(i)[0])

    def find(self, place: int) -> tuple[int, int, int]:
        """Leaf and index of the pre-token that holds the character at ``place``, and where it starts."""
        node, at = 1, 0
        while node < self.width:
            node *= 2
            if place >= at + self.chars[node]:
                at += self.chars[node]
                node += 1
        leaf = min(node - self.width, len(self.leaves) - 1)
        pieces = self.leaf(leaf)[0]
        for i, p in enumerate(pieces):
            if place < at + len(p):
                return leaf, i, at
            at += len(p)
        return leaf, len(pieces), at

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace the characters [start, end) by ``text``; places beyond the document count as its end."""
        start, end = min(max(start, 0), self.length), min(max(end, start, 0), self.length)
        first, i, base = self.find(max(0, start - LOOK)) if start >= LOOK else (0, 0, 0)
        last, old = first, list(self.leaf(first)[0][i:])
        held = sum(map(len, old))
        while True:
            whole = last + 1 == len(self.leaves)
            if whole or base + held >= end + 64:
                local = "".join(old)
                local = local[: start - base] + text + local[end - base :]
                done = self._rescan(local, old, start - base + len(text), end - base, whole)
                if done:
                    break
            last += 1
            old += self.leaf(last)[0]
            held += sum(map(len, self.leaf(last)[0]))
        fresh, kept = done
        self.encoded += len(fresh)
        rest = len(old) - kept
        pieces, counts = self.leaf(first)[0][:i] + fresh, self.leaf(first)[1][:i] + [len(self.encoder[p]) // 4 for p in fresh]
        if kept:
            tail = [c for k in range(first, last + 1) for c in (self.leaf(k)[1][i:] if k == first else self.leaf(k)[1])]
            pieces, counts = pieces + old[rest:], counts + tail[rest:]
        span = last - first + 1
        step = max(1, -(-len(pieces) // span))
        if step > 4 * LEAF:
            every = [(self.leaf(k) if k < first or k > last else ((pieces, counts) if k == first else ([], []))) for k in range(len(self.leaves))]
            self._build([x for p, _ in every for x in p], [x for _, c in every for x in c])
            return
        touched = set()
        for k in range(span):
            self.leaves[first + k] = (pieces[k * step : (k + 1) * step], counts[k * step : (k + 1) * step])
            self._leaf(first + k)
            touched.add((self.width + first + k) // 2)
        while touched and touched != {0}:
            for node in touched:
                self._node(node)
            touched = {node // 2 for node in touched if node > 1}

    def _rescan(self, local: str, old: list[str], new_end: int, old_end: int, whole: bool) -> tuple[list[str], int] | None:
        """New pre-tokens up to the first boundary that falls on an old one after the edit, and how many old ones stay; None: look farther."""
        bounds, at = {}, 0
        for k, p in enumerate(old):
            if at >= old_end:
                bounds[at - old_end + new_end] = len(old) - k
            at += len(p)
        fresh: list[str] = []
        for start, end in self.encoder.spans(local):
            if start >= new_end and start in bounds:
                return fresh, bounds[start]
            if not whole and end + LOOK > len(local):
                return None
            fresh.append(local[start:end])
        return (fresh, 0) if whole else None


def _lists(found: list, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in found]), pa.int32()), pa.array(np.concatenate([np.asarray(x, np.int64) for x in found]), kind))


def plant(text: str, counts: Counts) -> tuple[np.ndarray, ...]:
    """What is stored of a text's tree: lengths and token counts of its pre-tokens, sizes of its leaves, and the sums above them."""
    spans = counts.encoder.spans(text) if tokens.UNSURE.search(text) else None
    pieces = [text[a:b] for a, b in spans] if spans else tokens.PRETOKEN.findall(text)
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    found = np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces))
    first = np.arange(0, max(1, len(pieces)), LEAF)
    width = 1 << (len(first) - 1).bit_length()
    sums = []
    for x in (lens, found):
        level = np.zeros(2 * width, np.int64)
        if len(x):
            level[width : width + len(first)] = np.add.reduceat(x, first)
        at = width
        while at > 1:
            level[at // 2 : at] = level[at : 2 * at : 2] + level[at + 1 : 2 * at : 2]
            at //= 2
        sums.append(level)
    return lens, found, np.diff(np.append(first, len(pieces))), *sums


class Counts(dict):
    """Token counts of pre-tokens, kept as the encoder keeps their ids."""

    def __init__(self, encoder: tokens.Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        n = len(self.encoder.encode(piece)) // 4
        if len(piece) <= tokens.LONGEST:
            if len(self) >= tokens.CACHE:
                self.clear()
            self[piece] = n
        return n


def _plant(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counts = Counts(tokens.encoder(path))
    for b in batches:
        for at in range(0, len(b), 256):
            part = b.slice(at, 256)
            planted = [plant(t, counts) for t in part.column(2).to_pylist()]
            lists = [_lists([d[k - 1] for d in planted], f[1].value_type) for k, f in enumerate(TREE) if k]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *lists], schema=TREES)


def _edit(batches: Iterator[pa.RecordBatch], path: str, trees_too: bool) -> Iterator[pa.RecordBatch]:
    """Columns: a stored tree, then its edits."""
    enc = tokens.encoder(path)
    for b in batches:
        for at in range(0, len(b), 256):
            out, dumped = [], []
            part = b.slice(at, 256)
            arrays = []
            for k in range(3, 8):
                flat, ends = part.column(k).values.to_numpy(), part.column(k).offsets.to_numpy().tolist()
                arrays.append([flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)])
            for row, doc, text, given, *stored in zip(*(part.column(k).to_pylist() for k in (0, 1, 2, 8)), *arrays, strict=True):
                tree = PieceTree.load(enc, text, *stored)
                edits = [(e["start"] or 0, e["end"] or 0, e["text"] or "") for e in given or [] if e is not None]
                before, after = tree.count, text
                for s, e, t in edits:
                    tree.edit(s, e, t)
                    s = min(max(s, 0), len(after))
                    after = after[:s] + t + after[max(s, min(e, len(after))) :]
                if enc.special(text) or enc.special(after):
                    out.append((doc, len(enc.whole(text)) // 4, len(enc.whole(after)) // 4, None, None, len(edits)))
                else:
                    out.append((doc, before, tree.count, tree.size, tree.encoded, len(edits)))
                if trees_too:
                    dumped.append((row, doc, *tree.dump()))
            if trees_too:
                cols = list(zip(*dumped, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), *(_lists(cols[2 + k], f[1].value_type) for k, f in enumerate(TREE) if k)], schema=TREES)
            else:
                yield common.batch(COUNTS, **dict(zip(COUNTS.names, zip(*out), strict=True)))


def trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The segment trees of ``docs(doc_id, text)``, one row for each row, as a written table; ``row`` is a number of its own."""
    path = path or tokens.default_path()
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    return common.materialize(common.arrow_map(rows, lambda it: _plant(it, path), TREES_DDL), "edit-trees")


EDITS_DDL = "array<struct<start: long, end: long, text: string>>"


def apply_edits(kept: DataFrame, path: str | None = None, trees_too: bool = False) -> DataFrame:
    """Apply ``edits`` to ``kept``, trees with a column of that name: token counts before and after, or (trees_too) the trees after them.

    The counts are doc_id, tokens_before, tokens_after, pieces, pieces_encoded (how many pre-tokens had to be encoded anew) and edits.
    """
    path = path or tokens.default_path()
    rows = kept.select(*TREES.names, F.col("edits").cast(EDITS_DDL).alias("edits"))
    shape = TREES_DDL if trees_too else "doc_id long, tokens_before long, tokens_after long, pieces long, pieces_encoded long, edits int"
    return common.arrow_map(rows, lambda it: _edit(it, path, trees_too), shape)


def edited_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Of ``docs(doc_id, text, edits array<struct<start, end, text>>)``, token counts before and after the edits, applied in order.

    Places are characters of the text as the edits before have left it; a place beyond it is its end, an end before its start is its start.
    Null text is empty, null edits are none, null fields of an edit are 0 or ''. Where a special token's spelling is in the text, before
    or after, both are encoded whole (pieces and pieces_encoded are null). Other columns are ignored; one row per row; an empty table gives
    no rows.
    """
    # the edits travel with the row that they belong to: ids may repeat
    rows = docs.select("doc_id", "text", F.col("edits").cast(EDITS_DDL).alias("edits"))
    path = path or tokens.default_path()
    common.bound_batches(docs.sparkSession)
    planted = rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), common.text_or_empty().alias("text"), "edits")
    kept = common.materialize(common.arrow_map(planted, lambda it: _plant_with(it, path), TREES_DDL + f", edits {EDITS_DDL}"), "edit-trees")
    return apply_edits(kept, path)


def _plant_with(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Trees, with the column after the text carried along."""
    for b in batches:
        at = 0
        for t in _plant(iter([b]), path):
            yield pa.RecordBatch.from_arrays([*t.columns, b.column(3).slice(at, len(t))], schema=t.schema.append(b.schema.field(3)))
            at += len(t)


#: What the edits of the query put in; chosen to join, split and start pre-tokens.
INSERTS = ("", " edited", "\n\n", "n't ", "42", " ", "'s", "###")
EDITS = 4


def with_edits(docs: DataFrame) -> DataFrame:
    """A script of EDITS edits for each document, drawn from its id: up to 31 characters are replaced by one of INSERTS."""
    draw = "crc32(cast(concat(coalesce(cast(doc_id as string), ''), ':', j) as binary))"
    start = f"pmod({draw}, char_length(coalesce(text, '')) + 1)"
    choices = ", ".join("'" + x.replace("\n", "\\n").replace("'", "\\'") + "'" for x in INSERTS)
    edit = f"named_struct('start', {start}, 'end', {start} + shiftright({draw}, 5) % 32, 'text', element_at(array({choices}), cast(shiftright({draw}, 11) % {len(INSERTS)} as int) + 1))"
    return docs.withColumn("edits", F.expr(f"transform(sequence(1, {EDITS}), j -> {edit})"))


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_edits(with_edits(trees(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))))
