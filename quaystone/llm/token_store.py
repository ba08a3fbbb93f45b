"""Token ids in binary files: one zstandard frame for each document, a shared dictionary trained on id arrays, an offset index in each file.

A store is a folder with ``dictionary`` (one file, the trained dictionary) and ``shards``. A shard holds consecutive documents in ascending
order of doc_id:

    magic, part u32, number in the part u32, bytes of an id u8, sha256 of the dictionary, documents u64, ids of the part before it u64
    the documents' frames
    doc_ids i64, null marks u8, offsets u64 (one more than documents), numbers of ids u64
    offset of the index u64, trailer

A shard's parts and numbers give the order of all shards. One document is read by the index alone: its frame is found by offset, and no
other is decompressed.
"""

from __future__ import annotations

import array
import bisect
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: About as many bytes of frames are in a shard; a larger document has one of its own.
SHARD_BYTES = 8 << 20
#: The dictionary is trained on at most so many documents, none of more bytes of text than that; it has at most so many bytes.
SAMPLE_DOCS, SAMPLE_TEXT_BYTES, DICT_BYTES = 512, 16 << 10, 112 << 10
LEVEL = 3
MAGIC, TRAILER = b"QSIDS001", "\nQSIDEND"
HEAD = struct.Struct("<8sIIB32sQQ")
#: The published pre-tokenisation pattern of the word vocabulary, and its normalisers.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]
#: Characters on which two Unicode versions or two libraries' classes could differ, and the start of a special token.
UNSURE = regex.compile("[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧]|<\\|")
END_OF_WORD = b"\xff"
#: Most words and pieces in a worker's caches, and the longest that is kept.
CACHE, LONGEST = 400_000, 64

FRAMES = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])
BLOB = pa.schema([("blob", pa.binary())])
READ = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
PLACE = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64())])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Cache(dict):
    """What ``make`` gives for a key, kept for at most CACHE keys of at most LONGEST characters."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[key] = out
        return out


def fast_words(path: str):
    """The file's merges in tiktoken, if its merges are in the order of its ids; else None.

    The end of a word is a byte of its own there, one that no UTF-8 text has: the tokens of a last character with its end come before all
    merges in the file, so that byte is merged first.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in pairs]
    if not suffix or made != list(range(512, 512 + len(made))):
        return None
    of = tokens.byte_alphabet()
    raw = lambda t: bytes(of[c] for c in t.removesuffix(suffix)) + (END_OF_WORD if t.endswith(suffix) else b"")
    ranks = {raw(t): i for t, i in vocab.items() if i < 512 + len(made)}
    if len(ranks) != 512 + len(made):
        return None
    return tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})._core_bpe


class WordEncoder:
    """Serialised ids of texts.

    Where the file has the published normalisers and pattern, a text is cut at spaces, which no word crosses; each piece is looked up, a new
    piece is put together from its words, and a new word goes through the faster of the two public libraries, on the vocabulary of that very
    file, where its merges allow that. A text with an unsure character goes through the tokenizer whole, and so does every text of a file
    that is built otherwise.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        splits = [p.get("pattern", {}).get("Regex") for p in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        kinds = [n["type"] for n in (made.get("normalizer") or {}).get("normalizers", [])]
        self.known = splits[:1] == [WORDS] and kinds == NORMALISERS and made.get("post_processor") is None
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        fast, form = fast_words(path), "H" if self.kind.itemsize == 2 else "I"
        word = self.whole if fast is None else lambda w: array.array(form, fast.encode_single_piece(w.encode() + END_OF_WORD)).tobytes()
        words, find = Cache(word), regex.compile(WORDS).findall
        self.pieces = Cache(lambda piece: b"".join(map(words.__getitem__, find(piece))))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.known or UNSURE.search(text):
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, text.lower().split()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def train(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary for serialised id arrays. Samples too few or too small to train on serve as its content; none give an empty one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int, raw: bytes) -> Iterator[pa.RecordBatch]:
    enc, shared = encoder(path), _dictionary(raw)
    if shared:
        shared.precompute_compress(level=LEVEL)
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
    last = np.array([end], enc.kind).tobytes()
    for b in batches:
        ids = [enc.encode(t) + last for t in b.column(1).to_pylist()]
        yield common.batch(FRAMES, doc_id=b.column(0), tie=b.column(2), n_tokens=[len(x) // enc.kind.itemsize for x in ids], frame=[squeeze.compress(x) for x in ids])


def shard(part: int, number: int, width: int, sha: bytes, first: int, rows: list[tuple[int | None, int, bytes]]) -> bytes:
    """A shard without its trailer, of rows (doc_id, number of ids, frame)."""
    docs, counts, frames = zip(*rows, strict=True)
    offsets = HEAD.size + np.cumsum([0, *map(len, frames)], dtype="<u8")
    index = np.array([d or 0 for d in docs], "<i8").tobytes() + bytes(d is None for d in docs) + offsets.tobytes() + np.array(counts, "<u8").tobytes()
    return b"".join([HEAD.pack(MAGIC, part, number, width, sha, len(rows), first), *frames, index, struct.pack("<Q", int(offsets[-1]))])


def _shards(batches: Iterator[pa.RecordBatch], width: int, sha: bytes, most: int) -> Iterator[pa.RecordBatch]:
    """Shards of a task's rows, which come in order."""
    part, number, first, ids, size, held = TaskContext.get().partitionId(), 0, 0, 0, 0, []
    for b in batches:
        for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if held and size + len(row[2]) > most:
                yield common.batch(BLOB, blob=[shard(part, number, width, sha, first, held)])
                number, first, size, held = number + 1, ids, 0, []
            held.append(row)
            ids, size = ids + row[1], size + len(row[2])
    if held:
        yield common.batch(BLOB, blob=[shard(part, number, width, sha, first, held)])


class Shard:
    """A shard's content, read by its index."""

    def __init__(self, blob: bytes, raw: bytes):
        magic, self.part, self.number, width, sha, n, self.first = HEAD.unpack_from(blob)
        if magic != MAGIC or not blob.endswith(TRAILER.encode()):
            raise ValueError("not a shard of token ids")
        if sha != hashlib.sha256(raw).digest():
            raise ValueError("the shard was written with another dictionary")
        at = struct.unpack_from("<Q", blob, len(blob) - len(TRAILER) - 8)[0]
        docs = np.frombuffer(blob, "<i8", n, at).tolist()
        self.docs = [None if null else d for d, null in zip(docs, blob[at + 8 * n : at + 9 * n], strict=True)]
        self.offsets = np.frombuffer(blob, "<u8", n + 1, at + 9 * n).tolist()
        self.counts = np.frombuffer(blob, "<u8", n, at + 9 * n + 8 * (n + 1)).tolist()
        self.blob, self.kind = blob, np.dtype(f"<u{width}")
        self.expand = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))

    def ids(self, i: int) -> np.ndarray:
        """The ids of the shard's i-th document; no other frame is touched."""
        out = np.frombuffer(self.expand.decompress(self.blob[self.offsets[i] : self.offsets[i + 1]]), self.kind)
        if len(out) != self.counts[i]:
            raise ValueError("a document's ids do not match the index")
        return out

    def find(self, doc_id: int) -> range:
        """Places of a doc_id in the shard, by binary search; null doc_ids come first."""
        nulls = sum(d is None for d in self.docs[: 1 + len(self.docs)]) if self.docs and self.docs[0] is None else 0
        lo = bisect.bisect_left(self.docs, doc_id, lo=nulls)
        return range(lo, bisect.bisect_right(self.docs, doc_id, lo=lo))


def _write_blobs(blobs: DataFrame, path: str) -> None:
    """Each row's bytes as a file of their own, with the trailer: Spark's text writer writes bytes as they are."""
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("lineSep", TRAILER).option("maxRecordsPerFile", 1).text(path)


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = 1, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the ids of ``docs(doc_id, text)`` as a store: each text's ids, then the id ``end``.

    Null text counts as empty (the end id alone). Null doc_ids come first; rows of one doc_id are documents each, in an order of their texts'
    hashes. Other columns are ignored; an empty table gives a store without shards. Texts of any length are encoded whole. The dictionary is
    trained on a bounded sample (``SAMPLE_DOCS`` documents of at most ``SAMPLE_TEXT_BYTES``, by hash); it is at most ``DICT_BYTES`` long and
    goes to every task. Frames, not texts, are dealt by ranges of doc_id and sorted.
    """
    spark = docs.sparkSession
    path = path or default_path()
    common.bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    short = rows.where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    drawn = common.sample_by_hash(short, SAMPLE_DOCS, ["doc_id", "tie"], short.count())
    enc = encoder(path)
    raw = train([enc.encode(r.text) for r in drawn.select("text").collect()])
    sha, width = hashlib.sha256(raw).digest(), enc.kind.itemsize
    _write_blobs(spark.createDataFrame([(raw,)], "blob binary"), f"{folder}/dictionary")
    frames = common.materialize(common.arrow_map(rows, lambda it: _encode(it, path, end, raw), "doc_id long, tie long, n_tokens long, frame binary"), "token-frames", "lz4")
    dealt = frames.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "n_tokens", "frame")
    _write_blobs(common.arrow_map(dealt, lambda it: _shards(it, width, sha, shard_bytes), "blob binary"), f"{folder}/shards")
    common.drop(spark, frames.scratch_path)


def dictionary(spark: SparkSession, folder: str) -> bytes:
    """The store's dictionary, of at most DICT_BYTES."""
    kept = [bytes(r.content) for r in spark.read.format("binaryFile").load(f"{folder}/dictionary").select("content").collect() if r.content]
    return kept[0].removesuffix(TRAILER.encode())


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{folder}/shards").where("length > 0").select("path", "content")


def _rows(batches: Iterator[pa.RecordBatch], raw: bytes) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b.column(1):
            s = Shard(blob.as_py(), raw)
            starts = s.first + np.cumsum([0, *s.counts[:-1]])
            crcs = [zlib.crc32(s.ids(i).astype("<u4").tobytes()) for i in range(len(s.docs))]
            yield common.batch(READ, part=[s.part] * len(crcs), doc_id=s.docs, start=starts, n_tokens=s.counts, ids_crc32=crcs)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document of a store, from its files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A shard says how many ids of its part come before it; the parts, no more than a shuffle has partitions, are added up on the driver.
    """
    raw = dictionary(spark, folder)
    rows = common.materialize(common.arrow_map(_files(spark, folder), lambda it: _rows(it, raw), "part int, doc_id long, start long, n_tokens long, ids_crc32 long"), "token-rows")
    before, total = [], 0
    for part, n in sorted(rows.groupBy("part").agg(F.sum("n_tokens")).collect()):
        before.append((part, total))
        total += n
    starts = spark.createDataFrame(before, "part int, before long")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _places(batches: Iterator[pa.RecordBatch], raw: bytes) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            s = Shard(blob.as_py(), raw)
            yield common.batch(PLACE, doc_id=s.docs, file=[file] * len(s.docs), offset=s.offsets[:-1], length=np.diff(s.offsets), n_tokens=s.counts)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, file, offset, length, n_tokens) of every document's frame; no frame is decompressed."""
    raw = dictionary(spark, folder)
    return common.arrow_map(_files(spark, folder), lambda it: _places(it, raw), "doc_id long, file string, offset long, length long, n_tokens long")


def fetch(spark: SparkSession, folder: str, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of a short list of documents; only their frames are decompressed. Unknown doc_ids give no row."""
    raw = dictionary(spark, folder)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(1):
                s = Shard(blob.as_py(), raw)
                at = [i for d in sorted(set(wanted)) for i in s.find(d)]
                if at:
                    yield pa.record_batch({"doc_id": pa.array([s.docs[i] for i in at], pa.int64()), "ids": pa.array([s.ids(i).tolist() for i in at], pa.list_(pa.int32()))})

    return common.arrow_map(_files(spark, folder), some, "doc_id long, ids array<int>")


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "token-store")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    return read(spark, folder)
