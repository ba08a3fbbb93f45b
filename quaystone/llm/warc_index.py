"""WARC archives and their index, merged externally from locally sorted runs.

Pages become WARC 1.1 records, each a gzip member of its own, in archives in the shared folder; a page whose payload another page with a
smaller id has too becomes a revisit record. Archives are read back record by record, in splits of bounded size, and each split gives one
run of index entries, sorted by URL key and timestamp. Splitters from a bounded sample cut the runs into ranges, and each range's k runs are merged by a loser tree.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Most records of an archive, about as many rows of a merged range, most ranges (they grow beyond), and keys of the sample for each.
ARCHIVE_RECORDS, RANGE_ROWS, MAX_RANGES, SAMPLE_PER_RANGE = 5000, 20_000, 1 << 16, 32
SAMPLE_KEYS = 1 << 19
BLOCK_ROWS = 2048
#: A gzip member of nothing: it separates the members that Spark's text writer writes as lines.
EMPTY_MEMBER = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
URN = "urn:quaystone:page:"
LAST = 1 << 63

MEMBERS = pa.schema([("page_id", pa.int64()), ("sha", pa.string()), ("member", pa.binary())])
LINES = pa.schema([("member", pa.binary())])
ENTRY = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])
BLOCKS = pa.schema([("range_no", pa.int32()), ("run", pa.string()), ("seq", pa.int32()), ("block", pa.binary())])
MERGED = pa.schema([("range_no", pa.int32()), ("pos", pa.int64()), *list(ENTRY)[1:]])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the right, then path and query; no scheme, port or fragment. Null or no host: the text itself."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = parts.hostname
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.lower().split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def base32(sha_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha_hex)).decode()


def captured(page_id: int | None) -> datetime:
    """When a page of the synthetic crawl was captured: its id in seconds (modulo a century) after the start."""
    return EPOCH + timedelta(seconds=(page_id or 0) % 3_155_760_000)


def record(page_id: int | None, url: str | None, payload: bytes | None, sha_hex: str, size: int, refers_to: int | None = None) -> bytes:
    """One WARC record as a gzip member: a response with its payload, or (payload None) a revisit of another page's response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    name = lambda i: f"<{URN}{'none' if i is None else i}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:quaystone:nowhere")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {captured(page_id):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32(sha_hex)}"]
    if payload is None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(4)]
        out = [record(p, u, html, sha, len(html)) for p, u, html, sha in zip(*cols, strict=True)]
        yield common.batch(MEMBERS, page_id=cols[0], sha=cols[3], member=out)


def _revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(5)]
        yield common.batch(LINES, member=[record(p, u, None, sha, n, first) for p, u, sha, n, first in zip(*cols, strict=True)])


def write_archives(pages: DataFrame, path: str, records_per_file: int = ARCHIVE_RECORDS) -> None:
    """Write ``pages(page_id, url, html)`` as WARC records. Payload: html in UTF-8, null as empty.

    Of equal payloads, empty ones too, the rows with the smallest page_id are responses (repeated rows all are) and the others revisit it; a
    null page_id is larger than any other. Which is which is found on ids and digests alone. Every page's payload is compressed where it lies;
    where the table of first pages is too large to broadcast, all compressed members are dealt by (page_id, digest) to meet it, so that
    copies do not meet in one task. Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), common.text_or_empty("html").cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    known = common.materialize(rows.select("page_id", "url", "sha", F.octet_length("payload").cast("long").alias("n")), "warc-digests")
    firsts = common.materialize(known.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("of")), "warc-firsts")
    named = common.spread_join(known, firsts, "sha", "of", known.count())
    revisits = common.arrow_map(named.where("not (page_id <=> first)").select("page_id", "url", "sha", "n", "first"), _revisits, ddl(LINES))
    members = common.arrow_map(rows.select("page_id", "url", "payload", "sha"), _responses, ddl(MEMBERS))
    first = firsts.select(F.col("sha").alias("__sha"), "first")
    responses = members.join(first, F.col("page_id").eqNullSafe(F.col("first")) & (F.col("sha") == F.col("__sha")), "left_semi").select("member")
    lines = responses.union(revisits)
    lines.select(F.col("member").cast("string").alias("value")).write.option("lineSep", EMPTY_MEMBER).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).text(path)
    common.drop(spark, known.scratch_path, firsts.scratch_path)


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of a WARC record (names in lower case), and its block."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").removeprefix(URN)
    return None if tail in ("", "none") else int(tail)


def entry(file: str, offset: int, length: int, content: bytes) -> tuple:
    """Index entry of a record; the digest and size of a response are checked against its payload."""
    fields, block = parse(content)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    uri = fields["warc-target-uri"]
    stamp = re.sub(r"\D", "", fields["warc-date"])
    return url_key("" if uri == "urn:quaystone:nowhere" else uri), stamp, _page(fields["warc-record-id"]), file, offset, length, fields["warc-type"], _page(fields.get("warc-refers-to")), digest, size


def order(e: tuple) -> tuple:
    """URL key, timestamp, page (null last), then place: no two entries are equal."""
    return e[0], e[1], LAST if e[2] is None else e[2], e[3], e[4]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in the order of their split: one sorted run for each split, with places relative to its first record."""
    run, at, held = None, 0, []

    def close() -> Iterator[pa.RecordBatch]:
        held.sort(key=order)
        for i in range(0, len(held), 4096):
            part = held[i : i + 4096]
            yield common.batch(ENTRY, run=[run] * len(part), **dict(zip(ENTRY.names[1:], zip(*part), strict=True)))

    for b in batches:
        for path, start, member in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            file = path.rsplit("/", 1)[-1]
            if run != f"{file}#{start}":
                yield from close()
                run, at, held = f"{file}#{start}", 0, []
            if member:
                held.append(entry(file, at, len(member), zlib.decompress(member, 31)))
            at += len(member) + len(EMPTY_MEMBER)
    yield from close()


CELLS = pa.schema(list(ENTRY)[1:])


def _packed(entries: list[tuple]) -> bytes:
    """Entries as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, CELLS) as out:
        out.write_batch(common.batch(CELLS, **dict(zip(CELLS.names, zip(*entries), strict=True))))
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> Iterator[tuple]:
    table = pa.ipc.open_stream(block).read_all()
    return zip(*(c.to_pylist() for c in table.columns), strict=True)


def _blocks(batches: Iterator[pa.RecordBatch], splitters: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Cut sorted runs at the splitters; each range's part of a run goes on as blocks of bounded size."""
    task = TaskContext.get().partitionId()
    held: list[tuple] = []
    at = [None, 0, 0]

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            yield common.batch(BLOCKS, range_no=[at[1]], run=[f"{at[0]}#{task}"], seq=[at[2]], block=[_packed(held)])
            at[2] += 1
            held.clear()

    for b in batches:
        for run, *e in zip(*(b.column(i).to_pylist() for i in range(len(ENTRY))), strict=True):
            e = tuple(e)
            r = bisect.bisect_right(splitters, order(e))
            if run != at[0] or r != at[1] or len(held) >= BLOCK_ROWS:
                yield from flush()
                if run != at[0]:
                    at[2] = 0
                at[0], at[1] = run, r
            held.append(e)
    yield from flush()


class LoserTree:
    """Merge k sorted iterators: each inner node holds the loser of the match below it, so that a new head plays log2(k) matches."""

    def __init__(self, runs: list[Iterator[tuple]], key: Callable[[tuple], tuple]):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads: list = [self._next(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.k
        self.winner = self._build(1)

    def _next(self, i: int):
        e = next(self.runs[i], None)
        return None if e is None else (self.key(e), e)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[0] <= y[0])

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w][1]
            self.heads[w] = self._next(w)
            node = (w + self.k) // 2
            while node >= 1:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by range, run and place in the run: merge the runs of each range."""
    runs: dict[str, list[bytes]] = {}
    now = None

    def one(blocks: list[bytes]) -> Iterator[tuple]:
        for x in blocks:
            yield from _unpacked(x)

    def close() -> Iterator[pa.RecordBatch]:
        part, pos = [], 0
        for e in LoserTree([one(x) for x in runs.values()], order):
            part.append((now, pos, *e))
            pos += 1
            if len(part) == 4096:
                yield common.batch(MERGED, **dict(zip(MERGED.names, zip(*part), strict=True)))
                part = []
        if part:
            yield common.batch(MERGED, **dict(zip(MERGED.names, zip(*part), strict=True)))

    for b in batches:
        for r, run, _, block in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if r != now:
                if runs:
                    yield from close()
                now, runs = r, {}
            runs.setdefault(run, []).append(block)
    if runs:
        yield from close()


def index(spark: SparkSession, path: str) -> DataFrame:
    """The merged index of the archives in ``path``: entries in global order of (range_no, pos), which is that of URL key and timestamp."""
    lines = spark.read.option("lineSep", EMPTY_MEMBER).option("encoding", "ISO-8859-1").text(path)
    split = F.col("_metadata.file_block_start")
    records = lines.select(F.col("_metadata.file_path").alias("path"), split.alias("start"), F.col("value").cast("binary").alias("member"))
    runs = common.materialize(common.arrow_map(records, _read, ddl(ENTRY)), "index-runs")
    # a split's first record lies after all records of the splits before it in its file; each ends with an empty member
    ends = runs.groupBy("file", "run").agg(F.max(F.col("offset") + F.col("length") + len(EMPTY_MEMBER)).alias("size"))
    ends = ends.withColumn("at", F.substring_index("run", "#", -1).cast("long"))
    bases = ends.select("run", (F.sum("size").over(W.partitionBy("file").orderBy("at")) - F.col("size")).alias("base"))
    few = bases.count() <= common.BROADCAST_ROWS
    placed = runs.join(F.broadcast(bases) if few else bases, "run").withColumn("offset", F.col("offset") + F.col("base")).select(*ENTRY.names)
    runs = common.materialize(placed if few else placed.sortWithinPartitions("run", "url_key", "ts", F.coalesce("page_id", F.lit(LAST - 1)), "file", "offset"), "index-placed")
    rows = runs.count()
    ranges = max(1, min(MAX_RANGES, -(-rows // RANGE_ROWS)))
    splitters: list[tuple] = []
    if ranges > 1:
        keys = runs.select("url_key", "ts", F.coalesce("page_id", F.lit(LAST - 1)), "file", "offset")
        part = F.pmod(F.xxhash64("file", "offset"), F.lit(max(1, rows // min(SAMPLE_KEYS, SAMPLE_PER_RANGE * ranges)))) == 0
        sample = sorted(tuple(r) for r in keys.where(part).collect())
        splitters = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    blocks = common.arrow_map(runs, lambda it: _blocks(it, splitters), ddl(BLOCKS))
    dealt = blocks.repartition(common.partitions(spark), "range_no").sortWithinPartitions("range_no", "run", "seq")
    return common.arrow_map(dealt, _merge, ddl(MERGED))


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    common.release(spark)
    out = index(spark, path)
    common.drop(spark, path)  # the runs are written: this result needs the archives no more
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "range_no", "pos")
