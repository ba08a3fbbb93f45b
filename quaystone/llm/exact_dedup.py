"""Exact dedup by an extendible-hash index whose runs and buckets are files in the shared folder.

Map tasks write local runs: equal texts of one Arrow batch are combined to one entry (the text, once, and its members). A directory that
doubles where buckets are overfull cuts the keys into buckets; each owner task takes a range of them. An owner walks its buckets in key
order, chains the entries of equal 64-bit keys, compares their bytes and merges equal ones. It answers by entry: equality is that of the
bytes, and only numbers travel back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What normalisation deletes: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Most entries of a bucket.
BUCKET_ROWS = 1024

RUN = pa.schema([("h", pa.int64()), ("sha", pa.string()), ("norm", pa.binary()), ("n", pa.int64()), ("best_cp", pa.int64()), ("best_id", pa.int64()), ("best_at", pa.int32()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))])
RUN_DDL = "h long, sha string, norm binary, n long, best_cp long, best_id long, best_at int, ids array<long>, rows array<long>"
ENTRY = pa.schema([("h", pa.int64()), ("e", pa.int64()), ("norm", pa.binary()), ("n", pa.int64()), ("cp", pa.int64()), ("id", pa.int64())])
OWNED = pa.schema([("e", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("wins", pa.bool_())])
OWNED_DDL = "e long, keep_id long, group_size long, wins boolean"


def better(cp: int, doc: int | None, than_cp: int, than_doc: int | None) -> bool:
    """More code points, then the smaller id; a null id is last."""
    return (-cp, doc is None, doc or 0) < (-than_cp, than_doc is None, than_doc or 0)


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each distinct text of a batch, with all its members and the place of the best of them."""
    for b in batches:
        found: dict[bytes, int] = {}
        out: list[list] = []
        for h, sha, norm, cp, doc, row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            at = found.setdefault(norm, len(out))
            if at == len(out):
                out.append([h, sha, norm, 1, cp, doc, 0, [doc], [row]])
                continue
            e = out[at]
            if better(cp, doc, e[4], e[5]):
                e[4:7] = cp, doc, e[3]
            e[3] += 1
            e[7].append(doc)
            e[8].append(row)
        if out:
            yield common.batch(RUN, **dict(zip(RUN.names, zip(*out), strict=True)))


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by key: chain those of one key, compare their bytes, merge equal ones. A chain holds a text once.

    Each entry gets its text's row that stays, the number of rows, and whether that row is one of its members.
    """
    key, chain, out = None, [], []

    def close() -> None:
        for _, _, doc, n, winner, entries in chain:
            out.extend((e, doc, n, e == winner) for e in entries)

    def flush() -> pa.RecordBatch:
        part = common.batch(OWNED, **dict(zip(OWNED.names, zip(*out), strict=True)))
        out.clear()
        return part

    for b in batches:
        for h, entry, norm, n, cp, doc in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if h != key:
                close()
                key, chain = h, []
            for c in chain:
                if c[0] == norm:
                    c[3] += n
                    c[5].append(entry)
                    if better(cp, doc, c[1], c[2]):
                        c[1], c[2], c[4] = cp, doc, entry
                    break
            else:
                chain.append([norm, cp, doc, n, entry, [entry]])
        if len(out) >= 4096:
            yield flush()
    close()
    if out:
        yield flush()


def dedup(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, row: str | None = None) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256, and the column ``row`` if it is named.

    Texts are equal when identical without the characters of SPACES; null counts as empty, and all empty texts are one group. The row
    with the most code points, then the smallest doc_id (null last) stays; of rows that repeat that very id and length, one of them. Other
    columns are ignored. Empty input gives no rows.
    """
    spark = docs.sparkSession
    text = common.text_or_empty()
    number = F.col(row).cast("long") if row else F.lit(None).cast("long")
    rows = docs.select("doc_id", text.alias("t"), number.alias("row")).select("row", F.col("doc_id").cast("long"), F.translate("t", SPACES, "").alias("norm"), F.char_length("t").cast("long").alias("cp"))
    rows = rows.select(F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha"), F.col("norm").cast("binary").alias("norm"), "cp", "doc_id", "row")
    # entries are numbered where they are written, before the numbers are used
    runs = common.materialize(common.arrow_map(rows, combine, RUN_DDL).withColumn("e", F.monotonically_increasing_id()), "dedup-runs")
    k = F.shiftrightunsigned("h", 4)
    leaves = common.grow_directory(spark, runs.select(k.alias("h"), F.lit(1).cast("long").alias("size")), bucket_rows)
    n = common.partitions(spark)
    # buckets are in order of their keys, and owners take ranges of them; a bucket has one owner, that of its least key
    entries = common.with_leaf(runs.select("h", "e", "norm", "n", "best_cp", "best_id").withColumn("k", k), leaves, "k")
    owner = (F.expr("shiftleft(__prefix, 60 - __bits)") / F.lit(float(1 << 60)) * n).cast("int")
    dealt = entries.repartitionById(n, owner).sortWithinPartitions("h").select("h", "e", "norm", "n", "best_cp", "best_id")
    classes = common.materialize(common.arrow_map(dealt, own, OWNED_DDL), "dedup-classes")
    members = runs.join(classes, "e").select("keep_id", "group_size", "wins", "best_at", "sha", F.posexplode(F.arrays_zip("ids", "rows")).alias("at", "member"))
    more = [F.col("member.rows").alias(row)] if row else []
    return members.select(*more, F.col("member.ids").alias("doc_id"), "keep_id", "group_size", (F.col("wins") & (F.col("at") == F.col("best_at"))).alias("kept"), F.col("sha").alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -cp, b := doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
