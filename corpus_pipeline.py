"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes what the stage before has kept and applies one operator's decisions; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import common, decontaminate, exact_dedup, kneser_ney, packing, simhash


def boxed(docs: DataFrame, *read: str) -> DataFrame:
    """(doc_id, text, those of ``read``, __row): the whole row as one column, so that no name of a user's column can meet one of an operator's."""
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return docs.select("doc_id", "text", *read, F.struct(*[name(c) for c in docs.columns]).alias("__row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model keeps. Rows of one doc_id are judged each; equal rows alike. All columns are kept, whatever their names."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kneser_ney.quality(boxed(docs, "lang"), labels, rows_too=True).where("keep").select("__row.__row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the row that exact dedup keeps. Null and blank texts are one group. All columns are kept."""
    rows = common.with_row(boxed(docs))
    gone = exact_dedup.dedup(rows.select("doc_id", "text", "__r"), row="__r").where("not kept").select("__r")
    return rows.join(gone, "__r", "left_anti").select("__row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies: SimHash fingerprints of at most 2 differing bits, found by
    the covering, or 0.8 similarity on five-word shingles. Texts without words are in no group. All columns are kept."""
    rows = common.with_row(boxed(docs))
    gone = simhash.near_rows(rows.select("doc_id", "text", "__r"), width=5, least=0.8, most=2).where("not kept").select("__r")
    return rows.join(gone, "__r", "left_anti").select("__row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found; null and empty texts hold none. All columns are kept."""
    found = decontaminate.matches(boxed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("__hits") == 0).select("__row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("decontamination", decontaminated), ("packing", packed)]
#: No stage but exact dedup can be said in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
