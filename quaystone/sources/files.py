"""Sources and sinks: message fixtures, bytes, lines, tolerant JSON lines, directories, reports and training lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mt as M

LABEL = "doc_id string, difficulty string, text string, truth map<string,string>, teacher_raw map<string,string>, teacher_canonical map<string,string>, error string, seconds double"


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all cores where a scan has few splits, for work that costs much more per row than moving it does.

    A file of one row group is one task's work, however many cores there are. A table of at least four splits a core is left as it is, so
    that what is shuffled is bounded by the cluster, not by the data.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= 4 * cores else rows.repartition(2 * cores)


def mt_texts(spark: SparkSession, path: str, least: int = 4) -> DataFrame:
    """(path, fields) of text files that hold an MT103 with at least ``least`` fields."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    found = files.where("text like '%{1:%' or text like '%:20:%'").withColumn("tags", M.tags(F.col("text")))
    return _filled(found, M.message_fields(F.col("text"), F.col("tags")), least)


def mx_texts(spark: SparkSession, path: str, least: int = 4) -> DataFrame:
    """(path, fields) of XML files that hold a credit transfer with at least ``least`` fields; files that are no XML hold none."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.xml").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return _filled(files, {k: F.coalesce(v, F.lit("")) for k, v in M.mx_fields(F.col("text")).items()}, least)


def _filled(rows: DataFrame, fields: dict, least: int) -> DataFrame:
    pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k), v) for k, v in fields.items()]), lambda x: x["col2"] != ""))
    return rows.select("path", pairs.alias("fields")).where(F.size("fields") >= least)


def seeds(spark: SparkSession, path: str, limit: int = 200) -> DataFrame:
    """The first ``limit`` value sets of a folder of fixtures, MT before MX, by path."""
    both = mt_texts(spark, path).withColumn("source", F.lit(0)).unionByName(mx_texts(spark, path).withColumn("source", F.lit(1)))
    return both.orderBy("source", "path").limit(limit)


def bytes_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines without surrounding blanks, blank ones left out."""
    return spark.read.text(path).select(F.trim("value").alias("span")).where("span <> ''")


def labels_of(spark: SparkSession, path: str) -> DataFrame:
    """Label records; lines that are no JSON are left out, missing fields get their defaults."""
    rows = spark.read.json(path, schema=LABEL, mode="DROPMALFORMED").where("doc_id is not null")
    empty = F.create_map().cast("map<string,string>")
    defaults = {"difficulty": F.lit(""), "text": F.lit(""), "truth": empty, "teacher_raw": empty, "teacher_canonical": empty, "seconds": F.lit(0.0)}
    return rows.withColumns({k: F.coalesce(k, v) for k, v in defaults.items()})


def directory_rows(texts: DataFrame) -> DataFrame:
    """(iban, expected) of JSON texts {iban: bic} in a column value."""
    one = texts.select(F.explode(F.from_json("value", "map<string,string>")).alias("iban", "expected"))
    return one.select(F.upper(F.regexp_replace("iban", r"\s+", "")).alias("iban"), "expected")


def directory_of(spark: SparkSession, path: str) -> DataFrame:
    """A directory file {iban: bic}, or a folder of them."""
    return directory_rows(spark.read.text(path, wholetext=True))


def append_labels(new: DataFrame, path: str) -> None:
    """Append label records that the folder does not hold yet: a restart repeats nothing."""
    spark = new.sparkSession
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        new = new.join(labels_of(spark, path).select("doc_id"), "doc_id", "left_anti")
    new.write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows, as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def training_line() -> Column:
    """A line {query, tools, answers, reasoning} of the columns span, schema, values (a map) and reasoning."""
    tool = F.array(F.struct(F.lit("extract_payment").alias("name"), F.col("schema").alias("parameters")))
    answer = F.array(F.struct(F.lit("extract_payment").alias("name"), F.col("values").alias("arguments")))
    return F.to_json(F.struct(F.col("span").alias("query"), tool.alias("tools"), answer.alias("answers"), "reasoning"))


def write_training_lines(examples: DataFrame, path: str) -> None:
    examples.select(training_line().alias("value")).write.text(path)
