"""Labelling runs: a teacher as a data source of requests and replies, with retries, and runs that resume where they ended."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.teacher import read_reply
from ..shipping import ship
from . import jsonl

NAME = "quaystone_teacher"
LABELS = "span_id long, sample_no int, values string, error string, calls int"


@dataclass
class Requests(InputPartition):
    """One file of requests, as JSON lines."""

    path: str


class TeacherReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.teacher = options["path"].rstrip("/"), options["teacher"]
        self.samples, self.tries = int(options.get("samples", "1")), int(options.get("tries", "3"))

    def partitions(self) -> list[Requests]:
        files, base = fs.FileSystem.from_uri(self.path)
        found = sorted(f.path for f in files.get_file_info(fs.FileSelector(base)) if f.is_file and f.size and not f.base_name.startswith(("_", ".")))
        return [Requests(p) for p in found] or [Requests("")]

    def read(self, partition: Requests) -> Iterator[tuple]:
        if not partition.path:
            return
        module, _, name = self.teacher.partition(":")
        ask = getattr(importlib.import_module(module), name)
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_stream(partition.path) as lines:
            held = b""
            while chunk := lines.read(1 << 20):
                *whole, held = (held + chunk).split(b"\n")
                for line in whole:
                    yield from self._asked(ask, line)
            yield from self._asked(ask, held)

    def _asked(self, ask, line: bytes) -> Iterator[tuple]:
        if not line.strip():
            return
        request = json.loads(line)
        for n in range(self.samples):
            values, error, calls = {}, "no reply", 0
            while calls < self.tries:
                calls += 1
                try:
                    values, error = read_reply(ask(request, n, calls))
                    break
                except OSError as e:  # the teacher could not be reached; other errors are the caller's
                    error = f"{type(e).__name__}: {e}"
            yield request["span_id"], n, json.dumps(values, sort_keys=True), error, calls


class TeacherSource(DataSource):
    """Labels of the requests in the files of a folder, one task for each file.

    Options: ``path``; ``teacher``, as ``module:function(request, sample_no, attempt) -> reply``; ``samples`` of each request; ``tries`` at most
    while the teacher raises OSError. ``calls`` counts the tries of a label.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LABELS

    def reader(self, schema) -> TeacherReader:
        return TeacherReader(self.options)


def labels_of(spark: SparkSession, path: str) -> DataFrame:
    """The labels that runs have left in a folder; none if there is no such folder. Broken lines are passed over."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], LABELS)
    return spark.read.schema(LABELS).option("mode", "DROPMALFORMED").json(path)


def run(requests: DataFrame, path: str, work: str, teacher: str, samples: int = 1, tries: int = 3, waves: int = 1) -> None:
    """Label those of ``requests(span_id, ...)`` that the folder ``path`` holds no label of, and append the labels there.

    Requests, with all their columns, are written below ``work`` for the teacher's tasks. They go in ``waves`` by a hash of the span_id; each
    wave's labels appear together, so that a run that fails loses one wave's calls at most, and the next run asks for what is missing
    only. A request whose teacher stays out of reach gets a label with an error, which counts as done. Null span_ids are left out.
    """
    spark = requests.sparkSession
    ship(spark)
    spark.dataSource.register(TeacherSource)
    done = labels_of(spark, path).select("span_id").distinct()
    pending = requests.where("span_id is not null").join(done, "span_id", "left_anti").withColumn("__wave", F.pmod(F.xxhash64("span_id"), F.lit(waves)).cast("int"))
    pending.write.mode("overwrite").partitionBy("__wave").json(work)
    for wave in range(waves):
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{work}/__wave={wave}")
        if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
            labels = spark.read.format(NAME).options(path=f"{work}/__wave={wave}", teacher=teacher, samples=samples, tries=tries).load()
            jsonl.write(labels, path)
