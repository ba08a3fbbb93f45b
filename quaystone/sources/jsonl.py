"""JSON lines as a sink of its own: what a task writes is seen when the job is done, and a task that ran twice appends once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shipping import ship

NAME = "quaystone_jsonl"
#: Attempts write below a name that readers of a folder pass over.
STAGED = "_staged"


@dataclass
class Staged(WriterCommitMessage):
    """What one attempt of a task wrote; None where it had no row."""

    path: str | None
    rows: int


class JsonLinesWriter(DataSourceWriter):
    """Attempts write files of their own; the commit moves those of the attempts that count, an abort or a lost attempt leaves none to be read."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex[:12]

    def write(self, rows: Iterator[Row]) -> Staged:
        files, base = fs.FileSystem.from_uri(self.path)
        first = next(rows, None)
        if first is None:
            return Staged(None, 0)
        folder = f"{base}/{STAGED}/{self.job}"
        files.create_dir(folder, recursive=True)
        at, n = f"{folder}/{uuid.uuid4().hex}.json", 0
        with files.open_output_stream(at) as out:
            row: Row | None = first
            while row is not None:
                out.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode() + b"\n")
                n, row = n + 1, next(rows, None)
        return Staged(at, n)

    def commit(self, messages: list) -> None:
        files, base = fs.FileSystem.from_uri(self.path)
        files.create_dir(base, recursive=True)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(base)):
                if f.is_file:
                    files.delete_file(f.path)
        for k, m in enumerate(messages):
            if m is not None and m.path:
                files.move(m.path, f"{base}/part-{self.job}-{k:05d}.json")
        self._forget(files, base)

    def abort(self, messages: list) -> None:
        self._forget(*fs.FileSystem.from_uri(self.path))

    def _forget(self, files: fs.FileSystem, base: str) -> None:
        if files.get_file_info(f"{base}/{STAGED}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/{STAGED}/{self.job}")


class JsonLines(DataSource):
    """``df.write.format("quaystone_jsonl").option("path", folder)``; modes append and overwrite."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> JsonLinesWriter:
        return JsonLinesWriter(self.options["path"], overwrite)


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows as JSON lines into a folder that the driver and all tasks reach by that path. Nulls are written as null."""
    spark: SparkSession = df.sparkSession
    ship(spark)
    spark.dataSource.register(JsonLines)
    df.write.format(NAME).mode(mode).option("path", path).save()
