"""File sinks: JSON, CSV and partitioned comparisons."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def json_lines(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).json(path)


class _Fragments(DataSourceWriter):
    """Rows of one text column as fragments of a JSON array, one a task, which the commit puts together in order."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.folder = path, overwrite, f"{path}.{uuid.uuid4().hex}.parts"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        at = TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        name = f"{self.folder}/{at.partitionId():09d}-{at.taskAttemptId()}"
        n = 0
        with open(name, "w", encoding="utf-8") as f:
            for (text,) in rows:
                f.write(",\n" * (n > 0) + text)
                n += 1
        return _Fragment(at.partitionId(), name, n)

    def commit(self, messages: list[_Fragment | None]) -> None:
        whole = f"{self.folder}.whole"
        with open(whole, "wb") as out:
            out.write(b"[")
            first = True
            for m in sorted((m for m in messages if m and m.rows), key=lambda m: m.partition):
                out.write(b"\n" if first else b",\n")
                first = False
                with open(m.name, "rb") as part:
                    shutil.copyfileobj(part, out, 1 << 20)
            out.write(b"\n]\n")
        if self.overwrite:
            os.replace(whole, self.path)
        else:
            os.link(whole, self.path)  # fails if another file is there
            os.unlink(whole)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list[_Fragment | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


@dataclass
class _Fragment(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class JsonArraySink(DataSource):
    """Writes a text column, in the order of its partitions, as the elements of one JSON array in a file that tasks and driver share."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [f.dataType.simpleString() for f in schema] != ["string"]:
            raise ValueError("one text column")
        path = self.options["path"]
        if "://" in path or (path.startswith("file:") and not path.startswith("file:/")):
            raise ValueError(f"a folder that tasks and driver share as files, not {path}")
        return _Fragments(path.removeprefix("file:"), overwrite)


def json_array(df: DataFrame, path: str, order: list[str | Column] | None = None) -> None:
    """All rows as one JSON array in one file, in order if one is given, an element a line.

    Each task writes its own fragment; only bytes, some at a time, pass the driver.
    """
    df.sparkSession.dataSource.register(JsonArraySink)
    rows = df.orderBy(*order) if order else df
    rows.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json")).write.format("json_array").mode("overwrite").save(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of such a file, by lines, so that it is read in splits."""
    lines = spark.read.text(path).where(~F.col("value").isin("[", "]"))
    return lines.select(F.from_json(F.regexp_replace("value", ",$", ""), schema).alias("r")).select("r.*")


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by '; '."""
    flat = [F.array_join(c, "; ").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def audit_csv(audit: dict[str, DataFrame], folder: str) -> None:
    """Header positions, discrepancies and missing labels as three CSV folders."""
    for name in ("headers", "discrepancies", "missing"):
        csv(audit[name], f"{folder}/{name}")


def shown(df: DataFrame, columns: list[str], most: int = 100) -> DataFrame:
    """The rows and columns that a page shows."""
    return df.select(*(c for c in columns if c in df.columns)).limit(most)
