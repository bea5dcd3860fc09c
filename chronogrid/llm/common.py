"""Helpers shared by the training-data operators.

Row functions here run inside Spark tasks on one Arrow batch at a time, so what
a task holds is bounded by the batch limits of :func:`bounded_batches`.
"""

from __future__ import annotations

import base64
import functools
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The special string of the 50k byte-level vocabulary and its id.
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Limit the rows of an Arrow batch, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without it (tests on one machine) gets one of ours.

    A cluster without that setting is an error, as its machines share no temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that count, under fixed names; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; None is no output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabularies are."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """A rank file: token bytes to rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=4)
def encoder(path: str, special: bool = True):
    """A tiktoken encoder of a rank file; special adds the end-of-text string."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={END_OF_TEXT: END_OF_TEXT_ID} if special else {})


def hex_or_null(c: Column) -> Column:
    return F.lower(F.hex(c))


def stored(df: DataFrame, name: str, partition: str | None = None, at: str | None = None) -> DataFrame:
    """Write a table into the session's shared checkpoint folder and read it back; this cuts its lineage.

    A loop names the place (``at``) and so writes over what an earlier round left there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{at or uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grouped(df: DataFrame, by: list[str], order: list[str], f: Callable[[pa.Table], pa.Table | None], schema: str, n: int | None = None) -> DataFrame:
    """Run f on the rows of each key, streamed from sorted partitions, so that many small groups cost little.

    A group is held whole; callers bound its size before.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            got = f(t)
            if got is not None and got.num_rows:
                yield from got.select(names).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            change = np.zeros(t.num_rows, bool)
            for c in by:
                v = t[c].combine_chunks()
                change[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
            if held:
                change[0] = any(held[-1][c][-1] != t[c][0] for c in by)
            for at, end in itertools.pairwise([0, *np.flatnonzero(change[1:]) + 1, t.num_rows]):
                if held and (at or change[0]):
                    yield from out(pa.concat_tables(held))
                    held = []
                held.append(t.slice(at, end - at))
        if held:
            yield from out(pa.concat_tables(held))

    dealt = df.repartition(*([n] if n else []), *by).sortWithinPartitions(*by, *order)
    return dealt.mapInArrow(run, schema)
