"""Extension point for language-model extraction: a provider object, called per document in tasks."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_json
from ..schemas import CONFIG, LLM_EXTRACTION
from ..session import shared_dir, stored


@runtime_checkable
class Provider(Protocol):
    """Turns a document into reply texts; it must pickle, and may open its client when first used."""

    name: str
    model: str

    def extract_timetable(self, content: bytes) -> str: ...

    def generate_config(self, content: bytes, extraction: str) -> str: ...


def _tried(call: Callable[[], str], attempts: int, wait: float) -> tuple[str | None, str | None]:
    """(reply, error) of at most so many calls, with a wait that doubles between them."""
    for k in range(attempts):
        try:
            return call(), None
        except Exception as e:  # whatever a client raises concerns this document only
            error = f"{type(e).__name__}: {e}"
        if k + 1 < attempts:
            time.sleep(wait * 2**k)
    return None, error


REPLY = "key string, reply string, error string"


def asked(docs: DataFrame, call: Callable[[Provider, bytes, str | None], str], provider: Provider, attempts: int, wait: float) -> DataFrame:
    """key, reply, error of each row of docs (key, content, given)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *_tried(lambda: call(provider, bytes(content), given), attempts, wait)) for key, content, given in zip(batch["key"], batch["content"], batch["given"])]
            yield pd.DataFrame(rows, columns=["key", "reply", "error"], dtype=object)

    return docs.select("key", "content", "given").mapInPandas(run, REPLY)


def kept_replies(docs: DataFrame, call: Callable[[Provider, bytes, str | None], str], provider: Provider, store: str, attempts: int, wait: float, wave: int) -> DataFrame:
    """As asked, but a reply is asked for once: it is written into ``store`` before it is used.

    What is stored is not asked for again, by this run or a later one, and equal keys are
    asked for once. The rest is asked in waves of about so many documents, each written when it
    is done, so that a job that breaks off loses the replies of one wave at most. Errors are not
    stored; the next run asks again.
    """
    spark = docs.sparkSession

    def known() -> DataFrame:
        try:
            return spark.read.schema(REPLY).parquet(store)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], REPLY)

    lack = stored(docs.dropDuplicates(["key"]).join(known(), "key", "left_anti"), "to-ask")
    waves = max(1, -(-lack.count() // wave))
    errors = spark.createDataFrame([], REPLY)
    for k in range(waves if not lack.isEmpty() else 0):
        some = lack.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == k)
        got = stored(asked(some, call, provider, attempts, wait), "replies")
        got.where("error IS NULL").write.mode("append").parquet(store)
        errors = errors.unionAll(got.where("error IS NOT NULL"))
    return known().dropDuplicates(["key"]).unionAll(errors)


def extract(docs: DataFrame, provider: Provider, with_config: bool = False, store: str | None = None, attempts: int = 3, wait: float = 1.0, wave: int = 1000) -> DataFrame:
    """file, extraction (struct), layout (struct, null unless asked for) and error of each document.

    The layout prompt gets the extraction's reply. A call is tried ``attempts`` times; one that
    fails is an error in its row, not of the job. Replies are kept by the hash of content, prompt,
    provider and model, in ``store`` or, without it, in the shared folder for this call alone.
    """
    place = store or f"{shared_dir(docs.sparkSession)}/replies-{uuid.uuid4().hex}"
    who = F.lit(f"{provider.name}/{provider.model}")
    key = lambda prompt, *more: F.sha2(F.concat_ws("\n", F.lit(prompt), who, F.sha2("content", 256), *more), 256)
    first = docs.select("file", "content", key("extraction").alias("key"), F.lit(None).cast("string").alias("given"))
    replies = kept_replies(first, lambda p, content, _: p.extract_timetable(content), provider, f"{place}/extraction", attempts, wait, wave)
    got = first.drop("given").join(replies, "key", "left").select("file", "content", "reply", "error")
    if with_config:
        second = got.where("error IS NULL").select("file", "content", key("layout", F.sha2("reply", 256)).alias("key"), F.col("reply").alias("given"))
        layouts = kept_replies(second, lambda p, content, given: p.generate_config(content, given), provider, f"{place}/layout", attempts, wait, wave)
        met = second.select("file", "key").join(layouts, "key", "left").select("file", F.col("reply").alias("layout_reply"), F.col("error").alias("layout_error")).dropDuplicates(["file"])
        got = got.join(met, "file", "left").withColumn("error", F.coalesce("error", "layout_error"))
    else:
        got = got.withColumn("layout_reply", F.lit(None).cast("string"))
    inner = lambda t: t[len("struct<") : -1]
    return got.select("file", parse_json(F.col("reply"), _ddl(inner(LLM_EXTRACTION))).alias("extraction"), parse_json(F.col("layout_reply"), _ddl(inner(CONFIG))).alias("layout"), "error")


def _ddl(fields: str) -> str:
    """struct<...> around fields, as from_json takes it."""
    return f"struct<{fields}>"


def flat_entries(df: DataFrame) -> DataFrame:
    """Extracted entries as rows with their file, in order."""
    return df.where("error IS NULL").select("file", F.posexplode("extraction.entries").alias("seq", "e")).select("file", "seq", "e.*")
