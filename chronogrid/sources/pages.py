"""Page sources: decoded words and boxes, or documents through a decoder that the caller brings."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PAGES, RECTS, SCAN_ERRORS, WORDS
from ..session import shared_dir

#: What a decoder returns of one document's bytes: page dicts with width, height, words and rects; it may raise.
Decoder = Callable[[bytes], list[dict]]

_DECODED = f"kind string, {WORDS}, width double, height double, fill boolean, error string"
_NAMES = [c.split()[0] for c in _DECODED.split(", ")]


def decoded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, rects, pages) from parquet tables of a folder."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
    return read("words", WORDS), read("rects", RECTS), read("pages", PAGES)


def documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """file and content of the documents of a folder or path, not of its subfolders."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "length", "content").where("file <> ''")


def decode(docs: DataFrame, decoder: Decoder) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(words, rects, pages, errors): a document that fails is an error row, with the pages before it kept.

    Documents are decoded where they lie, one at a time, and once: what the decoder gives is
    kept by kind in the shared folder, and each of the four reads its own kind from there.
    """

    def rows(file: str, content: bytes) -> Iterator[tuple]:
        blank = dict.fromkeys(_NAMES)
        try:
            for number, page in enumerate(decoder(content), 1):
                at = blank | {"file": file, "page": number}
                yield at | {"kind": "page", "width": page["width"], "height": page["height"]}
                for kind, name in (("word", "words"), ("rect", "rects")):
                    for seq, item in enumerate(page[name]):
                        yield at | {"kind": kind, "seq": seq} | {k: item.get(k) for k in ("text", "x0", "x1", "top", "bottom", "width")} | {"fill": bool(item.get("fill"))}
        except Exception as error:  # what a decoder raises on a bad document is data here
            yield blank | {"kind": "error", "file": file, "error": f"{type(error).__name__}: {error}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                out = pd.DataFrame(list(rows(file, bytes(content))), columns=_NAMES)
                yield out.astype({"page": "Int32", "seq": "Int32", "fill": "boolean", **{c: "float64" for c in ("x0", "x1", "top", "bottom", "width", "height")}})

    path = f"{shared_dir(docs.sparkSession)}/decoded-{uuid.uuid4().hex}"
    docs.select("file", "content").mapInPandas(run, _DECODED).write.partitionBy("kind").parquet(path)
    every = docs.sparkSession.read.schema(_DECODED).parquet(path)
    pick = lambda kind, schema: every.where(F.col("kind") == kind).select(*(c.split()[0] for c in schema.split(", ")))
    return pick("word", WORDS), pick("rect", RECTS), pick("page", PAGES), pick("error", SCAN_ERRORS)
