"""A training corpus from documents: toxic ones go, one of each near-duplicate group stays, repeated passages are cut, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, and each works on all that the one before kept.
No stage fails on nulls, empty texts, ties, repeated rows or an empty table:

- toxicity keeps rows with a null text (scored as empty) or a null id;
- near-duplicates keeps rows with a null id and, of repeated rows, one; rows with one id and
  different texts are one document, which stays or goes with all its texts;
- repeated passages are cut from the text; a document that loses all its text stays, empty, and a
  null text becomes empty; rows that share an id count as one document, each keeps its columns;
- packing takes a null text as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.llm import minhash, packing, suffix_dedup, toxicity
from chronogrid.llm.common import bounded_batches, stored, table

#: SQL cannot score, hash or tokenize as the stages do; tests hold each against brute force.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not predict toxic."""
    bounded_batches(spark)
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group (five-word shingles, similarity 0.8)."""
    bounded_batches(spark)
    groups = minhash.near_duplicates(docs, settings=minhash.Settings(words=5))
    kept = groups.groupBy("doc_id").agg(F.min("component_id").alias("least")).where("least = doc_id").select("doc_id")
    one_each = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one_each.select(docs.columns).unionAll(docs.where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte stretches that a document with a smaller id has too."""
    bounded_batches(spark)
    # one key of id and text, never null, so that repeats are dropped and rows joined in one exchange of the texts
    key = lambda i, sha: F.concat_ws("-", F.coalesce(i.cast("string"), F.lit("none")), sha)
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    cut = suffix_dedup.deduplicate(docs, with_text=True).select(key(F.col("doc_id"), F.col("text_sha256")).alias("cut_key"), F.col("kept").alias("cut_text"))
    rest = docs.withColumn("cut_key", key(F.col("doc_id"), sha)).drop("text")
    out = rest.join(cut.dropDuplicates(["cut_key"]), "cut_key").withColumn("text", F.col("cut_text"))  # repeated rows lose the same
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of at most 1024 tokens."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("repeated passages", cut_repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet into the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
