"""The training-data queries: name -> function of (spark, sf_dir), with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe_replay, fuzzy_passages, lattice, lexical, merkle, minhash, ogg, packing, page_text, suffix_dedup, token_counts, toxicity, warc
from .common import bounded_batches, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return lattice.link_vectors(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    documents = table(spark, sf_dir, "documents")
    return toxicity.scores(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op6_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_passages.passages(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return bpe_replay.encode_decode(table(spark, sf_dir, "documents"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op10_ogg_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return ogg.round_trip(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return page_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op2_warc_derivatives": op2_warc_derivatives,
    "op10_ogg_round_trip": op10_ogg_round_trip,
    "op11_lexical_search": op11_lexical_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_page_text": op13_page_text,
    "op1_token_counts": op1_token_counts,
    "op3_lattice_links": op3_lattice_links,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_fuzzy_passages": op6_fuzzy_passages,
    "op7_minhash": op7_minhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_bpe_encode_decode": op9_bpe_encode_decode,
}

ORACLES: dict[str, str] = {
    "op2_warc_derivatives": warc.ORACLE,
    "op11_lexical_search": lexical.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
