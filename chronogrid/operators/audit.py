"""Consistency of labels and their positions: medians, spread, outliers, what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import EXPECTED_LABELS
from ..functions.numbers import exact_round
from ..session import meet

TOLERANCE = 5.0
LABEL = r"^\d{2}:\d{2}[AP]M"


def header_words(words: DataFrame, low: float = 85, high: float = 120) -> DataFrame:
    """Hour labels in the header band, coordinates to two places."""
    two = lambda c: exact_round(F.col(c), 2).alias(c)
    return words.where(F.col("top").between(low, high) & F.col("text").rlike(LABEL)).select("file", "page", F.col("text").alias("label"), two("x0"), two("x1"), two("top"), two("bottom"))


def expected_positions(values: DataFrame, label: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """Exact median of each label, without a label's values in one task.

    A quantile sketch gives two values between which the middle must lie (its rank
    error is at most 1 / accuracy, and they stand ten times as far apart). One
    aggregate counts what is below them, and only the distinct values between them,
    some thousandth of all, are put in order.
    """
    some = values.where(F.col(value).isNotNull()).select(F.col(label).alias("_l"), F.col(value).alias("_v"))
    far = 10 / accuracy
    ends = some.groupBy("_l").agg(F.percentile_approx("_v", [0.5 - far, 0.5 + far], accuracy).alias("_ends"), F.count("*").alias("_n")).select(F.col("_l").alias("_label"), F.col("_ends")[0].alias("_low"), F.col("_ends")[1].alias("_high"), "_n")
    met = some.join(ends, F.col("_l").eqNullSafe(F.col("_label")))
    place = F.when(F.col("_v") < F.col("_low"), F.lit(None)).otherwise(F.col("_v"))
    counts = met.where(F.col("_v") <= F.col("_high")).groupBy("_l", place.alias("_v")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy("_l").orderBy(F.col("_v").asc_nulls_first()))
    ranked = counts.withColumn("_upto", upto)
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    middle = (at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor((F.col("_n") + 2) / 2))) / 2
    return ranked.groupBy("_l").agg(middle.cast("double").alias("expected")).withColumnRenamed("_l", label)


def outliers(values: DataFrame, label: str, value: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows farther than tolerance from their label's median, with expected and delta.

    The medians are one row for each label and are joined back; labels are few,
    rows are many, so nothing but the aggregate is shuffled where Spark sees that.
    """
    met = values.join(expected_positions(values, label, value), label)
    return met.withColumn("delta", F.abs(F.col(value) - F.col("expected"))).where(F.col("delta") > tolerance)


def discrepancies(headers: DataFrame, tolerance: float = TOLERANCE, whole: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Header labels off the median of all, worst first within a label, labels descending; whole picks the rows that can be named."""
    out = whole(outliers(headers, "label", "x0", tolerance))
    two = lambda c, n: exact_round(c, 2).alias(n)
    return out.select("file", "page", "label", two(F.col("expected"), "expected_x"), F.col("x0").alias("actual_x"), two(F.col("delta"), "delta"), "top").orderBy(F.desc("label"), F.desc("delta"), "file", "page")


def expected_labels(spark: SparkSession, labels: tuple[str, ...] = EXPECTED_LABELS) -> DataFrame:
    return spark.createDataFrame(list(enumerate(labels)), "idx int, label string")


def spread(values: DataFrame, expected: DataFrame, label: str, value: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Median, least, greatest, population deviation and count of each expected label; 'no data' where there is none."""
    stats = values.groupBy(label).agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.stddev_pop(value).alias("deviation"), F.count(value).alias("n"))
    stats = stats.join(expected_positions(values, label, value).withColumnRenamed("expected", "median"), label, "left").select(label, "median", "least", "greatest", "deviation", "n")
    status = F.when(F.col("n").isNull(), F.lit("no data")).when(F.col("greatest") - F.col("least") <= 2 * tolerance, F.lit("ok")).otherwise(F.lit("spread"))
    return expected.join(stats, label, "left").withColumn("status", status).withColumn("n", F.coalesce("n", F.lit(0)))


def missing_labels(found: DataFrame, keys: list[str], label: str, expected: Column) -> DataFrame:
    """Keys with the expected labels that they lack, in the expected order; complete keys are left out."""
    sets = found.groupBy(*keys).agg(F.collect_set(label).alias("found"))
    return sets.withColumn("missing", F.array_except(expected, F.col("found"))).where(F.size("missing") > 0).select(*keys, "missing")


def missing_headers(pages: DataFrame, headers: DataFrame, labels: tuple[str, ...] = EXPECTED_LABELS) -> DataFrame:
    """As missing_labels, over all pages, with pages that have no label at all."""
    sets = meet(pages.select("file", "page"), headers.groupBy("file", "page").agg(F.collect_set("label").alias("found")), ["file", "page"], "left")
    lack = F.array_except(F.array(*map(F.lit, labels)), F.coalesce("found", F.array().cast("array<string>")))
    return sets.select("file", "page", lack.alias("missing")).where(F.size("missing") > 0)


def totals(results: DataFrame) -> DataFrame:
    """Files and entries of nested results."""
    return results.agg(F.count("*").alias("total_files"), F.coalesce(F.sum(F.size("entries")), F.lit(0)).alias("total_entries"))


def verdict(*tables: DataFrame) -> DataFrame:
    """One row: the issues in all tables together."""
    counts = [t.agg(F.count("*").alias("n")) for t in tables]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out.agg(F.sum("n").alias("issues"))
