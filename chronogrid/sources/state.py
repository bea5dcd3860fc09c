"""Saved state and configuration tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CONFIG_DOCUMENT, PLACEMENT, SESSION_EVENT
from . import markers

TABLES = {"course_configs": CONFIG_DOCUMENT, "session_events": SESSION_EVENT, "placements": PLACEMENT}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table, empty if nothing has been stored."""
    try:
        return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TABLES[name])


def append(df: DataFrame, folder: str, name: str) -> None:
    """Append rows to a stored table."""
    schema = df.sparkSession.createDataFrame([], TABLES[name]).schema
    df.select(*(df[f.name].cast(f.dataType) for f in schema)).write.mode("append").parquet(f"{folder}/{name}")


def add_version(df: DataFrame, folder: str, course_code: str, config_id: str) -> int:
    """Append a configuration (one row) of a course under a version that no other run has; the version.

    The version is claimed first, so a run that fails then leaves a gap, never a second row of one version.
    """
    spark, code = df.sparkSession, course_code.upper()
    known = read(spark, folder, "course_configs").where(F.col("course_code") == code).agg(F.max("version")).first()[0] or 0
    version = markers.claim(spark, f"{folder}/versions", code, config_id, known + 1)
    append(df.withColumns({"version": F.lit(version), "course_code": F.lit(code), "config_id": F.lit(config_id)}), folder, "course_configs")
    return version


def activate(spark: SparkSession, folder: str, course_code: str, config_id: str) -> int:
    """Make a stored configuration the active one of its course; the number of this activation.

    The activation is one marker, so whoever reads sees the old state or the new one, and of
    two runs at once the later number counts.
    """
    code = course_code.upper()
    stored = read(spark, folder, "course_configs").where((F.col("config_id") == config_id) & (F.col("course_code") == code))
    if stored.isEmpty():
        raise ValueError(f"course {code} has no configuration {config_id}")
    return markers.claim(spark, f"{folder}/activations", code, config_id)


def configurations(spark: SparkSession, folder: str) -> DataFrame:
    """Stored configurations with their status after all activations: the last one is active, those before it are superseded."""
    made = markers.read(spark, f"{folder}/activations").select(F.col("key").alias("course_code"), "number", F.col("text").alias("config_id"))
    last = made.groupBy("course_code").agg(F.max_by("config_id", "number").alias("active_id"))
    ever = made.select("course_code", "config_id").distinct().withColumn("ever", F.lit(True))
    met = read(spark, folder, "course_configs").join(last, "course_code", "left").join(ever, ["course_code", "config_id"], "left")
    status = F.when(F.col("config_id") == F.col("active_id"), F.lit("active")).when(F.col("ever") | (F.col("active_id").isNotNull() & (F.col("status") == "active")), F.lit("superseded")).otherwise(F.col("status"))
    names = [f.name for f in spark.createDataFrame([], CONFIG_DOCUMENT).schema]
    return met.withColumn("status", status).select(names)
