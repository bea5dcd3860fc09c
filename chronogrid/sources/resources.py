"""The index of resources as XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_XML = "_id string, _type string, _link string, n string, name string, dept string, faculty string"


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _resources(raw: DataFrame) -> DataFrame:
    name = F.trim(F.coalesce("n", "name", F.lit("")))  # older indexes say name
    return raw.select(_text("_id").alias("id"), _text("_type").alias("type"), _text("_link").alias("link"), name.alias("name"), _text("dept").alias("dept"), _text("faculty").alias("faculty"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """id, type, link, name, dept and faculty of each resource element of XML files; what is absent is empty."""
    return _resources(spark.read.format("xml").option("rowTag", "resource").schema(_XML).load(path))


def parse(df: DataFrame, column: str) -> DataFrame:
    """The same from a column that holds one resource element each."""
    return _resources(df.select(F.from_xml(F.col(column), _XML).alias("x")).select("x.*"))
