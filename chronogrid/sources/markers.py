"""Markers in a shared folder that only one of several runs can make: the compare-and-set under versions and activations.

A marker is a small file. It is written under a name of its own and then given its real name,
which fails if that exists: by a hard link on a file system of this machine, by a rename that does
not replace on others. So a marker that can be seen is whole, and only one run has made it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file of this text; False, and nothing changed, if it exists."""
    parsed = urlparse(path)
    own = f"{path}.{uuid.uuid4().hex}.new"
    if parsed.scheme in ("", "file"):
        target, temporary = parsed.path, urlparse(own).path
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(temporary, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(temporary, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(temporary)
        return True
    fs, at = _file_system(spark, path)
    out = fs.create(at(own), True)
    out.write(text.encode())
    out.close()
    made = not fs.exists(at(path)) and fs.rename(at(own), at(path))
    if not made:
        fs.delete(at(own), False)
    return made


def _names(spark: SparkSession, folder: str) -> list[str]:
    parsed = urlparse(folder)
    if parsed.scheme in ("", "file"):
        return os.listdir(parsed.path) if os.path.isdir(parsed.path) else []
    fs, at = _file_system(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(at(folder))] if fs.exists(at(folder)) else []


def _folder_of(key: str) -> str:
    """A name that no file system or reader takes for anything but a name."""
    return f"k{key.encode().hex()}"


def claim(spark: SparkSession, folder: str, key: str, text: str | Callable[[int], str], least: int = 1) -> int:
    """The next free number of a key, from least on, which is this run's alone; text is what its marker holds.

    A run that loses a number to another takes the next one.
    """
    at = f"{folder}/{_folder_of(key)}"
    number = max([least, *(int(n) + 1 for n in _names(spark, at) if n.isdigit())])
    while not put_new(spark, f"{at}/{number}", text(number) if callable(text) else text):
        number += 1
    return number


def read(spark: SparkSession, folder: str) -> DataFrame:
    """key, number, text of all markers of a folder."""
    keys = _names(spark, folder)
    if not keys:
        return spark.createDataFrame([], "key string, number long, text string")
    raw = spark.read.text([f"{folder}/{k}" for k in keys if k.startswith("k")], wholetext=True).select("value", F.split(F.input_file_name(), "/").alias("p"))
    return raw.select(F.decode(F.unhex(F.substring(F.element_at("p", -2), 2, 1 << 20)), "UTF-8").alias("key"), F.element_at("p", -1).alias("last"), F.col("value").alias("text")).where(F.col("last").rlike(r"^\d+$")).select("key", F.col("last").cast("long").alias("number"), "text")
