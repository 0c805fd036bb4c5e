"""Digests of files and JSON values, and what has changed since a manifest of them was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import canonical_json


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path below `path`, size_bytes, sha256) of the files there, folders below included; digests are taken where files
    are read, a file in one task."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.element_at(F.split("path", F.lit(f"{root}/").cast("string"), 2), -1)
    return found.select(below.alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def json_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's canonical JSON."""
    return F.sha2(canonical_json(columns), 256)


def differences(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) between two tables as `files`: missing, extra, or changed. No rows if nothing has changed."""
    a = manifest.select("path", F.struct("size_bytes", "sha256").alias("before"))
    both = a.join(now.select("path", F.struct("size_bytes", "sha256").alias("after")), "path", "full")
    change = F.when(F.col("after").isNull(), "missing").when(F.col("before").isNull(), "extra").when(F.col("before") != F.col("after"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")
