"""What a query keeps between its jobs, and plain sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session, or what was set on its context.

    Only in local mode, where all is one machine, a temporary folder is set if there is none; a cluster needs the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder: later uses neither scan its sources again nor lose it with an
    executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """`df` computed once as compressed Parquet in the shared folder: like `kept`, for wide or large results of which later
    scans need some columns."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def write_parquet(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """`df` as Parquet in place of what was there, in folders by `keys`; only those of keys that `df` has are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if keys else "static")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def canonical_json(columns: list[str]) -> Column:
    """One row as canonical JSON: keys in order at every level of structs given by name, nulls included, no white space."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_canonical_jsonl(df: DataFrame, path: str, order: list[str]) -> bool:
    """Rows as canonical JSON lines in `order`, in one folder of files that sort as their rows do; equal rows always make
    equal files. What is there already with the same digest is left alone. Whether anything was written."""
    lines = stored(df.select(F.struct(*order).alias("o"), canonical_json(df.columns).alias("value")))
    digest = rows_digest(lines)
    spark = df.sparkSession
    mark = f"{path}.digest"
    there = _exists(spark, mark) and spark.read.text(mark).first()["value"] == digest and _exists(spark, path)
    if there:
        return False
    lines.repartitionByRange("o").sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)
    spark.createDataFrame([(digest,)], "value string").coalesce(1).write.mode("overwrite").text(mark)
    return True


def rows_digest(lines: DataFrame) -> str:
    """A digest of a table's values that their order doesn't change: SHA-256 of the sums of two hashes of each row, with the
    number of rows. Equal rows count as often as they come."""
    h = [F.sum(F.xxhash64(F.lit(k), *lines.columns).cast("decimal(38,0)")).cast("string") for k in (0, 1)]
    return lines.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *[F.coalesce(x, F.lit("0")) for x in h]), 256)).first()[0]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included, so that every line has every field."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
