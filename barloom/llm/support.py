"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_folder

#: Translation of the 26 ASCII capitals; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its name as a whole, whatever signs the name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` written once as Parquet into the shared folder, and that folder, for `dropped` when nothing reads it any more.

    Unlike a checkpoint it is compressed, and later scans read only the columns that they need.
    """
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def dropped(spark: SparkSession, folder: str) -> None:
    """Deletes what `stored` has written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot if it has more than this part of all rows, so there are fewer hot keys than this.
HOT = 10_000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """`left` joined with `right`, which has one row for each key and in the column n how often `left` has the key.

    rows: of `left`, which has no nulls in `key`. The hot keys, fewer than HOT whatever the input, are broadcast, so that
    their rows stay where they are; the others meet in a shuffle.
    """
    names = [c for c in right.columns if c not in (key, "n")]
    held = F.struct(*names).alias("_held")
    hot = right.where(F.col("n") * HOT > rows).select(key, held)  # fewer than HOT rows
    marked = left.join(F.broadcast(hot), key, "left")
    # Not broadcast at any size: the driver would have to hold `right`.
    rest = marked.where("_held is null").drop("_held").join(right.select(key, held).hint("merge"), key)
    both = marked.where("_held is not null").unionByName(rest)
    return both.select(*left.columns, *[F.col("_held")[c].alias(c) for c in names])


def mapped(f: Callable[[list], list], kind: pa.DataType, ddl: str, alone: bool = False) -> Callable[[Column], Column]:
    """A column function from `f`, which takes a list of values (None for null) and returns a list of `kind`.

    Values go through `f` and on in pieces of about 4 MB, so that a batch of long texts needs no more memory than a batch
    of short ones. alone: `f` needs nothing that is `built`, so a task first lets go of what an earlier one has built.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if alone:
            let_go()
        for batch in batches:
            for piece in pieces(batch):
                yield pa.array(f(piece), kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ddl)


#: What this worker has built last, by what and from what.
_built: list = [None, None, None]


def built(make: Callable, source):
    """`make(source)`, kept in this worker until something else is built.

    Only one is kept, so the caches of stages that share workers don't add up.
    """
    same = _built[0] is make and (_built[1] is source or (isinstance(source, bytes) and _built[1] == source))
    if not same:
        let_go()
        _built[:] = make, source, make(source)
    return _built[2]


def let_go() -> None:
    """Drops what is built; the memory, that of earlier tasks too, goes back to the system, which otherwise counts it on for
    the next stage."""
    _built[:] = None, None, None
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def pieces(batch: pa.Array, size: int = 4 << 20) -> Iterator[list]:
    """`batch` as lists of values, each of about `size` bytes or of one value."""
    start, n = 0, len(batch)
    step = max(1, int(n * size / max(1, batch.nbytes)))
    while start < n:
        yield batch.slice(start, step).to_pylist()
        start += step


def file_bytes(path: str) -> bytes:
    """A vocabulary file, given by its path or by its name in `public_tokenizers`."""
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    with open(path, "rb") as file:
        return file.read()
