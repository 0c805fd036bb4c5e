"""Sharding by sampled splitters, with DataFrame functions alone.

Key samples, drawn with a chance in proportion to size, give quantile splitters. Records fall into the ranges between
them; a key that is itself a splitter, as every hot key is, gets a range of its own. Ranges that are overfull
all the same are subdivided: by equal steps of the key, or, if one key fills them, by a hash of the id. A running sum
over the range totals and one within each range place every record on a common line, which is cut into shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import cut

LAWS = ("bytes", "rows")


def shard(
    docs: DataFrame,
    shards: int,
    law: str = "bytes",
    id_col: str = "doc_id",
    text_col: str = "text",
    key: Column | None = None,
    ranges: int = 8,
    range_rows: int = 1_000_000,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    law: `bytes` makes the sums of size differ by no more than one record at each cut, `rows` makes counts at most one
    apart. size is the UTF-8 bytes of the text (null: none) plus 8. slot counts the records of a shard from 0 without a
    gap. grown_shard is null: a further shard would move records of all.
    key: a long that orders the records, by default a hash of the text, so that equal texts lie together and only a cut
    parts them. Equal keys are ordered by id (null first), checksum and size; rows equal in all of these are alike.
    ranges: for each shard; range_rows: more than so many records make a range overfull. An empty table gives an empty
    one; other columns are left out, whatever their names.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}, not {law!r}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            (F.xxhash64(text) if key is None else key.cast("long")).alias("key"),
        )
    ).withColumn("weight", F.col("size") if law == "bytes" else F.lit(1).cast("long"))
    total, rows = base.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.count("*")).first()
    n = shards * ranges
    # Eight samples a range are expected in all, however large the input.
    chance = F.shiftrightunsigned(F.xxhash64("key", "doc_id", F.lit("sample")), 11) / F.lit(float(1 << 53))
    sample = base.where(chance < F.col("weight") * F.lit(8.0 * n / max(total, 1)))
    quantiles = [i / n for i in range(1, n)]
    # A key with more rows than a range should have stands alone too, however few bytes its rows have; fewer than n do.
    hot = base.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * n > rows).collect()
    splitters = sorted({*(sample.agg(F.percentile_approx("key", quantiles, 10_000).alias("q")).first().q or []), *(r["key"] for r in hot)})
    bounds = F.array(*map(F.lit, splitters)).cast("array<bigint>")
    below = F.size(F.filter(bounds, lambda s: s < F.col("key")))
    ranged = base.withColumn("range", below * 2 + F.array_contains(bounds, F.col("key")).cast("int"))
    found = {
        r["range"]: r
        for r in ranged.groupBy("range").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    }  # at most two rows for each splitter
    parts, low, span = [], [], []
    for i in range(2 * len(splitters) + 1):
        r = found.get(i)
        parts.append(max(1, -(-r["n"] // range_rows), -(-r["w"] * n // (2 * total))) if r and total else 1)
        low.append(r["lo"] if r and r["lo"] is not None else 0)
        span.append(float((r["hi"] - r["lo"]) if r and r["lo"] is not None else 0))

    def of(values: list, kind: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("range") + 1)

    step = (F.col("key").cast("double") - of(low, "double")) / (of(span, "double") + 1.0) * of(parts, "int")
    single = F.pmod(F.xxhash64("doc_id", "text_crc32"), of(parts, "int"))
    sub = F.when(of(span, "double") > 0, F.least(F.greatest(F.floor(step), F.lit(0)), of(parts, "int") - 1)).otherwise(single)
    ranged = ranged.withColumn("sub", sub.cast("int"))
    before = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range", "sub").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    starts = totals.select("range", "sub", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    within = Window.partitionBy("range", "sub").orderBy("key", "doc_id", "text_crc32", "size")
    placed = ranged.join(starts, ["range", "sub"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "weight",
        (F.col("w0") + F.sum("weight").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")).alias("w"),
        (F.col("n0") + F.row_number().over(within) - 1).alias("n"),
    )
    # The middle of a record decides; for rows of weight 1 the start does, which keeps counts within one.
    cut_at = f"(2 * w + {'weight' if law == 'bytes' else '0'}) * {shards}L div {2 * max(total, 1)}L"
    placed = cut(placed.withColumn("shard", F.least(F.expr(cut_at), F.lit(shards - 1)).cast("int")))
    first = placed.groupBy("shard").agg(F.min("n").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(law).alias("law"),
        "shard",
        (F.col("n") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
