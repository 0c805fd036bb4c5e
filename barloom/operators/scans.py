"""Running sums and exact quantiles in two levels, so that no task holds a whole table or a whole hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import kept, stored

#: Positions of a range in a running scan.
WIDTH = 1 << 18
#: Equal steps into which a group's values fall at each level of a quantile.
STEPS = 1024

_JOIN = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least, "product": lambda a, b: a * b}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "product": F.product}


def running(rows: DataFrame, order: str, columns: dict[str, tuple[str, str]], keys: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """`rows` with a running sum, max, min or product of a column for each entry of `columns` (name: column, kind), in the
    order of the whole number `order`, for each of `keys`.

    Positions are cut into ranges of `width`. The totals of ranges, a row each, are scanned first, and what comes before a
    range is carried into the scan within it. Nulls add nothing; before the first value the result is null. Rows of equal
    order come in any order.
    """
    at = F.floor(F.col(order) / width).alias("_range")
    totals = rows.groupBy(*keys, at).agg(*[_AGG[kind](c).alias(f"_{n}") for n, (c, kind) in columns.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = totals.select(*keys, "_range", *[_AGG[kind](f"_{n}").over(before).alias(f"_{n}") for n, (_, kind) in columns.items()])
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_range", at).join(carried, [*keys, "_range"])

    def both(name: str, column: str, kind: str) -> Column:
        carry, own = F.col(f"_{name}"), _AGG[kind](column).over(within)
        return F.coalesce(_JOIN[kind](carry, own) if kind in ("max", "min") else F.when(carry.isNotNull() & own.isNotNull(), _JOIN[kind](carry, own)), carry, own).alias(name)

    return out.select(*rows.columns, *[both(n, *c) for n, c in columns.items()])


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` with their place, from 0, in an order of several keys that no two rows are equal in.

    Rows are dealt into ranges, numbered within them, and start behind the rows of the ranges before.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_range", F.spark_partition_id()))  # ranges are drawn from samples, so they are fixed first
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = placed.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(*order)
    return placed.join(starts, "_range").withColumn(name, F.col("_start") + F.row_number().over(within) - 1).drop("_range", "_start")


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], levels: int = 2, steps: int = STEPS, weight: str | None = None) -> DataFrame:
    """(keys, a column for each of `wanted`: its interpolated quantile) of the groups with a value that is not null.

    By rank selection: equal values meet before anything else; of each group, `steps` equal steps between its least and
    largest value are counted, and only the step that holds a wanted rank is looked at further, `levels` times. What is
    then left is ordered. Counts are the only thing that grows with a group. A quantile between two ranks needs both.
    weight: a column with how many rows a row stands for.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on = [f"_k{i}" for i in range(len(keys))]
    # Null keys are a group of their own; a struct makes them equal in joins.
    slim = rows.where(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("_k"), *[F.col(k).alias(n) for k, n in zip(keys, on)]).alias("_key"), F.col(value).cast("double").alias("v"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("n"))
    slim = slim.withColumn("_id", F.to_json("_key", {"ignoreNullFields": "false"}))
    salt = F.pmod(F.xxhash64("v"), F.lit(parts)).alias("s")
    counted = kept(slim.groupBy("_id", salt, "v").agg(F.first("_key").alias("_key"), F.sum("n").alias("n")))
    groups = counted.groupBy("_id").agg(F.first("_key").alias("_key"), F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.collect_set("s").alias("s"))
    # A group's spans go to the hashes that it has values in, so a hot group is in many tasks and a small one in few.
    places = groups.select("_id", F.explode("s").alias("s"))

    def within(spans: DataFrame) -> DataFrame:
        return counted.select("_id", "s", "v", "n").join(spans.join(places, "_id").hint("merge"), ["_id", "s"]).where("v >= lo and v <= hi")

    ranks = []
    for name, q in wanted.items():
        spot = (F.col("total") - 1) * F.lit(float(q))
        for side, rank in (("a", F.floor(spot)), ("b", F.ceil(spot))):
            ranks.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.cast("long").alias("rank"), (spot - F.floor(spot)).alias("part")))
    sought = groups.select("_id", "_key", "lo", "hi", F.lit(0).cast("long").alias("before"), F.explode(F.array(*ranks)).alias("r")).select("_id", "_key", "lo", "hi", "before", "r.*")
    for _ in range(levels):
        # The spans that hold sought ranks, each once; a value counts in every one of them that it lies in.
        spans = sought.select("_id", "lo", "hi", "before").distinct()
        step = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * steps), F.lit(steps - 1))).otherwise(0).cast("int").alias("step")
        steps_of = within(spans).groupBy("_id", "lo", "hi", "before", step).agg(F.sum("n").alias("n"), F.min("v").alias("vlo"), F.max("v").alias("vhi"))
        order = Window.partitionBy("_id", "lo", "hi").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # `steps` rows at most
        ends = steps_of.withColumn("end", F.col("before") + F.sum("n").over(order))
        ends = ends.select("_id", "lo", "hi", (F.col("end") - F.col("n")).alias("start"), "end", "vlo", "vhi")
        sought = sought.join(ends, ["_id", "lo", "hi"]).where("rank >= start and rank < end").select("_id", "_key", F.col("vlo").alias("lo"), F.col("vhi").alias("hi"), F.col("start").alias("before"), "name", "side", "rank", "part")
    spans = sought.select("_id", "lo", "hi", "before").distinct()
    order = Window.partitionBy("_id", "lo", "hi").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    left = within(spans).select("_id", "lo", "hi", "v", "n", (F.col("before") + F.sum("n").over(order)).alias("end"))
    found = sought.join(left, ["_id", "lo", "hi"]).where("rank < end and rank >= end - n")

    def at(name: str, side: str, column: str) -> Column:
        return F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col(column)))

    out = found.groupBy("_id").agg(F.first("_key").alias("_key"), *[(at(n, "a", "v") + at(n, "a", "part") * (at(n, "b", "v") - at(n, "a", "v"))).alias(n) for n in wanted])
    return out.select(*[F.col("_key")[o].alias(k) for k, o in zip(keys, on)], *wanted)
