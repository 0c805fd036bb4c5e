"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import cut


def salted(rows: DataFrame, value: str, parts: int) -> DataFrame:
    """`rows` with a column s, one of `parts` numbers by the hash of `value`."""
    return rows.withColumn("s", F.pmod(F.xxhash64(value), F.lit(parts)))


def _with_least(rows: DataFrame, among: DataFrame, parts: int) -> DataFrame:
    """(a, b, m) for `rows` (a, b): m is the least b that `among` (a, b) has for a, or a itself if that is less.

    The minimum is taken in two levels, by node and hash and then by node, and goes back to the hashes in which a node
    has rows: a node with very many is in many tasks, one with few rows in as few.
    """
    one = salted(among, "b", parts).groupBy("a", "s").agg(F.min("b").alias("m"))
    two = one.groupBy("a").agg(F.least(F.min("m"), F.col("a")).alias("m"), F.collect_set("s").alias("s"))  # at most `parts` numbers
    return salted(rows, "b", parts).join(two.select("a", "m", F.explode("s").alias("s")).hint("merge"), ["a", "s"]).select("a", "b", "m")


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has at most one smaller neighbour, and none if it has larger ones."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down > 0)").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in `links` (a, b: long) that are not the smallest of their component; component is
    the smallest node that can be reached.

    Alternates two steps until links are stars around the smallest nodes: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours. Rows never exceed the links, and the number of rounds grows with the
    logarithm of a group's size. Each step is cut off by a checkpoint. Loops (a = b) and nulls are dropped.
    """
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = links.select("a", "b").where("a is not null and b is not null")
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(now):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both.where("b > a"), both, parts).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())
        small = _with_least(large, large, parts).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = cut(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
