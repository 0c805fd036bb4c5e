"""Bars and dense panels from the star-schema tables.

A panel is a long table of one row for each asset and period: (asset_idx, symbol, t, day, open, high, low, close, volume,
amount, tradable). It is dense on the global calendar; prices are NULL where an asset did not trade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import kept

PRICES = ("open", "high", "low", "close")
FIELDS = (*PRICES, "volume", "amount")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(rows: DataFrame, symbol: Column, day: Column) -> DataFrame:
    """Bars from line items: one aggregation by (symbol, day), partial before its shuffle."""
    price = F.try_divide("l_extendedprice", "l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    rows = rows.select(symbol.alias("symbol"), day.alias("day"), price.alias("price"), order.alias("at"), "l_quantity", "l_extendedprice")
    return rows.groupBy("symbol", "day").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
    )


def bars_brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return bars(joined, F.col("p_brand"), F.date_trunc("week", "l_shipdate").cast("date"))


def bars_nation_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = lines.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return bars(joined, F.col("n_name"), F.col("l_shipdate").cast("date"))


def tradable() -> Column:
    return F.coalesce((F.col("volume") > 0) & (F.col("amount") > 0), F.lit(False))


def universe(bars: DataFrame) -> DataFrame:
    """(symbol, asset_idx) in the order of names: a dimension table, as small as the universe."""
    return bars.select("symbol").distinct().withColumn("asset_idx", (F.row_number().over(Window.orderBy("symbol")) - 1).cast("long"))


def calendar(bars: DataFrame) -> DataFrame:
    """(day, t) of the days with any bar: as small as the calendar."""
    return bars.select("day").distinct().withColumn("t", (F.row_number().over(Window.orderBy("day")) - 1).cast("long"))


def last_t(bars: DataFrame) -> int:
    """The position of the last day of the calendar, -1 without any."""
    return bars.agg(F.countDistinct("day")).first()[0] - 1


def panel(bars: DataFrame, are_kept: bool = False) -> DataFrame:
    """The dense grid of universe and calendar with the bars on it; cells without a trade have NULL prices.

    Every asset unfolds into the positions of the calendar, whose length is one number, and days come by an equi join. Bars
    are computed once and kept, since universe, calendar and cells all come from them.
    """
    bars = bars if are_kept else kept(bars)
    days = calendar(bars)
    last = last_t(bars)
    grid = universe(bars).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(last))) if last >= 0 else F.lit(0))
    grid = grid.withColumn("t", F.col("t").cast("long")).join(days, "t")
    placed = grid.join(bars, ["symbol", "day"], "left").withColumn("tradable", tradable())
    masked = [F.when(F.col("tradable"), F.col(c)).alias(c) for c in FIELDS]
    return placed.select("asset_idx", "symbol", "t", "day", *masked, "tradable")


def brand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(bars_brand_week(spark, sf_dir))


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(bars_nation_day(spark, sf_dir))
