"""Reports over daily results and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import lag
from . import scans

DAYS = 252


def benchmark_equity(panel: DataFrame, start_t: int) -> DataFrame:
    """(t, day, daily_return, equity, drawdown) from `start_t` on: every day the mean return of the assets that traded on it
    and on the day before, compounded from 1; a day without any returns 0.

    The running product and maximum are scans in two levels over one row for each day of the calendar.
    """
    both = F.col("tradable") & lag(F.col("tradable"), 1) & (lag(F.col("close"), 1) > 0)
    rows = panel.withColumn("_r", F.when(both, F.try_divide(F.col("close"), lag(F.col("close"), 1)) - 1)).where(F.col("t") >= start_t)
    daily = rows.groupBy("t", "day").agg(F.when(F.col("t") == start_t, 0.0).otherwise(F.coalesce(F.avg("_r"), F.lit(0.0))).alias("daily_return"))
    return with_drawdown(scans.running(daily.withColumn("_g", 1 + F.col("daily_return")), "t", {"equity": ("_g", "product")}).drop("_g"), [])


def with_drawdown(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, t, equity) with what equity has lost since its highest so far."""
    found = scans.running(rows, "t", {"_top": ("equity", "max")}, tuple(keys))
    return found.withColumn("drawdown", F.col("equity") / F.col("_top") - 1).drop("_top")


def strategy_equity(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Daily scores (keys, t, day, absolute_return, baseline_return) as equity and benchmark_equity, compounded from 1."""
    rows = daily.withColumns({"_a": 1 + F.col("absolute_return"), "_b": 1 + F.col("baseline_return")})
    grown = scans.running(rows, "t", {"equity": ("_a", "product"), "benchmark_equity": ("_b", "product")}, tuple(keys))
    return with_drawdown(grown.drop("_a", "_b"), keys)


def equity_summary(rows: DataFrame, keys: list[str], yearly: bool = False) -> DataFrame:
    """Return, yearly return, Sharpe ratio and worst drawdown of each key (and year), and what the benchmark returned.

    Returns and drawdowns are within the rows of a key (and year), the first of which returns 0; a ratio without spread
    is missing. Reads (keys, t, day, equity, benchmark_equity).
    """
    by = [*keys, "year"] if yearly else keys
    rows = rows.withColumn("year", F.year("day")) if yearly else rows
    before = F.lag("equity").over(Window.partitionBy(*by).orderBy("t"))
    rows = with_drawdown(rows.withColumn("_r", F.coalesce(F.try_divide(F.col("equity"), before) - 1, F.lit(0.0))), by)

    def ends(name: str) -> Column:
        return F.try_divide(F.max_by(name, "t"), F.min_by(name, "t"))

    years = F.count("*") / float(DAYS)
    spread = F.stddev_pop("_r")
    moves = F.round("_r", 12)  # a day in cash is none, whatever the division leaves
    return rows.groupBy(*by).agg(
        F.count("*").alias("days"),
        F.count_if(moves > 0).alias("up_days"),
        F.count_if(moves < 0).alias("down_days"),
        (ends("equity") - 1).alias("total_return"),
        (F.pow(ends("equity"), 1 / years) - 1).alias("annual_return"),
        F.when(spread > 0, F.avg("_r") / spread * DAYS**0.5).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        (ends("benchmark_equity") - 1).alias("benchmark_total_return"),
        (F.pow(ends("benchmark_equity"), 1 / years) - 1).alias("benchmark_annual_return"),
    )


def trades(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """The purchases of a scorer as closed trades (keys, t, symbol, pnl, holding_days, reason)."""
    late = F.col("sell_t") - F.col("buy_t")
    reason = F.when(F.col("sell_t").isNull(), "not_bought").when(F.col("fwd_ret") < 0, "loss").otherwise("gain")
    rows = ranked.where(F.col("rank") <= F.col("top_k"))
    return rows.select(*keys, "t", "symbol", F.col("fwd_ret").alias("pnl"), F.coalesce(late, F.lit(0)).alias("holding_days"), reason.alias("reason"))


def trade_distribution(closed: DataFrame, keys: list[str]) -> DataFrame:
    """Win rate, moments and interpolated 5 and 95 per cent points of each key's trades."""
    sums = closed.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.avg("pnl").alias("mean_pnl"),
        F.avg("holding_days").alias("mean_holding_days"),
        F.sum("pnl").alias("total_pnl"),
    )
    points = scans.quantiles(closed, keys, "pnl", {"p05_pnl": 0.05, "median_pnl": 0.5, "p95_pnl": 0.95}).join(scans.quantiles(closed, keys, "holding_days", {"median_holding_days": 0.5}), keys)
    names = ("trades", "win_rate", "mean_pnl", "median_pnl", "p05_pnl", "p95_pnl", "mean_holding_days", "median_holding_days", "total_pnl")
    return sums.join(points, keys, "left").select(*keys, *names)


def tail_attribution(closed: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """What the lowest and highest `share` of each key's trades consist of, by symbol and reason. Ties go to the earlier day,
    then the symbol; a tail has one trade at least."""
    group, order = Window.partitionBy(*keys), ("pnl", "t", "symbol")
    rows = closed.withColumns({"_size": F.greatest(F.lit(1), F.ceil(F.count("*").over(group) * share)), "_low": F.row_number().over(group.orderBy(*order)), "_n": F.count("*").over(group)})
    tail = F.array_compact(F.array(F.when(F.col("_low") <= F.col("_size"), "left"), F.when(F.col("_low") > F.col("_n") - F.col("_size"), "right")))
    return rows.withColumn("tail", F.explode(tail)).groupBy(*keys, "tail", "symbol", "reason").agg(
        F.count("*").alias("trades"), F.avg("pnl").alias("mean_pnl"), F.sum("pnl").alias("total_pnl"), F.avg("holding_days").alias("mean_holding_days")
    )


def drawdown_summary(offsets: DataFrame) -> DataFrame:
    """Median and worst result over the offsets of `scoring.drawdown_offsets`."""
    return offsets.agg(
        F.count("*").alias("offsets"), F.median("total_return").alias("median_total_return"), F.min("total_return").alias("worst_total_return"), F.median("max_drawdown").alias("median_drawdown"), F.min("max_drawdown").alias("worst_drawdown")
    )


def first_usable_day(panel: DataFrame, min_universe: int = 10) -> DataFrame:
    """(t, day) of the first day with at least `min_universe` tradable assets; no row if there is none."""
    counts = panel.groupBy("t", "day").agg(F.count_if("tradable").alias("n")).where(F.col("n") >= min_universe)
    return counts.agg(F.min(F.struct("t", "day")).alias("x")).where("x is not null").select("x.t", "x.day")


def rank_scores(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks as scores: the best of n eligible assets gets n, the last 1."""
    return ranked.where("rank is not null").select(*keys, "t", "asset_idx", (F.col("eligible_count") - F.col("rank") + 1).alias("score"))


def largest_gaps(left: DataFrame, right: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(name, max_gap, unmatched) by column: how far two tables with the same keys differ, for reconciliation."""
    a, b = left.select(*keys, F.struct(*names).alias("_a")), right.select(*keys, F.struct(*names).alias("_b"))
    both = a.join(b, keys, "full")
    gaps = both.agg(*[F.max(F.abs(F.col(f"_a.{n}") - F.col(f"_b.{n}"))).alias(n) for n in names], F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"))
    return gaps.unpivot(["unmatched"], names, "name", "max_gap")
