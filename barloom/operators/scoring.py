"""Forward targets and scorers of cross-sectional signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import by_asset

HARD, WEAK = -5.0, -2.0
#: A signal with at most this spread is constant.
CONSTANT = 1e-12
#: Digits that a correlation keeps: one that is zero may come out as 1e-17.
DIGITS = 12


def by_day(keys: tuple[str, ...] = ()):
    return Window.partitionBy(*keys, "t")


def top_k(count: Column, share: float = 0.2, least: int = 2, most: int = 4) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(count * F.lit(share)).cast("int"))).cast("long")


def executable() -> Column:
    return F.col("tradable") & (F.col("open") > 0)


def forward_targets(panel: DataFrame, start_t: int, end_t: int | None, horizon: int = 10, min_universe: int = 10) -> DataFrame:
    """The panel's rows of decision days with what a purchase on the next day brings.

    The split ends with `end_t`, or with the calendar. Bought at the next open; sold at the first executable open from `horizon` days on, inside the split. What cannot be
    bought stays cash. A day on which something bought cannot be sold, or with fewer than `min_universe` available
    assets, is left out. Adds buy_t, sell_t, fwd_ret, available_count, top_k and baseline_ret.
    """
    inside = panel if end_t is None else panel.where(F.col("t") <= end_t)
    sale = F.when(executable(), F.struct("t", "open"))
    # The next executable row at or after each: a running last value in reverse order, linear in the rows.
    ahead = Window.partitionBy("asset_idx").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = inside.withColumn("__sale", F.last(sale, ignorenulls=True).over(ahead))
    rows = rows.withColumns(
        {
            "buy_t": F.lead("t", 1).over(by_asset()),
            "__buy": F.lead(F.when(executable(), F.col("open")), 1).over(by_asset()),
            "__sold": F.lead("__sale", 1 + horizon).over(by_asset()),
        }
    )
    rows = rows.where((F.col("t") >= start_t) & F.col("buy_t").isNotNull() & F.col("tradable"))
    fwd = F.when(F.col("__buy").isNull(), 0.0).otherwise(F.try_divide(F.col("__sold.open"), F.col("__buy")) - 1)
    rows = rows.withColumns({"sell_t": F.when(F.col("__buy").isNotNull(), F.col("__sold.t")), "fwd_ret": fwd})
    rows = rows.withColumns(
        {
            "available_count": F.count("*").over(by_day()),
            "__whole": F.min(F.col("fwd_ret").isNotNull()).over(by_day()),
            "baseline_ret": F.avg("fwd_ret").over(by_day()),
        }
    )
    kept = rows.where(F.col("__whole") & (F.col("available_count") >= min_universe))
    return kept.withColumn("top_k", top_k(F.col("available_count"))).drop("__sale", "__buy", "__sold", "__whole")


def in_split(panel: DataFrame, start: str, end: str | None) -> tuple[int, int | None]:
    """(first, last position) of the days from `start` to `end` (None: all that follow), both included; an error if there
    are none."""
    inside = panel.where(F.col("day") >= F.lit(start).cast("date"))
    inside = inside if end is None else inside.where(F.col("day") <= F.lit(end).cast("date"))
    first, last = inside.agg(F.min("t"), F.max("t")).first()
    if first is None:
        raise ValueError(f"no days from {start} to {end}")
    return first, last


def split_targets(panel: DataFrame, splits: dict[str, tuple[str, str | None]], horizon: int = 10, min_universe: int = 10) -> DataFrame:
    """`forward_targets` of each split (name: first and last day), with its name in the column split. Windows of signals see
    the days before a split; no purchase or sale leaves it."""
    found = None
    for name, (start, end) in splits.items():
        rows = forward_targets(panel, *in_split(panel, start, end), horizon, min_universe).withColumn("split", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return found


def unpivoted(targets: DataFrame, signals: list[str], name: str = "formula", value: str = "signal") -> DataFrame:
    """A row for each target row and signal, so that all signals are scored in one plan: columns `name` and `value`."""
    kept = [c for c in targets.columns if c not in signals]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias(name), F.col(s).cast("double").alias(value)) for s in signals])).alias("_x")
    return targets.select(*kept, each).select(*kept, f"_x.{name}", f"_x.{value}")


def ranked(targets: DataFrame, signal: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Target rows, of one signal or of each of `keys`, with rank (by 32-bit signal, ties to the lower asset), eligibility and average ranks for the IC."""
    value = F.col(signal).cast("float")
    rows = targets.withColumn("sig", F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value))
    ok = F.col("sig").isNotNull()
    return rows.withColumns(
        {
            "rank": F.when(ok, F.row_number().over(by_day(keys).orderBy(F.col("sig").desc_nulls_last(), "asset_idx"))),
            "eligible_count": F.count("sig").over(by_day(keys)),
            "rank_sig": F.when(ok, average_rank([*keys, "t"], "sig", ok)),
            "rank_ret": F.when(ok, average_rank([*keys, "t"], "fwd_ret", ok)),
        }
    )


def average_rank(keys: list[str], value: str, ok: Column) -> Column:
    """Ascending rank among the rows of `keys` where `ok`; ties get their mean rank."""
    group = Window.partitionBy(*keys, ok)
    ties = Window.partitionBy(*keys, ok, value)
    return F.rank().over(group.orderBy(value)) + (F.count("*").over(ties) - 1) / 2


def correlation(a: str, b: str) -> Column:
    """Pearson's; NULL where one side does not vary, for which the built-in raises a division by zero in ANSI mode."""
    return F.round(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), DIGITS)


def daily_scores(targets: DataFrame, signal: str, min_universe: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each decision day (of each of `keys`): the mean return of the best `top_k`, its excess over the mean of all, and the IC."""
    rows = ranked(targets, signal, keys)
    chosen = F.col("rank") <= F.col("top_k")
    out = rows.groupBy(*keys, "t", "day").agg(
        F.first("available_count").alias("available_count"),
        F.first("eligible_count").alias("eligible_count"),
        F.first("top_k").alias("top_k"),
        F.avg(F.when(chosen, F.col("fwd_ret"))).alias("absolute_return"),
        F.first("baseline_ret").alias("baseline_return"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(chosen, F.struct("rank", "asset_idx")))), lambda x: x["asset_idx"].cast("string")), ";").alias("selected"),
        F.max(F.when(chosen, F.coalesce("sell_t", F.lit(-1)))).alias("last_exit"),
        F.when(F.first("eligible_count") >= min_universe, correlation("rank_sig", "rank_ret")).alias("rank_ic"),
    )
    return out.withColumn("excess_return", F.col("absolute_return") - F.col("baseline_return"))


def summary(daily: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each of `keys`): a single day without enough eligible assets makes a signal invalid, at a reward of -5."""
    enough = F.coalesce(F.min(F.col("eligible_count") >= F.col("top_k")), F.lit(False))
    mean, std = F.avg("rank_ic"), F.stddev_pop("rank_ic")
    return daily.groupBy(*keys).agg(
        enough.alias("valid"),
        F.count("*").alias("scorer_days"),
        F.when(enough, F.avg("excess_return")).otherwise(HARD).alias("reward"),
        F.when(enough, F.avg("absolute_return")).alias("mean_absolute_return"),
        F.when(enough, F.median("absolute_return")).alias("median_absolute_return"),
        F.when(enough, F.avg((F.col("absolute_return") > 0).cast("double"))).alias("absolute_hit_rate"),
        F.when(enough, F.avg("baseline_return")).alias("mean_baseline_return"),
        F.when(enough, mean).alias("rank_ic_mean"),
        F.when(enough, std).alias("rank_ic_std"),
        F.when(enough & (std > 0), F.try_divide(mean, std)).alias("rank_ic_ir"),
        F.when(enough, F.avg(F.when(F.col("rank_ic").isNotNull(), (F.col("rank_ic") > 0).cast("double")))).alias("rank_ic_positive_rate"),
    )


def drawdown_offsets(daily: DataFrame, horizon: int = 10) -> DataFrame:
    """For each offset below `horizon`: compounded return and largest drawdown of every `horizon`-th day from it, leaving
    out days that are bought before the last position is sold.

    A fold over each offset's days in order; an offset has at most the calendar's days / horizon.
    """
    position = F.row_number().over(Window.orderBy("t")) - 1  # one row for each day of the calendar
    rows = daily.withColumn("p", position).withColumn("offset", (F.col("p") % horizon).cast("long"))
    held = rows.groupBy("offset").agg(F.array_sort(F.collect_list(F.struct("t", "last_exit", "absolute_return"))).alias("days"))
    start = F.struct(F.lit(1.0).alias("equity"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("drawdown"), F.lit(-1).cast("long").alias("exit"), F.lit(0).cast("long").alias("used"))

    def fold(a: Column, d: Column) -> Column:
        buy = d["t"] + 1
        equity = a["equity"] * (1.0 + d["absolute_return"])
        peak = F.greatest(a["peak"], equity)
        left = F.when(d["last_exit"] >= 0, d["last_exit"]).otherwise(buy)
        moved = F.struct(equity.alias("equity"), peak.alias("peak"), F.least(a["drawdown"], equity / peak - 1.0).alias("drawdown"), left.alias("exit"), (a["used"] + 1).alias("used"))
        return F.when(buy <= a["exit"], a).otherwise(moved)

    out = held.select("offset", F.aggregate("days", start, fold).alias("x"))
    return out.select("offset", (F.col("x.equity") - 1.0).alias("total_return"), F.col("x.drawdown").alias("max_drawdown"), F.col("x.used").alias("used"))


def older_daily_scores(panel: DataFrame, signal: str, horizon: int = 10, min_universe: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """The older scorer: fixed sale day, and days with fewer than two eligible assets are passed over. With `keys`, of each of
    them."""
    asset = Window.partitionBy(*keys, "asset_idx").orderBy("t")
    rows = panel.withColumns(
        {
            "b": F.lead("open", 1).over(asset),
            "s": F.lead("open", 1 + horizon).over(asset),
            "ok_b": F.lead("tradable", 1).over(asset),
            "ok_s": F.lead("tradable", 1 + horizon).over(asset),
        }
    )
    rows = rows.where(F.col("tradable") & F.col("ok_s").isNotNull()).withColumn("available_count", F.count("*").over(by_day(keys)))
    rows = rows.where((F.col("available_count") >= min_universe) & F.col("ok_b") & F.col("ok_s") & F.col(signal).isNotNull() & (F.col("b") > 0) & F.col("s").isNotNull())
    rows = rows.withColumn("eligible_count", F.count("*").over(by_day(keys))).where("eligible_count >= 2")
    rows = rows.withColumn("top_k", F.least(top_k(F.col("available_count")), F.col("eligible_count")))
    rows = rows.withColumn("rank", F.row_number().over(by_day(keys).orderBy(F.col(signal).desc(), "asset_idx"))).where("rank <= top_k")
    ret = F.col("s") / F.col("b") - 1
    return rows.groupBy(*keys, "t", "day").agg(
        F.first("available_count").alias("available_count"),
        F.first("eligible_count").alias("eligible_count"),
        F.first("top_k").alias("top_k"),
        F.avg(ret).alias("mean_forward_return"),
        F.median(ret).alias("median_forward_return"),
        F.avg((ret > 0).cast("double")).alias("hit_rate"),
    )


def older_summary(daily: DataFrame, horizon: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    mean = F.avg("mean_forward_return")
    return daily.groupBy(*keys).agg(
        F.count("*").alias("scorer_days"),
        mean.alias("mean_return"),
        F.median("mean_forward_return").alias("median_return"),
        F.avg((F.col("mean_forward_return") > 0).cast("double")).alias("hit_rate"),
        (mean * 252 / horizon).alias("annual_proxy"),
        F.avg("top_k").alias("avg_top_k"),
    )


def scorer_comparison(panel: DataFrame, targets: DataFrame, signals: list[str], horizon: int = 10) -> DataFrame:
    """Both scorers side by side for each signal column of `panel` and `targets`: days, mean returns, and how the mean of
    absolute returns differs."""
    new = summary(daily_scores(unpivoted(targets, signals), "signal", keys=("formula",)), ("formula",))
    rows = unpivoted(panel.select("asset_idx", "t", "day", "open", "tradable", *signals), signals)
    old = older_summary(older_daily_scores(rows, "signal", horizon, keys=("formula",)), horizon, ("formula",))
    new = new.select("formula", "valid", F.col("scorer_days").alias("corrected_days"), F.col("mean_absolute_return").alias("corrected_absolute_return"), F.col("reward").alias("corrected_excess_return"))
    both = new.join(old.select("formula", F.col("scorer_days").alias("older_days"), F.col("mean_return").alias("older_absolute_return")), "formula", "full")
    return both.withColumn("absolute_return_difference", F.col("corrected_absolute_return") - F.col("older_absolute_return"))


def signal_quality(targets: DataFrame, signals: list[str], least_coverage: float = 0.9) -> DataFrame:
    """Coverage and spread of each signal over the available cells of decision days, and why it is invalid."""
    named = F.explode(F.array(*[F.struct(F.lit(s).alias("formula"), F.col(s).alias("v")) for s in signals])).alias("x")
    out = targets.select(named).select("x.*").groupBy("formula").agg(
        F.count("*").alias("available"), F.count("v").alias("finite"), F.stddev_pop("v").alias("spread")
    )
    coverage = F.col("finite") / F.col("available")
    reason = (
        F.when(F.col("finite") == 0, "non_finite_result")
        .when(coverage < least_coverage, "low_coverage")
        .when(F.col("spread") <= CONSTANT, "constant_signal")
        .otherwise("")
    )
    out = out.select("formula", "available", "finite", coverage.alias("coverage"), "spread", reason.alias("reason"))
    return out.withColumn("penalty", penalty(F.col("reason")))


def penalty(reason: Column) -> Column:
    """Weak reasons cost -2, hard ones -5, none 0."""
    return F.when(reason == "", 0.0).when(reason.isin("low_coverage", "constant_signal"), WEAK).otherwise(HARD)
