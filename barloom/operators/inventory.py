"""Which products belong to a universe: scope by name, market state, liquidity, and groups by benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import kept, stored
from . import scans

CANDIDATE, EXCLUDED, REVIEW = "candidate", "exclude", "review"


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """The patterns that a text has in it, in their order."""
    return F.filter(F.array(*map(F.lit, patterns)).cast("array<string>"), lambda p: F.contains(F.upper(text), F.upper(p)))


def scope(text: Column, excluded: tuple[str, ...], review: tuple[str, ...], allowed: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(class, reasons): allowed patterns win over excluded ones, those over ones to review; without any it is a candidate."""
    allow, out, look = (_matches(text, p) for p in (allowed, excluded, review))
    kind = F.when(F.size(allow) > 0, CANDIDATE).when(F.size(out) > 0, EXCLUDED).when(F.size(look) > 0, REVIEW).otherwise(CANDIDATE)
    reason = F.when(F.size(allow) > 0, "explicit_allow").when(F.size(out) > 0, F.array_join(out, ";")).otherwise(F.array_join(look, ";"))
    return kind, reason


def market_state(listed: Column, delisted: Column, as_of: Column) -> Column:
    return F.when(delisted <= as_of, "ended").when(listed.isNull() | (listed > as_of), "not_yet_listed").otherwise("active")


def normalised(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """A benchmark's name in upper case without white space, signs and a trailing `RETURN`; then its alias."""
    plain = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[\s()\-_/]+", ""), "RETURN$", "")
    if not aliases:
        return plain
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, plain), plain)


#: Rows of a code that are ordered together; codes with more are taken apart by amount.
TOGETHER = 1 << 18


def _sums() -> list[Column]:
    """Aggregates of what `_liquid` takes.

    Amounts are summed as decimals, without rounding errors, so products with equal amounts have equal means and share a
    rank, in whatever order rows come. `rough` is for amounts that are no such decimals.
    """
    names = ("exact", "rough", "odd", "amounts", "volume", "volumes", "observations")
    return [*[(F.try_sum if n == "exact" else F.sum)(n).alias(n) for n in names], F.min("first_day").alias("first_day"), F.max("last").alias("last")]


def _liquid(sums: DataFrame, *more: str) -> DataFrame:
    total = F.when(F.col("odd") == 0, F.col("exact").cast("double"))
    return sums.select(
        "code", "observations", F.try_divide(F.coalesce(total, "rough"), "amounts").alias("avg_amount"), F.try_divide("volume", "volumes").alias("avg_volume"),
        F.col("last.close").alias("latest_close"), "first_day", F.col("last.day").alias("last_day"), *more,
    )


def liquidity(days: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Of rows (code, day, amount, volume, close): observations, mean and median amount, mean volume, the last close, and
    the first and last day.

    Days are read once. Rows of a code meet in one shuffle, in order of amount, which is where the median comes from. Codes
    of more than `together` rows are in no single task: their rows with equal amounts meet first, and the median is found by
    rank.
    """
    days = stored(days.select("code", "day", "amount", "volume", "close"))
    hot = F.broadcast(kept(days.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") > together).select("code")))  # few, since each has many rows
    amount = F.col("amount").cast("double")
    exact = amount.try_cast("decimal(28,8)")
    odd = (amount.isNotNull() & (exact.isNull() | (exact.cast("double") != amount))).cast("long")
    given = {"exact": exact, "rough": amount, "odd": odd, "amounts": amount.isNotNull().cast("long"), "volumes": F.col("volume").isNotNull().cast("long"), "observations": F.lit(1).cast("long"), "first_day": F.col("day"), "last": F.struct("day", "close")}
    own = Window.partitionBy("code")
    place = F.row_number().over(own.orderBy(F.col("amount").asc_nulls_last()))
    few = days.join(hot, "code", "left_anti").withColumns({"_n": F.count("amount").over(own), "_at": place}).withColumns(given)
    middle = [F.max(F.when(F.col("_at") == F.expr(side), F.col("amount").cast("double"))).alias(n) for n, side in (("_a", "(_n + 1) div 2"), ("_b", "_n div 2 + 1"))]
    median = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + 0.5 * (F.col("_b") - F.col("_a")))
    found = _liquid(few.groupBy("code").agg(*_sums(), *middle).withColumn("median_amount", F.when(F.col("amounts") > 0, median)), "median_amount")
    met = stored(days.join(hot, "code", "left_semi").withColumns(given).groupBy("code", "amount").agg(*_sums()))
    middles = scans.quantiles(met, ["code"], "amount", {"median_amount": 0.5}, weight="observations")
    return found.unionByName(_liquid(met.groupBy("code").agg(*_sums())).join(middles, "code", "left"))


def inventory(products: DataFrame, liquid: DataFrame, shares: DataFrame, as_of: str, excluded: tuple[str, ...], review: tuple[str, ...], allowed: tuple[str, ...] = (), aliases: dict[str, str] | None = None) -> DataFrame:
    """Products (code, name, benchmark, listed, delisted) with scope, market state, group, `liquidity` and latest share
    (code, latest_share), and their rank in the group by mean amount: ties share the best rank, missing ones come last."""
    kind, reason = scope(F.concat_ws("|", F.coalesce("name", F.lit("")), F.coalesce("benchmark", F.lit(""))), excluded, review, allowed)
    out = products.withColumns({"scope": kind, "reasons": reason, "group": normalised(F.col("benchmark"), aliases), "state": market_state(F.col("listed"), F.col("delisted"), F.lit(as_of).cast("date"))})
    names = ("observations", "avg_amount", "median_amount", "avg_volume", "latest_close")
    out = out.join(liquid.select("code", *names), "code", "left").join(shares.select("code", "latest_share"), "code", "left")
    return out.withColumn("rank_in_group", F.rank().over(Window.partitionBy("group").orderBy(F.col("avg_amount").desc_nulls_last())))


def groups(found: DataFrame) -> DataFrame:
    """Candidates by group: products by state, their codes in order, and the largest mean amount."""
    state = F.col("state")
    return found.where(F.col("scope") == CANDIDATE).groupBy("group").agg(
        F.count("*").alias("products"),
        F.count_if(state == "active").alias("active"),
        F.count_if(state == "ended").alias("ended"),
        F.count_if(state == "not_yet_listed").alias("pending"),
        F.array_join(F.transform(F.array_sort(F.collect_list("code")), lambda c: c.cast("string")), ";").alias("codes"),
        F.max("avg_amount").alias("max_avg_amount"),
    )


def selection(found: DataFrame, per_group: int) -> DataFrame:
    """The `per_group` most liquid active candidates of each group, with the number of active ones there."""
    active = found.where((F.col("scope") == CANDIDATE) & (F.col("state") == "active"))
    group = Window.partitionBy("group")
    rows = active.withColumns({"active_in_group": F.count("*").over(group), "place": F.row_number().over(group.orderBy(F.col("avg_amount").desc_nulls_last(), "code"))})
    return rows.where(F.col("place") <= per_group)
