"""Column builders for causal windows on a dense panel. Missing is NULL and spreads; a window needs all its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def by_asset():
    """One asset in time order. Every frame below shares this partitioning and order, so one shuffle and sort serve all."""
    return Window.partitionBy("asset_idx").orderBy("t")


def window(n: int):
    return by_asset().rowsBetween(1 - n, 0)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def lag(x: Column, n: int) -> Column:
    return F.lag(x, n).over(by_asset())


def full(x: Column, n: int, aggregate: Callable[[Column], Column]) -> Column:
    """The aggregate over the last n rows if none of them is missing."""
    return F.when(F.count(x).over(window(n)) == n, aggregate(x).over(window(n)))


def mean(x: Column, n: int) -> Column:
    return full(x, n, F.avg)


def std(x: Column, n: int) -> Column:
    return full(x, n, F.stddev_pop)


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive."""
    return F.when(b > 0, F.try_divide(a, b))


def masked(x: Column) -> Column:
    return F.when(F.col("tradable"), x)


def rank_in_window(x: Column, n: int) -> Column:
    """Average rank of the newest value among the last n, scaled to 0..1."""
    held = F.collect_list(x).over(window(n))
    below = F.size(F.filter(held, lambda v: v < x))
    equal = F.size(F.filter(held, lambda v: v == x))
    return F.when((F.size(held) == n) & x.isNotNull(), (below + (equal + 1) / 2 - 1) / (n - 1))
