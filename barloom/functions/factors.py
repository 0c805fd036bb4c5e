"""The forty base factors, the older temporal operators and the four fixed formulas, as columns of a dense panel."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rolling import finite, full, lag, masked, mean, rank_in_window, ratio, std

WINDOWS = (5, 10, 20, 40, 60)
FIXED = ("DAYRET", "GAP", "INTRADAY", "RANGE", "CLV")
FAMILIES = ("ROC", "PRICE_MA", "VOL", "TS_RANK", "RSV")
PAIRS = tuple(combinations(WINDOWS, 2))
NAMES = (*FIXED, *(f"{f}_{w}" for f in FAMILIES for w in WINDOWS), *(f"MA_RATIO_{s}_{l}" for s, l in PAIRS))


def _prices() -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(c) for c in ("open", "high", "low", "close"))


def base(name: str) -> Column:
    """A factor that needs no full window."""
    o, h, l, c = _prices()
    before = lag(c, 1)
    if name == "DAYRET":
        return ratio(c, before) - 1
    if name == "GAP":
        return ratio(o, before) - 1
    if name == "INTRADAY":
        return ratio(c, o) - 1
    if name == "RANGE":
        return ratio(h - l, before)
    width = h - l
    return F.when(width > 0, F.try_divide(c * 2 - h - l, width)).when(width == 0, F.lit(0.0))


def windowed(name: str) -> Column:
    """A factor over full windows; VOL reads the column DAYRET."""
    family, *windows = name.rsplit("_", 2 if name.startswith("MA_RATIO") else 1)
    n = [*map(int, windows)]
    _, h, l, c = _prices()
    if family == "ROC":
        return ratio(c, lag(c, n[0])) - 1
    if family == "PRICE_MA":
        return ratio(c, mean(c, n[0])) - 1
    if family == "VOL":
        return std(F.col("DAYRET"), n[0])
    if family == "TS_RANK":
        return rank_in_window(c, n[0])
    if family == "RSV":
        low, high = full(l, n[0], F.min), full(h, n[0], F.max)
        return F.when(high - low > 0, F.try_divide(c - low, high - low)).when(high - low == 0, F.lit(0.0))
    return ratio(mean(c, n[0]), mean(c, n[1])) - 1


def with_factors(panel: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """The panel with the factors of `names`, masked to tradable cells; one shuffle by asset for all of them."""
    first = [n for n in FIXED if n in names or n == "DAYRET" and any(x.startswith("VOL") for x in names)]
    out = panel.withColumns({n: masked(base(n)) for n in first})
    rest = [n for n in names if n not in FIXED]
    out = out.withColumns({n: masked(finite(windowed(n))) for n in rest}) if rest else out
    return out.select(*panel.columns, *names)


# The older operators: no mask, fixed windows, and any finite ratio counts.


def safe_divide(a: Column, b: Column) -> Column:
    return finite(F.try_divide(a, b))


def ret(x: Column, n: int) -> Column:
    return safe_divide(x, lag(x, n)) - 1


def decay(x: Column) -> Column:
    return (x + lag(x, 1) * 0.8 + lag(x, 2) * 0.6) / 2.4


OPERATORS = {
    "DELAY1": lambda x: lag(x, 1),
    "DELAY5": lambda x: lag(x, 5),
    "DELAY10": lambda x: lag(x, 10),
    "MA5": lambda x: mean(x, 5),
    "MA10": lambda x: mean(x, 10),
    "MA20": lambda x: mean(x, 20),
    "STD10": lambda x: std(x, 10),
    "RET5": lambda x: ret(x, 5),
    "RET10": lambda x: ret(x, 10),
    "DECAY": decay,
}


def fixed_formula(name: str) -> Column:
    """The fixed formulas on close and amount."""
    c, a = F.col("close"), F.col("amount")
    if name == "mom_10":
        return ret(c, 10)
    if name == "ma_gap_5_20":
        return safe_divide(mean(c, 5), mean(c, 20)) - 1
    if name == "reversal_5":
        return -ret(c, 5)
    z = safe_divide(a - mean(a, 20), std(a, 20))
    return ret(c, 10) * F.when(z.isNotNull(), F.greatest(z, F.lit(0.0)))


FIXED_FORMULAS = ("mom_10", "ma_gap_5_20", "volume_confirmed_mom_10", "reversal_5")
