"""The base factors of one asset as arrays over its days, NaN for missing: what `factors` has as columns, for tasks that hold
an asset's history."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def lag(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.full(n, np.nan), x])[: len(x)]


def windows(x: np.ndarray, n: int) -> np.ndarray:
    """The last n values at each day, a row for a day; missing before the first."""
    return sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)


def mean(x: np.ndarray, n: int) -> np.ndarray:
    return windows(x, n).mean(axis=1)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b > 0)


def _share(part: np.ndarray, width: np.ndarray) -> np.ndarray:
    """part / width, 0 where there is no width."""
    return np.where(width == 0, 0.0, _ratio(part, width))


def masked(x: np.ndarray, tradable: np.ndarray) -> np.ndarray:
    return np.where(tradable & np.isfinite(x), x, np.nan)


def factor(name: str, prices: dict[str, np.ndarray], tradable: np.ndarray) -> np.ndarray:
    """A base factor from open, high, low and close."""
    family, *sizes = name.rsplit("_", 2 if name.startswith("MA_RATIO") else 1) if any(c.isdigit() for c in name) else (name,)
    n = [*map(int, sizes)]
    o, h, l, c = (prices[p] for p in ("open", "high", "low", "close"))
    with np.errstate(all="ignore"):
        found = {
            "DAYRET": lambda: _ratio(c, lag(c, 1)) - 1,
            "GAP": lambda: _ratio(o, lag(c, 1)) - 1,
            "INTRADAY": lambda: _ratio(c, o) - 1,
            "RANGE": lambda: _ratio(h - l, lag(c, 1)),
            "CLV": lambda: _share(c * 2 - h - l, h - l),
            "ROC": lambda: _ratio(c, lag(c, n[0])) - 1,
            "PRICE_MA": lambda: _ratio(c, mean(c, n[0])) - 1,
            "VOL": lambda: windows(masked(_ratio(c, lag(c, 1)) - 1, tradable), n[0]).std(axis=1),
            "TS_RANK": lambda: _rank(windows(c, n[0])),
            "RSV": lambda: _share(c - windows(l, n[0]).min(axis=1), windows(h, n[0]).max(axis=1) - windows(l, n[0]).min(axis=1)),
            "MA_RATIO": lambda: _ratio(mean(c, n[0]), mean(c, n[1])) - 1,
        }[family]()
    return masked(found, tradable)


def _rank(held: np.ndarray) -> np.ndarray:
    """The average rank of the newest value among those of its window, scaled to 0..1."""
    last = held[:, -1:]
    rank = ((held < last).sum(axis=1) + ((held == last).sum(axis=1) + 1) / 2 - 1) / (held.shape[1] - 1)
    return np.where(np.isnan(held).any(axis=1), np.nan, rank)
