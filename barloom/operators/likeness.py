"""Likeness of very many signals, and what is kept of a ranked list of them.

All pairs come from blocks: a pair of blocks and a span of days is one group, in which average ranks of a day are centred
and multiplied as matrices. Spearman's rho of a day becomes Fisher's z, and z is summed over days. Where two signals have
values for different assets, ranks are taken anew among those that both have.

The greedy steps go down a ranking: an item stays unless it conflicts with one that stays before it. That is the
lexicographically first independent set of the conflicts, which rounds find without going through items one by one: what
has no undecided conflict before it stays, and what conflicts with one that stays goes.

There are up to as many pairs as the square of the items, which Spark can't tell beforehand. So joins with pairs are merges by
hint, and none of them goes through the driver as a broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import kept

#: Days that a group of two blocks works on.
SPAN = 512
_PAIR = pa.schema([("block_a", pa.int32()), ("position_a", pa.int32()), ("block_b", pa.int32()), ("position_b", pa.int32()), ("days", pa.int64()), ("wz", pa.float64()), ("w", pa.float64())])
_PAIR_DDL = "block_a int, position_a int, block_b int, position_b int, days bigint, wz double, w double"


def centred_ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(average ranks less their mean, their norm) of each row of `x`, which has no missing values."""
    less = (x[:, None, :] < x[:, :, None]).sum(axis=2)
    equal = (x[:, None, :] == x[:, :, None]).sum(axis=2)
    ranks = less + (equal + 1.0) / 2.0 - (x.shape[1] + 1) / 2.0
    return ranks, np.sqrt((ranks**2).sum(axis=1))


def day_rho(x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(rho, n) of each row of `x` with each of `y`: rank correlation among the assets (columns) that both have, NaN with
    fewer than `least` of them or a constant side."""
    rho, n = np.full((len(x), len(y)), np.nan), np.zeros((len(x), len(y)), np.int64)
    have_x, have_y = np.isfinite(x), np.isfinite(y)
    (masks_x, of_x), (masks_y, of_y) = (np.unique(m, axis=0, return_inverse=True) for m in (have_x, have_y))
    of_x, of_y = of_x.reshape(-1), of_y.reshape(-1)
    for i, a in enumerate(masks_x):
        rows = np.flatnonzero(of_x == i)
        for j, b in enumerate(masks_y):
            both, columns = a & b, np.flatnonzero(of_y == j)
            count = int(both.sum())
            at = np.ix_(rows, columns)
            n[at] = count
            if count < least:
                continue
            (rx, nx), (ry, ny) = centred_ranks(x[rows][:, both]), centred_ranks(y[columns][:, both])
            norm = nx[:, None] * ny
            rho[at] = np.where(norm > 0, (rx @ ry.T) / np.where(norm > 0, norm, 1.0), np.nan)
    return rho, n


def pairs(found: DataFrame, blocks: DataFrame, n_blocks: int, min_assets: int = 10, min_days: int = 252, clip: float = 1e-7, span: int = SPAN) -> DataFrame:
    """(a, b, days, sufficient, rho) of each pair a < b of canonical hashes, of signals as `evaluation.signals` gives them.

    rho: Fisher's z of the daily rank correlations with weights of n - 3 (1 at least), averaged and turned back; days with
    fewer than `min_assets` common assets or a constant side don't count, and below `min_days` it is missing. Values are
    compared as 32-bit numbers. Each block meets every other once, so rows are sent as often as there are blocks.
    """
    names = blocks.select("block", F.posexplode("formulas").alias("position", "f")).select("block", "position", F.col("f.canonical_hash").alias("name"))
    # A pair (i, j), i <= j, takes block i as its first and block j as its second side.
    others = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    sent = found.select("block", F.col("t"), F.col("asset_idx"), F.col("signals"), F.explode(others).alias("other"), F.floor(F.col("t") / span).alias("days_of"))
    sent = sent.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "days_of", "block", "t", "asset_idx", "signals")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        rows = rows.sort_by([("block", "ascending"), ("t", "ascending"), ("asset_idx", "ascending")]).combine_chunks()
        block, day, asset = (rows[c].to_numpy() for c in ("block", "t", "asset_idx"))
        assets = np.unique(asset)

        def days(b: int) -> dict[int, np.ndarray]:
            at = np.flatnonzero(block == b)
            if not len(at):
                return {}
            x = rows["signals"].chunk(0).slice(at[0], len(at)).flatten().to_numpy().reshape(len(at), -1).astype(np.float32)
            out = {}
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(day[at])) + 1):
                full = np.full((x.shape[1], len(assets)), np.nan, np.float32)
                full[:, np.searchsorted(assets, asset[at][part])] = x[part].T
                out[int(day[at][part[0]])] = full
            return out

        left = days(i)
        right = left if i == j else days(j)
        totals = None
        for t in left.keys() & right.keys():
            rho, n = day_rho(left[t], right[t], min_assets)
            good = np.isfinite(rho)
            w = np.where(good, np.maximum(n - 3, 1), 0).astype(np.float64)
            wz = w * np.arctanh(np.clip(np.where(good, rho, 0.0), clip - 1, 1 - clip))
            new = np.stack([good.astype(np.float64), wz, w])
            totals = new if totals is None else totals + new
        if totals is None:
            return _PAIR.empty_table()
        every = np.ones(totals[0].shape, bool)
        a, b = np.nonzero(every if i != j else np.triu(every, 1))  # pairs without a usable day too
        return pa.table([pa.array(c, f.type) for c, f in zip([np.full(len(a), i), a, np.full(len(a), j), b, totals[0][a, b].astype(np.int64), totals[1][a, b], totals[2][a, b]], _PAIR)], schema=_PAIR)

    summed = sent.groupBy("i", "j", "days_of").applyInArrow(compare, _PAIR_DDL)
    one = ["block_a", "position_a", "block_b", "position_b"]
    totals = summed.groupBy(*one).agg(F.sum("days").alias("days"), F.try_divide(F.sum("wz"), F.sum("w")).alias("z"))
    first, second = (names.select(*[F.col(c).alias(f"{c}_{s}") for c in ("block", "position")], F.col("name").alias(f"name_{s}")) for s in "ab")
    named = totals.join(first.hint("merge"), one[:2]).join(second.hint("merge"), one[2:])
    enough = (F.col("days") >= min_days) & F.col("z").isNotNull()
    return named.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"), "days", enough.alias("sufficient"), F.when(enough, F.tanh("z")).alias("rho"))


def covered(found: DataFrame, blocks: DataFrame, min_assets: int = 10, min_days: int = 252) -> DataFrame:
    """(canonical_hash, days, sufficient): on how many days a signal has enough values to be compared."""
    counted = found.select("block", "t", F.posexplode("signals").alias("position", "x")).groupBy("block", "position", "t").agg(F.count_if(~F.isnan("x")).alias("n"))
    days = counted.groupBy("block", "position").agg(F.count_if(F.col("n") >= min_assets).alias("days"))
    names = blocks.select("block", F.posexplode("formulas").alias("position", "f")).select("block", "position", "f.canonical_hash")
    return names.join(days.hint("merge"), ["block", "position"], "left").select("canonical_hash", F.coalesce("days", F.lit(0)).alias("days"), (F.coalesce("days", F.lit(0)) >= min_days).alias("sufficient"))


def ranked(items: DataFrame) -> DataFrame:
    """(name, place) of items (canonical_hash, reward, token_len): by reward, then length, then hash. A place is a struct of
    these, so that no task has to number all items."""
    return items.select(F.col("canonical_hash").alias("name"), F.struct((-F.col("reward")).alias("r"), F.col("token_len").alias("l"), F.col("canonical_hash").alias("h")).alias("place"))


def _directed(conflicts: DataFrame, places: DataFrame) -> DataFrame:
    """(before, before_place, after, after_place) of conflicts (a, b), by place; their other columns stay."""
    p = lambda x: places.select(F.col("name").alias(x), F.col("place").alias(f"p{x}")).hint("merge")
    both = conflicts.join(p("a"), "a").join(p("b"), "b")
    first = F.col("pa") < F.col("pb")
    return both.select(
        *[c for c in conflicts.columns if c not in ("a", "b")],
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("before"), F.when(first, F.col("pa")).otherwise(F.col("pb")).alias("before_place"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("after"), F.when(first, F.col("pb")).otherwise(F.col("pa")).alias("after_place"),
    )


def first_independent(places: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, int]:
    """((name, stays) of every name in `places` (name, place), the number of rounds).

    stays: no name of a smaller place that stays conflicts with it (conflicts: a, b). Rounds end when all are decided; in
    each one at least the first undecided name is, and chains of conflicts alone make many.
    """
    edges = kept(_directed(conflicts, places).select("before", "after"))
    state = kept(places.select("name", F.lit(None).cast("boolean").alias("stays")))
    rounds = 0
    while state.where("stays is null").limit(1).count():
        of = state.select(F.col("name").alias("before"), F.col("stays").alias("stays_before"))
        # What its conflicts before it say: one stays, or one is undecided.
        word = edges.join(of.hint("merge"), "before").groupBy("after").agg(F.max(F.coalesce("stays_before", F.lit(False))).alias("beaten"), F.max(F.col("stays_before").isNull()).alias("open"))
        decided = F.when(F.col("beaten"), False).when(~F.coalesce("open", F.lit(False)), True)
        state = kept(state.join(word.hint("merge"), state.name == word.after, "left").select("name", F.coalesce("stays", decided).alias("stays")))
        rounds += 1
    return state, rounds


def among(found: DataFrame, items: DataFrame, by: str = "merge") -> DataFrame:
    """The pairs of which both are in `items` (canonical_hash)."""
    for side in "ab":
        found = found.join(items.select(F.col("canonical_hash").alias(side)).hint(by), side, "left_semi")
    return found


def deduplicated(items: DataFrame, found: DataFrame, duplicate_rho: float = 0.995) -> DataFrame:
    """(canonical_hash, stays, reason, blocker) of items (canonical_hash, reward, token_len) in the order of `ranked`.

    An item goes if its likeness (found: as `pairs`) to one that stays before it can't be told (insufficient_overlap) or is
    `duplicate_rho` or more (signal_duplicate); blocker is the first such one.
    """
    places = kept(ranked(items))
    conflicts = kept(found.where(~F.col("sufficient") | (F.col("rho") >= duplicate_rho)).select("a", "b", "sufficient"))
    state, _ = first_independent(places, conflicts)
    held = state.where("stays").select(F.col("name").alias("before"))
    first = _directed(conflicts, places).join(held.hint("merge"), "before").groupBy("after").agg(F.min_by(F.struct("before", "sufficient"), "before_place").alias("x"))
    out = state.join(first.hint("merge"), state.name == first.after, "left")
    reason = F.when(F.col("stays"), "").when(F.col("x.sufficient"), "signal_duplicate").otherwise("insufficient_overlap")
    return out.select(F.col("name").alias("canonical_hash"), "stays", reason.alias("reason"), F.when(~F.col("stays"), F.col("x.before")).alias("blocker"))


def clustered(items: DataFrame, found: DataFrame, cluster_rho: float = 0.9) -> DataFrame:
    """(canonical_hash, leader, leads) of items: in their order an item joins the first leader whose likeness to it is
    `cluster_rho` or more, and leads otherwise."""
    places = kept(ranked(items))
    alike = kept(found.where(F.col("sufficient") & (F.col("rho") >= cluster_rho)).select("a", "b"))
    state, _ = first_independent(places, alike)
    held = state.where("stays").select(F.col("name").alias("before"))
    first = _directed(alike, places).join(held.hint("merge"), "before").groupBy("after").agg(F.min_by("before", "before_place").alias("leader"))
    out = state.join(first.hint("merge"), state.name == first.after, "left")
    return out.select(F.col("name").alias("canonical_hash"), F.when(F.col("stays"), F.col("name")).otherwise(F.col("leader")).alias("leader"), F.col("stays").alias("leads"))


def top_duplicates(items: DataFrame, found: DataFrame, n: int = 50, duplicate_rho: float = 0.995) -> DataFrame:
    """One row: of the `n` best items, how many are duplicates of a better one that is none, their rate, and how many
    comparisons, and comparisons without enough days, going down the list takes."""
    best = kept(items.orderBy(F.col("reward").desc(), "token_len", "canonical_hash").limit(n))
    places = kept(ranked(best))
    few = kept(among(found, best, by="broadcast"))  # `n` items
    alike = few.where(F.col("sufficient") & (F.col("rho") >= duplicate_rho)).select("a", "b")
    state, _ = first_independent(places, alike)
    held = state.join(places, "name").where("stays").select(F.col("name").alias("before"), F.col("place").alias("p"))
    stop = _directed(alike, places).join(held, "before").groupBy("after").agg(F.min("before_place").alias("stop"))
    # An item is compared with those that stay before it, up to the first that it repeats.
    tried = state.join(places, "name").join(stop, F.col("name") == F.col("after"), "left").join(F.broadcast(held), F.col("p") < F.col("place"))  # `n` rows at most
    tried = tried.where(F.col("stop").isNull() | (F.col("p") <= F.col("stop")))
    told = few.where("sufficient").select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(1).alias("told"))
    tried = tried.join(told, (F.least("name", "before") == F.col("_a")) & (F.greatest("name", "before") == F.col("_b")), "left")
    counts = tried.agg(F.count("*").alias("comparisons"), F.count_if(F.col("told").isNull()).alias("insufficient")).first()
    sums = state.agg(F.count("*").alias("formulas"), F.count_if(~F.col("stays")).alias("duplicates"))
    return sums.select("formulas", "duplicates", F.coalesce(F.try_divide(F.col("duplicates"), F.col("formulas")), F.lit(0.0)).alias("duplicate_rate"), F.lit(counts["comparisons"]).alias("comparisons"), F.lit(counts["insufficient"]).alias("insufficient"))
