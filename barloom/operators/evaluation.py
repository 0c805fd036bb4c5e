"""Many formulas at once: values by asset and block of formulas, scores by day and block.

A block is some hundred formulas. Assets, with their whole history, meet every block; what a task computes is the matrix
of one asset's days by one block's formulas, in which factors and equal subformulas are computed once. A second shuffle brings the
assets of a few days and a block together, where signals are ranked side by side; it leaves a row for each formula and span of
days. No plan grows with the number of formulas.

There are as many formulas as attempts, and Spark takes tables that have arrays or come from Python for far smaller than they
are. So joins with them are merges by hint, and none of them goes through the driver as a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, factors
from ..sources.star import PRICES
from ..sources.storage import kept
from . import scoring

#: Formulas of a block, about.
BLOCK = 128
#: Cells of a span of days that are scored together, about; a day with more assets is a span of its own.
CELLS = 1024
#: Cells of the grid of assets by blocks for each shuffle partition, so that partitions get about as much.
SHARES = 4
FACTORS = frozenset(factors.NAMES)
TARGET = ("fwd_ret", "sell_t", "available_count", "top_k", "baseline_ret")


def in_blocks(formulas: DataFrame, size: int = BLOCK) -> tuple[DataFrame, int]:
    """((block, formulas: array of canonical_hash and program in order of hash), how many blocks) of different
    formulas (canonical_hash, program)."""
    n = max(1, -(-formulas.count() // size))
    block = F.pmod(F.xxhash64("canonical_hash"), F.lit(n)).cast("int").alias("block")
    rows = formulas.select(block, F.struct("canonical_hash", "program").alias("f")).groupBy("block").agg(F.array_sort(F.collect_list("f")).alias("formulas"))  # about `size` of them
    return kept(rows), n


def histories(panel: DataFrame, targets: DataFrame) -> DataFrame:
    """(asset_idx, days: array of t, tradable, target columns and prices in order of t): a row for each asset."""
    placed = panel.select("asset_idx", "t", "tradable", *PRICES)
    found = placed.join(targets.select("asset_idx", "t", *TARGET), ["asset_idx", "t"], "left")
    day = F.struct("t", "tradable", *[F.col(c).cast("double").alias(c) for c in (*TARGET, *PRICES)])
    return found.groupBy("asset_idx").agg(F.array_sort(F.collect_list(day)).alias("days"))


def values(program: list[str], column: dict[str, np.ndarray], tradable: np.ndarray, known: dict[str, np.ndarray]) -> np.ndarray:
    """The value of a postfix program on each day, NaN where it has none; `known` keeps those of subprograms."""
    stack: list[str] = []

    def put(name: str, make) -> None:
        if name not in known:
            known[name] = make()
        stack.append(name)

    def masked(x: np.ndarray) -> np.ndarray:
        return arrays.masked(x, tradable)

    for token in program:
        if token in FACTORS:
            put(token, lambda: arrays.factor(token, column, tradable))
        elif token.startswith("="):
            put(token, lambda: masked(np.full(len(tradable), float(token[1:]))))
        elif token.startswith(("REF_", "MEAN_")):
            a, n = stack.pop(), int(token.split("_")[1])
            put(f"({a} {token})", lambda: masked((arrays.lag if token[0] == "R" else arrays.mean)(known[a], n)))
        elif token in ("NEG", "ABS", "SIGN"):
            a = stack.pop()
            put(f"({a} {token})", lambda: {"NEG": np.negative, "ABS": np.abs, "SIGN": np.sign}[token](known[a]))
        else:
            b, a = stack.pop(), stack.pop()
            with np.errstate(all="ignore"):
                put(f"({a} {b} {token})", lambda: masked({"ADD": np.add, "SUB": np.subtract, "MUL": np.multiply, "DIV": np.divide}[token](known[a], known[b])))
    return known[stack.pop()]


def signals(history: DataFrame, blocks: DataFrame, n_blocks: int, packed: bool = False) -> DataFrame:
    """(block, t, asset_idx, target columns, signals: array in the order of the block's formulas, NaN for missing) of the
    cells that are available on decision days. packed: the array's numbers as bytes, which cost Spark less to move."""
    parts = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A grid of groups of assets by groups of blocks: each side is sent once for each group of the other, and meets in a cell.
    wide = min(n_blocks, SHARES * parts)
    high = max(1, SHARES * parts // wide)
    at = lambda block, asset: (block * high + asset).cast("int").alias("cell")
    of_assets = history.select("asset_idx", "days", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("g")).select(at(F.col("g"), F.pmod("asset_idx", F.lit(high))), "asset_idx", "days")
    of_blocks = blocks.select("block", F.transform("formulas", lambda f: f["program"]).alias("programs"), F.explode(F.sequence(F.lit(0), F.lit(high - 1))).alias("g")).select(at(F.pmod("block", F.lit(wide)), F.col("g")), "block", "programs")
    pairs = of_assets.repartition(parts, "cell").join(of_blocks.repartition(parts, "cell").hint("merge"), "cell")
    kinds = {"sell_t": "bigint", "available_count": "bigint", "top_k": "bigint"}
    out = pa.schema([("block", pa.int32()), ("t", pa.int64()), ("asset_idx", pa.int64()), *[(c, pa.int64() if c in kinds else pa.float64()) for c in TARGET], ("signals", pa.binary() if packed else pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, asset, days, programs in zip(*(batch[c] for c in ("block", "asset_idx", "days", "programs"))):
                rows = days.values
                column = {n: rows.field(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in (*TARGET, *PRICES)}
                tradable = rows.field("tradable").to_numpy(zero_copy_only=False).astype(bool)
                known: dict[str, np.ndarray] = {}
                found = [values(p, column, tradable, known) for p in programs.as_py()]
                at = np.flatnonzero(np.isfinite(column["available_count"]))
                matrix = np.stack(found, axis=1)[at]
                if packed:
                    flat = pa.array([row.tobytes() for row in np.ascontiguousarray(matrix)], pa.binary())
                else:
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(found)), pa.array(matrix.reshape(-1)))
                target = [pa.array(column[c][at], from_pandas=True).cast(out.field(c).type) for c in TARGET]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block.as_py(), np.int32)), rows.field("t").take(pa.array(at)), pa.array(np.full(len(at), asset.as_py(), np.int64)), *target, flat], schema=out)

    ddl = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in TARGET)
    return pairs.select("block", "asset_idx", "days", "programs").mapInArrow(run, f"block int, t bigint, asset_idx bigint, {ddl}, signals {'binary' if packed else 'array<double>'}")


_SPAN = [("block", pa.int32(), "int"), ("position", pa.int32(), "int"), ("t", pa.int64(), "bigint"), ("scorable", pa.bool_(), "boolean"), ("excess", pa.float64(), "double"), ("days", pa.int64(), "bigint"), ("picks", pa.string(), "string"), ("available", pa.int64(), "bigint"), ("finite", pa.int64(), "bigint"), ("mean", pa.float64(), "double"), ("m2", pa.float64(), "double")]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Signals as a matrix, a row for each cell."""
    if pa.types.is_list(column.type):
        return column.combine_chunks().flatten().to_numpy().reshape(rows, -1)
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(rows, -1)


def _score_span(rows: pa.Table) -> pa.Table:
    """The scores of a span of days and a block: what the best of each signal return over all, summed over days, whom each
    day selects, and the spread of the signal."""
    rows = rows.sort_by([("t", "ascending"), ("asset_idx", "ascending")]).combine_chunks()
    x = _matrix(rows["signals"], rows.num_rows)
    size = x.shape[1]
    days, first, day = np.unique(rows["t"].to_numpy(), return_index=True, return_inverse=True)
    place = np.arange(rows.num_rows) - first[day]  # a cell's row among those of its day

    def grid(values: np.ndarray, empty) -> np.ndarray:
        out = np.full((len(days), place.max() + 1, *values.shape[1:]), empty, values.dtype)
        out[day, place] = values
        return out

    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    single[~np.isfinite(single)] = np.nan
    single = grid(single, np.nan)
    asset, fwd = grid(rows["asset_idx"].to_numpy(), -1), grid(rows["fwd_ret"].to_numpy(), 0.0)
    top_k, baseline = rows["top_k"].to_numpy()[first], rows["baseline_ret"].to_numpy()[first]
    eligible = (~np.isnan(single)).sum(axis=1)
    order = np.argsort(-single, axis=1, kind="stable")[:, : top_k.max()]  # missing ones come last, ties go to the lower asset
    taken = np.minimum(top_k[:, None], eligible)
    every = np.arange(len(days))[:, None, None]
    gained = np.where(np.arange(order.shape[1])[:, None] < taken[:, None, :], fwd[every, order], 0.0).sum(axis=1)
    excess = np.where(taken > 0, gained / np.maximum(taken, 1) - baseline[:, None], 0.0).sum(axis=0)
    named = {a: str(a) for a in np.unique(asset).tolist()}
    best, counts, labels = asset[every, order].transpose(2, 0, 1).tolist(), taken.T.tolist(), [f"{t}:" for t in days.tolist()]
    picks = ["|".join([t + ";".join([named[a] for a in of[:k]]) for t, of, k in zip(labels, best[j], counts[j])]) for j in range(size)]
    finite = np.isfinite(x)
    n = finite.sum(axis=0)
    mean = np.where(finite, x, 0.0).sum(axis=0) / np.maximum(n, 1)
    m2 = np.where(finite, (x - mean) ** 2, 0.0).sum(axis=0)
    same = {"block": rows["block"][0].as_py(), "t": int(days[0]), "available": rows.num_rows}
    columns = {"position": np.arange(size), "scorable": (eligible >= top_k[:, None]).all(axis=0), "excess": excess, "days": (taken > 0).sum(axis=0), "picks": picks, "finite": n, "mean": np.where(n > 0, mean, 0.0), "m2": m2} | {k: [v] * size for k, v in same.items()}
    return pa.table([pa.array(columns[c], kind) for c, kind, _ in _SPAN], schema=pa.schema([(c, kind) for c, kind, _ in _SPAN]))


def scores(found: DataFrame, blocks: DataFrame, least_coverage: float = 0.9, span: int = 1) -> DataFrame:
    """(canonical_hash, reward, scorable, quality_reason, coverage, selection_hash) of each formula whose `signals` are given.

    selection_hash: of what each day selects, in order of rank; equal for formulas that trade alike.
    span: days that are scored together.
    """
    spans = kept(found.groupBy("block", F.floor(F.col("t") / span)).applyInArrow(_score_span, ", ".join(f"{c} {ddl}" for c, _, ddl in _SPAN)))
    picks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "picks"))), lambda x: x["picks"]), "|")
    one = ["block", "position"]
    apart = spans.groupBy(*one).agg(
        F.sum("finite").alias("finite"), F.sum("available").alias("available"), F.collect_list(F.struct("mean", "finite", "m2")).alias("of"),
        F.try_divide(F.sum("excess"), F.sum("days")).alias("reward"), F.coalesce(F.min("scorable"), F.lit(False)).alias("scorable"), F.sha2(picks, 256).alias("selection_hash"),
    )
    # Spread from each span's spread about its own mean and the spread of the means: no sum of squares that cancels.
    total = lambda f: F.aggregate("of", F.lit(0.0), lambda a, x: a + f(x))
    apart = apart.withColumn("centre", F.coalesce(F.try_divide(total(lambda x: x["mean"] * x["finite"]), F.col("finite")), F.lit(0.0)))
    apart = apart.withColumn("m2", total(lambda x: x["m2"] + x["finite"] * F.pow(x["mean"] - F.col("centre"), 2)))
    coverage, spread = F.col("finite") / F.col("available"), F.sqrt(F.try_divide(F.col("m2"), F.col("finite")))
    reason = F.when(F.col("finite") == 0, "non_finite_result").when(coverage < least_coverage, "low_coverage").when(spread <= scoring.CONSTANT, "constant_signal").otherwise("")
    names = blocks.select("block", F.posexplode("formulas").alias("position", "f")).select("block", "position", "f.canonical_hash")
    return apart.join(names.hint("merge"), one).select("canonical_hash", "reward", "scorable", reason.alias("quality_reason"), coverage.alias("coverage"), "selection_hash")
