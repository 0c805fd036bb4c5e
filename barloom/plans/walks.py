"""Random formulas as rows: walks through the grammar whose random numbers are a function of seed, row and step.

A row's formula depends on nothing but its number, so that any split of the rows into partitions, and any repetition of a
task, gives the same formulas. The grammar is a table of states; a batch of rows walks through it side by side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import language

_STEP, _MIX, _LAST = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_LAST)
    return x ^ (x >> np.uint64(31))


def uniforms(seed: int, rows: np.ndarray, step: int) -> np.ndarray:
    """A number in [0, 1) for each row number (a long) at a step of its walk."""
    with np.errstate(over="ignore"):
        start = rows.astype(np.int64).view(np.uint64) * np.uint64(_STEP) + np.uint64(seed & _MASK)
        mixed = _mixed(_mixed(start) + np.uint64(step + 1) * np.uint64(_STEP))
    return (mixed >> np.uint64(11)).astype(np.float64) / (1 << 53)


@lru_cache(maxsize=4)
def grammar(longest: int = language.LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of actions, their tokens, the states they lead to) by state and tokens left; token -1 ends the formula."""
    states, todo = {language.START: 0}, [(language.START, longest)]
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    while todo:
        state, left = todo.pop()
        at = states[state], left
        if at in found:
            continue
        moves = [(language.IDS[t], language.step(state, t)) for t in language.legal(state, left)]
        for _, after in moves:
            states.setdefault(after, len(states))
            todo.append((after, left - 1))
        found[at] = [(t, states[after]) for t, after in moves] + ([(-1, states[state])] if state == (1, None, None) else [])
    widest = max(map(len, found.values()))
    counts = np.zeros((len(states), longest + 1), np.int16)
    tokens, after = (np.full((len(states), longest + 1, widest), -1, np.int16) for _ in range(2))
    for (s, left), moves in found.items():
        counts[s, left] = len(moves)
        tokens[s, left, : len(moves)], after[s, left, : len(moves)] = zip(*moves)
    return counts, tokens, after


def _lists(tokens: np.ndarray, names: Sequence[str]) -> pa.Array:
    """Rows of token numbers, ended by -1, as lists of names."""
    there = tokens >= 0
    ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(names).take(pa.array(tokens[there])))


def walk(seed: int, rows: np.ndarray, longest: int = language.LONGEST) -> np.ndarray:
    """Token numbers of each row's formula, -1 behind its end: uniform over the legal actions at each step, ending included."""
    counts, tokens, after = grammar(longest)
    state, live = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
    out = np.full((len(rows), longest), -1, np.int64)
    for k in range(longest + 1):
        left = longest - k
        choice = (uniforms(seed, rows, k) * counts[state, left]).astype(np.int64)
        token = tokens[state, left, choice]
        live &= token >= 0
        if k == longest or not live.any():
            break
        out[live, k] = token[live]
        state = np.where(live, after[state, left, choice], state)
    return out


def formulas(row: Column, seed: int, longest: int = language.LONGEST) -> Column:
    """An array of token names for each row number: U2, uniform over legal actions."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for numbers in batches:
            yield _lists(walk(seed, numbers.to_numpy(zero_copy_only=False), longest), language.TOKENS)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<string>")(row.cast("long"))


#: What an operand, a unary and a binary operator weigh where a value is on the stack, and a binary one that
#: is needed to end in time.
OPERAND, UNARY, BINARY, NEEDED = 0.35, 0.40, 0.25, 1.0


def weighted_walk(seed: int, rows: np.ndarray, inputs: int, unary: int, binary: int, lengths: tuple[int, int], deepest: int) -> np.ndarray:
    """Token numbers of each row: operands from 0, then unary, then binary operators.

    A length is drawn first. While values must be reduced to end in time, or the stack is full, no operand is drawn;
    binary operators need two values. What is left on the stack is reduced by binary operators drawn evenly.
    """
    low, high = lengths
    target = low + (uniforms(seed, rows, 0) * (high - low + 1)).astype(np.int64)
    depth = np.zeros(len(rows), np.int64)
    out = np.full((len(rows), high + deepest), -1, np.int64)
    for k in range(high + deepest):
        inside, open_ = k < target, depth > 1
        left = target - k - 1
        empty = inside & (depth == 0)
        may_open = empty | (inside & ~(depth - 1 >= left + 1) & (depth < deepest))
        weights = np.stack(
            [
                np.where(empty, 1.0, np.where(may_open, OPERAND, 0.0)) * inputs,
                np.where(inside & ~empty, UNARY, 0.0) * unary,
                np.where(inside, np.where(depth >= 2, np.where(left <= depth - 1, NEEDED, BINARY), 0.0), np.where(open_, 1.0, 0.0)) * binary,
            ],
            axis=1,
        )
        total = weights.sum(axis=1)
        spot = uniforms(seed, rows, k + 1) * total
        bounds = np.cumsum(weights, axis=1)
        kind = np.minimum((spot[:, None] >= bounds).sum(axis=1), 2)
        sizes = np.array([inputs, unary, binary])[kind]
        below = np.where(kind > 0, bounds[np.arange(len(rows)), kind - 1], 0.0)
        width = weights[np.arange(len(rows)), kind]
        within = np.minimum(((spot - below) / np.where(width > 0, width, 1.0) * sizes).astype(np.int64), sizes - 1)
        token = np.array([0, inputs, inputs + unary])[kind] + within
        live = total > 0
        out[live, k] = token[live]
        depth += np.where(live, np.array([1, 0, -1])[kind], 0)
    return out


def weighted_formulas(row: Column, seed: int, inputs: Sequence[str], unary: Sequence[str], binary: Sequence[str], lengths: tuple[int, int] = (3, 12), deepest: int = 4) -> Column:
    """An array of token names for each row number: U1, the older generator's weights."""
    names = [*inputs, *unary, *binary]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for numbers in batches:
            yield _lists(weighted_walk(seed, numbers.to_numpy(zero_copy_only=False), len(inputs), len(unary), len(binary), lengths, deepest), names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<string>")(row.cast("long"))
