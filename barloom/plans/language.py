"""The postfix formula language: tokens, grammar, trees, canonical form, opcodes and a planner into DataFrame columns.

A tree is a nested tuple: (factor name, windows...), ("CONST", value), (operator, child...) or (REF or MEAN, child, window).
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import factors
from ..functions.rolling import finite, lag, masked, mean

# The vocabulary, in the order of ids.
TOKENS = (
    "DAYRET", "GAP", "INTRADAY", "RANGE", "CLV", "ROC", "PRICE_MA", "VOL", "TS_RANK", "RSV", "MA_RATIO",
    "WIN_1", "WIN_5", "WIN_10", "WIN_20", "WIN_40", "WIN_60",
    "ADD", "SUB", "MUL", "NEG", "ABS", "SIGN", "REF", "MEAN", "CONST_0", "CONST_1",
)
IDS = {name: i for i, name in enumerate(TOKENS)}
LONGEST = 15
UNARY, BINARY, ROLLING = ("NEG", "ABS", "SIGN"), ("ADD", "SUB", "MUL"), ("REF", "MEAN")
WINDOWED = {*factors.FAMILIES, "MA_RATIO"}


class FormulaError(ValueError):
    """A token list that is no formula; `reason` is a short code."""

    def __init__(self, reason: str, detail: str):
        super().__init__(f"{reason}: {detail}")
        self.reason = reason


def _window(token: str) -> int | None:
    return int(token[4:]) if token.startswith("WIN_") else None


def step(state: tuple, token: str) -> tuple:
    """The grammar state (values on the stack, open window, pending factor and its windows) after a token."""
    depth, window, pending = state
    size = _window(token)
    if pending:
        name, *seen = pending
        if size is None or size == 1 or (seen and size <= seen[-1]) or (name == "MA_RATIO" and not seen and size == factors.WINDOWS[-1]):
            raise FormulaError("invalid_formula", f"{token} after {name}")
        if name == "MA_RATIO" and not seen:
            return depth, None, (name, size)
        return depth + 1, None, None
    if window is not None:
        if token not in ROLLING or (token == "MEAN" and window == 1):
            raise FormulaError("invalid_formula", f"{token} after a window of {window}")
        return depth, None, None
    if size is not None:
        if not depth:
            raise FormulaError("stack_underflow", f"{token} without a value")
        return depth, size, None
    if token in WINDOWED:
        return depth, None, (token,)
    if token in factors.FIXED or token.startswith("CONST_"):
        return depth + 1, None, None
    need = 2 if token in BINARY else 1
    if token in ROLLING:
        raise FormulaError("invalid_formula", f"{token} without a window")
    if depth < need:
        raise FormulaError("stack_underflow", f"{token} needs {need} values")
    return depth - need + 1, None, None


START = (0, None, None)


@lru_cache(maxsize=None)
def shortest_end(state: tuple) -> int:
    """Tokens that a state needs at least to become a formula."""
    depth, window, pending = state
    if pending:
        return (2 if pending == ("MA_RATIO",) else 1) + depth
    return (1 if window is not None else 0) + (depth - 1 if depth else 1)


def legal(state: tuple, left: int) -> list[str]:
    """The tokens that may follow if `left` tokens remain in all."""
    out = []
    for token in TOKENS:
        try:
            after = step(state, token)
        except FormulaError:
            continue
        if shortest_end(after) <= left - 1:
            out.append(token)
    return out


def parse(tokens: list[str] | list[int]) -> tuple:
    """The tree of a postfix token list; FormulaError if it is none."""
    names = [t if isinstance(t, str) else TOKENS[t] if 0 <= t < len(TOKENS) else "" for t in tokens]
    if any(n not in IDS for n in names):
        raise FormulaError("unknown_instruction", str(tokens))
    if not names or len(names) > LONGEST:
        raise FormulaError("invalid_formula", f"{len(names)} tokens")
    state, stack, windows = START, [], []
    for name in names:
        pending = state[2]
        state = step(state, name)
        if (size := _window(name)) is not None:
            windows.append(size)
            if pending and not state[2]:
                stack.append((pending[0], *windows))
                windows = []
        elif name in ROLLING:
            stack.append((name, stack.pop(), windows.pop()))
        elif name in BINARY:
            right = stack.pop()
            stack.append((name, stack.pop(), right))
        elif name in UNARY:
            stack.append((name, stack.pop()))
        elif name.startswith("CONST_"):
            stack.append(("CONST", float(name[6:])))
        elif name not in WINDOWED:
            stack.append((name,))
    if state[1] is not None or state[2] or len(stack) != 1:
        raise FormulaError("stack_not_single", str(names))
    return stack[0]


def text(tree: tuple) -> str:
    name, *rest = tree
    if name == "CONST":
        return f"{rest[0]:g}"
    return name + (f"({','.join(text(r) if isinstance(r, tuple) else str(r) for r in rest)})" if rest else "")


def digest(tree: tuple) -> str:
    return hashlib.sha256(json.dumps(tree, separators=(",", ":")).encode()).hexdigest()


def canonical(tree: tuple) -> tuple:
    """An equal tree in normal form: double NEG, ABS, SIGN and neutral constants removed, constants folded, operands of
    ADD and MUL in the order of their digests. x * 0 stays, since it is missing where x is."""
    name, *rest = tree
    rest = [canonical(r) if isinstance(r, tuple) else r for r in rest]
    if name in UNARY and isinstance(rest[0], tuple) and rest[0][0] == name:
        return rest[0][1] if name == "NEG" else rest[0]
    if name in BINARY:
        left, right = rest
        a, b = (x[1] if x[0] == "CONST" else None for x in rest)
        if a is not None and b is not None:
            return ("CONST", a + b if name == "ADD" else a - b if name == "SUB" else a * b)
        neutral = 1.0 if name == "MUL" else 0.0
        if b == neutral:
            return left
        if a == neutral and name != "SUB":
            return right
        if name != "SUB":
            rest = sorted(rest, key=digest)
    return (name, *rest)


def opcodes(tree: tuple) -> list[int]:
    """Stack program: 0-39 factors, 40 and 41 constants, 42-47 operators, 48-53 REF, 54-58 MEAN by window."""
    name, *rest = tree
    if name == "CONST":
        if rest[0] not in (0.0, 1.0):
            raise FormulaError("unknown_instruction", f"no opcode for the constant {rest[0]:g}")
        return [40 + int(rest[0])]
    if name in ROLLING:
        at = (1, *factors.WINDOWS).index(rest[1]) if name == "REF" else factors.WINDOWS.index(rest[1])
        return [*opcodes(rest[0]), (48 if name == "REF" else 54) + at]
    if name in UNARY or name in BINARY:
        return [code for r in rest for code in opcodes(r)] + [42 + (*BINARY, *UNARY).index(name)]
    return [factors.NAMES.index("_".join(map(str, tree)))]


def program(tree: tuple) -> list[str]:
    """The tree in postfix order, a name for each step: a factor, `=` and a constant, or an operator with its window."""
    name, *rest = tree
    if name == "CONST":
        return [f"={rest[0]!r}"]
    if name in ROLLING:
        return [*program(rest[0]), f"{name}_{rest[1]}"]
    if name in UNARY or name in BINARY:
        return [step for r in rest for step in program(r)] + [name]
    return ["_".join(map(str, tree))]


def operator_names(tree: tuple) -> list[str]:
    """The operators of a tree, as often as they occur."""
    below = [n for r in tree[1:] if isinstance(r, tuple) for n in operator_names(r)]
    return [*below, tree[0]] if tree[0] in (*ROLLING, *UNARY, *BINARY) else below


def repeats(tree: tuple) -> int:
    """Subtrees with an operator that occur more than once, each counted without its first."""
    seen: dict[tuple, int] = {}

    def visit(t: tuple) -> None:
        if t[0] in (*ROLLING, *UNARY, *BINARY):
            seen[t] = seen.get(t, 0) + 1
        for r in t[1:]:
            if isinstance(r, tuple):
                visit(r)

    visit(tree)
    return sum(n - 1 for n in seen.values())


def shape(tree: tuple) -> tuple[int, int]:
    """(nodes, depth) of a tree."""
    below = [shape(r) for r in tree[1:] if isinstance(r, tuple)]
    return 1 + sum(n for n, _ in below), 1 + max((d for _, d in below), default=0)


def factor_names(tree: tuple) -> set[str]:
    name, *rest = tree
    if name in (*ROLLING, *UNARY, *BINARY):
        return {n for r in rest if isinstance(r, tuple) for n in factor_names(r)}
    return set() if name == "CONST" else {"_".join(map(str, tree))}


def _height(tree: tuple) -> int:
    """Operators on the longest way down."""
    below = max((_height(r) for r in tree[1:] if isinstance(r, tuple)), default=0)
    return below + (tree[0] in (*ROLLING, *UNARY, *BINARY))


def plan(panel: DataFrame, formulas: dict[str, tuple]) -> DataFrame:
    """The panel with a column for each formula.

    Equal subtrees are computed once, all those of one height in one stage, so that expressions stay small however deep
    formulas are. All windows share the panel's partitioning by asset: the whole takes one shuffle.
    """
    wanted = tuple(n for n in factors.NAMES if any(n in factor_names(t) for t in formulas.values()))
    out = factors.with_factors(panel, wanted)
    levels: dict[int, dict[tuple, str]] = {}

    def visit(tree: tuple) -> None:
        for r in tree[1:]:
            if isinstance(r, tuple):
                visit(r)
        if height := _height(tree):
            level = levels.setdefault(height, {})
            level.setdefault(tree, f"__{height}_{len(level)}")

    for tree in formulas.values():
        visit(tree)

    def column(tree: tuple) -> Column:
        """A subtree whose stage is done."""
        if height := _height(tree):
            return F.col(levels[height][tree])
        return masked(F.lit(tree[1])) if tree[0] == "CONST" else F.col("_".join(map(str, tree)))

    def value(tree: tuple) -> Column:
        name, *rest = tree
        if name in ROLLING:
            return masked((lag if name == "REF" else mean)(column(rest[0]), rest[1]))
        if name in UNARY:
            a = column(rest[0])
            return -a if name == "NEG" else F.abs(a) if name == "ABS" else F.signum(a)
        a, b = map(column, rest)
        return masked(finite(a + b if name == "ADD" else a - b if name == "SUB" else a * b))

    for height in sorted(levels):
        out = out.withColumns({n: value(t) for t, n in levels[height].items()})
    return out.select(*panel.columns, *[column(t).alias(n) for n, t in formulas.items()])
