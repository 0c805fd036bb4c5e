"""The older formula language: postfix tokens over raw columns, planned into DataFrame columns.

Its operators don't look at the mask, and a result that is not finite is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.factors import OPERATORS, safe_divide
from ..functions.rolling import finite
from .language import FormulaError

# The vocabulary by kind.
INPUTS = ("open", "high", "low", "close", "volume", "amount", "CONST_0", "CONST_1")
BINARY = ("ADD", "SUB", "MUL", "DIV")
UNARY = ("NEG", "ABS", "SIGN", *OPERATORS)


def parse(tokens: list[str]) -> tuple:
    """The tree of a postfix token list; FormulaError if it is none."""
    stack: list[tuple] = []
    for token in tokens:
        need = 0 if token in INPUTS else 1 if token in UNARY else 2 if token in BINARY else None
        if need is None:
            raise FormulaError("unknown_instruction", token)
        if len(stack) < need:
            raise FormulaError("stack_underflow", f"{token} needs {need} values")
        below = [stack.pop() for _ in range(need)][::-1]
        stack.append((token, *below))
    if len(stack) != 1:
        raise FormulaError("stack_not_single", str(tokens))
    return stack[0]


def infix(tree: tuple) -> str:
    name, *rest = tree
    if name in BINARY:
        return f"({infix(rest[0])} {name} {infix(rest[1])})"
    return f"{name}({infix(rest[0])})" if rest else name


def plan(panel: DataFrame, formulas: dict[str, list[str]]) -> DataFrame:
    """The panel with a column for each formula; equal subtrees are computed once, those of one height in one stage."""
    levels: dict[int, dict[tuple, str]] = {}

    def height(tree: tuple) -> int:
        return 1 + max(map(height, tree[1:])) if tree[1:] else 0

    def visit(tree: tuple) -> None:
        for t in tree[1:]:
            visit(t)
        if at := height(tree):
            levels.setdefault(at, {}).setdefault(tree, f"__{at}_{len(levels.get(at, {}))}")

    def column(tree: tuple) -> Column:
        if at := height(tree):
            return F.col(levels[at][tree])
        return F.lit(float(tree[0][6:])) if tree[0].startswith("CONST_") else F.col(tree[0])

    def value(tree: tuple) -> Column:
        name, *below = tree
        a, b = (*map(column, below), None)[:2]
        if name in BINARY:
            return safe_divide(a, b) if name == "DIV" else finite({"ADD": a + b, "SUB": a - b, "MUL": a * b}[name])
        return {"NEG": lambda: -a, "ABS": lambda: F.abs(a), "SIGN": lambda: F.signum(a)}.get(name, lambda: OPERATORS[name](a))()

    trees = {n: parse(t) for n, t in formulas.items()}
    for tree in trees.values():
        visit(tree)
    out = panel
    for at in sorted(levels):
        out = out.withColumns({n: value(t) for t, n in levels[at].items()})
    return out.select(*panel.columns, *[column(t).alias(n) for n, t in trees.items()])
