"""Formulas as people read them: an infix text, and a simpler equal formula with the names of the rules that led to it.

Unlike the canonical form, what comes out can be written in tokens again: constants are 0, 1 and -1 (as NEG of 1) alone.
Rules are tried from the leaves up, at each node in the order of `RULES`; the first that applies replaces the node.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import language

ZERO, ONE = ("CONST", 0.0), ("CONST", 1.0)
_FOLD = {"ADD": lambda a, b: a + b, "SUB": lambda a, b: a - b, "MUL": lambda a, b: a * b}
_SIGNED = {"NEG": lambda a: -a, "ABS": abs, "SIGN": lambda a: float((a > 0) - (a < 0))}


def constant(tree: tuple) -> float | None:
    """The number that a tree of a constant and unary operators is."""
    if tree[0] == "CONST":
        return tree[1]
    below = constant(tree[1]) if tree[0] in _SIGNED else None
    return None if below is None else _SIGNED[tree[0]](below)


def _written(x: float | None) -> tuple | None:
    """A constant that can be written."""
    return {0.0: ZERO, 1.0: ONE, -1.0: ("NEG", ONE)}.get(x) if x is not None else None


def _folded(t: tuple) -> tuple | None:
    values = [constant(c) for c in t[1:]]
    return None if None in values else _written(_FOLD[t[0]](*values))


def _unary(t: tuple) -> tuple | None:
    found = _written(constant(t))
    return found if found != t else None


def order(tree: tuple) -> str:
    """What operands of ADD and MUL are ordered by: a fixed text of the tree."""
    name, *rest = tree
    parts = [r for r in rest if isinstance(r, tuple)]
    kind = "constant" if name == "CONST" else "operator" if name in (*language.UNARY, *language.BINARY, *language.ROLLING) else "factor"
    row = {"kind": kind, "name": f"CONST_{int(rest[0])}" if name == "CONST" else name, "params": [] if name == "CONST" else [r for r in rest if not isinstance(r, tuple)], "children": [json.loads(order(p)) for p in parts]}
    return json.dumps(row, sort_keys=True, separators=(",", ":"))


def _without(value: float, sides: tuple[int, ...]) -> Callable[[tuple], tuple | None]:
    """The other operand, where one of `sides` is the neutral value."""
    return lambda t: next((t[3 - side] for side in sides if constant(t[side]) == value), None)


#: (name, operators, what a node becomes or None); {} in a name stands for the operator.
RULES: list[tuple[str, tuple[str, ...], Callable[[tuple], tuple | None]]] = [
    ("{}_constant", language.UNARY, _unary),
    ("double_neg", ("NEG",), lambda t: t[1][1] if t[1][0] == "NEG" else None),
    ("double_abs", ("ABS",), lambda t: t[1] if t[1][0] == "ABS" else None),
    ("double_sign", ("SIGN",), lambda t: t[1] if t[1][0] == "SIGN" else None),
    ("constant_fold", language.BINARY, _folded),
    ("add_zero", ("ADD",), _without(0.0, (1, 2))),
    ("sub_zero", ("SUB",), _without(0.0, (2,))),
    ("mul_one", ("MUL",), _without(1.0, (1, 2))),
    ("commutative_order", ("ADD", "MUL"), lambda t: (t[0], t[2], t[1]) if order(t[2]) < order(t[1]) else None),
]


def simplified(tree: tuple) -> tuple[tuple, list[str]]:
    """(a simpler equal tree, the rules applied in order)."""
    trace, parts = [], []
    for r in tree[1:]:
        if isinstance(r, tuple):
            r, below = simplified(r)
            trace += below
        parts.append(r)
    node = (tree[0], *parts)
    for name, operators, rule in RULES:
        if node[0] in operators and (new := rule(node)) is not None:
            return new, [*trace, name.format(node[0].lower())]
    return node, trace


def tokens(tree: tuple) -> list[str]:
    """The token list of a tree."""
    name, *rest = tree
    if name == "CONST":
        return [f"CONST_{int(rest[0])}"]
    if name in language.ROLLING:
        return [*tokens(rest[0]), f"WIN_{rest[1]}", name]
    below = [t for r in rest if isinstance(r, tuple) for t in tokens(r)]
    return [*below, name, *(f"WIN_{w}" for w in rest if not isinstance(w, tuple))]


def infix(tree: tuple) -> str:
    """Binary operators between their operands, in brackets; others as functions."""
    name, *rest = tree
    if name in language.BINARY:
        return f"({infix(rest[0])} {name} {infix(rest[1])})"
    if name == "CONST":
        return f"CONST_{int(rest[0])}"
    inner = ",".join(infix(r) if isinstance(r, tuple) else str(r) for r in rest)
    return f"{name}({inner})" if inner else name


_FIELDS = pa.struct([("infix", pa.string()), ("simplified_infix", pa.string()), ("simplified", pa.list_(pa.string())), ("rules", pa.list_(pa.string()))])


def shown(tokens_: Column) -> Column:
    """A struct for each token list: infix text, that of the simpler formula, its tokens and the rules; for what is no
    formula the tokens as text, and no more."""

    def one(names: list[str] | None) -> dict:
        try:
            tree = language.parse(names or [])
        except language.FormulaError:
            return {"infix": " ".join(names or []), "simplified_infix": None, "simplified": None, "rules": []}
        new, rules = simplified(tree)
        return {"infix": infix(tree), "simplified_infix": infix(new), "simplified": tokens(new), "rules": rules}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([*map(one, batch.to_pylist())], _FIELDS)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<infix: string, simplified_infix: string, simplified: array<string>, rules: array<string>>")(tokens_)
