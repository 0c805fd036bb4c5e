"""SQL of the queries on formula attempts. What formulas are is worked out here once more, on texts and one by one.

Attempts come from suppliers, so the SQL lists those of the first `KNOWN` suppliers and keeps the ones that are there.
"""

from __future__ import annotations

import hashlib
import json
import re

from . import sql
from .plans import language

KNOWN = 100
_MASK = (1 << 64) - 1


def _uniform(seed: int, row: int, step: int) -> float:
    def mix(x: int) -> int:
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
        return x ^ (x >> 31)

    golden = 0x9E3779B97F4A7C15
    return (mix((mix((row * golden + seed) & _MASK) + (step + 1) * golden) & _MASK) >> 11) / (1 << 53)


def walked(seed: int, row: int, longest: int = language.LONGEST) -> list[str]:
    """The formula of a row, drawn one action after another."""
    state, tokens = language.START, []
    while True:
        actions = language.legal(state, longest - len(tokens)) + ([None] if state == (1, None, None) else [])
        token = actions[int(_uniform(seed, row, len(tokens)) * len(actions))]
        if token is None:
            return tokens
        tokens.append(token)
        state = language.step(state, token)
        if len(tokens) == longest:
            return tokens


def normal_text(tokens: list[str]) -> str | None:
    """The canonical form as the text that is hashed, built up from texts; None for what is no formula."""
    stack: list[str] = []
    sizes: list[str] = []
    number = lambda x: float(m[1]) if (m := re.fullmatch(r'\["CONST",(.*)\]', x)) else None
    waiting = None
    for token in tokens:
        if token.startswith("WIN_"):
            sizes.append(token[4:])
            if waiting and len(sizes) == (2 if waiting == "MA_RATIO" else 1):
                stack.append(f'["{waiting}",{",".join(sizes)}]')
                waiting, sizes = None, []
            elif not waiting and not stack:
                return None
        elif token in ("REF", "MEAN"):
            stack.append(f'["{token}",{stack.pop()},{sizes.pop()}]')
        elif token in ("NEG", "ABS", "SIGN"):
            if not stack:
                return None
            x, head = stack.pop(), f'["{token}",'
            stack.append((x[len(head) : -1] if token == "NEG" else x) if x.startswith(head) else f"{head}{x}]")
        elif token in ("ADD", "SUB", "MUL"):
            if len(stack) < 2:
                return None
            b, a = stack.pop(), stack.pop()
            p, q = number(a), number(b)
            unit = 1.0 if token == "MUL" else 0.0
            if p is not None and q is not None:
                stack.append(f'["CONST",{json.dumps({"ADD": p + q, "SUB": p - q, "MUL": p * q}[token])}]')
            elif q == unit or (p == unit and token != "SUB"):
                stack.append(a if q == unit else b)
            else:
                pair = [a, b] if token == "SUB" else sorted([a, b], key=lambda x: hashlib.sha256(x.encode()).hexdigest())
                stack.append(f'["{token}",{pair[0]},{pair[1]}]')
        elif token.startswith("CONST_"):
            stack.append(f'["CONST",{float(token[6:])!r}]')
        elif token in language.WINDOWED:
            waiting = token
        else:
            stack.append(f'["{token}"]')
    return stack[0] if len(stack) == 1 and not sizes and not waiting else None


def _tree(x) -> tuple:
    return tuple(_tree(y) if isinstance(y, list) else y for y in x)


def tokens_of(seed: int, i: int) -> list[str]:
    """What the query makes of attempt i: every tenth loses its last token, every tenth repeats an earlier walk."""
    found = walked(seed, i - 5 if i % 10 == 7 else i)
    return found[:-1] if i % 10 == 3 and len(found) > 1 else found


def shown(tokens: list[str]) -> tuple[str, str | None, list[str]]:
    """(infix text, that of the simpler formula, rules), worked out on texts from left to right."""
    if normal_text(tokens) is None:
        return " ".join(tokens), None, []
    number = {"CONST_0": 0.0, "CONST_1": 1.0, "NEG(CONST_1)": -1.0}
    plain: list[str] = []
    stack: list[tuple[str, str, float | None]] = []  # simpler text, key, value
    traces: list[list[str]] = []
    key = lambda kind, name, params, children: json.dumps({"children": [json.loads(c) for c in children], "kind": kind, "name": name, "params": params}, separators=(",", ":"))
    constant = {0.0: ("CONST_0", key("constant", "CONST_0", [], []), 0.0), 1.0: ("CONST_1", key("constant", "CONST_1", [], []), 1.0)}
    constant[-1.0] = ("NEG(CONST_1)", key("operator", "NEG", [], [constant[1.0][1]]), -1.0)
    sizes: list[int] = []
    waiting = None
    for token in tokens:
        if token.startswith("WIN_"):
            sizes.append(int(token[4:]))
            if waiting and len(sizes) == (2 if waiting == "MA_RATIO" else 1):
                x = f"{waiting}({','.join(map(str, sizes))})"
                plain.append(x)
                stack.append((x, key("factor", waiting, sizes, []), None))
                traces.append([])
                waiting, sizes = None, []
        elif token in ("REF", "MEAN"):
            n = sizes.pop()
            plain.append(f"{token}({plain.pop()},{n})")
            text, k, _ = stack.pop()
            stack.append((f"{token}({text},{n})", key("operator", token, [n], [k]), None))
        elif token in ("NEG", "ABS", "SIGN"):
            plain.append(f"{token}({plain.pop()})")
            text, k, v = stack.pop()
            value = None if v is None else {"NEG": -v, "ABS": abs(v), "SIGN": float((v > 0) - (v < 0))}[token]
            whole = f"{token}({text})"
            if value in constant and constant[value][0] != whole:
                stack.append(constant[value])
                traces[-1].append(f"{token.lower()}_constant")
            elif text.startswith(f"{token}("):
                child = json.loads(k)["children"][0]
                stack.append((text[4:-1], json.dumps(child, separators=(",", ":")), number.get(text[4:-1])) if token == "NEG" else (text, k, v))
                traces[-1].append(f"double_{token.lower()}")
            else:
                stack.append((whole, key("operator", token, [], [k]), value))
        elif token in ("ADD", "SUB", "MUL"):
            right = plain.pop()
            plain.append(f"({plain.pop()} {token} {right})")
            b, a = stack.pop(), stack.pop()
            trace = traces.pop()
            traces[-1] += trace
            folded = None if a[2] is None or b[2] is None else {"ADD": a[2] + b[2], "SUB": a[2] - b[2], "MUL": a[2] * b[2]}[token]
            unit = 1.0 if token == "MUL" else 0.0
            if folded in constant:
                stack.append(constant[folded])
                traces[-1].append("constant_fold")
            elif token != "SUB" and a[2] == unit:
                stack.append(b)
                traces[-1].append("mul_one" if token == "MUL" else "add_zero")
            elif b[2] == unit:
                stack.append(a)
                traces[-1].append({"MUL": "mul_one", "ADD": "add_zero", "SUB": "sub_zero"}[token])
            else:
                if token != "SUB" and b[1] < a[1]:
                    a, b = b, a
                    traces[-1].append("commutative_order")
                stack.append((f"({a[0]} {token} {b[0]})", key("operator", token, [], [a[1], b[1]]), None))
        elif token in language.WINDOWED:
            waiting = token
        else:
            plain.append(token)
            stack.append(constant[float(token[6:])] if token.startswith("CONST_") else (token, key("factor", token, [], []), None))
            traces.append([])
    return plain[0], stack[0][0], traces[0]


def older_walked(seed: int, row: int, inputs: tuple, unary: tuple, binary: tuple, lengths: tuple[int, int], deepest: int) -> list[str]:
    """The older generator's formula of a row, drawn one token after another."""
    low, high = lengths
    target = low + int(_uniform(seed, row, 0) * (high - low + 1))
    tokens, depth = [], 0
    while len(tokens) < target or depth > 1:
        k = len(tokens)
        left = target - k - 1
        if k >= target:
            choices = [(t, 1.0, -1) for t in binary]
        elif depth == 0:
            choices = [(t, 1.0, 1) for t in inputs]
        else:
            choices = [(t, 0.35, 1) for t in inputs] if depth - 1 < left + 1 and depth < deepest else []
            choices += [(t, 0.40, 0) for t in unary]
            choices += [(t, 1.0 if left <= depth - 1 else 0.25, -1) for t in binary] if depth >= 2 else []
        spot = _uniform(seed, row, k + 1) * sum(w for _, w, _ in choices)
        for token, w, change in choices:
            if spot < w:
                break
            spot -= w
        tokens.append(token)
        depth += change
    return tokens


class Attempts:
    """The attempts of a seed, their different formulas, and SQL up to the table `attempts` with the status of each."""

    def __init__(self, seed: int):
        self.tokens = [tokens_of(seed, i) for i in range(KNOWN)]
        self.texts = [normal_text(t) for t in self.tokens]
        self.hashes = [x and hashlib.sha256(x.encode()).hexdigest() for x in self.texts]
        self.trees = {"f" + h: _tree(json.loads(x)) for x, h in zip(self.texts, self.hashes) if x}

    def _features(self, i: int) -> tuple:
        """(factors, operators, nodes, depth, repeats) from the text."""
        x = self.texts[i]
        if x is None:
            return [], [], 0, 0, 0
        factors = {"_".join(m.strip('"[]').split('",')).replace(",", "_") for m in re.findall(r'\["(?:' + "|".join(sorted({*language.WINDOWED, *language.factors.FIXED}, key=len, reverse=True)) + r')"[^\[\]]*\]', x)}
        operators = sorted(re.findall(r'"(NEG|ABS|SIGN|ADD|SUB|MUL|REF|MEAN)"', x))
        depth = deepest = 0
        for c in x:
            depth += {"[": 1, "]": -1}.get(c, 0)
            deepest = max(deepest, depth)
        ends, parts = [], {}
        for at, c in enumerate(x):
            if c == "[":
                ends.append(at)
            elif c == "]":
                part = x[ends.pop() : at + 1]
                if re.match(r'\["(NEG|ABS|SIGN|ADD|SUB|MUL|REF|MEAN)"', part):
                    parts[part] = parts.get(part, 0) + 1
        return sorted(factors), operators, x.count("["), deepest, sum(n - 1 for n in parts.values())

    def ctes(self, batch_sql, formula_ctes) -> str:
        used = tuple(n for n in language.factors.NAMES if any(n in language.factor_names(t) for t in self.trees.values()))
        rows = []
        for i, t in enumerate(self.tokens):
            factors, operators, nodes, depth, repeats = self._features(i)
            name = "NULL" if self.hashes[i] is None else f"'{self.hashes[i]}'"
            rows.append(f"({i}, '{' '.join(t)}', {len(t)}, {name}, '{';'.join(factors)}', '{';'.join(operators)}', {nodes}, {depth}, {repeats})")
        spreads = " UNION ALL ".join(f"SELECT '{n}' AS formula, stddev_pop({n}) AS spread FROM targets" for n in self.trees)
        return f"""{batch_sql(sql.with_factors(sql.BRAND, used) + ', ' + formula_ctes(self.trees), {n: n for n in self.trees}, 'valued')},
scored AS (
  SELECT formula, avg(absolute_return - baseline_return) AS reward, coalesce(bool_and(eligible_count >= top_k), false) AS scorable, sha256(string_agg(CAST(t AS VARCHAR) || ':' || selected, '|' ORDER BY t)) AS selection_hash
  FROM daily GROUP BY formula
),
cover AS (SELECT formula, count(*) AS available, count(s) AS finite FROM sig GROUP BY formula),
spreads AS ({spreads}),
listed(attempt_index, tokens, token_len, canonical_hash, factors, operators, nodes, depth, repeats) AS (VALUES {', '.join(rows)}),
tried AS (SELECT l.* FROM listed l JOIN supplier ON s_suppkey = l.attempt_index),
flaws AS (
  SELECT a.*, s.reward AS r, s.selection_hash, c.finite / c.available AS coverage,
    CASE WHEN canonical_hash IS NULL OR c.finite IS NULL OR c.finite = 0 THEN 'vm_invalid' WHEN NOT coalesce(scorable, false) THEN 'insufficient_daily_signal'
      WHEN c.finite / c.available < 0.9::DOUBLE THEN 'low_coverage' WHEN spread <= 1e-12 THEN 'constant_signal' END AS flaw
  FROM tried a LEFT JOIN scored s ON s.formula = 'f' || a.canonical_hash LEFT JOIN cover c ON c.formula = s.formula LEFT JOIN spreads p ON p.formula = s.formula
),
firsts AS (SELECT *, row_number() OVER (PARTITION BY canonical_hash, flaw IS NULL ORDER BY attempt_index) AS n FROM flaws),
seconds AS (SELECT *, row_number() OVER (PARTITION BY selection_hash, flaw IS NULL AND n = 1 ORDER BY attempt_index) AS m FROM firsts),
attempts AS MATERIALIZED (
  SELECT *, coalesce(flaw, CASE WHEN n > 1 THEN 'canonical_duplicate' WHEN m > 1 THEN 'selection_duplicate' ELSE 'accepted_unique' END) AS status,
    round(CASE WHEN flaw IS NULL THEN r END, 8) + 0.0 AS reward, round(CASE WHEN flaw IS NULL THEN r ELSE -5.0::DOUBLE END, 8) + 0.0 AS effective_reward, flaw IS NULL AS ok FROM seconds
),
best AS (SELECT canonical_hash, min(attempt_index) AS first_index, count(*) AS attempts, arg_min(token_len, (-reward, token_len, attempt_index)) AS token_len, arg_min(reward, (-reward, token_len, attempt_index)) AS reward FROM attempts WHERE ok GROUP BY canonical_hash)"""


#: Pairs of the best forms of each bucket among those with enough days, by definition: ranks among the assets that both have.
PAIRS = """items AS (SELECT canonical_hash, token_len, reward FROM best QUALIFY row_number() OVER (PARTITION BY (token_len - 1) // 5 ORDER BY reward DESC, token_len, canonical_hash) <= 500),
enough AS (SELECT formula FROM (SELECT formula, t, count(s) AS k FROM sig GROUP BY formula, t) GROUP BY formula HAVING count_if(k >= 10) >= 252),
eligible AS MATERIALIZED (SELECT i.*, row_number() OVER (ORDER BY reward DESC, token_len, canonical_hash) AS place FROM items i JOIN enough e ON e.formula = 'f' || i.canonical_hash),
vals AS MATERIALIZED (SELECT canonical_hash AS h, t, asset_idx, s FROM sig JOIN eligible ON 'f' || canonical_hash = formula WHERE s IS NOT NULL),
pr AS (SELECT a.h AS a, b.h AS b, a.t, a.s AS x, b.s AS y FROM vals a JOIN vals b ON a.t = b.t AND a.asset_idx = b.asset_idx AND a.h < b.h),
prank AS (
  SELECT a, b, t, rank() OVER (PARTITION BY a, b, t ORDER BY x) + (count(*) OVER (PARTITION BY a, b, t, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY a, b, t ORDER BY y) + (count(*) OVER (PARTITION BY a, b, t, y) - 1) / 2.0::DOUBLE AS ry FROM pr
),
pd AS (SELECT a, b, t, count(*) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN round(corr(rx, ry), 12) END AS r FROM prank GROUP BY a, b, t HAVING count(*) >= 10),
pz AS (SELECT a, b, atanh(least(greatest(r, 1e-7 - 1), 1 - 1e-7)) AS z, greatest(n - 3, 1) AS w FROM pd WHERE r IS NOT NULL),
summed AS (SELECT a, b, count(*) AS days, round(tanh(sum(z * w) / sum(w)), 8) + 0.0 AS rho FROM pz GROUP BY a, b),
pairs AS MATERIALIZED (
  SELECT x.canonical_hash AS a, y.canonical_hash AS b, coalesce(days, 0) AS days, coalesce(days, 0) >= 252 AS sufficient, CASE WHEN days >= 252 THEN rho END AS rho
  FROM eligible x JOIN eligible y ON x.canonical_hash < y.canonical_hash LEFT JOIN summed s ON s.a = x.canonical_hash AND s.b = y.canonical_hash
),
near AS (SELECT p.*, e.place AS pa, f.place AS pb FROM pairs p JOIN eligible e ON e.canonical_hash = p.a JOIN eligible f ON f.canonical_hash = p.b)"""


def greedy(name: str, conflict: str, source: str = "eligible") -> str:
    """CTE `name` (place, stays): down the ranking one by one; an item stays unless it conflicts with one that stays."""
    return f"""{name}_rows AS (SELECT row_number() OVER (ORDER BY place) AS i, place FROM {source}),
{name}_before AS (SELECT r.i, r.place, list(least(n.pa, n.pb)) FILTER (n.pa IS NOT NULL) AS before FROM {name}_rows r LEFT JOIN near n ON greatest(n.pa, n.pb) = r.place AND {conflict} GROUP BY r.i, r.place),
{name}_run AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS place, false AS stays, []::BIGINT[] AS held
  UNION ALL
  SELECT b.i, b.place, NOT coalesce(list_has_any(b.before, r.held), false), CASE WHEN coalesce(list_has_any(b.before, r.held), false) THEN r.held ELSE list_append(r.held, b.place) END
  FROM {name}_run r JOIN {name}_before b ON b.i = r.i + 1
),
{name} AS MATERIALIZED (SELECT place, stays FROM {name}_run WHERE i > 0)"""
