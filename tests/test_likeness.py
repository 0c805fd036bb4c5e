"""Likeness of signals in blocks against the loop over pairs and days; greedy steps against going down the list."""

import math
import random

import numpy as np
import pytest

from barloom.operators import likeness


def ranks(x):
    return [sum(y < v for y in x) + (sum(y == v for y in x) + 1) / 2 for v in x]


def naive(a, b, least=5, clip=1e-7):
    """(days, z or None) of two signals [day][asset]."""
    total = weight = days = 0
    for x, y in zip(a, b):
        both = [(u, v) for u, v in zip(x, y) if not (math.isnan(u) or math.isnan(v))]
        if len(both) < least:
            continue
        p, q = (np.array(ranks([r[k] for r in both])) for k in (0, 1))
        p, q = p - p.mean(), q - q.mean()
        norm = math.sqrt((p**2).sum() * (q**2).sum())
        if norm == 0:
            continue
        w = max(len(both) - 3, 1)
        total += w * math.atanh(min(max((p * q).sum() / norm, clip - 1), 1 - clip))
        weight, days = weight + w, days + 1
    return days, (math.tanh(total / weight) if weight else None)


def signals(n, days, assets, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, days, assets))
    base[1::4] = base[0::4][: len(base[1::4])] * 3 + rng.normal(size=base[1::4].shape) * 0.02  # nearly the same order
    base[2::4] = rng.integers(-2, 3, base[2::4].shape)  # ties
    base[3::4][rng.random(base[3::4].shape) < 0.2] = np.nan  # other assets
    base[-1] = 1.0  # constant
    return base.astype(np.float32).astype(np.float64)


def table(spark, x, blocks):
    """Signals dealt out to blocks, and the names of their places."""
    n, days, assets = x.shape
    parts = [list(range(b, n, blocks)) for b in range(blocks)]
    rows = [(b, t, a, x[at, t, a].tolist()) for b, at in enumerate(parts) for t in range(days) for a in range(assets)]
    names = [(b, [(f"s{i:04d}", []) for i in at]) for b, at in enumerate(parts)]
    return spark.createDataFrame(rows, "block int, t long, asset_idx long, signals array<double>"), spark.createDataFrame(names, "block int, formulas array<struct<canonical_hash: string, program: array<string>>>")


@pytest.mark.parametrize(("blocks", "span"), [(1, 512), (3, 7)])
def test_pairs_equal_the_loop(spark, blocks, span):
    x = signals(13, 24, 9, 5)
    found = likeness.pairs(*table(spark, x, blocks), blocks, min_assets=5, min_days=20, span=span).collect()
    assert len(found) == 13 * 12 / 2
    for r in found:
        days, rho = naive(x[int(r["a"][1:])], x[int(r["b"][1:])])
        assert (r["days"], r["sufficient"]) == (days, days >= 20)
        assert r["rho"] == (pytest.approx(rho, abs=1e-9) if days >= 20 else None)


def test_many_signals_need_no_large_plan(spark):
    x = signals(400, 6, 12, 6)
    rows, names = table(spark, x, 4)
    found = likeness.pairs(rows, names, 4, min_assets=5, min_days=2)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = {(r["a"], r["b"]): r["rho"] for r in found.collect()}
    assert len(got) == 400 * 399 / 2
    for a, b in [(0, 1), (4, 5), (2, 6), (3, 7), (17, 300)]:
        assert got[f"s{a:04d}", f"s{b:04d}"] == pytest.approx(naive(x[a], x[b])[1], abs=1e-9)


def items(spark, rows):
    return spark.createDataFrame(rows, "canonical_hash string, reward double, token_len int")


def in_order(rows):
    return [h for h, *_ in sorted(rows, key=lambda r: (-r[1], r[2], r[0]))]


def greedy(order, conflict):
    held = []
    for h in order:
        if not any(conflict(h, k) for k in held):
            held.append(h)
    return held


@pytest.mark.parametrize("shape", ["random", "chain", "none", "all"])
def test_rounds_equal_going_down_the_list(spark, shape):
    rng = random.Random(shape)
    rows = [(f"h{i:02d}", rng.choice([0.1, 0.2, 0.3]), rng.randint(1, 3)) for i in range(24)]
    order = in_order(rows)
    pairs = {
        "random": {tuple(sorted(rng.sample(order, 2))) for _ in range(60)}, "chain": {tuple(sorted(p)) for p in zip(order, order[1:])}, "none": set(),
        "all": {(a, b) for a in order for b in order if a < b},
    }[shape]
    state, rounds = likeness.first_independent(likeness.ranked(items(spark, rows)), spark.createDataFrame(sorted(pairs), "a string, b string"))
    assert {r["name"] for r in state.collect() if r["stays"]} == {*greedy(order, lambda a, b: tuple(sorted((a, b))) in pairs)}
    assert rounds <= {"none": 1, "all": 2, "chain": 24, "random": 12}[shape]


def test_kept_clusters_and_top(spark):
    rng = random.Random(4)
    rows = [(f"h{i:02d}", rng.choice([0.1, 0.2, 0.3]), rng.randint(1, 3)) for i in range(20)]
    order = in_order(rows)
    rho = {(a, b): rng.choice([None, 0.1, 0.92, 0.95, 0.999]) for a in order for b in order if a < b}
    found = spark.createDataFrame([(a, b, 300 if r is not None else 10, r is not None, r) for (a, b), r in rho.items()], "a string, b string, days int, sufficient boolean, rho double").cache()
    of = lambda a, b: rho[min(a, b), max(a, b)]
    held = greedy(order, lambda a, b: of(a, b) is None or of(a, b) >= 0.995)
    unique = {r["canonical_hash"]: r for r in likeness.deduplicated(items(spark, rows), found).collect()}
    assert {h for h, r in unique.items() if r["stays"]} == {*held}
    for h in order:
        if h not in held:
            first = next(k for k in held if order.index(k) < order.index(h) and (of(h, k) is None or of(h, k) >= 0.995))
            assert (unique[h]["blocker"], unique[h]["reason"]) == (first, "insufficient_overlap" if of(h, first) is None else "signal_duplicate")
    leaders, want = [], {}
    for h in order:
        want[h] = next((k for k in leaders if of(h, k) is not None and of(h, k) >= 0.9), h)
        leaders += [h] if want[h] == h else []
    clusters = {r["canonical_hash"]: r["leader"] for r in likeness.clustered(items(spark, rows), found).collect()}
    assert clusters == want
    kept, compared, short, doubles = [], 0, 0, 0
    for h in order[:12]:
        for k in kept:
            compared += 1
            short += of(h, k) is None
            if of(h, k) is not None and of(h, k) >= 0.995:
                doubles += 1
                break
        else:
            kept.append(h)
    (top,) = likeness.top_duplicates(items(spark, rows), found, 12).collect()
    assert (top["formulas"], top["duplicates"], top["comparisons"], top["insufficient"]) == (12, doubles, compared, short)
    assert top["duplicate_rate"] == pytest.approx(doubles / 12)


def test_coverage(spark):
    x = np.full((2, 4, 6), 1.0)
    x[1, :2, 3:] = np.nan
    found = {r["canonical_hash"]: (r["days"], r["sufficient"]) for r in likeness.covered(*table(spark, x, 2), 5, 3).collect()}
    assert found == {"s0000": (4, True), "s0001": (2, False)}
