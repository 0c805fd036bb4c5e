"""What is as large as the attempts, or as their pairs, meets in shuffles: no table of formulas goes through the driver."""

import numpy as np

from barloom import attempt_sql
from barloom.operators import candidates, evaluation, likeness

DAY = "struct<t: bigint, tradable: boolean, fwd_ret: double, sell_t: double, available_count: double, top_k: double, baseline_ret: double, open: double, high: double, low: double, close: double>"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _history(spark, assets, days):
    rng = np.random.default_rng(2)
    rows = []
    for a in range(assets):
        close = 10 + rng.normal(size=days).cumsum() * 0.1
        rows.append((a, [(t, True, float(rng.normal() * 0.01), float(t + 11), float(assets), 2.0, 0.0, float(c) - 0.01, float(c) + 0.1, float(c) - 0.1, float(c)) for t, c in enumerate(close)]))
    return spark.createDataFrame(rows, f"asset_idx long, days array<{DAY}>")


def test_tables_of_formulas_are_not_broadcast(spark):
    rows = spark.createDataFrame([(i, attempt_sql.tokens_of(3, i)) for i in range(60)], "attempt_index long, tokens array<string>")
    tried = candidates.described(rows).cache()
    blocks, n = evaluation.in_blocks(tried.where("reason = ''").select("canonical_hash", "program").dropDuplicates(["canonical_hash"]), 16)
    assert n > 1
    found = evaluation.signals(_history(spark, 12, 40), blocks, n)
    scores = evaluation.scores(found, blocks)
    rated = candidates.resolved(tried, scores)
    items = candidates.best_of_hash(rated).select("canonical_hash", "reward", "token_len")
    pairs = likeness.pairs(found, blocks, n, min_days=20)
    steps = {"signals": found, "scores": scores, "status": rated, "coverage": likeness.covered(found, blocks), "pairs": pairs, "deduplicated": likeness.deduplicated(items, pairs), "clustered": likeness.clustered(items, pairs)}
    assert {name for name, df in steps.items() if "Broadcast" in _plan(df)} == set()
    assert rated.count() == 60 and rated.where("canonical_hash is null").count() > 0


def test_each_block_meets_each_asset_once(spark):
    """Also where there are more blocks than shares of the partitions, and fewer."""
    rows = spark.createDataFrame([(f"h{i:03d}", [f"={i}.0"]) for i in range(60)], "canonical_hash string, program array<string>")
    for size in (1, 7, 100):
        blocks, n = evaluation.in_blocks(rows, size)
        names = {r["block"]: [f["canonical_hash"] for f in r["formulas"]] for r in blocks.collect()}
        seen = [(name, r["asset_idx"], r["t"], x) for r in evaluation.signals(_history(spark, 5, 3), blocks, n).collect() for name, x in zip(names[r["block"]], r["signals"], strict=True)]
        assert len(seen) == len(set(seen)) == 60 * 5 * 3
        assert all(x == int(name[1:]) for name, _, _, x in seen)
