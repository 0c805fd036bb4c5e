"""Attempts: what formulas are, their values in blocks, status and reports, and display texts."""

import hashlib
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom import attempt_sql
from barloom.functions import arrays, factors
from barloom.operators import candidates, evaluation, scoring
from barloom.plans import display, language, older, walks
from barloom.sources import star

FORMULAS = {
    "a": "CLV INTRADAY ADD", "b": "ROC WIN_20 WIN_5 MEAN", "c": "DAYRET WIN_10 REF ABS NEG", "d": "MA_RATIO WIN_5 WIN_20 SIGN RSV WIN_10 MUL", "e": "CONST_1 TS_RANK WIN_5 SUB",
    "f": "VOL WIN_10 WIN_1 REF WIN_20 MEAN GAP SUB", "g": "CONST_1",
}


def tried(spark, token_lists):
    return candidates.described(spark.createDataFrame([*enumerate(token_lists)], "attempt_index long, tokens array<string>"))


def test_values_in_blocks_equal_the_plan(spark):
    panel = star.brand_panel(spark, "/root/testdata/sf0.01").where("asset_idx < 12").cache()
    trees = {n: language.canonical(language.parse(t.split())) for n, t in FORMULAS.items()}
    targets = scoring.forward_targets(panel, 60, None, 10)
    rows = spark.createDataFrame([(n, language.program(t)) for n, t in trees.items()], "canonical_hash string, program array<string>")
    blocks, n = evaluation.in_blocks(rows, 3)
    assert n == 3
    names = {r["block"]: [f["canonical_hash"] for f in r["formulas"]] for r in blocks.collect()}
    found = {}
    for r in evaluation.signals(evaluation.histories(panel, targets), blocks, n).collect():
        for name, v in zip(names[r["block"]], r["signals"]):
            found[r["t"], r["asset_idx"], name] = None if math.isnan(v) else v
    planned = scoring.forward_targets(language.plan(panel, trees), 60, None, 10).collect()
    assert len(found) == len(planned) * len(trees)
    for r in planned:
        for name in trees:
            assert found[r["t"], r["asset_idx"], name] == (None if r[name] is None else pytest.approx(r[name], rel=1e-9, abs=1e-12)), (name, r["t"])


def test_factors_as_arrays_equal_the_columns(spark):
    panel = star.brand_panel(spark, "/root/testdata/sf0.001").where("asset_idx < 4 and t < 150")
    rows = sorted(factors.with_factors(panel).collect(), key=lambda r: (r["asset_idx"], r["t"]))
    for asset in range(4):
        mine = [r for r in rows if r["asset_idx"] == asset]
        prices = {p: np.array([math.nan if r[p] is None else r[p] for r in mine]) for p in star.PRICES}
        tradable = np.array([r["tradable"] for r in mine])
        assert not tradable.all()
        for name in factors.NAMES:
            found = [None if math.isnan(v) else v for v in arrays.factor(name, prices, tradable)]
            assert found == [None if r[name] is None else pytest.approx(r[name], rel=1e-9, abs=1e-12) for r in mine], name


def test_forms_equal_the_second_implementation(spark):
    lists = [attempt_sql.walked(4, i) for i in range(400)] + [["CLV", "ADD"], ["WIN_5"], [], ["CONST_1", "CONST_1", "ADD"], "CLV NEG NEG CONST_0 SUB".split()]
    for r in tried(spark, lists).collect():
        text = attempt_sql.normal_text(lists[r["attempt_index"]])
        assert (r["canonical_hash"] is None) == (text is None)
        if text:
            assert r["canonical_hash"] == attempt_sql.hashlib.sha256(text.encode()).hexdigest()
            assert len(r["operators"]) + len([t for t in r["program"] if t in language.factors.NAMES or t[0] == "="]) == r["nodes"] == len(r["program"])


def test_described_attempts(spark):
    rows = {r["attempt_index"]: r for r in tried(spark, ["CLV INTRADAY ADD".split(), "INTRADAY CLV ADD".split(), ["CLV", "ADD"], "CLV ABS CLV ABS MUL".split()]).collect()}
    assert rows[0]["canonical_hash"] == rows[1]["canonical_hash"] and (rows[0]["nodes"], rows[0]["depth"]) == (3, 2)
    assert rows[2]["reason"] == "stack_underflow" and rows[2]["canonical_hash"] is None
    assert (rows[3]["operators"], rows[3]["repeats"], rows[3]["factors"]) == (["ABS", "ABS", "MUL"], 1, ["CLV"])


def test_status_and_rewards(spark):
    rows = spark.createDataFrame([(i, h, 3, "" if h else "invalid_formula") for i, h in enumerate(["p", "q", "p", None, "r", "s", "t", "u"])], "attempt_index long, canonical_hash string, token_len int, reason string")
    scores = [("p", 0.5, True, "", 1.0, "x"), ("q", 0.4, True, "", 1.0, "x"), ("r", 0.9, True, "low_coverage", 0.5, "y"), ("s", 0.9, True, "constant_signal", 1.0, "z"), ("t", 0.9, False, "", 1.0, "w"), ("u", -0.2, True, "", 1.0, "v")]
    found = candidates.resolved(rows, spark.createDataFrame(scores, "canonical_hash string, reward double, scorable boolean, quality_reason string, coverage double, selection_hash string")).cache()
    got = {r["attempt_index"]: (r["status"], r["reward"], r["effective_reward"]) for r in found.collect()}
    assert got == {
        0: ("accepted_unique", 0.5, 0.5), 1: ("selection_duplicate", 0.4, 0.4), 2: ("canonical_duplicate", 0.5, 0.5), 3: ("vm_invalid", None, -5.0), 4: ("low_coverage", None, -5.0),
        5: ("constant_signal", None, -5.0), 6: ("insufficient_daily_signal", None, -5.0), 7: ("accepted_unique", -0.2, -0.2),
    }
    for width in (1, 3, 100):
        best = {r["attempt_index"]: (r["best_so_far"], r["mean_best"]) for r in candidates.running_best(found, width).collect()}
        assert best[0] == (0.5, 0.5) and best[7] == (0.5, pytest.approx(0.5))
    late = found.withColumn("attempt_index", 7 - F.col("attempt_index"))
    curve = {r["attempt_index"]: r["best_so_far"] for r in candidates.running_best(late, 2).collect()}
    assert [curve[i] for i in range(8)] == [-0.2, -0.2, -0.2, -0.2, -0.2, 0.5, 0.5, 0.5]


def test_before_the_first_sound_attempt_the_best_is_the_hard_reward(spark):
    rows = spark.createDataFrame([(0, "vm_invalid", None), (1, "low_coverage", None), (2, "accepted_unique", 0.25)], "attempt_index long, status string, reward double")
    assert [(r["best_so_far"], r["mean_best"]) for r in candidates.running_best(rows).orderBy("attempt_index").collect()] == [(-5.0, -5.0), (-5.0, -5.0), (0.25, -3.25)]


def test_a_missing_signal_is_an_error(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "canonical_hash string")
    there = spark.createDataFrame([("a", 1.0), ("b", None)], "canonical_hash string, x double")
    assert {(r["canonical_hash"], r["x"]) for r in candidates.with_signals(rows, there).collect()} == {("a", 1.0), ("b", None)}
    with pytest.raises(Exception, match="no signal for b"):
        candidates.with_signals(rows, there.where("canonical_hash = 'a'")).collect()


def test_invalid_sensitivity(spark):
    rewards = [0.1, None, 0.3, -0.2, None, 0.4, 0.1, 0.2, 0.3, 0.0, 0.5, None]
    rows = spark.createDataFrame([*enumerate(rewards)], "attempt_index long, reward double")
    found = {(r["hard_reward"], r["scope"]): r for r in candidates.invalid_sensitivity(rows, 4, 1).collect()}
    for hard in candidates.HARD_REWARDS:
        per = []
        for at in (0, 4, 8):
            batch = rewards[at : at + 4]
            x = [hard if r is None else r for r in batch]
            sd = statistics.pstdev(x)
            adv = [abs((v - (sum(x) - v) / 3) / (sd + 1e-5)) for v in x]
            bad, good = ([a for a, r in zip(adv, batch) if (r is None) == which] for which in (True, False))
            per.append((len(bad), sum(bad) / len(bad), sum(good) / len(good), sum(bad) / sum(adv), statistics.pstdev([r for r in batch if r is not None]) / (sd + 1e-5)))
        for scope, rows_ in (("all", per), ("last_1", per[-1:])):
            r = found[hard, scope]
            assert [r["invalid_count"], r["invalid_advantage"], r["valid_advantage"], r["invalid_share"], r["valid_spread"]] == pytest.approx([sum(c) / len(c) for c in zip(*rows_)])
    with pytest.raises(Exception, match="no others"):
        candidates.invalid_sensitivity(spark.createDataFrame([(0, None)], "attempt_index long, reward double"), 4, 1).collect()


# Display


@pytest.mark.parametrize(
    ("tokens", "text", "rules"),
    [
        ("CLV NEG NEG", "CLV", ["double_neg"]), ("CONST_1 NEG ABS", "CONST_1", ["abs_constant"]), ("CONST_1 CONST_1 ADD", "(CONST_1 ADD CONST_1)", []), ("CONST_0 CONST_1 SUB", "NEG(CONST_1)", ["constant_fold"]),
        ("CLV CONST_0 ADD", "CLV", ["add_zero"]), ("CONST_0 CLV SUB", "(CONST_0 SUB CLV)", []), ("CLV CONST_1 MUL SIGN SIGN", "SIGN(CLV)", ["mul_one", "double_sign"]), ("INTRADAY CLV ADD", "(CLV ADD INTRADAY)", ["commutative_order"]),
        ("ROC WIN_20 WIN_5 REF", "REF(ROC(20),5)", []), ("CONST_0 NEG", "CONST_0", ["neg_constant"]),
    ],
)
def test_display(tokens, text, rules):
    tree, found = display.simplified(language.parse(tokens.split()))
    assert (display.infix(tree), found) == (text, rules)
    assert language.parse(display.tokens(tree)) == tree


def test_display_equals_the_second_implementation(spark):
    rows = spark.range(600).select("id", walks.formulas(F.col("id"), 9).alias("tokens"))
    for r in rows.select("id", "tokens", display.shown(F.col("tokens")).alias("x")).collect():
        assert (r["x"]["infix"], r["x"]["simplified_infix"], r["x"]["rules"]) == attempt_sql.shown(r["tokens"])


def test_simpler_formulas_have_the_same_values(spark):
    panel = star.brand_panel(spark, "/root/testdata/sf0.001").where("asset_idx < 6")
    lists = [t for t in (attempt_sql.walked(21, i) for i in range(400)) if display.simplified(language.parse(t))[1]][:25]
    trees = {f"f{i}": language.parse(t) for i, t in enumerate(lists)}
    simple = {f"g{i}": display.simplified(t)[0] for i, t in enumerate(trees.values())}
    found = language.plan(panel, trees | simple)
    # x SUB x and the like differ in nothing; sums in another order in the last bits.
    far = [F.count_if(~F.coalesce(F.abs(F.col(f"f{i}") - F.col(f"g{i}")) <= 1e-9, F.col(f"f{i}").isNull() & F.col(f"g{i}").isNull())) for i in range(len(trees))]
    assert set(found.agg(*far).first()) == {0}


def test_older_formulas(spark):
    assert older.infix(older.parse("close open SUB MA5 CONST_1 DIV".split())) == "(MA5((close SUB open)) DIV CONST_1)"
    for wrong in ("close ADD", "close open", "nothing"):
        with pytest.raises(language.FormulaError):
            older.parse(wrong.split())
    rows = [(0, t, float(t), 2.0 if t != 3 else 0.0, True) for t in range(6)]
    panel = spark.createDataFrame(rows, "asset_idx long, t long, close double, open double, tradable boolean")
    found = {r["t"]: r["x"] for r in older.plan(panel, {"x": "close open DIV DELAY1".split()}).collect()}
    assert found == {0: None, 1: 0.0, 2: 0.5, 3: 1.0, 4: None, 5: 2.0}


def test_splits_by_date(spark):
    panel = star.brand_panel(spark, "/root/testdata/sf0.01").cache()
    days = {r["t"]: str(r["day"]) for r in panel.select("t", "day").distinct().collect()}
    first, last = scoring.in_split(panel, "1996-01-01", "1996-12-31")
    assert days[first] >= "1996-01-01" > days[first - 1] and days[last] <= "1996-12-31" < days[last + 1]
    found = scoring.split_targets(panel, {"a": ("1996-01-01", "1996-12-31"), "b": ("1997-01-01", None)})
    inside = found.groupBy("split").agg(F.min("t").alias("lo"), F.max(F.greatest("buy_t", F.coalesce("sell_t", F.lit(0)))).alias("hi")).collect()
    assert {r["split"]: r["lo"] >= (first if r["split"] == "a" else last) for r in inside} == {"a": True, "b": True}
    assert next(r["hi"] for r in inside if r["split"] == "a") <= last
    with pytest.raises(ValueError, match="no days"):
        scoring.in_split(panel, "2050-01-01", None)


def test_spans_of_days_score_as_single_days(spark):
    """Days scored together, from signals as bytes, are what they are one by one from arrays; rows grow with spans only."""
    panel = star.brand_panel(spark, "/root/testdata/sf0.01").where("asset_idx < 12").cache()
    trees = {n: language.canonical(language.parse(t.split())) for n, t in FORMULAS.items()}
    rows = spark.createDataFrame([(n, language.program(t)) for n, t in trees.items()], "canonical_hash string, program array<string>")
    blocks, n = evaluation.in_blocks(rows, 3)
    history = evaluation.histories(panel, scoring.forward_targets(panel, 60, None, 10)).cache()
    found = evaluation.signals(history, blocks, n)
    names = {r["block"]: [f["canonical_hash"] for f in r["formulas"]] for r in blocks.collect()}
    days = {}
    for r in found.collect():
        for name, x in zip(names[r["block"]], r["signals"]):
            days.setdefault(name, {}).setdefault(r["t"], []).append((x, r["asset_idx"], r["fwd_ret"], r["top_k"], r["baseline_ret"]))
    single = {r["canonical_hash"]: r for r in evaluation.scores(found, blocks).collect()}
    spans = {r["canonical_hash"]: r for r in evaluation.scores(evaluation.signals(history, blocks, n, packed=True), blocks, span=40).collect()}
    assert {*single} == {*spans} == {*FORMULAS}
    for name, r in spans.items():
        assert r["selection_hash"] == single[name]["selection_hash"] and r["scorable"] == single[name]["scorable"] and r["quality_reason"] == single[name]["quality_reason"]
        excess, picks = [], []
        for t, cells in sorted(days[name].items()):
            best = sorted((c for c in cells if not math.isnan(c[0])), key=lambda c: (-np.float32(c[0]), c[1]))[: cells[0][3]]
            picks.append(f"{t}:" + ";".join(str(c[1]) for c in best))
            excess += [sum(c[2] for c in best) / len(best) - cells[0][4]] if best else []
        assert r["selection_hash"] == hashlib.sha256("|".join(picks).encode()).hexdigest()
        assert r["reward"] == (pytest.approx(sum(excess) / len(excess), rel=1e-9, abs=1e-12) if excess else None) and r["coverage"] == pytest.approx(single[name]["coverage"])
