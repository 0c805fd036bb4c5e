"""Grammar, trees, canonical form and plans of formulas."""

import pytest

from barloom.functions import factors
from barloom.plans import language as lang


def test_text_of_a_nested_formula():
    assert lang.text(lang.parse("DAYRET ROC WIN_20 ADD WIN_5 REF".split())) == "REF(ADD(DAYRET,ROC(20)),5)"


@pytest.mark.parametrize("tokens", ["ROC WIN_1", "MA_RATIO WIN_20 WIN_10", "DAYRET WIN_1 MEAN", "ADD", "DAYRET GAP", "", "NOPE"])
def test_illegal_formulas(tokens):
    with pytest.raises(lang.FormulaError):
        lang.parse(tokens.split())


def test_every_reachable_state_can_close():
    seen, todo = set(), [(lang.START, lang.LONGEST)]
    while todo:
        state, left = todo.pop()
        if (state, left) in seen:
            continue
        seen.add((state, left))
        tokens = lang.legal(state, left)
        assert tokens or state == (1, None, None)
        todo += [(lang.step(state, t), left - 1) for t in tokens]


@pytest.mark.parametrize(
    "tokens, want",
    [
        ("DAYRET NEG NEG", ("DAYRET",)),
        ("DAYRET ABS ABS", ("ABS", ("DAYRET",))),
        ("DAYRET CONST_0 ADD", ("DAYRET",)),
        ("CONST_1 DAYRET MUL", ("DAYRET",)),
        ("DAYRET CONST_0 MUL", None),
        ("CONST_1 CONST_1 ADD", ("CONST", 2.0)),
    ],
)
def test_canonical_forms(tokens, want):
    tree = lang.parse(tokens.split())
    assert lang.canonical(tree) == (want if want is not None else lang.canonical(tree))
    if want is None:
        assert lang.canonical(tree)[0] == "MUL"


def test_operand_order_does_not_matter():
    a, b = (lang.canonical(lang.parse(t.split())) for t in ("DAYRET GAP ADD", "GAP DAYRET ADD"))
    assert lang.digest(a) == lang.digest(b)


def _panel(spark, scale=1.0, gap=None, days=90):
    rows = []
    for a in range(3):
        for t in range(days):
            c = (100 + t * (1 + 0.1 * a)) * (1 + 0.25 * a) * scale
            ok = t != gap
            rows.append((a, t, *((c - 0.5 * scale, c + scale, c - scale, c) if ok else (None,) * 4), ok))
    return spark.createDataFrame(rows, "asset_idx long, t long, open double, high double, low double, close double, tradable boolean")


def test_windows_need_all_their_rows(spark):
    found = factors.with_factors(_panel(spark, gap=20), ("PRICE_MA_5", "ROC_5")).where("asset_idx = 0").collect()
    by = {r["t"]: r for r in found}
    assert by[24]["PRICE_MA_5"] is None and by[25]["PRICE_MA_5"] is not None
    assert by[25]["ROC_5"] is None and by[26]["ROC_5"] is not None


def test_factors_do_not_depend_on_scale_or_the_future(spark):
    names = ("DAYRET", "CLV", "VOL_10", "TS_RANK_10", "RSV_10", "MA_RATIO_5_20")
    key = lambda df: {(r["asset_idx"], r["t"]): [r[n] for n in names] for r in df.collect()}
    base = key(factors.with_factors(_panel(spark), names))
    for other in (key(factors.with_factors(_panel(spark, 7.0), names)), key(factors.with_factors(_panel(spark, days=60), names))):
        for k, values in other.items():
            assert values == pytest.approx(base[k], abs=1e-9, nan_ok=True) if None not in values else [v is None for v in values] == [v is None for v in base[k]]


def test_flat_prices(spark):
    rows = [(0, t, 10.0, 10.0, 10.0, 10.0, True) for t in range(10)]
    panel = spark.createDataFrame(rows, "asset_idx long, t long, open double, high double, low double, close double, tradable boolean")
    last = factors.with_factors(panel, ("CLV", "RSV_5", "TS_RANK_5")).where("t = 9").first()
    assert (last["CLV"], last["RSV_5"], last["TS_RANK_5"]) == (0.0, 0.0, 0.5)


def test_a_plan_takes_one_shuffle(spark):
    panel = _panel(spark)
    plan = lang.plan(panel, {"x": lang.parse("DAYRET ROC WIN_20 ADD WIN_5 REF WIN_10 MEAN".split())})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_opcodes_of_walks_and_constants():
    import numpy as np

    from barloom.plans import walks

    for row in walks.walk(7, np.arange(200)):
        assert all(0 <= c < 59 for c in lang.opcodes(lang.parse([lang.TOKENS[t] for t in row if t >= 0])))
    assert lang.opcodes(lang.parse(["CONST_1"])) == [41]
    for tokens in ("CONST_1 CONST_1 ADD", "CONST_0 CONST_1 SUB"):
        with pytest.raises(lang.FormulaError, match="opcode"):
            lang.opcodes(lang.canonical(lang.parse(tokens.split())))
