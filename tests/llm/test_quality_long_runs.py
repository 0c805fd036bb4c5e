"""Long runs without white space are rated whole."""

import numpy as np
import pytest

from barloom.llm import quality


def _rater(seed=1):
    weights = np.random.default_rng(seed).normal(size=quality.BUCKETS)
    return quality.Rater(quality.CumulativeLink([0, 1], weights, np.zeros(1)))


def test_what_follows_a_long_beginning_counts():
    start = "日本語" * 2000
    same = _rater()
    assert len({same(start + end) for end in ("", "終わり" * 3000, "x1!" * 3000)}) == 3


def test_end_sign_is_the_true_end():
    ends = [quality.token_buckets("ab1-" * 5000 + end)[-1] for end in ("", "?!", "x")]
    assert len({*ends}) == 3 and ends[1] == quality.token_buckets("ab1-?!")[-1]


@pytest.mark.parametrize("text", ["a b a", "x" * 64, "x" * 65 + " short", "Word9" * 500, "é" * 7000 + " a b b", ""])
def test_scoring_and_fitting_have_the_same_features(text):
    rater = _rater()
    rows, cols, values = quality.features([text])
    assert rater(text) == pytest.approx(float((values * rater.model.weights[cols]).sum()))
    assert rater(text) == rater(text)
    assert not any(len(r) > quality.PIECE for r in rater.known)


def test_fitting_tells_long_runs_apart_by_their_ends():
    start = "字" * 200
    texts = [start + ("良" if i % 2 else "悪") * 500 for i in range(40)]
    model = quality.fit(texts, [i % 2 for i in range(40)])
    chances = model.probabilities(np.array([*map(quality.Rater(model), texts)]))[:, 1]
    assert chances[1::2].min() > 0.5 > chances[::2].max()
