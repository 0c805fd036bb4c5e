"""The fit of the toxicity model: flat where its objective by definition is flat, and scores recomputed from it."""

import random

import numpy as np
import pytest

from barloom.llm import toxicity


def sample(n=240, seed=3):
    rng = random.Random(seed)
    plain, rude = [f"word{i}" for i in range(60)], ["idiot", "moron", "scumbag"]
    texts, labels = [], []
    for _ in range(n):
        bad = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randint(3, 12)) + rng.choices(rude, k=rng.randint(1, 3)) * bad
        words += ["idiot"] * (not bad and rng.random() < 0.03)
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


def parts(model, texts, labels):
    """(features in the Nyström space, targets, class weights, ridge, weights there) by the docstrings."""
    raw = toxicity.Embedding(model.landmarks)(texts).astype(np.float64)
    own = toxicity.Kernel(model.landmarks).full(model.landmarks).astype(np.float64) ** toxicity.POWER
    value, vector = np.linalg.eigh((own + own.T) / 2)
    keep = value > 1e-3 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    x = np.hstack([raw @ root, np.ones((len(texts), 1))])
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    share = {s: (y == s).sum() for s in (1.0, -1.0)}
    weight = np.array([1 / (2 * share[s]) for s in y])
    ridge = np.array([1e-3] * (x.shape[1] - 1) + [1e-9])
    w = np.append(np.linalg.pinv(root) @ model.weights, model.bias)
    return raw, x, y, weight, ridge, w


def test_weights_are_where_the_objective_is_flat():
    texts, labels = sample()
    model = toxicity.fit(texts, labels, landmarks=12)
    _, x, y, weight, ridge, w = parts(model, texts, labels)

    def objective(v):
        return 0.5 * (ridge * v * v).sum() + 0.5 * (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()

    best = objective(w)
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-5
        assert abs(objective(w + step) - objective(w - step)) / 2e-5 < 1e-6
    rng = np.random.default_rng(1)
    assert all(objective(w + rng.normal(size=len(w)) * s) > best for s in (1e-3, 1e-1, 1.0) for _ in range(20))
    # Another way down the same valley ends at the same place.
    v = np.zeros(len(w))
    rate = 1 / (np.linalg.eigvalsh((x.T * weight) @ x).max() + ridge.max())
    seen = v
    for i in range(60_000):
        ahead = v + (i / (i + 3)) * (v - seen)
        on = 1 - y * (x @ ahead) > 0
        seen, v = v, ahead - rate * (ridge * ahead + (x[on] * weight[on, None]).T @ ((x @ ahead - y)[on]))
    assert objective(v) == pytest.approx(best, rel=1e-3)


def test_curve_is_the_likeliest():
    texts, labels = sample()
    model = toxicity.fit(texts, labels, landmarks=12)
    raw, _, y, *_ = parts(model, texts, labels)
    margin = model.margin(raw)
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = model.curve
    p = 1 / (1 + np.exp(-(a * margin + b)))
    assert abs((goal - p).sum()) < 1e-3 and abs(((goal - p) * margin).sum()) < 1e-2
    assert model.score(raw) == pytest.approx(p)


def test_scores_of_a_table_are_those_of_the_model(spark):
    texts, labels = sample()
    model = toxicity.fit(texts, labels, landmarks=12)
    odd = [*texts[:30], None, "", " ", "you idiot", texts[0]]
    found = toxicity.scores(spark.createDataFrame([*enumerate(odd)], "doc_id long, text string").repartition(3), model).collect()
    want = model.score(toxicity.Embedding(model.landmarks)(odd))
    assert [r["score"] for r in sorted(found, key=lambda r: r["doc_id"])] == pytest.approx(want.tolist())
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in found)
    right = [int(s >= 0.5) == y for s, y in zip(model.score(toxicity.Embedding(model.landmarks)(texts)), labels)]
    assert sum(right) / len(right) > 0.97
