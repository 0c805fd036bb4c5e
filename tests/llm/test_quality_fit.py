"""The fit of the ordinal model against its likelihood by definition, and what the pipeline's first stage keeps."""

import math

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import quality

RIDGE = 1e-2


def _data():
    """Texts of four words whose grades 0, 1 and 2 follow the words, but not strictly."""
    random = np.random.default_rng(5)
    texts, grades = [], []
    for _ in range(120):
        good = random.random()
        texts.append(" ".join(random.choice(["alpha", "Beta"] if random.random() < good else ["x9", "zz!"]) for _ in range(8)))
        grades.append(int(np.clip(round(2 * good + random.normal() / 2), 0, 2)))
    return texts, grades


def _loss(texts, grades, weights, thresholds):
    """Mean negative log-likelihood by definition, P(grade <= k) = 1 / (1 + exp(line - threshold k)), and the penalty."""
    total = 0.0
    for text, grade in zip(texts, grades):
        _, cols, values = quality.features([text])
        line = sum(v * weights[c] for c, v in zip(cols.tolist(), values.tolist()))
        below = [0.0, *(1 / (1 + math.exp(line - t)) for t in thresholds), 1.0]
        total -= math.log(below[grade + 1] - below[grade])
    return total / len(texts) + RIDGE / 2 * float((weights**2).sum())


def test_fit_is_where_the_likelihood_by_definition_is_flat():
    texts, grades = _data()
    model = quality.fit(texts, grades, ridge=RIDGE, rounds=3000)
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    used, step = np.unique(quality_columns(texts)), 1e-4
    assert not model.weights[np.setdiff1d(np.arange(quality.BUCKETS), used)].any()

    def slope(vector, at):
        found = []
        for sign in (1, -1):
            vector[at] += sign * step
            found.append(_loss(texts, grades, model.weights, model.thresholds))
            vector[at] -= sign * step
        return (found[0] - found[1]) / (2 * step)

    # The loss is convex, so a flat point is its minimum.
    slopes = [slope(model.weights, c) for c in used] + [slope(model.thresholds, k) for k in range(2)]
    assert max(map(abs, slopes)) < 2e-3
    start = _loss(texts, grades, np.zeros(quality.BUCKETS), np.array([-1.0, 1.0]))
    assert _loss(texts, grades, model.weights, model.thresholds) < start - 0.05


def quality_columns(texts):
    _, cols, _ = quality.features(texts)
    return cols


def test_chances_are_those_by_definition():
    model = quality.CumulativeLink([0, 1, 2], np.zeros(quality.BUCKETS), np.array([-0.5, 1.25]))
    for line in (-3.0, 0.0, 0.7, 4.0):
        below = [0.0, 1 / (1 + math.exp(line + 0.5)), 1 / (1 + math.exp(line - 1.25)), 1.0]
        assert np.allclose(model.probabilities(np.array([line]))[0], np.diff(below))


def test_first_stage_keeps_what_the_model_by_definition_keeps(spark, tmp_path):
    texts, grades = _data()
    texts = [*texts, None, "", "alpha " * 30_000, "zz! " * 30_000]
    rows = [(i, t, "s", "en", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, grade string, __id string")
    labels = [(i, min(g, 1)) for i, g in enumerate(grades)] + [(None, 1), (3, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs.repartition(3), str(tmp_path))
    assert kept.columns == docs.columns
    model = quality.fit(texts[: len(grades)], [min(g, 1) for g in grades])
    expected = set()
    for i, text in enumerate(texts):
        _, cols, values = quality.features([text])
        line = float((values * model.weights[cols]).sum())
        if 1 - 1 / (1 + math.exp(line - model.thresholds[0])) >= 0.5:
            expected.add(i)
    assert {r[0] for r in kept.select(F.col("doc_id")).collect()} == expected
    assert 0 < len(expected) < len(texts)


def test_first_stage_of_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).count() == 0
