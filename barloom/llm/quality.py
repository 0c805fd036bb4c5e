"""Quality by ordinal cumulative-link regression on graded ratings.

A text's features are relative frequencies of hashed tokens: of each run between white space, its letters and signs as
they are, its shape, the signs at its end, and whether it repeats the run before. Long runs are whole: they count as
consecutive pieces, each with its own letters and shape. All grades share one weight vector; ordered thresholds cut the line, so
that P(grade <= k) = logistic(threshold[k] - weights . features). The result is the expected grade and the probability of
at least a wanted grade, by which documents are selected.
"""

from __future__ import annotations

import operator
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import built, mapped

BUCKETS = 1 << 16
#: Labelled rows that a model is fitted on at most: those of the lowest hash of the id.
SAMPLE = 6_000
#: Runs whose buckets or weights a task keeps.
CACHED = 150_000
LETTERS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")


#: Signs of a piece of a run.
PIECE = 64


def n_pieces(run: str) -> int:
    return -(-len(run) // PIECE)


def token_buckets(run: str) -> list[int]:
    """Buckets of a run between white space: each piece case-folded, each piece's shape, and the last three signs of the
    whole run's shape."""

    def shaped(m: re.Match) -> str:
        word = m[0]
        return "A" if word.isupper() else "a" if word.islower() else "Aa"

    def shape_of(part: str) -> str:
        return DIGITS.sub("0", LETTERS.sub(shaped, part))

    out = []
    for i in range(0, len(run), PIECE):
        piece = run[i : i + PIECE]
        out += _bucket("w " + piece.casefold()), _bucket("s " + shape_of(piece))
    return [*out, _bucket("e " + shape_of(run)[-3:])]


def _bucket(token: str) -> int:
    return xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass")) % BUCKETS


REPEAT = _bucket("repeat")


def repeats(runs: list[str]) -> int:
    return sum(map(operator.eq, runs, runs[1:]))


class CumulativeLink:
    """Weights over buckets, thresholds in ascending order, and the grades that they part."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def probabilities(self, lines: np.ndarray) -> np.ndarray:
        """[texts, grades] from `lines`, the values of weights . features."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - lines[:, None], -30, 30)))
        edges = np.hstack([np.zeros((len(lines), 1)), below, np.ones((len(lines), 1))])
        return np.diff(edges, axis=1)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the non-zero features."""
    rows, cols, values, known = [], [], [], {}
    for i, text in enumerate(texts):
        runs = (text or "").split()
        found = []
        for r in runs:
            if len(r) > PIECE:
                found += token_buckets(r)
                continue
            if r not in known:
                if len(known) > CACHED:
                    known.clear()
                known[r] = token_buckets(r)
            found += known[r]
        found += [REPEAT] * repeats(runs)
        bucket, n = np.unique(np.array(found, np.int64), return_counts=True)
        rows.append(np.full(len(bucket), i))
        cols.append(bucket)
        values.append(n / max(1, sum(map(n_pieces, runs))))
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, values))


def fit(texts: list[str | None], grades: list[int], ridge: float = 1e-5, rounds: int = 200) -> CumulativeLink:
    """The most likely weights and thresholds under an L2 penalty, by adaptive gradient steps over all rows.

    With fewer than two grades there is one certain grade (0 without any rows).
    """
    levels = sorted({*grades})
    if len(levels) < 2:
        return CumulativeLink(levels or [0], np.zeros(BUCKETS), np.zeros(0))
    rows, cols, values = features(texts)
    y = np.searchsorted(levels, grades)
    n, k = len(y), len(levels) - 1
    share = np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / n
    first = np.log(share / (1 - share))
    # Thresholds are a first one and the logarithms of the steps, so they stay in order.
    w, cut = np.zeros(BUCKETS), np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    sum_w, sum_cut = np.full(BUCKETS, 1e-8), np.full(k, 1e-8)

    def logistic(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for _ in range(rounds):
        theta = np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))
        line = np.bincount(rows, values * w[cols], n)
        high = np.where(y < k, logistic(theta[np.minimum(y, k - 1)] - line), 1.0)
        low = np.where(y > 0, logistic(theta[np.maximum(y - 1, 0)] - line), 0.0)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        g = (dh - dl) / n
        grad_w = np.bincount(cols, values * g[rows], BUCKETS) + ridge * w
        grad_theta = np.bincount(np.maximum(y - 1, 0), dl * (y > 0), k)[:k] / n - np.bincount(np.minimum(y, k - 1), dh * (y < k), k)[:k] / n
        back = np.cumsum(grad_theta[::-1])[::-1]
        grad_cut = np.concatenate([back[:1], back[1:] * np.exp(cut[1:])])
        sum_w += grad_w**2
        sum_cut += grad_cut**2
        w -= 2.0 * grad_w / np.sqrt(sum_w)
        cut -= 0.1 * grad_cut / np.sqrt(sum_cut)
    return CumulativeLink(levels, w, np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])])))


def train(docs: DataFrame, ratings: DataFrame, grade_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> CumulativeLink:
    """A model of a bounded sample of the rated texts, fitted on the driver. Null ids and grades are left out; of several
    grades for an id the highest counts."""
    known = ratings.select(F.col(id_col).cast("long").alias("__id"), F.col(grade_col).cast("int").alias("grade")).where("__id is not null and grade is not null")
    known = known.groupBy("__id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(known), "__id").orderBy("__id", "text").limit(2 * sample).collect()  # `known` has `sample` rows at most
    return fit([r["text"] for r in rows], [r["grade"] for r in rows])


class Rater:
    """The value of weights . features of texts, with the weights of runs remembered."""

    def __init__(self, model: CumulativeLink):
        self.model, self.known = model, {}

    def __call__(self, text: str | None) -> float:
        runs, known, weights = (text or "").split(), self.known, self.model.weights
        count = len(runs)
        try:
            total = sum(map(known.__getitem__, runs))
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            long = [r for r in runs if len(r) > PIECE]  # never remembered, so that a task's memory stays bounded
            short = [r for r in runs if len(r) <= PIECE] if long else runs
            for r in {*short}.difference(known):
                known[r] = float(weights[token_buckets(r)].sum())
            total = sum(map(known.__getitem__, short)) + sum(float(weights[token_buckets(r)].sum()) for r in long)
            count = len(short) + sum(map(n_pieces, long))
        return (total + repeats(runs) * float(weights[REPEAT])) / max(1, count)


def rated(docs: DataFrame, model: CumulativeLink, at_least: int = 1, text_col: str = "text") -> Column:
    """A struct column for whole texts: expected_grade, tail_probability (of a grade of `at_least` or more)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list:
        m = held.value
        p = m.probabilities(np.array([*map(built(Rater, m), texts)]))
        grades = np.array(m.grades)
        return [{"expected_grade": e, "tail_probability": t} for e, t in zip((p @ grades).tolist(), p[:, grades >= at_least].sum(axis=1).tolist())]

    kind = pa.struct([("expected_grade", pa.float64()), ("tail_probability", pa.float64())])
    return mapped(run, kind, "struct<expected_grade: double, tail_probability: double>")(F.col(text_col))


def quality(docs: DataFrame, model: CumulativeLink, at_least: int = 1, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail_probability, selected) of every row: a map without shuffle over whole texts.

    selected: tail_probability is `least` or more. Null and empty texts have no features, so the thresholds alone rate
    them. Null ids and repeated rows are returned as they came; other columns are left out, whatever their names.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), rated(docs, model, at_least, text_col).alias("x"))
    return found.select("doc_id", "x.*", (F.col("x.tail_probability") >= least).alias("selected"))


def select(docs: DataFrame, model: CumulativeLink, at_least: int = 1, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, that are selected."""
    return docs.where(rated(docs, model, at_least, text_col)["tail_probability"] >= least)
