"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words is the gap-weighted subsequence kernel: over all subsequences of three symbols, the sum of the
products of decay ** span, normalised to 1 for a word with itself. Inserted characters lengthen spans and so lower the
likeness of an insult only little. Landmarks are words that labels tell apart and common words; a sentence is its
likeness to each landmark, the largest over its words, mapped by the inverse root of the landmarks' own kernel matrix
(Nyström). A linear SVM is trained on labelled texts, whose sentences count as one bag (the largest likeness over them),
and a logistic curve turns margins into scores.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import built, mapped

#: Words longer than this are seen through overlapping windows of this many symbols, a half apart.
LONGEST = 24
ORDER, DECAY = 3, 0.75
#: Kernel values below this count as none; the others are raised to POWER, which parts an insult, even a disguised one,
#: from what chance shares with it. Values cut off in this way need not be positive definite, so the Nyström root leaves
#: out eigenvalues that are negative or less than a thousandth of the largest.
LEAST, POWER = 0.5, 3
#: Symbols: 26 letters, 10 digits, and others by code point.
SYMBOLS = 48
EDGE = re.compile(r"^\W+|\W+$")
INNER = re.compile(r"[\W_]+")
SPACED = re.compile(r"(?<!\S)\w(?:\s+\w(?!\S)){2,}")
#: Signs and digits that stand for letters in disguised words.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


class _Symbols(dict):
    """From code points to the kernel's small integers, as characters: without accents and disguises."""

    def __missing__(self, o: int) -> str:
        c = DISGUISES.get(chr(o), unicodedata.normalize("NFKD", chr(o))[0])
        k = ord(c)
        k = k - 96 if 97 <= k <= 122 else k - 48 + 27 if 48 <= k <= 57 else 37 + k % (SYMBOLS - 37)
        self[o] = chr(k)
        return self[o]


_symbols = _Symbols()


def symbols(word: str) -> bytes:
    return word.translate(_symbols).encode("latin-1")


def windows(word: str) -> list[str]:
    """The word, or overlapping windows of a long one; none if it is shorter than a subsequence."""
    if len(word) <= LONGEST:
        return [word] if len(word) >= ORDER else []
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def words_of(raw: str) -> list[str]:
    """The kernel's words of a case-folded run between white space: without signs at its ends and, if there are any inside,
    also without those, and each part between them."""
    word = EDGE.sub("", raw)
    plain = INNER.sub("", word)
    if plain == word:
        return windows(word)
    return [*windows(word), *windows(plain), *(w for part in INNER.split(word) for w in windows(part))]


def raw_words(text: str | None) -> set[str]:
    """The distinct case-folded runs of a text between white space, and joined runs of three or more single characters."""
    folded = (text or "").casefold()
    found = {*folded.split()}
    found.update("".join(run.split()) for run in SPACED.findall(folded))
    return found


class Kernel:
    """Normalised kernel values between words and landmarks, 0 below LEAST."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.steps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        vectors = [self._vector(w) for w in landmarks]
        keys = sorted({k for v in vectors for k in v})
        self.row = np.zeros(SYMBOLS**ORDER, np.int32)
        self.row[keys] = np.arange(1, len(keys) + 1)
        self.table = np.zeros((len(keys) + 1, len(landmarks)), np.float32)
        for j, v in enumerate(vectors):
            norm = sum(x * x for x in v.values()) ** 0.5 or 1.0
            for k, x in v.items():
                self.table[self.row[k], j] = x / norm
        #: The table's values that are not zero, row by row: where a row's begin, its landmarks and values.
        filled, self.columns = np.nonzero(self.table)
        self.filled = self.table[filled, self.columns].astype(np.float64)
        self.begins = np.searchsorted(filled, np.arange(len(self.table) + 1))
        #: The most that a subsequence can add to any landmark's value.
        self.most = self.table.max(axis=1, initial=0)[self.row]

    def _vector(self, word: str) -> dict[int, float]:
        found: Counter = Counter()
        s = symbols(word)
        for i, j, k in combinations(range(len(s)), ORDER):
            found[(s[i] * SYMBOLS + s[j]) * SYMBOLS + s[k]] += DECAY ** (k - i + 1)
        return found

    def _positions(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self.steps:
            at = np.array([*combinations(range(n), ORDER)], np.int64).reshape(-1, ORDER)
            self.steps[n] = at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)
        return self.steps[n]

    def _sums(self, n: int, word: np.ndarray, row: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """[n, landmarks]: by word, the rows of the table times their weights; most landmarks share none of a subsequence."""
        counts = self.begins[row + 1] - self.begins[row]
        at = np.arange(counts.sum()) + np.repeat(self.begins[row] - (np.cumsum(counts) - counts), counts)
        cells = np.repeat(word * len(self.landmarks), counts) + self.columns[at]
        found = np.bincount(cells, self.filled[at] * np.repeat(weight, counts), n * len(self.landmarks))
        return found.astype(np.float32).reshape(n, len(self.landmarks))

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words with any value, their values: float32 [words, landmarks])."""
        coded, by_length, who, values = [*map(symbols, words)], {}, [], []
        for i, s in enumerate(coded):
            by_length.setdefault(len(s), []).append(i)
        for n, rows in by_length.items():
            at, weight = self._positions(n)
            step = max(1, 400_000 // max(1, len(at)))
            for i in range(0, len(rows) if len(at) else 0, step):
                part = np.array(rows[i : i + step])
                s = np.frombuffer(b"".join(coded[r] for r in part), np.uint8).reshape(-1, n).astype(np.int32)
                keys = (s[:, at[:, 0]] * SYMBOLS + s[:, at[:, 1]]) * SYMBOLS + s[:, at[:, 2]]
                # Equal subsequences add to a norm before it is squared, so this norm is the least possible.
                bound = self.most[keys] @ weight / np.sqrt((weight * weight).sum())
                near = np.flatnonzero(bound >= LEAST)
                if not len(near):
                    continue
                known = self.row[keys[near]]
                r, c = np.nonzero(known)
                got = self._sums(len(near), r, known[r, c], weight[c])
                far = got.max(axis=1) < LEAST * np.sqrt((weight * weight).sum())
                part, keys, got = part[near][~far], keys[near][~far], got[~far]
                if not len(part):
                    continue
                order = np.argsort(keys, axis=1, kind="stable")
                ordered = np.take_along_axis(keys, order, 1)
                new = np.ones(ordered.shape, bool)
                new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
                sums = np.add.reduceat(weight[order].ravel(), np.flatnonzero(new.ravel()))
                norm = np.sqrt(np.add.reduceat(sums * sums, np.concatenate([[0], np.cumsum(new.sum(axis=1))[:-1]])))
                got /= norm[:, None]
                for i, v in zip(part.tolist(), np.where(got >= LEAST, got, 0)):
                    if v.any():
                        who.append(i)
                        values.append(v)
        return np.array(who, np.int64), np.array(values, np.float32).reshape(len(values), len(self.landmarks))

    def full(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        who, values = self(words)
        out[who] = values
        return out


#: Runs whose values a task keeps.
CACHED = 500_000


class Embedding:
    """Texts as vectors: the largest kernel value of any word with each landmark, raised to POWER."""

    def __init__(self, landmarks: list[str]):
        self.kernel = Kernel(landmarks)
        self._forget()

    def _forget(self) -> None:
        #: Runs between white space without any value, and the row of values of the others.
        self.none: set[str] = set()
        self.known: dict[str, int] = {}
        self.values = np.zeros((0, len(self.kernel.landmarks)), np.float32)

    def _learn(self, runs: list[str]) -> None:
        words, owner = [], []
        for k, run in enumerate(runs):
            for w in words_of(run):
                words.append(w)
                owner.append(k)
        who, values = self.kernel(words)
        best: dict[int, np.ndarray] = {}
        for i, v in zip(who.tolist(), values**POWER):
            k = owner[i]
            best[k] = np.maximum(best[k], v) if k in best else v
        if best:
            self.known.update((runs[k], len(self.values) + i) for i, k in enumerate(best))
            self.values = np.concatenate([self.values, np.array([*best.values()])])
        self.none.update(r for k, r in enumerate(runs) if k not in best)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) + len(self.none) > CACHED:
            self._forget()
        parts = [raw_words(t) - self.none for t in texts]
        self._learn([*{w for p in parts for w in p}.difference(self.known)])
        out = np.zeros((len(texts), self.values.shape[1]), np.float32)
        for i, p in enumerate(parts):
            if rows := [r for r in map(self.known.get, p) if r is not None]:
                out[i] = self.values[rows].max(axis=0)
        return out


class Model:
    """Landmarks, a weight for each and the score's curve."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, curve: tuple[float, float]):
        self.landmarks, self.weights, self.bias, self.curve = landmarks, weights, bias, curve

    def margin(self, features: np.ndarray) -> np.ndarray:
        return features.astype(np.float64) @ self.weights + self.bias

    def score(self, features: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1.0 / (1.0 + np.exp(-np.clip(a * self.margin(features) + b, -30, 30)))


def choose_landmarks(texts: list[str | None], labels: np.ndarray, n: int) -> list[str]:
    """Words that are much likelier in texts of label 1, the most telling first, no two very much alike."""
    counts = [Counter(), Counter()]
    for text, label in zip(texts, labels.tolist()):
        counts[label].update({w for run in raw_words(text) for w in words_of(run)})
    size = [max(1, int((labels == k).sum())) for k in (0, 1)]
    value = {}
    for w, c in counts[1].items():
        odds = np.log((c + 0.1) / (size[1] + 0.2)) - np.log((counts[0][w] + 0.1) / (size[0] + 0.2))
        if c > 1 and odds > 1:
            value[w] = odds * c**0.5
    ranked = sorted(value, key=lambda w: (-value[w], w))[: 8 * n] or sorted(counts[0], key=lambda w: (-counts[0][w], w))[:n]
    alike, taken = Kernel(ranked).full(ranked), []
    for i in range(len(ranked)):
        if len(taken) < n and (not taken or alike[i, taken].max() < 0.8):
            taken.append(i)
    return [ranked[i] for i in taken]


def fit(texts: list[str | None], labels: list[int], landmarks: int = 96, cost: float = 10.0, rounds: int = 40) -> Model:
    """The SVM (squared hinge, Newton steps) on Nyström features, balanced by class, and the curve of its margins.

    Without texts of both labels the score is the share of label 1 (a half without any).
    """
    y01 = np.array(labels, np.int64)
    if len({*labels}) < 2:
        share = float(y01.mean()) if len(y01) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model([], np.zeros(0), 0.0, (0.0, float(np.log(share / (1 - share)))))
    chosen = choose_landmarks(texts, y01, landmarks)
    if not chosen:
        return fit([], [])
    features = np.concatenate([Embedding(chosen)(texts[i : i + 2000]) for i in range(0, len(texts), 2000)]).astype(np.float64)
    own = Kernel(chosen).full(chosen).astype(np.float64) ** POWER
    value, vector = np.linalg.eigh((own + own.T) / 2)
    keep = value > 1e-3 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    x = np.hstack([features @ root, np.ones((len(texts), 1))])
    y = np.where(y01 == 1, 1.0, -1.0)
    weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) / len(y)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1.0 / (cost * 100))
    ridge[-1] = 1e-9
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xo = x[on] * weight[on, None]
        new = np.linalg.solve(np.diag(ridge) + x[on].T @ xo, xo.T @ y[on])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    margin = x @ w
    a, b = 1.0, 0.0
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        z, g, h = np.stack([margin, np.ones_like(margin)], 1), goal - p, p * (1 - p) + 1e-9
        step = np.linalg.solve((z * h[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return Model(chosen, root @ w[:-1], float(w[-1]), (float(a), float(b)))


#: Labelled rows that a model is fitted on at most: those of the lowest hash of the id.
SAMPLE = 6_000


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(text, label) of at most `sample` labelled rows that are not held out."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("label")).where("__id is not null and label is not null")
    known = known.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(known), "__id").select("__id", "text", "label")  # `known` has `sample` rows at most


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, landmarks: int = 96, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of a bounded sample of the labelled texts, fitted on the driver."""
    rows = training_rows(docs, labels, label_col, id_col, text_col, sample).orderBy("__id", "text").limit(2 * sample).collect()
    return fit([r["text"] for r in rows], [int(r["label"] > 0) for r in rows], landmarks)


def _embedding(model: Model) -> Embedding:
    return Embedding(model.landmarks)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: a map without shuffle over whole texts.

    Null and empty texts are scored like texts without likeness to any landmark. Null ids and repeated rows are returned
    as they came; other columns are left out, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list:
        m, out = held.value, []
        embed = built(_embedding, m)
        for i in range(0, len(texts), 200):
            out += m.score(embed(texts[i : i + 200])).tolist()
        return out

    found = docs.select(F.col(id_col).alias("doc_id"), mapped(run, pa.float64(), "double")(F.col(text_col)).alias("score"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
