"""Vector codes by product quantisation, with segment-mean lower bounds.

A vector is cut into parts, and each part position has a codebook. Finding the nearest entry goes from coarse to fine: of
a block of b components with means m and residual norms r (the length of what is left without the mean), the squared
distance of two blocks is b (m - m')^2 plus that of the residuals, which is (r - r')^2 at least. Summed over blocks this
bounds the distance from below, and halving the blocks tightens it. Entries whose bound exceeds an exact distance already
known are filtered out, level by level; survivors get exact integer distances. Sums and squares are exact, and the bound
is lowered by more than its rounding, so no nearest entry is lost.

Codebooks are refined by rounds over vectors that stay where they are: a task hands on the count and the sums of each
entry it has assigned, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ballmeans import integers, matrix
from .support import dropped, join_hot, stored


def _blocks(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, residual norms times the root of the block's size) of `n` blocks of each row."""
    cut = x.reshape(len(x), n, -1)
    sums = cut.sum(axis=2)
    return sums, np.sqrt((cut.shape[2] * (cut**2).sum(axis=2) - sums**2).astype(np.float64))


class Codebook:
    """The entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries, width = entries, entries.shape[1]
        self.levels = [n for n in (1, 2, 4, 8, 16) if width % n == 0 and n < width] or [1]
        self.coarse = [_blocks(entries, n) for n in self.levels]
        self.squares = (entries**2).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, squared distance) of each row, ties to the lower index, and how many exact
        distances that took."""
        n, width = x.shape
        sums, residuals = _blocks(x, self.levels[0])
        low = self._bound(sums[:, None, :], residuals[:, None, :], *(c[None] for c in self.coarse[0]), width // self.levels[0])
        guess = low.argmin(axis=1)
        known = ((x - self.entries[guess]) ** 2).sum(axis=1)
        # The bound's rounding is below 1e-12 of the squares that go into it.
        slack = 1e-9 * ((x**2).sum(axis=1)[:, None] + self.squares) + 1e-3
        row, entry = np.nonzero(low - slack <= known[:, None])
        for blocks, coarse in zip(self.levels[1:], self.coarse[1:]):
            sums, residuals = _blocks(x, blocks)
            low = self._bound(sums[row], residuals[row], coarse[0][entry], coarse[1][entry], width // blocks)
            left = low - slack[row, entry] <= known[row]
            row, entry = row[left], entry[left]
        exact = np.full((n, len(self.entries)), np.iinfo(np.int64).max)
        exact[row, entry] = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        best = exact.argmin(axis=1)  # the guess always survives; of equal ones the lower index
        return best, exact[np.arange(n), best], len(row) + n

    @staticmethod
    def _bound(sums, residuals, entry_sums, entry_residuals, size: int) -> np.ndarray:
        means = (sums - entry_sums).astype(np.float64) ** 2
        return ((means + (residuals - entry_residuals) ** 2) / size).sum(axis=-1)


def encode(books: list[Codebook], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), a column for each part."""
    width = x.shape[1] // len(books)
    found = [book.nearest(x[:, p * width : (p + 1) * width])[:2] for p, book in enumerate(books)]
    return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _refined(vectors: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries (part, entry, component) after one round."""
    parts, n, width = entries.shape
    books = [Codebook(e) for e in entries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), np.int64)
        for batch in batches:
            x = matrix(batch["v"])
            codes = encode(books, x)[0] if len(x) else np.zeros((0, parts), np.int64)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=n)
                np.add.at(sums[p], codes[:, p], x[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"]
        )

    found = vectors.select("v").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    moved = entries.copy()
    for r in totals.collect():  # one row for each entry at most
        moved[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return moved


def codes(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector without null or non-finite components.

    A component x becomes floor(scale * x). Each of `parts` equal parts has a codebook, at first the parts of the `entries`
    vectors with the smallest ids (equal ids by vector, null ids last); each round assigns parts to the nearest entry, ties
    to the lower index, and moves entries to the floor of their parts' mean; unused ones stay. code: two hex digits a part;
    error: squared distances summed over parts; label_error: errors summed over equal labels, nulls together.

    Vectors have the length of the one that comes first by id among those whose length is a multiple of `parts`. Vectors
    of another length are returned with null code and error, and add nothing to label_error. Null vectors are left out,
    repeated rows count as often as they come. Without vectors there are no rows. Components over `ballmeans.widest` raise.
    Other columns are left out, whatever their names.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits has 1 to 256 entries")
    spark = rows.sparkSession
    labelled = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"), F.col(label_col).alias("label"))
    every, kept_in = stored(integers(labelled, scale, "id", "x", None, ("label",)))
    order = [F.col("id").asc_nulls_last(), "v"]
    leader = every.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(*order).select(F.size("v").alias("n")).first()
    dims = leader["n"] if leader else parts
    vectors = every.where(F.size("v") == dims)
    first = np.array([r["v"] for r in vectors.orderBy(*order).select("v").limit(entries).collect()], np.int64).reshape(-1, parts, dims // parts)
    now = first.transpose(1, 0, 2).copy()
    for _ in range(rounds if leader else 0):
        now = _refined(vectors, now)
    books = [Codebook(e) for e in now] if leader else []
    kind = every.select("id", "label").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, distance = encode(books, matrix(batch["v"]))
                digits = found.astype(np.uint8).tobytes().hex()
                code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(code), pa.array(distance.sum(axis=1))], ["id", "label", "code", "error"])

    coded = vectors.mapInArrow(run, kind.add("code", "string").add("error", "long"))
    others = every.where(F.size("v") != dims).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    known = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    done, _ = stored(coded.unionByName(others).withColumn("key", known))
    dropped(spark, kept_in)
    totals = done.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    seal = hashlib.sha256(",".join(map(str, now.reshape(-1).tolist())).encode()).hexdigest()
    out = join_hot(done, totals, "key", done.count())
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(seal).alias("codebooks_sha256"))
