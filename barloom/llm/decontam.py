"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training texts.

Every window of a benchmark item (n consecutive words, or the whole of a shorter item) has a 64-bit rolling hash. Tasks
hash the windows of a document in vectorised form, look them up in the sorted set and compare the words of every hit, so
a chance equality of hashes never counts. Then spans or whole documents can be removed.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import built, cut, mapped, named

#: Letters, digits and everything beyond ASCII, as UTF-8 after A-Z are lower-cased.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of benchmark windows that one pass broadcasts; more are scanned in further passes over the documents.
BLOCK_BYTES = 64 << 20


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def windows_of(text: str | None, n: int) -> set[bytes]:
    """The distinct windows of an item, each joined by spaces."""
    words = words_of(text)
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class WindowSet:
    """Benchmark windows by rolling hash."""

    def __init__(self, windows: dict[bytes, list[str]]):
        self.items = windows
        vocabulary = {w for window in windows for w in window.split(b" ")}
        #: 0 is kept for words that no window has.
        self.code = {w: i for i, w in enumerate(sorted(vocabulary), 1)}
        rng = np.random.default_rng(7)
        self.value = rng.integers(1, 1 << 63, len(self.code) + 1, np.uint64) | np.uint64(1)
        self.by_length: dict[int, np.ndarray] = {}
        lengths: dict[int, list[list[int]]] = {}
        for window in windows:
            codes = [self.code[w] for w in window.split(b" ")]
            lengths.setdefault(len(codes), []).append(codes)
        self.weight = rng.integers(1, 1 << 63, max(lengths, default=1), np.uint64) | np.uint64(1)
        for k, codes in lengths.items():
            self.by_length[k] = np.unique((self.value[np.array(codes)] * self.weight[:k]).sum(axis=1, dtype=np.uint64))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (from, to) of words that windows cover, and the ids of the items whose windows occur."""
        spans, items = [], set()
        codes = np.array([*map(self.code.get, words, [0] * len(words))], np.int64)
        values = self.value[codes]
        unknown = np.concatenate([[0], np.cumsum(codes == 0)])
        for k, hashes in self.by_length.items():
            n = len(words) - k + 1
            if n <= 0:
                continue
            starts = np.flatnonzero(unknown[k:] == unknown[:n])
            if not len(starts):
                continue
            mixed = np.zeros(len(starts), np.uint64)
            for j in range(k):
                mixed += values[starts + j] * self.weight[j]
            at = np.minimum(np.searchsorted(hashes, mixed), len(hashes) - 1)
            for i in starts[hashes[at] == mixed].tolist():
                found = self.items.get(b" ".join(words[i : i + k]))
                if found is not None:
                    spans.append((i, i + k))
                    items.update(found)
        return spans, items


def _window_table(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(window, items: list of distinct ids as strings) of the benchmark."""
    of = mapped(lambda texts: [sorted(windows_of(t, n)) for t in texts], pa.list_(pa.binary()), "array<binary>")
    bare = items.select(F.col(id_col).cast("string").alias("item"), F.explode(of(F.col(text_col))).alias("window"))
    return bare.where("item is not null").groupBy("window").agg(F.collect_set("item").alias("items"))


def _blocks(table: DataFrame, limit: int):
    """Parts of the window table as dicts, each of about `limit` bytes at most; at least one, which may be empty."""
    block, size = {}, 0
    for row in table.toLocalIterator():
        if size > limit:
            yield block
            block, size = {}, 0
        block[bytes(row["window"])] = row["items"]
        size += len(row["window"]) + sum(map(len, row["items"])) + 100
    yield block


SCANNED = pa.struct([("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string()))])


def _scanner(held):
    """From texts to (n_words, a bit for each word that is hit, items)."""

    def scan(texts: list) -> list:
        windows, out = built(WindowSet, held.value), []
        for text in texts:
            words = words_of(text)
            spans, items = windows.scan(words) if words else ((), ())
            hit = np.zeros(len(words), bool)
            for i, j in spans:
                hit[i:j] = True
            out.append({"n_words": len(words), "hits": np.packbits(hit).tobytes() if spans else b"", "items": sorted(items)})
        return out

    return scan


def _joined(first: list, second: list) -> list:
    out = []
    for a, b in zip(first, second):
        bits = a["hits"] or b["hits"]
        if a["hits"] and b["hits"]:
            bits = (np.frombuffer(a["hits"], np.uint8) | np.frombuffer(b["hits"], np.uint8)).tobytes()
        out.append({"n_words": a["n_words"], "hits": bits, "items": sorted({*a["items"], *b["items"]})})
    return out


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list[tuple[object, Column]]:
    """[(broadcast, column)]: for each block of benchmark windows, a struct column of `docs` with its n_words, hits and items.

    The windows are streamed to the driver in blocks of `block_bytes`, and each block is one broadcast: usually one in
    all, since benchmarks are small. Null ids and items without words have no windows.
    """
    context = docs.sparkSession.sparkContext
    blocks = _blocks(_window_table(benchmark, n, item_col, item_text_col), block_bytes)
    kind = "struct<n_words: long, hits: binary, items: array<string>>"
    for block in blocks:
        held = context.broadcast(block)
        yield held, mapped(_scanner(held), SCANNED, kind)(F.col(text_col))


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, item_col: str, item_text_col: str, block_bytes: int) -> DataFrame:
    """(row: all of `docs`' columns, text, __found) of every row; further blocks of windows take further passes, each
    behind a checkpoint."""
    docs = docs.select(F.struct(*map(named, docs.columns)).alias("row"), named(text_col).alias("text"))
    text_col = "text"
    passes = scan_benchmark(docs, benchmark, n, text_col, item_col, item_text_col, block_bytes)
    _, column = next(passes)
    docs = docs.withColumn("__found", column)
    for held, column in passes:
        def both(rows: list, held=held) -> list:
            return _joined([r["f"] for r in rows], _scanner(held)([r["t"] for r in rows]))

        join = mapped(both, SCANNED, "struct<n_words: long, hits: binary, items: array<string>>")
        docs = cut(docs.withColumn("__found", join(F.struct(F.col("__found").alias("f"), F.col(text_col).alias("t")))))
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row.

    A word is hit if any occurrence of a benchmark window covers it. Null and empty texts have no words and are clean.
    With an empty benchmark all are clean. Null ids and repeated rows are returned as they came; repeated items count
    once. Other columns are left out, whatever their names.
    """
    bare = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _scanned(bare, benchmark, n, "text", item_col, item_text_col, block_bytes)

    def digest(rows: list) -> list:
        return [
            {"n_hit": int(np.unpackbits(np.frombuffer(r["hits"], np.uint8)).sum()), "sha": hashlib.sha256(",".join(r["items"]).encode()).hexdigest()}
            for r in rows
        ]

    more = mapped(digest, pa.struct([("n_hit", pa.int64()), ("sha", pa.string())]), "struct<n_hit: long, sha: string>")
    found = found.select("row.doc_id", "__found", more("__found").alias("__more"))
    return found.select(
        "doc_id",
        F.col("__found.n_words").alias("n_words"),
        F.col("__more.n_hit").alias("n_hit"),
        F.size("__found.items").cast("long").alias("n_items"),
        F.col("__more.sha").alias("items_sha256"),
        (F.col("__more.n_hit") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, with all columns, in which no benchmark window occurs. Null and empty texts stay."""
    found = _scanned(docs, benchmark, n, text_col, item_col, item_text_col, block_bytes)
    return found.where(F.size("__found.items") == 0).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs`, with all columns, where the text between the first and the last byte of each run of hit words is cut out.

    Texts without hits stay as they are, null too.
    """
    found = _scanned(docs, benchmark, n, text_col, item_col, item_text_col, block_bytes)

    def cleaned(rows: list) -> list:
        out = []
        for r in rows:
            if not r["f"]["hits"]:
                out.append(r["t"])
                continue
            data = r["t"].encode("utf-8", "surrogatepass")
            at = [m.span() for m in WORD.finditer(data.lower())]
            hit = np.unpackbits(np.frombuffer(r["f"]["hits"], np.uint8))[: len(at)].tolist()
            kept, since, i = [], 0, 0
            while i < len(at):
                j = i
                while j < len(at) and hit[j]:
                    j += 1
                if j > i:
                    kept.append(data[since : at[i][0]])
                    since = at[j - 1][1]
                i = max(j, i + 1)
            out.append(b"".join([*kept, data[since:]]).decode("utf-8", "surrogatepass"))
        return out

    text = mapped(cleaned, pa.string(), "string")(F.struct(F.col("__found").alias("f"), F.col("text").alias("t")))
    found = found.select("row", text.alias("text"))
    return found.select(*[F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns])
