"""Token counts by byte-pair merging, without token ids.

A word starts as its bytes in a doubly linked list; a heap holds the adjacent pairs that have a rank. The pair of lowest
rank (leftmost among equals) is merged until no pair has a rank. The count is the initial symbols minus the merges.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import built, file_bytes, mapped

#: Fixed value: how the vocabulary's byte-level step splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a task keeps of counts already made; at most CACHED_LENGTH characters each.
CACHED, CACHED_LENGTH = 800_000, 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Visible Latin-1 characters stand for themselves; the others follow from code point 256 on, in the order of bytes.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class MergeCounter:
    """Counts tokens as the byte-level BPE vocabulary `data` (a tokenizers .json) does, by its merges alone."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        symbols: dict[str, int] = {s: b for b, s in enumerate(byte_symbols())}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            made = symbols.setdefault(left + right, len(symbols))
            self.pairs.setdefault((symbols[left], symbols[right]), (rank, made))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words, self.odd = regex.compile(WORDS), regex.compile(r" (?:\s|\Z)")
        self.known: dict[str, int] = {}

    def word(self, data: bytes) -> int:
        """Tokens of one word: its bytes minus the merges."""
        pairs, n = self.pairs, len(data)
        symbol, after, before = list(data), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(data, data[1:])) if p in pairs]
        heapq.heapify(heap)
        merges, pop, push = 0, heapq.heappop, heapq.heappush
        while heap:
            _, i, left, right = pop(heap)
            j = after[i]
            if j < 0 or symbol[i] != left or symbol[j] != right:
                continue  # one side has been merged meanwhile
            merges += 1
            symbol[i], symbol[j] = pairs[left, right][1], -1
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (p := (symbol[i], symbol[k])) in pairs:
                    push(heap, (pairs[p][0], i, *p))
            if (h := before[i]) >= 0 and (p := (symbol[h], symbol[i])) in pairs:
                push(heap, (pairs[p][0], h, *p))
        return n - merges

    def part(self, text: str) -> int:
        """Tokens of a text that can be cut before and after; remembered if short."""
        found = self.known.get(text)
        if found is None:
            words = self.words.findall(text)
            found = self.word(text.encode()) if len(words) == 1 else sum(map(self.part, words))
            if len(text) <= CACHED_LENGTH:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[text] = found
        return found

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        A space between two visible characters begins a word, whatever surrounds it, so the text is cut there.
        """
        if not self.odd.search(text):
            parts, known, part = text.split(" "), self.known, self.part
            total = part(parts[0])
            for p in parts[1:]:
                p = " " + p
                got = known.get(p)
                total += part(p) if got is None else got
            return total
        return sum(map(self.part, self.words.findall(text)))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; 0 for null. A special string inside is one token."""
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(self.plain(p) for p in pieces if p)


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row: a map without shuffle.

    vocabulary: path or name of a byte-level BPE .json, read by the driver and broadcast (a fixed file of some MB).
    Null texts count as empty: 0 bytes, 0 tokens. Null ids and repeated rows are returned as they came; other columns
    are left out, whatever their names.
    """
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))

    def counts(texts: list) -> list:
        counter = built(MergeCounter, data.value)
        return [counter.count(t) for t in texts]

    n = mapped(counts, pa.int64(), "long")(F.col(text_col))
    bare = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return bare.withColumn("over_limit", F.col("n_tokens") > limit)
