"""SentencePiece encoding and decoding with the N best segmentations.

The pieces of a text form a lattice over its characters. A forward Viterbi pass gives the best score up to each position;
these are exact heuristics for a backward A-star search from the end, which therefore yields the segmentations in order
of score. Scores are logarithms of probabilities of single pieces: a unigram model's own, or, for a model of merges,
whose scores are no more than minus the rank of a merge, those of Zipf's law over the ranks (see `zipf`). So the best
segmentation is the likeliest under that law, not the one that the merges lead to. Characters without a piece are byte
pieces, 10 below the lowest score of a single character.

Where no piece has two neighbouring characters in a row, every path passes between them, so the lattice falls into spans
there, mostly words. Spans recur, and their best segmentation and the loss to the second best are remembered; those that
are new in a group of texts go through the forward pass together, a numpy operation for all their edges from one position
to another. The N best of a text can only deviate from the best in the N - 1 spans with the smallest losses; only those
are searched.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import built, file_bytes, mapped

SPACE = "▁"
#: Scores are multiples of 1 / GRID.
GRID = 1 << 20
#: Spans of one generation that a worker keeps, of at most CACHED_LENGTH characters each, and those whose N best it keeps.
CACHED, CACHED_LENGTH, SEVERAL = 400_000, 32, 20_000
#: Characters of the texts whose new spans are segmented together, and how many spans a forward pass takes at once.
TOGETHER, BLOCK = 1 << 20, 8_192


def opened(records: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 32-bit words of records of spans, the places of each one's four words in front of the ids, and what these are:
    score and loss to the second best. (Bytes, unlike tuples, cost the garbage collector nothing.)"""
    words = np.frombuffer(b"".join(records), np.uint32)
    sizes = np.fromiter(map(len, records), np.int64, len(records)) >> 2
    heads = (sizes.cumsum() - sizes)[:, None] + np.arange(4)
    return words, heads, words[heads].view(np.float64)


def zipf(rank: float, n: int) -> float:
    """The logarithm of a piece's probability by Zipf's law: 1 / rank over the sum of 1 / k for n pieces."""
    return -math.log(max(1.0, rank)) - math.log(math.log(n) + 0.5772156649 + 0.5 / n)


class PieceModel:
    """A SentencePiece vocabulary with byte pieces and an identity normaliser."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(data)
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces or not spec.trainer_spec.byte_fallback:
            raise ValueError("only models with byte pieces and without text normalisation are supported")
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        merges = spec.trainer_spec.model_type == spec.trainer_spec.BPE
        if not merges and spec.trainer_spec.model_type != spec.trainer_spec.UNIGRAM:
            raise ValueError("only unigram and BPE models are supported")
        known = [(i, p) for i, p in enumerate(spec.pieces) if p.type == p.NORMAL]
        normal = {p.piece: (zipf(-p.score, len(known)) if merges else p.score, i) for i, p in known}
        self.setup(normal, {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == p.BYTE})

    cached, together = CACHED, TOGETHER

    @classmethod
    def of(cls, pieces: dict[str, float], prefix: bool = True) -> PieceModel:
        """A model of its own: ids 0 to 255 are bytes, then the pieces in the order given."""
        made = cls.__new__(cls)
        made.prefix = prefix
        made.setup({p: (s, 256 + i) for i, (p, s) in enumerate(pieces.items())}, {b: b for b in range(256)})
        return made

    def setup(self, normal: dict[str, tuple[float, int]], byte_ids: dict[int, int]) -> None:
        # On a grid, sums are exact in any order, so that equally likely paths tie and the search need not visit them all.
        normal = {piece: (round(score * GRID) / GRID, i) for piece, (score, i) in normal.items()}
        #: Pieces by their characters: each leads to [further characters, score or None, id as bytes].
        self.tree: dict[str, list] = {}
        for piece, (score, i) in normal.items():
            level = self.tree
            for c in piece:
                node = level.setdefault(c, [{}, None, b""])
                level = node[0]
            node[1:] = score, np.uint32(i).tobytes()
        single = [s for p, (s, _) in normal.items() if len(p) == 1]
        self.unknown = min(single or [s for s, _ in normal.values()] or [0.0]) - 10.0
        self.byte_ids = byte_ids
        self.pairs = {piece[k : k + 2] for piece in normal for k in range(len(piece) - 1)}
        self.flatten(normal)
        self.cut_at_space = not any(p[0] != SPACE and p[1] == SPACE for p in self.pairs)
        self.text = {i: p.replace(SPACE, " ").encode() for p, (_, i) in normal.items()} | {i: bytes([b]) for b, i in byte_ids.items()}
        #: Spans seen lately and, once those are `cached`, the ones before them; what is met again moves up.
        self.spans: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.several: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def flatten(self, normal: dict[str, tuple[float, int]]) -> None:
        """The tree and the pairs in arrays: characters and nodes are numbered, and what follows node k by character c is in
        slot base[k] + c, if that is owned by k."""
        chars = sorted({c for piece in normal for c in piece})
        number = {c: k for k, c in enumerate(chars, 1)}  # 0 fills up rows, the last is for characters in no piece
        self.width = len(chars) + 2
        self.numbers = np.full(ord(max(chars, default="\0")) + 2, self.width - 1, np.int32)
        self.numbers[[*map(ord, chars)]] = np.arange(1, self.width - 1)
        #: Characters that are a piece by themselves.
        self.alone = np.array([True, *[c in normal for c in chars], False])
        nodes, below = [[self.tree, None, b""]], []
        for level, _, _ in nodes:  # which grows
            below.append((np.array([number[c] for c in level], np.int64), len(nodes)))
            nodes.extend(level.values())
        self.scores = np.array([-np.inf if score is None else score for _, score, _ in nodes])
        self.ids = np.array([int.from_bytes(ids, "little") for _, _, ids in nodes], np.uint32)
        slots, rng = 1 << (4 * len(nodes)).bit_length(), random.Random(0)
        self.base = np.zeros(len(nodes), np.int32)
        self.owner, self.target = np.full(slots + self.width, -1, np.int32), np.zeros(slots + self.width, np.int32)
        for k in sorted((k for k, (c, _) in enumerate(below) if c.size), key=lambda k: -below[k][0].size):
            c, first = below[k]
            while (self.owner[c + (at := rng.randrange(slots))] >= 0).any():
                pass
            self.base[k], self.owner[c + at], self.target[c + at] = at, k, np.arange(first, first + c.size)
        keys = np.array([number[a] * self.width + number[b] for a, b in self.pairs], np.int64)
        self.paired = np.zeros(self.width**2 // 8 + 1, np.uint8)
        np.bitwise_or.at(self.paired, keys >> 3, (1 << (keys & 7)).astype(np.uint8))

    def numbered(self, text: str) -> np.ndarray:
        """The numbers of a text's characters."""
        return self.numbers[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(self.numbers) - 1)]

    def edges(self, span: str) -> tuple[list[tuple[int, int, float, bytes]], list[float]]:
        """The pieces of a span as (start, end, score, ids) in order of start, and the best score up to each position
        (forward Viterbi)."""
        n, out, best = len(span), [], [0.0] + [-np.inf] * len(span)
        for i in range(n):
            level, single = self.tree, False
            for j in range(i, n):
                node = level.get(span[j])
                if node is None:
                    break
                level, score, ids = node
                if score is not None:
                    out.append((i, j + 1, score, ids))
                    best[j + 1] = max(best[j + 1], best[i] + score)
                    single = single or j == i
            if not single:
                ids = np.array([self.byte_ids[b] for b in span[i].encode("utf-8", "surrogatepass")], np.uint32).tobytes()
                out.append((i, i + 1, self.unknown, ids))
                best[i + 1] = max(best[i + 1], best[i] + self.unknown)
        return out, best

    def nbest(self, span: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a span, or all if there are fewer: (score, ids), best first.

        Backward A-star. Equal scores come in the order in which the search meets them, which is always the same; the
        one nearest to completion goes first.
        """
        edges, best = self.edges(span)
        ending: list[list[tuple[int, float, bytes]]] = [[] for _ in best]
        for i, j, s, ids in edges:
            ending[j].append((i, s, ids))
        heap, count, out = [(-best[-1], len(span), 0, 0.0, None)], 0, []
        while heap and len(out) < n:
            _, at, _, score, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path is not None:
                    ids.append(path[0])
                    path = path[1]
                out.append((score, b"".join(ids)))
                continue
            for i, s, ids in ending[at]:
                count += 1
                heapq.heappush(heap, (-(best[i] + s + score), i, count, s + score, (ids, path)))
        return out

    def viterbi(self, span: str) -> tuple[float, float, bytes]:
        """(score, loss to the second best, ids) of the best segmentation: forward, with the two best scores up to each
        position."""
        n, tree, none = len(span), self.tree, -np.inf
        best, second, last = [0.0] + [none] * n, [none] * (n + 1), [None] * (n + 1)
        for i in range(n):
            level, here, single = tree, best[i], None
            for j in range(i, n):
                node = level.get(span[j])
                if node is None:
                    break
                level, score, ids = node
                if score is not None:
                    if j == i:
                        single = score
                    through, j = here + score, j + 1
                    if through > best[j]:
                        other = second[i] + score
                        second[j] = best[j] if best[j] > other else other
                        best[j] = through
                        last[j] = i, ids
                    elif through > second[j]:
                        second[j] = through
            if single is None:
                ids, j, through = np.array([self.byte_ids[b] for b in span[i].encode("utf-8", "surrogatepass")], np.uint32).tobytes(), i + 1, here + self.unknown
                if through > best[j]:
                    second[j] = max(best[j], second[i] + self.unknown)
                    best[j] = through
                    last[j] = i, ids
                elif through > second[j]:
                    second[j] = through
        ids, at = [], n
        while at:
            at, part = last[at]
            ids.append(part)
        ids.reverse()
        return best[n], best[n] - second[n], b"".join(ids)

    def viterbis(self, spans: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each span and its record: what `viterbi` says of it. The longest come first."""

        def record(span: str) -> bytes:
            score, loss, ids = self.viterbi(span)
            return np.array([score, loss]).tobytes() + ids

        # Long ones, and those with byte pieces, go one by one.
        long = sum(len(span) > CACHED_LENGTH for span in spans)
        yield from ((span, record(span)) for span in spans[:long])
        spans = spans[long:]
        lengths = np.fromiter(map(len, spans), np.int64, len(spans))
        chars = np.zeros((len(spans), lengths.max(initial=0)), np.int32)
        chars[np.arange(chars.shape[1]) < lengths[:, None]] = self.numbered("".join(spans))
        plain = self.alone[chars].all(axis=1)
        yield from ((spans[k], record(spans[k])) for k in np.flatnonzero(~plain).tolist())
        spans, lengths, chars = [spans[k] for k in np.flatnonzero(plain).tolist()], lengths[plain], chars[plain]
        if not spans:
            return
        n, longest = len(spans), int(lengths[0])
        chars, every = np.ascontiguousarray(chars.T), np.arange(n)
        best, second = np.full((longest + 1, n), -np.inf), np.full((longest + 1, n), -np.inf)
        since, last = np.zeros((longest + 1, n), np.int32), np.zeros((longest + 1, n), np.int32)
        best[0] = 0.0
        for i in range(longest):
            rows = every[: np.count_nonzero(lengths > i)]
            node = np.zeros(rows.size, np.int32)
            for j in range(i, longest):
                slot = self.base[node] + chars[j][rows]
                goes = np.flatnonzero(self.owner[slot] == node)
                if not goes.size:
                    break
                rows, node = rows[goes], self.target[slot[goes]]
                score = self.scores[node]
                ends = np.flatnonzero(score > -np.inf)
                at, score = rows[ends], score[ends]
                through, old = best[i][at] + score, best[j + 1][at]
                second[j + 1][at] = np.maximum(np.maximum(second[j + 1][at], np.minimum(old, through)), second[i][at] + score)
                better = np.flatnonzero(through > old)
                at = at[better]
                best[j + 1][at], since[j + 1][at], last[j + 1][at] = through[better], i, node[ends[better]]
        steps, at, rows = [], lengths, every
        while rows.size:
            steps.append((rows, self.ids[last[at, rows]]))
            at = since[at, rows]
            more = np.flatnonzero(at)
            rows, at = rows[more], at[more]
        words, used = np.zeros((n, 4 + len(steps)), np.uint32), np.zeros((n, 4 + len(steps)), bool)
        score = best[lengths, every]
        words[:, :4], used[:, :4] = np.stack([score, score - second[lengths, every]], 1).view(np.uint32), True
        for k, (rows, ids) in enumerate(reversed(steps), 4):
            words[rows, k], used[rows, k] = ids, True
        flat, ends = words[used].tobytes(), [0, *(4 * used.sum(axis=1).cumsum()).tolist()]
        yield from zip(spans, [flat[a:b] for a, b in pairwise(ends)])

    def learn(self, spans: set[str]) -> list[str]:
        """Puts the records of spans, which may hold further cuts, into `spans`; the ones that are too long to be kept there."""
        new = spans.difference(self.spans)
        if len(self.spans) + len(new) > self.cached:
            self.spans, self.older, new = {}, self.spans, spans
        known, older = self.spans, self.older
        known.update({s: older[s] for s in new if s in older})
        new = [s for s in new if s not in known]
        if not new:
            return []
        # Cut where `cut` does, all in one string.
        text, lengths = "".join(new), np.fromiter(map(len, new), np.int64, len(new))
        chars, starts = self.numbered(text).astype(np.int64), lengths.cumsum() - lengths
        keys = chars[:-1] * self.width + chars[1:]
        cuts = np.ones(len(text) + 1, bool)
        cuts[1:-1] = (self.paired[keys >> 3] >> (keys & 7).astype(np.uint8) & 1) == 0
        cuts[starts] = True
        bounds = np.flatnonzero(cuts)
        parts, first = [text[a:b] for a, b in pairwise(bounds.tolist())], np.searchsorted(bounds, starts)
        fresh = {*parts}.difference(known)
        known.update({p: older[p] for p in fresh if p in older})
        fresh = sorted(fresh.difference(known), key=len, reverse=True)
        for k in range(0, len(fresh), BLOCK):
            known.update(self.viterbis(fresh[k : k + BLOCK]))
        # A span has the sum of its parts' scores, their smallest loss, and their ids.
        words, heads, each = opened([*map(known.__getitem__, parts)])
        whole = np.stack([np.add.reduceat(each[:, 0], first), np.minimum.reduceat(each[:, 1], first)], 1)
        words, keep = words.copy(), np.ones(len(words), bool)
        keep[heads] = False
        keep[heads[first]], words[heads[first]] = True, whole.view(np.uint32)
        ends = np.add.reduceat(keep, heads[first, 0], dtype=np.int64).cumsum() * 4
        flat = words[keep].tobytes()
        known.update(zip(new, [flat[a:b] for a, b in pairwise([0, *ends.tolist()])]))
        return [s for s in {*new, *fresh} if len(s) > CACHED_LENGTH]

    def cut(self, span: str) -> list[str]:
        """The span in parts between which no piece reaches."""
        parts, since, pairs = [], 0, self.pairs
        for i in range(1, len(span)):
            if span[i - 1 : i + 1] not in pairs:
                parts.append(span[since:i])
                since = i
        return [*parts, span[since:]]

    def spans_of(self, text: str) -> list[str]:
        """The normalised text in spans: in front of white space wherever the vocabulary allows, else in one."""
        if not text:
            return []
        if not self.cut_at_space or SPACE in text:
            return [(SPACE if self.prefix else "") + text.replace(" ", SPACE)]
        lead = SPACE if self.prefix else ""
        if "  " not in text and text[0] != " " != text[-1]:
            return (lead + text.replace(" ", " " + SPACE)).split(" ")
        spans = []
        for part in text.split(" "):
            if part:
                spans.append(lead + part)
                lead = SPACE
            else:
                lead += SPACE
        return spans if text[-1] != " " else [*spans, lead[:-1]]

    def encode(self, text: str | None, n: int = 1) -> list[tuple[float, bytes]]:
        """The n best segmentations of a whole text: (score, ids as little-endian uint32), best first."""
        return next(self.encode_all([text], n))

    def encode_all(self, texts: Iterable[str | None], n: int = 1) -> Iterator[list[tuple[float, bytes]]]:
        """`encode` of each text. The spans of several texts are segmented together."""
        group, size = [], 0
        for text in texts:
            group.append(self.spans_of(text or ""))
            size += len(text or "")
            if size >= self.together:
                yield from self._encoded(group, n)
                group, size = [], 0
        yield from self._encoded(group, n)

    def _encoded(self, group: list[list[str]], n: int) -> Iterator[list[tuple[float, bytes]]]:
        long = self.learn(set().union(*group))
        each = [[*map(self.spans.__getitem__, spans)] for spans in group]
        for span in long:
            del self.spans[span]
        for spans, records in zip(group, each):
            yield self._best(spans, records, n) if spans else [(0.0, b"")]

    def _best(self, spans: list[str], records: list[bytes], n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text from its spans and their records."""
        words, heads, each = opened(records)
        keep = np.ones(len(words), bool)
        keep[heads] = False
        score, ids = float(each[:, 0].sum()), words[keep].tobytes()
        if n < 2:
            return [(score, ids)]
        # The smallest losses of single parts; spans with several parts are searched part by part.
        near = each[:, 1].argsort(kind="stable")[: n - 1]
        combined: list[tuple[float, tuple[tuple[int, bytes], ...]]] = [(0.0, ())]
        for k in sorted(near[each[near, 1] < np.inf].tolist()):
            ways = self._ways(spans[k], n)
            more = [(loss + ways[0][0] - s, (*chosen, (k, way))) for loss, chosen in combined for s, way in ways]
            combined = heapq.nsmallest(n, more, key=itemgetter(0))
        out = []
        for loss, chosen in combined:
            now, at = [], 0
            for k, way in chosen:
                start = 4 * (int(heads[k, 0]) - 4 * k)
                now += ids[at:start], way
                at = start + len(records[k]) - 16
            out.append((score - loss, b"".join([*now, ids[at:]])))
        return out

    def _ways(self, span: str, n: int) -> list[tuple[float, bytes]]:
        """The n best of a span, combined from its parts."""
        found = self.several.get((span, n))
        if found is not None:
            return found
        ways = [(0.0, b"")]
        for part in self.cut(span):
            more = [(s + t, a + b) for s, a in ways for t, b in self.nbest(part, n)]
            ways = heapq.nsmallest(n, more, key=lambda x: -x[0])
        if len(span) <= CACHED_LENGTH:
            if len(self.several) >= SEVERAL:
                self.several.clear()
            self.several[span, n] = ways
        return ways

    def decode(self, ids: bytes) -> str:
        """The text of ids: of bytes that are no UTF-8, U+FFFD."""
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


class SparePieceModel(PieceModel):
    """A model for tasks whose workers have other stages behind them: less memory, more time."""

    cached, together = 30_000, 1 << 17


ENCODED = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))


def encoded(docs: DataFrame, model: str, n: int = 1, text_col: str = "text") -> Column:
    """An array column of the n best segmentations of whole texts: struct(score, ids), best first.

    Null and empty texts have one segmentation without ids, of score 0. model: path or name of a .model file, read by
    the driver and broadcast (a fixed file of some 100 KB).
    """
    held = docs.sparkSession.sparkContext.broadcast(file_bytes(model))

    def run(texts: list) -> list:
        m = built(PieceModel, held.value)
        return [[{"score": s, "ids": np.frombuffer(ids, "<i4")} for s, ids in ways] for ways in m.encode_all(texts, n)]

    return mapped(run, ENCODED, "array<struct<score: double, ids: array<int>>>")(F.col(text_col))


def change(best: np.ndarray, other: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(start, dropped, ids): `other` is `best` with `dropped` ids from `start` on replaced by ids."""
    n = min(len(best), len(other))
    apart = np.flatnonzero(best[:n] != other[:n])
    start = int(apart[0]) if apart.size else n
    left = n - start
    apart = np.flatnonzero(best[len(best) - left :] != other[len(other) - left :])
    tail = left - 1 - int(apart[-1]) if apart.size else left
    return start, len(best) - tail - start, other[start : len(other) - tail]


OTHERS = pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int32()), ("dropped", pa.int32()), ("ids", pa.list_(pa.int32()))]))
BEST_DDL = "struct<ids: array<int>, score: double, round_trip: boolean, others: array<struct<score: double, start: int, dropped: int, ids: array<int>>>>"


def best(docs: DataFrame, model: str, n: int = 1, text_col: str = "text") -> Column:
    """A struct column of whole texts: ids and score of the best segmentation, whether it decodes to the text (null: the
    empty text), and the others of the n best, in order. Both ways are one pass, so that a task needs one worker and one
    model.

    Another segmentation is the best with `dropped` ids from `start` on replaced by its ids: most of a text is the same in
    all of them. See `ways`.
    """
    held = docs.sparkSession.sparkContext.broadcast(file_bytes(model))

    def run(texts: list) -> list:
        m, out = built(SparePieceModel, held.value), []
        for text, ((score, ids), *others) in zip(texts, m.encode_all(texts, n)):
            first, more = np.frombuffer(ids, "<i4"), []
            for s, way in others:
                start, dropped, new = change(first, np.frombuffer(way, "<i4"))
                more.append({"score": s, "start": start, "dropped": dropped, "ids": new.copy()})
            out.append({"ids": first, "score": score, "round_trip": m.decode(ids) == (text or ""), "others": more})
        return out

    kind = pa.struct([("ids", pa.list_(pa.int32())), ("score", pa.float64()), ("round_trip", pa.bool_()), ("others", OTHERS)])
    return mapped(run, kind, BEST_DDL)(F.col(text_col))


def ways(ids: Column, score: Column, others: Column) -> Column:
    """All n best segmentations, struct(score, ids) in order, from the best and the others as `best` gives them."""
    def whole(x: Column) -> Column:
        behind = x["start"] + x["dropped"]
        return F.struct(x["score"].alias("score"), F.concat(F.slice(ids, 1, x["start"]), x["ids"], F.slice(ids, behind + 1, F.size(ids) - behind)).alias("ids"))

    return F.concat(F.array(F.struct(score.alias("score"), ids.alias("ids"))), F.transform(others, whole))


def decoded(docs: DataFrame, model: str, ids_col: str = "ids") -> Column:
    """The texts of a column of ids; null for null."""
    held = docs.sparkSession.sparkContext.broadcast(file_bytes(model))

    def run(rows: list) -> list:
        m = built(PieceModel, held.value)
        return [None if ids is None else m.decode(np.array(ids, "<u4").tobytes()) for ids in rows]

    return mapped(run, pa.string(), "string")(F.col(ids_col))


DIGEST = pa.struct([("n_pieces", pa.int64()), ("score", pa.float64()), ("ids_crc32", pa.int64()), ("nbest_scores", pa.list_(pa.float64())), ("nbest_crc32", pa.list_(pa.int64())), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])
DIGEST_DDL = "struct<n_pieces: long, score: double, ids_crc32: long, nbest_scores: array<double>, nbest_crc32: array<long>, decoded_sha256: string, round_trip: boolean>"


def encodings(docs: DataFrame, model: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, score, ids_crc32, nbest_scores, nbest_crc32, decoded_sha256, round_trip) of every row.

    The first four are of the best segmentation, the arrays of the n best (fewer, if there are fewer), and the last two
    of what the best decodes to. Ids are taken as little-endian unsigned 32-bit integers. Null texts count as empty. The
    round trip is exact unless a text has U+2581 itself, which stands for a space. Null ids and repeated rows are
    returned as they came; other columns are left out, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(file_bytes(model))

    def run(texts: list) -> list:
        m, out = built(PieceModel, held.value), []
        for text, ways in zip(texts, m.encode_all(texts, n)):
            score, ids = ways[0]
            back = m.decode(ids)
            sums = [zlib.crc32(way) for _, way in ways]
            out.append(
                {
                    "n_pieces": len(ids) // 4,
                    "score": score,
                    "ids_crc32": sums[0],
                    "nbest_scores": [s for s, _ in ways],
                    "nbest_crc32": sums,
                    "decoded_sha256": hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(),
                    "round_trip": back == (text or ""),
                }
            )
        return out

    found = docs.select(F.col(id_col).alias("doc_id"), mapped(run, DIGEST, DIGEST_DDL)(F.col(text_col)).alias("x"))
    return found.select("doc_id", "x.*")
