"""Token ids in patched frame-of-reference blocks.

Documents are sorted by id over ranges, encoded, and packed into chunks of about `CHUNK` ids. A chunk is a row of a
Parquet table: its range and number, its document ids and lengths, and a payload that can be read by itself. The payload,
all little-endian:

    uint32 n, uint32 block size, uint32 number of blocks
    uint32 start of each block, counted from the end of this index
    blocks: uint32 minimum, uint8 width, uint16 exceptions,
            the low `width` bits of each id minus the minimum, packed from the lowest bit on,
            uint16 position of each exception, uint32 value minus minimum of each

The width holds the given percentile of a block's values; larger ones are exceptions. Block i has ids i * block size on,
so any id is found by its block's start alone.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import built, file_bytes, shared_folder

BLOCK, PERCENTILE, CHUNK = 4096, 95.0, 1 << 18
#: Runs between white space, and words, of one generation whose ids a worker keeps, of at most CACHED_LENGTH signs each.
CACHED, CACHED_LENGTH = 400_000, 48
#: Bytes of texts that a task encodes at once, one text at least.
PIECE_BYTES = 2 << 20


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The payload of `ids` (uint32)."""
    blocks, starts, at = [], [], 0
    for i in range(0, len(ids), block):
        part = ids[i : i + block].astype(np.uint32)
        low = part.min()
        value = part - low
        width = int(np.percentile(value, percentile, method="inverted_cdf")).bit_length()
        odd = np.flatnonzero(value >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
        bits = np.unpackbits(value.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        data = struct.pack("<IBH", int(low), width, len(odd)) + np.packbits(bits.ravel(), bitorder="little").tobytes()
        data += odd.astype("<u2").tobytes() + value[odd].astype("<u4").tobytes()
        starts.append(at)
        at += len(data)
        blocks.append(data)
    return struct.pack("<III", len(ids), block, len(blocks)) + np.array(starts, "<u4").tobytes() + b"".join(blocks)


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids (uint32) of a payload, or those from `first` to before `last`; only their blocks are read."""
    n, block, blocks = struct.unpack_from("<III", payload)
    starts = np.frombuffer(payload, "<u4", blocks, 12)
    body = 12 + 4 * blocks
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    out = []
    for b in range(first // block, (last - 1) // block + 1):
        at = body + int(starts[b])
        low, width, odd = struct.unpack_from("<IBH", payload, at)
        count = min(block, n - b * block)
        size = (count * width + 7) // 8
        bits = np.unpackbits(np.frombuffer(payload, np.uint8, size, at + 7), bitorder="little")[: count * width].reshape(count, width)
        wide = np.zeros((count, 32), np.uint8)
        wide[:, :width] = bits
        value = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().copy()
        places = np.frombuffer(payload, "<u2", odd, at + 7 + size)
        value[places] = np.frombuffer(payload, "<u4", odd, at + 7 + size + 2 * odd)
        out.append(value + np.uint32(low))
    offset = first // block * block
    return np.concatenate(out)[first - offset : last - offset]


#: Fixed value: white space as the vocabulary's normaliser has it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the vocabulary's word pattern, after texts are in lower case, for runs of ASCII alone and for others.
ASCII_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w{WHITE}]|_)+")
#: Texts with a capital sigma (whose lower case depends on its place in Python alone) or with letters that not every
#: version of Unicode has, go to the library whole.
UNSURE = re.compile("[Σ\u1c89\u1c8a\ua7c0-\ua7ff\U00010000-\U0001efff]")


class Recent:
    """What a worker remembers: entries of one generation and of the one before; those that are met again move up."""

    def __init__(self, room: int):
        self.room, self.now, self.before = room, {}, {}

    def fresh(self, keys: set) -> set:
        """The keys that are not remembered. Call it once for each batch."""
        if len(self.now) > self.room:
            self.now, self.before = {}, self.now
        new = keys.difference(self.now)
        if self.before:
            left = new.difference(self.before)
            again = new - left
            self.now.update(zip(again, map(self.before.__getitem__, again)))
            new = left
        return new

    def forget(self, keys) -> None:
        for k in keys:
            self.now.pop(k, None)


class Encoder:
    """Ids of whole texts by a tokenizers .json whose words never span white space.

    Texts are normalised as the vocabulary says and cut at white space; runs that are not remembered are cut into words,
    whose ids do not depend on their neighbours. Words that are not remembered go to the library joined by spaces, and
    the end-of-word tokens part their ids. Texts with special strings go there whole.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode())
        ending = [i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]
        self.ends_word = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        self.ends_word[ending] = True
        #: Ids of runs and of words alike.
        self.known = Recent(CACHED)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            (joined,) = self._ids([b" ".join(part).decode()])
            ends = ((np.flatnonzero(self.ends_word[np.frombuffer(joined, "<u4")]) + 1) * 4).tolist()
            if len(ends) == len(part):
                self.known.now.update(zip(part, map(joined.__getitem__, map(slice, [0, *ends], ends))))
            else:  # a match held several words, such as numerals that are no digits
                self.known.now.update(zip(part, self._ids([*map(bytes.decode, part)])))

    def _learn(self, runs: set[bytes]) -> None:
        plain, mixed, cut = [], [], []
        for r in runs:
            if r.isalpha():
                plain.append(r)
            else:
                mixed.append(r)
                cut.append(ASCII_WORDS.findall(r) if r.isascii() else [w.encode() for w in WORDS.findall(r.decode())])
        words = {*chain.from_iterable(cut)}.difference(self.known.now, plain)
        self._learn_words([*plain, *words])
        known = self.known.now.__getitem__
        self.known.now.update([(r, known(ws[0]) if len(ws) == 1 else b"".join(map(known, ws))) for r, ws in zip(mixed, cut)])

    def encode(self, texts: list[str | None], end: int | None) -> list[np.ndarray]:
        """Arrays of ids of the texts (null: empty), each with `end` behind it if that is given."""
        plain, whole = [], []
        for i, t in enumerate(texts):
            if t and ("<|" in t or not t.isascii() and UNSURE.search(t)):
                whole.append(i)
                t = None
            if t and not t.isascii():
                t = unicodedata.normalize("NFC", t)
            plain.append(t.lower() if t else "")
        split = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
        runs = split.flatten().dictionary_encode()
        distinct, at = runs.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), runs.indices.to_numpy()
        fresh = self.known.fresh({*distinct})
        self._learn(fresh)
        ids = [*map(self.known.now.__getitem__, distinct)]
        self.known.forget([r for r in fresh if len(r) > CACHED_LENGTH])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        sizes = size[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        every = np.frombuffer(b"".join(ids), "<u4")[np.repeat(first[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        edges = ends[split.offsets.to_numpy()]
        if end is not None:
            every = np.insert(every, edges[1:], end)
            edges = edges + np.arange(len(edges))
        out = [every[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())]
        for i in whole:
            out[i] = np.frombuffer(self._ids([texts[i]])[0] + (b"" if end is None else struct.pack("<I", end)), "<u4")
        return out


CHUNKS = "part int, chunk int, ids array<bigint>, lengths array<bigint>, payload binary"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int | None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> None:
    """Encodes every whole text and writes the chunks to `path`, in ascending order of id.

    Parts are ranges of ids, so (part, chunk) is the order of the file. Null ids come first; equal ids are ordered by
    text. Null and empty texts are the end id alone. A document stays in one chunk, however long.
    """
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, lengths, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        encoder = built(Encoder, data.value)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "chunk": pa.array([number], pa.int32()),
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "payload": pa.array([pack(np.concatenate(held))], pa.binary()),
                }
            )

        for batch in batches:
            step = max(1, min(1024, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, step):
                piece = batch.slice(i, step)
                for doc, got in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist(), end)):
                    ids.append(doc)
                    lengths.append(len(got))
                    held.append(got)
                    size += len(got)
                    if size >= chunk:
                        yield flush()
                        number, ids, lengths, held, size = number + 1, [], [], [], 0
        if ids:
            yield flush()

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    ordered = ordered.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "t")
    ordered.mapInArrow(packed, CHUNKS).write.mode("overwrite").option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>, ids_crc32) of every document in a file of `write_tokens`.

    start is the number of ids of all documents before it.
    """
    chunks = spark.read.parquet(path)
    kind = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64())])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                all_ids, n = unpack(row["payload"]), len(row["ids"])
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(all_ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]).astype(np.int32)), pa.array(all_ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["chunk"]] * n, pa.int32()), pa.array(row["ids"], pa.int64()), pa.array(starts), pa.array(lengths), lists, pa.array(crc, pa.int64())], schema=kind)

    docs = chunks.mapInArrow(unpacked, "part int, chunk int, doc_id bigint, offset bigint, n_tokens bigint, ids array<int>, ids_crc32 bigint")
    sizes = chunks.select("part", "chunk", F.expr("aggregate(lengths, 0L, (s, x) -> s + x)").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each range
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("p0"))
    within = sizes.select("part", "chunk", (F.sum("n").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n")).alias("c0"))
    starts = within.join(before, "part").select("part", "chunk", (F.col("p0") + F.col("c0")).alias("base"))
    return docs.join(starts, ["part", "chunk"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids", "ids_crc32")


def token_file(docs: DataFrame, vocabulary: str, end: int | None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes `docs` to `path` and reads them back; without a path, to a new folder beside the session's checkpoints.

    Repeated rows are written as often as they came; an empty table gives an empty file and result. Other columns are
    left out, whatever their names.
    """
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary, end, id_col, text_col)
    return read_tokens(spark, path)
