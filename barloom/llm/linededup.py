"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

A line's key is hashed to 128 bits. The state is a table (key, n_docs): in how many documents a key occurs. Documents
are inserted by adding their counts and deleted by subtracting them, in any order, so the state after a deletion is the
state without the document. Keys at or above a threshold are frequent; each shard of them has a cuckoo filter, which
takes insertions and deletions as keys cross the threshold, and the sorted keys themselves. Every line goes to the filter
of its key's shard and, only if that says yes, on to the exact keys there. A shard whose keys have many lines is there
several times, and its lines are dealt out to the copies by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .support import mapped, named, stored

BLANK = b" \t\n\x0b\x0c\r"
#: Keys of a shard at most, on average.
SHARD_KEYS = 1 << 16
#: Groups of lines for each shuffle partition, about.
GROUPS = 8


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def digest_of(line: bytes) -> bytes:
    """128 bits of a line's key, the line stripped of ASCII white space with A-Z lower-cased; b"" if that is empty."""
    key = line.strip(BLANK).lower()
    return xxhash.xxh3_128_digest(key) if key else b""


class CuckooFilter:
    """Set of 16-byte digests with deletion: buckets of four 16-bit tags, two buckets for each digest.

    May say yes to a digest that was never inserted (about 1 in 8,000), never no to one that was. Delete only what was
    inserted. A full table grows: the caller's `digests` are inserted anew.
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, room: int, tags: np.ndarray | None = None):
        self.mask = (1 << max(1, int(np.ceil(np.log2(max(2, room / (self.SLOTS * 0.85))))))) - 1
        self.tags = np.zeros((self.mask + 1, self.SLOTS), np.uint16) if tags is None else tags.reshape(-1, self.SLOTS).copy()
        self.mask = len(self.tags) - 1

    @staticmethod
    def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = digests.view("<u8").reshape(-1, 2)
        return words[:, 0], (words[:, 1] % np.uint64(65535)).astype(np.uint16) + np.uint16(1)

    def _places(self, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, tag = self._halves(np.frombuffer(b"".join(digests), np.uint8))
        one = (low & np.uint64(self.mask)).astype(np.int64)
        return tag, one, self._other(one, tag)

    def _other(self, bucket, tag):
        return bucket ^ ((tag.astype(np.int64) * 0x5BD1E995) & self.mask)

    def insert(self, digest: bytes) -> bool:
        """False if there is no room; the filter must be built anew then."""
        tag, one, two = (x[0] for x in self._places([digest]))
        for b in (one, two):
            free = np.flatnonzero(self.tags[b] == 0)
            if len(free):
                self.tags[b, free[0]] = tag
                return True
        bucket, undo = two, []
        for k in range(self.KICKS):
            slot = (k * 7 + int(tag)) % self.SLOTS
            undo.append((bucket, slot, self.tags[bucket, slot]))
            self.tags[bucket, slot], tag = tag, self.tags[bucket, slot]
            bucket = self._other(bucket, tag)
            free = np.flatnonzero(self.tags[bucket] == 0)
            if len(free):
                self.tags[bucket, free[0]] = tag
                return True
        for bucket, slot, tag in reversed(undo):
            self.tags[bucket, slot] = tag
        return False

    def delete(self, digest: bytes) -> bool:
        tag, one, two = (x[0] for x in self._places([digest]))
        for b in (one, two):
            at = np.flatnonzero(self.tags[b] == tag)
            if len(at):
                self.tags[b, at[0]] = 0
                return True
        return False

    def contains(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, bool)
        tag, one, two = self._places(digests)
        return (self.tags[one] == tag[:, None]).any(axis=1) | (self.tags[two] == tag[:, None]).any(axis=1)

    @classmethod
    def of(cls, digests: list[bytes]) -> CuckooFilter:
        room = len(digests)
        while True:
            made = cls(room)
            if all(map(made.insert, digests)):
                return made
            room = max(2 * room, 16)


def line_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n_docs) of the lines in `docs`: a key counts once for each row it occurs in. Empty keys have none."""
    of = mapped(lambda texts: [sorted({*map(digest_of, lines_of(t))} - {b""}) for t in texts], pa.list_(pa.binary()), "array<binary>", alone=True)
    return docs.select(F.explode(of(named(text_col))).alias("key")).groupBy("key").agg(F.count("*").alias("n_docs"))


def inserted(counts: DataFrame, docs: DataFrame, text_col: str = "text", sign: int = 1) -> DataFrame:
    """The state `counts` after `docs` are inserted."""
    change = line_counts(docs, text_col).withColumn("n_docs", F.col("n_docs") * sign)
    return counts.unionByName(change).groupBy("key").agg(F.sum("n_docs").alias("n_docs")).where("n_docs <> 0")


def deleted(counts: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The state `counts` after `docs`, which were inserted before, are deleted."""
    return inserted(counts, docs, text_col, -1)


FILTERS = "shard int, tags binary, keys binary"


def _sharded(counts: DataFrame, least: int, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    return counts.where(F.col("n_docs") >= least).select(shard, "key")


def build_filters(counts: DataFrame, least: int, shards: int) -> DataFrame:
    """(shard, tags of its cuckoo filter, its frequent keys in order) from a state; keys in at least `least` documents."""

    def build(part: pa.Table) -> pa.Table:
        keys = sorted(part["key"].to_pylist())
        made = CuckooFilter.of(keys)
        return pa.table({"shard": pa.array([part["shard"][0].as_py()], pa.int32()), "tags": [made.tags.tobytes()], "keys": [b"".join(keys)]})

    return _sharded(counts, least, shards).groupBy("shard").applyInArrow(build, FILTERS)


def refresh_filters(filters: DataFrame, before: DataFrame, after: DataFrame, least: int, shards: int) -> DataFrame:
    """`filters` of the state `before` made those of `after`: keys that crossed the threshold are inserted or deleted."""
    old, new = _sharded(before, least, shards), _sharded(after, least, shards)
    key = ["shard", "key"]
    moves = new.join(old, key, "left_anti").withColumn("up", F.lit(True)).unionByName(old.join(new, key, "left_anti").withColumn("up", F.lit(False)))

    def move(held: pa.Table, moved: pa.Table) -> pa.Table:
        rows, changes = held.to_pylist(), moved.to_pylist()
        shard = (rows or changes)[0]["shard"]
        data = rows[0]["keys"] if rows else b""
        keys = {data[i : i + 16] for i in range(0, len(data), 16)}
        now = CuckooFilter(0, np.frombuffer(rows[0]["tags"], np.uint16)) if rows else CuckooFilter(16)
        for c in changes:
            (keys.add if c["up"] else keys.discard)(c["key"])
            if now is not None and not (now.insert if c["up"] else now.delete)(c["key"]):
                now = None
        now = now or CuckooFilter.of(sorted(keys))
        return pa.table({"shard": pa.array([shard], pa.int32()), "tags": [now.tags.tobytes()], "keys": [b"".join(sorted(keys))]})

    return filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(move, FILTERS)


def spread(counts: DataFrame, least: int, shards: int, groups: int) -> DataFrame:
    """(shard, copies) of the shards that need more than one copy of their filter, fewer than `groups` rows: a shard gets
    one for each part of 1 / `groups` of all frequent lines that its keys have, so that a hot key is in many."""
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    frequent = counts.where(F.col("n_docs") >= least)
    total = frequent.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    loads = frequent.groupBy(shard).agg(F.sum("n_docs").alias("load")).where(F.col("load") * groups > total)
    return loads.select("shard", F.ceil(F.col("load") * groups / max(1, total)).cast("int").alias("copies"))


def frequent_lines(lines: DataFrame, filters: DataFrame, copies: DataFrame, shards: int, exact: bool = True) -> DataFrame:
    """The rows of `lines` (id, key) with a frequent key: a stream through each shard behind its cuckoo filter, and what
    the filter lets pass is looked up among the shard's keys (with `exact` false it is returned as it is).

    copies: as `spread`. A line goes to the copy that a hash of its id names, so the lines of a hot key are dealt out.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    n = F.coalesce("copies", F.lit(1))
    few = F.broadcast(copies)  # fewer rows than the groups that `spread` was given
    kind = lines.schema["id"].dataType
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("tags", "keys")]
    line = lines.select(shard, "id", "key").join(few, "shard", "left").select("shard", F.pmod(F.xxhash64("id"), n).cast("int").alias("copy"), "id", "key", *nothing)
    first = filters.join(few, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), n - 1)).alias("copy"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("binary").alias("key"), "tags", "keys")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, known = None, None, frozenset()
        for batch in batches:
            at = batch["shard"].to_numpy().astype(np.int64) << 32 | batch["copy"].to_numpy()
            ends = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if at[i] != current:
                    current, held = at[i], None
                for r in part.filter(part["tags"].is_valid()).to_pylist():
                    held = CuckooFilter(0, np.frombuffer(r["tags"], np.uint16))
                    known = frozenset(r["keys"][k : k + 16] for k in range(0, len(r["keys"]), 16))
                part = part.filter(part["key"].is_valid())
                if held is None or not part.num_rows:
                    continue
                keys = part["key"].to_pylist()
                yes = [bool(y) and (not exact or k in known) for y, k in zip(held.contains(keys), keys)]
                yield part.filter(pa.array(yes, pa.bool_())).select(["id", "key"])

    place = ["shard", "copy"]
    both = line.unionByName(first).repartition(parts, *place).sortWithinPartitions(*place, F.col("key").isNotNull())
    out = StructType([StructField("id", kind), StructField("key", BinaryType())])
    return both.mapInArrow(probe, out)


DROPPED = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])
DROPPED_DDL = "struct<n_lines: long, n_dropped: long, kept: string>"


def _without(lines: list[bytes], digests: list[bytes], gone: set[bytes]) -> dict:
    kept = [line for line, d in zip(lines, digests) if d not in gone] if gone else lines
    return {"n_lines": len(lines), "n_dropped": len(lines) - len(kept), "kept": b"\n".join(kept).decode("utf-8", "surrogatepass")}


def with_kept_lines(docs: DataFrame, counts: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row: all of `docs`' columns, kept: n_lines, n_dropped and the text without lines that `counts` has as frequent).

    The digests of a document's lines meet the filters of their shards, those that pass the shards' exact keys, and what
    is frequent comes back to the documents by id. Rows that share an id share what comes back, which harms nothing.
    """
    frequent, _ = stored(counts.where(F.col("n_docs") >= least).select("key", "n_docs"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, -(-frequent.count() // SHARD_KEYS))
    of = mapped(lambda texts: [[*({*map(digest_of, lines_of(t))} - {b""})] for t in texts], pa.list_(pa.binary()), "array<binary>", alone=True)
    lines = docs.select(named(id_col).alias("id"), F.explode(of(named(text_col))).alias("key"))
    found = frequent_lines(lines, build_filters(frequent, least, shards), spread(frequent, least, shards, GROUPS * parts), shards)
    gone = found.groupBy("id").agg(F.collect_set("key").alias("gone"))

    def drop_some(rows: list) -> list:
        out = []
        for r in rows:
            lines = lines_of(r["t"])
            out.append(_without(lines, [*map(digest_of, lines)] if r["g"] else [], {*(r["g"] or [])}))
        return out

    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"))  # the text is in it once
    joined = rows.join(gone, F.col("row")[id_col].eqNullSafe(F.col("id")), "left")
    both = F.struct(F.col("row")[text_col].alias("t"), F.col("gone").alias("g"))
    return joined.select("row", mapped(drop_some, DROPPED, DROPPED_DDL, alone=True)(both).alias("kept"))


def dedup_lines(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept) of every row.

    Lines whose key is in at least `least` rows of `docs` (or of what `counts` holds) are dropped everywhere; others stay
    in order. Lines with an empty key always stay. Null and empty texts are one empty line. Null ids and repeated rows
    are returned as they came, and repeated rows count as documents of their own. Other columns are left out.
    """
    bare = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    counts = line_counts(bare) if counts is None else counts
    found = with_kept_lines(bare, counts, least)
    return found.select("row.doc_id", "kept.n_lines", "kept.n_dropped", F.sha2(F.col("kept.kept"), 256).alias("kept_sha256"), "kept.kept")


def drop_lines(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, with all rows and columns, without frequent lines in the text. Null texts stay null, null ids and repeated
    rows stay as they are, an empty table stays empty, and columns may have any names."""
    found = with_kept_lines(docs, line_counts(docs, text_col), least, id_col, text_col)
    kept: Column = F.when(F.col("row")[text_col].isNotNull(), F.col("kept.kept"))
    return found.select(*[(kept if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
