"""The attempt ledger: records of fixed width in the order of their index, as a data source for reading and writing.

A reader cuts a ledger into ranges of whole records, so that tasks read their own bytes; a writer sorts by index first, and
its tasks write the parts of one ledger, which are named in order. The digest of a prefix is that of its bytes.
`path` is a folder (or, for reading, one file) that driver and executors have mounted.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# The layout of a record, its padding, and the names of status codes by number.
RECORD = np.dtype(
    [
        ("attempt_index", "<u8"), ("training_step", "<u4"), ("status", "u1"), ("token_len", "u1"), ("token_ids", "u1", (15,)),
        ("canonical_hash", "u1", (32,)), ("selection_hash", "u1", (32,)), ("reward", "<f4"), ("training_reward", "<f4"), ("coverage", "<f4"), ("finite_std", "<f4"),
    ]
)
PAD = 255
STATUS = ("pending_semantic_valid", "grammar_invalid", "vm_invalid", "insufficient_daily_signal", "low_coverage", "constant_signal", "canonical_duplicate", "selection_duplicate", "accepted_unique")
PENDING = 0

SCHEMA = "attempt_index long, training_step int, status int, token_ids array<int>, canonical_hash string, selection_hash string, reward float, training_reward float, coverage float, finite_std float"
_ARROW = pa.schema([("attempt_index", pa.int64()), ("training_step", pa.int32()), ("status", pa.int32()), ("token_ids", pa.list_(pa.int32())), ("canonical_hash", pa.string()), ("selection_hash", pa.string()), *[(n, pa.float32()) for n in ("reward", "training_reward", "coverage", "finite_std")]])
#: Records that a reader's task and a step of it take.
SPLIT, STEP = 1 << 20, 1 << 14


def parts(path: str) -> list[tuple[str, int]]:
    """(file, records) of a ledger in order; a file that ends inside a record is an error."""
    files = sorted(f"{path}/{n}" for n in os.listdir(path) if n.endswith(".bin")) if os.path.isdir(path) else [path]
    sizes = [(f, os.path.getsize(f)) for f in files]
    for f, size in sizes:
        if size % RECORD.itemsize:
            raise ValueError(f"{f} ends inside a record: {size} bytes are no multiple of {RECORD.itemsize}")
    return [(f, size // RECORD.itemsize) for f, size in sizes]


def decoded(data: bytes) -> pa.RecordBatch:
    rows = np.frombuffer(data, RECORD)
    hashes = lambda name: [h.hex() if h.strip(b"\0") else None for h in (x.tobytes() for x in rows[name])]
    tokens = [ids[:n].tolist() for ids, n in zip(rows["token_ids"], rows["token_len"].tolist())]
    numbers = [pa.array(rows[n], pa.float32(), mask=np.isnan(rows[n])) for n in ("reward", "training_reward", "coverage", "finite_std")]
    plain = [pa.array(rows[n].astype(np.int64)).cast(_ARROW.field(n).type) for n in ("attempt_index", "training_step", "status")]
    return pa.RecordBatch.from_arrays([*plain, pa.array(tokens, pa.list_(pa.int32())), pa.array(hashes("canonical_hash"), pa.string()), pa.array(hashes("selection_hash"), pa.string()), *numbers], schema=_ARROW)


def encoded(rows: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(rows.num_rows, RECORD)
    for name in ("attempt_index", "training_step", "status"):
        out[name] = rows[name].to_numpy(zero_copy_only=False)
    out["token_ids"] = PAD
    for i, ids in enumerate(rows["token_ids"].to_pylist()):
        if not 1 <= len(ids) <= RECORD["token_ids"].shape[0]:
            raise ValueError(f"attempt {out['attempt_index'][i]} has {len(ids)} tokens")
        out["token_len"][i], out["token_ids"][i, : len(ids)] = len(ids), ids
    for name in ("canonical_hash", "selection_hash"):
        for i, h in enumerate(rows[name].to_pylist()):
            if h:
                out[name][i] = np.frombuffer(bytes.fromhex(h), np.uint8)
    for name in ("reward", "training_reward", "coverage", "finite_std"):
        out[name] = rows[name].to_numpy(zero_copy_only=False)  # null as NaN
    if (out["status"] == PENDING).any():
        raise ValueError("attempts with an open status can't be written")
    return out


@dataclass
class _Range(InputPartition):
    file: str
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Range]:
        return [_Range(f, at, min(SPLIT, n - at)) for f, n in parts(self.path) for at in range(0, n, SPLIT)] or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        with open(part.file, "rb") as file:
            file.seek(part.first * RECORD.itemsize)
            for at in range(0, part.count, STEP):
                yield decoded(file.read(min(STEP, part.count - at) * RECORD.itemsize))


@dataclass
class _Written(WriterCommitMessage):
    file: str
    first: int
    count: int


class _Writer(DataSourceWriter):
    """Tasks write hidden files; the commit checks that their indices follow each other, then gives them their names."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        context = TaskContext.get()
        name = f"{self.path}/.part-{context.partitionId():06d}-{context.taskAttemptId()}"
        first = last = None
        with open(name, "wb") as file:
            batch = []
            for row in rows:
                i = row["attempt_index"]
                if last is not None and i != last + 1:
                    raise ValueError(f"attempt {i} follows {last}")
                first, last = i if first is None else first, i
                batch.append(row.asDict())
                if len(batch) == STEP:
                    file.write(encoded(pa.RecordBatch.from_pylist(batch, _ARROW)).tobytes())
                    batch = []
            if batch:
                file.write(encoded(pa.RecordBatch.from_pylist(batch, _ARROW)).tobytes())
        return _Written(name, -1 if first is None else first, 0 if first is None else last - first + 1)

    def commit(self, messages: list[_Written | None]) -> None:
        old = [] if self.overwrite else parts(self.path)
        follows = sum(n for _, n in old)
        new = sorted((m for m in messages if m and m.count), key=lambda m: m.first)
        for m in new:
            if m.first != follows:
                self.abort(messages)
                raise ValueError(f"attempt {m.first} follows {follows - 1}")
            follows += m.count
        if self.overwrite:
            for f, _ in parts(self.path):
                os.remove(f)
        for m in new:
            os.replace(m.file, f"{self.path}/{m.first:020d}.bin")
        for m in messages:
            if m and not m.count:
                os.remove(m.file)

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.file):
                os.remove(m.file)


class AttemptLedger(DataSource):
    @classmethod
    def name(cls) -> str:
        return "attempt_ledger"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(AttemptLedger)
    return spark.read.format("attempt_ledger").load(path)


def write(rows: DataFrame, path: str, append: bool = False) -> None:
    """Rows (SCHEMA, status as its number) as a ledger, or behind one. Indices must follow each other from 0, or from its
    end, without a gap; else nothing is written."""
    rows.sparkSession.dataSource.register(AttemptLedger)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    ordered = rows.select(*names).repartitionByRange("attempt_index").sortWithinPartitions("attempt_index")
    ordered.write.format("attempt_ledger").mode("append" if append else "overwrite").save(path)


def truncate(path: str, records: int) -> None:
    """Leaves the first `records` records of a ledger."""
    there = parts(path)
    if not 0 <= records <= sum(n for _, n in there):
        raise ValueError(f"{records} records are outside the ledger")
    for f, n in there:
        keep = min(n, records)
        records -= keep
        if keep == 0:
            os.remove(f)
        elif keep < n:
            os.truncate(f, keep * RECORD.itemsize)


def prefix_digest(path: str, records: int | None = None) -> str:
    """SHA-256 of the bytes of the first `records` records, or of all. Bytes are hashed in order, so one reader does it."""
    there = parts(path)
    left = sum(n for _, n in there) if records is None else records
    if not 0 <= left <= sum(n for _, n in there):
        raise ValueError(f"{left} records are outside the ledger")
    found = hashlib.sha256()
    for f, n in there:
        with open(f, "rb") as file:
            rest = min(n, left) * RECORD.itemsize
            left -= min(n, left)
            while rest and (data := file.read(min(1 << 20, rest))):
                found.update(data)
                rest -= len(data)
    return found.hexdigest()


def to_json(rows: DataFrame) -> DataFrame:
    """(attempt_index, value): a row for each attempt as one line of canonical JSON, keys in order and nulls included."""
    names = sorted(rows.columns)
    return rows.select("attempt_index", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))
