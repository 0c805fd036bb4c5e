"""Canonical exact digests of documents.

A text is made canonical (Unicode NFKC, case folding, NFKC again, runs of white space to one space) and hashed to 128
bits by XXH3. Equal digests are a bucket; in buckets of more than one document the canonical bytes themselves are
compared, and where they differ the digests get a suffix, so that equal fingerprints mean equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import mapped, named, stored

#: Bits of the digests' prefix that the filter of buckets with several documents has: 2 MB, whatever the input.
PREFIX_BITS = 24
#: Digests that different texts share, up to which they are broadcast.
FEW = 10_000


def canonical(text: str | None) -> bytes:
    """The canonical UTF-8 bytes of a text; none for null."""
    if not text:
        return b""
    if text.isascii():
        folded = text.lower()
    else:
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def edited(text: str, following: str) -> str:
    """`text` with its last half of code points replaced by the first as many (or all) of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def collided(docs: DataFrame, digests: DataFrame, text_col: str = "text", digest_of=digest) -> DataFrame:
    """(digest) of the buckets whose documents differ in canonical bytes; `digests` has the column digest of each row.

    Only rows whose digest's prefix belongs to a bucket of several go on to be compared; their canonical texts travel
    compressed, and equal ones meet before the shuffle. The filter of prefixes has a fixed size.
    """
    many = digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    prefix = F.conv(F.substring("digest", 1, PREFIX_BITS // 4), 16, 10).cast("long")
    maps = many.select(prefix.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    rows = maps.collect()  # at most 2 ** (PREFIX_BITS - 15) + 1 rows of 4 KB
    held = docs.sparkSession.sparkContext.broadcast({r["b"]: bytes(r["bits"]) for r in rows})

    def frames(texts: list) -> list:
        known, out, squeeze = held.value, [], zstandard.ZstdCompressor(level=1)
        for text in texts:
            data = canonical(text)
            name = digest_of(data)
            # Bucket numbers begin at 1, with positions 1 to 32768 in the first; see bitmap_bucket_number.
            p = int(name[: PREFIX_BITS // 4], 16)
            bucket, position = (1 + (p - 1) // 32768, (p - 1) % 32768) if p > 0 else (0, 0)
            bits = known.get(bucket)
            if bits is None or not bits[position // 8] >> (position % 8) & 1:
                out.append(None)
            else:
                out.append({"digest": name, "frame": squeeze.compress(data)})
        return out

    kind = pa.struct([("digest", pa.string()), ("frame", pa.binary())])
    shown = docs.select(mapped(frames, kind, "struct<digest: string, frame: binary>")(named(text_col)).alias("x")).where("x is not null").select("x.*")
    distinct = shown.groupBy("digest", "frame").agg(F.count("*").alias("n"))
    apart = distinct.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    # Frames that differ may still hold equal bytes, if tasks had different versions of the library.
    unpack = mapped(lambda fs: [zstandard.ZstdDecompressor().decompress(f) if f else b"" for f in fs], pa.binary(), "binary")
    bytes_apart = distinct.join(apart, "digest", "left_semi").select("digest", unpack("frame").alias("data")).distinct()
    return bytes_apart.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")


KIND = pa.struct([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("digest", pa.string()), ("edited_digest", pa.string()), ("strong", pa.string()), ("edited_strong", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
KIND_DDL = "n_chars bigint, edited_sha256 string, digest string, edited_digest string, strong string, edited_strong string, near_edited double, near_next double"


def _compared(text: str | None, following: str | None, own: bytes | None = None, other: bytes | None = None) -> dict:
    text, following = text or "", following or ""
    changed = edited(text, following)
    own = canonical(text) if own is None else own
    other = canonical(following) if other is None else other
    after = canonical(changed)
    return {
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        "digest": digest(own),
        "edited_digest": digest(after),
        "strong": hashlib.sha256(own).hexdigest(),
        "edited_strong": hashlib.sha256(after).hexdigest(),
        "near_edited": float(digest(own) == digest(after) and own == after),
        "near_next": float(digest(own) == digest(other) and own == other),
    }


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the one with the next lower id; after the last comes the first. Equal ids are ordered by text,
    null ids come last, null texts count as empty. The likeness of two fingerprints is 1 if they are equal and the
    canonical bytes are too, else 0. A single document is its own next; an empty table gives an empty one. Other columns
    are left out, whatever their names.

    Texts move once, into ranges of ids. Each range compares its neighbours in order; the texts at both ends of a range
    are kept with its results and are compared afterwards, two rows for each range.
    """
    kind = pa.schema([("doc_id", pa.int64()), *[(f.name, f.type) for f in KIND], ("part", pa.int32()), ("head", pa.string()), ("tail", pa.string())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = last = None
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = []
                piece = batch.slice(i, 512)
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    data = canonical(text)
                    if last is None:
                        head = text or ""
                    else:
                        rows.append({"doc_id": last[0], **_compared(last[1], text, last[2], data)})
                    last = doc, text, data
                yield pa.RecordBatch.from_pylist(rows, kind)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"doc_id": last[0], "part": TaskContext.get().partitionId(), "head": head, "tail": last[1] or ""}], kind)

    ordered = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    down = F.col("doc_id").desc_nulls_last()
    ordered = ordered.repartitionByRange(down).sortWithinPartitions(down, "text")
    found, _ = stored(ordered.mapInArrow(compare, f"doc_id bigint, {KIND_DDL}, part int, head string, tail string"))
    ends = found.where("part is not null")  # one row for each range
    # The numbers of the ranges alone go through one task; texts move by a join.
    by = Window.orderBy("part")
    after = F.coalesce(F.lead("part").over(by), F.first("part").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    order = ends.select("part", after.alias("after"))
    heads = ends.select(F.col("part").alias("after"), F.col("head").alias("next"))
    of = mapped(lambda rows: [_compared(r["tail"], r["next"]) for r in rows], KIND, f"struct<{KIND_DDL.replace(' ', ': ').replace(',:', ',')}>")
    ends = ends.select("part", "doc_id", "tail").join(order, "part").join(heads, "after")
    ends = ends.select("doc_id", F.struct("tail", "next").alias("p")).select("doc_id", of("p").alias("x")).select("doc_id", "x.*")
    every = found.where("part is null").drop("part", "head", "tail").unionByName(ends)
    apart, _ = stored(collided(docs, every.select("digest"), text_col).withColumn("apart", F.lit(True)))
    # Digests of several texts are next to none; a broadcast is bounded by their count, beyond it rows meet by digest.
    apart = F.broadcast(apart) if apart.count() <= FEW else apart.hint("merge")

    def parted(name: str, strong: str, flag: str):
        return F.when(F.col(flag), F.concat(name, F.lit("-"), strong)).otherwise(F.col(name))

    every = every.join(apart.select(F.col("digest"), F.col("apart").alias("a")), "digest", "left")
    every = every.join(apart.select(F.col("digest").alias("edited_digest"), F.col("apart").alias("b")), "edited_digest", "left")
    return every.select("doc_id", "n_chars", "edited_sha256", parted("digest", "strong", "a").alias("fingerprint"), parted("edited_digest", "edited_strong", "b").alias("edited_fingerprint"), "near_edited", "near_next")
