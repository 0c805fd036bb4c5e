"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into segments and mapped to the vector of their bit counts. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so a grid range-join on the vectors finds every
candidate. Candidates that meet in a grid cell are then verified exactly.

The join is in meeting form. Two fingerprints are at most 2 bits apart exactly if some 64-bit word is at most one bit
from both, and that word lies in a cell at Manhattan distance 0 or 1 from both vectors. So each fingerprint goes to its
own cell and to the neighbouring cells that one flipped bit can reach. Cells with a single visitor are dropped, and in
the others the words of that cell are compared for equality. A word has at most 65 fingerprints within one bit, so no
group is larger than that, whatever the data; links are a star in it, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .support import join_hot, mapped, named, stored

BITS = 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a whole text; 0 for null and for texts without words.

    Words are runs of bytes other than ASCII white space, after A-Z are lower-cased; shingles of `words` words, repeats
    included, are joined by a space and hashed by XXH64. Fewer words are one shingle.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = (ends - [len(p) + 1 for p in parts]).tolist()
    n, digest = max(1, len(parts) - words + 1), xxhash.xxh64_intdigest
    stops = (ends - 1).tolist()[min(words, len(parts)) - 1 :]
    hashes = np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts, stops)), np.uint64, n)
    return of_hashes(hashes)


def of_hashes(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash of unsigned 64-bit hashes: a bit is 1 if it is set in over half of them; 0 for none."""
    n = len(hashes)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        block = hashes[at : at + 65536].astype("<u8").view(np.uint8)
        counts += np.unpackbits(block.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; null texts have fingerprint 0."""
    of = mapped(lambda texts: [fingerprint(t, words) for t in texts], pa.int64(), "long", alone=True)
    return docs.select(named(id_col).cast("long").alias("doc_id"), of(named(text_col)).alias("fp"))


def _visiting(fps: DataFrame, width: int) -> DataFrame:
    """(fp, k, cell) of the distinct fingerprints: k = 0 is a fingerprint's own cell, k in 1..n the cell with one bit more
    in segment k - 1, k in n + 1..2n the one with a bit less in segment k - n - 1, for n segments.

    A cell is the vector of bit counts, packed into a long, or mixed into one by a hash where a long is too short: equal
    cells stay equal, and the exact comparison that follows bears chance meetings.
    """
    n, bits = BITS // width, width.bit_length()
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = fps.select("fp").distinct().repartition(parts, "fp")  # equal ones meet before the shuffle
    counts = F.expr(f"transform(sequence(0, {n - 1}), i -> bit_count(shiftrightunsigned(fp, i * {width}) & {(1 << width) - 1}))")
    if n * bits <= BITS:
        home = f"aggregate(sequence(0, {n - 1}), 0L, (c, i) -> c | shiftleft(cast(counts[i] as long), i * {bits}))"
        step = f"home + if(k <= {n}, 1L, -1L) * shiftleft(1L, (k - 1) % {n} * {bits})"
    else:
        home = "xxhash64(counts)"
        step = f"xxhash64(transform(counts, (c, i) -> if(i = (k - 1) % {n}, c + if(k <= {n}, 1, -1), c)))"
    full = f"counts[(k - 1) % {n}] = if(k <= {n}, {width}, 0)"
    cells = F.expr(f"transform(sequence(0, {2 * n}), k -> if(k = 0, home, if({full}, null, {step})))")
    at = one.select("fp", counts.alias("counts")).select("fp", "counts", F.expr(home).alias("home"))
    return at.select("fp", F.posexplode(cells).alias("k", "cell")).where("cell is not null")


def links(fps: DataFrame, width: int = 4) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of `fps` (fp: long), whose components are those of all pairs at
    most 2 bits apart.

    width: bits of a segment. Every link joins fingerprints that are at most 2 bits apart.
    """
    n = BITS // width
    # Fingerprints are distinct here, and of 64 random bits one in six million has the commonest cell, so no cell is hot.
    met = _visiting(fps, width).withColumn("n", F.count("*").over(Window.partitionBy("cell"))).where("n > 1")
    #: In the cell that segment (k - 1) % n leads to, lie the words with one bit of that segment set or cleared.
    flipped = f"transform(sequence(0, {width - 1}), j -> fp ^ shiftleft(1L, cast((k - 1) % {n} * {width} + j as int)))"
    there = f"filter({flipped}, w -> bit_count(w) - bit_count(fp) = if(k <= {n}, 1, -1))"
    words = met.select("fp", F.explode(F.expr(f"if(k = 0, array(fp), {there})")).alias("word"))
    groups = words.groupBy("word").agg(F.min("fp").alias("b"), F.max("fp").alias("top"), F.collect_list("fp").alias("all"))
    return groups.where("b <> top").select(F.explode("all").alias("a"), "b").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every row.

    Documents with at most 2 differing bits are linked; component_id is the smallest doc_id that links lead to. Null and
    empty texts have fingerprint zero and are linked like others. Rows with a null id keep their fingerprint and get the
    smallest id that is not null, if there is one. Repeated rows are returned as often as they came. An empty table gives
    an empty one; other columns of `docs` are left out, whatever their names. Ids are long or can be cast to it.
    """
    fps, _ = stored(fingerprints(docs, id_col, text_col, words))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    classes = components(links(fps, width))
    joined = first.join(classes, first.fp == classes.node, "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("class"))
    named = joined.groupBy("class").agg(F.min("first").alias("component_id"))
    of = joined.select("fp", "n", "class").join(named, "class").select("fp", "n", "component_id")
    return join_hot(fps, of, "fp", fps.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
