"""Near-duplicates by the Jaccard likeness of word shingles: SimHash fingerprints and MinHash bands find candidates, the sets
themselves decide.

First the sets whose SimHash fingerprints are at most 2 bits apart are compared, by `simhash.links`. A likeness of 0.8 is
some 10 bits on average, where the vectors of unlike texts meet too, so bands find the pairs that are further apart.
Two texts of likeness s agree in a band of 4 rows with a chance of s ** 4, so 32 bands miss a pair of likeness 0.8 with
a chance of 5e-8, and likelier pairs less often. No band is capped. Texts that share a band are first compared with the
one in the middle of most of these bands. Then, in bands that hold several groups all the same, pairs of different groups
are compared, the members of the largest group only with those outside: a pair within one group can't change the groups. So
a large group of copies costs about as many comparisons as it has members, and yet the groups are those of all pairs.
Bounds spare comparisons that can't succeed: shingles that no other text of a band has are common to no two texts, so
texts that merely share a passage are out before they are paired, and counts over bins of hashes bound the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components, salted
from .support import cut, join_hot, mapped, named, stored

BANDS, ROWS = 32, 4
#: Bits of the hashed ids in the filter of texts that have candidates.
SLOT_BITS = 24
#: Bins of shingle hashes, a power of two, whose counts bound what two sets have in common.
BINS = 64
#: About so many members of a band are compared in one task with those outside its largest group.
SHARE = 1_000
_random = np.random.default_rng(20)
_TIMES = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_MIX = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes (XXH64) of a whole text's shingles of `words` words, ascending; none without words.

    Words are runs of bytes other than ASCII white space, after A-Z are lower-cased. Fewer words are one shingle.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts, stops = (ends - [len(p) + 1 for p in parts]).tolist(), (ends - 1).tolist()[min(words, len(parts)) - 1 :]
    return np.unique(np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts, stops)), np.uint64, len(stops)))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit value for each band; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[i : i + 1024, None] ^ _MIX) * _TIMES).min(axis=0), out=least)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(hashes: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes()))


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, key, SimHash fingerprint, size of the set, bands) of every row; equal sets have equal keys and fingerprints."""

    def run(texts: list) -> list:
        found = (shingles(text, words) for text in texts)
        return [{"key": _key(h), "fp": simhash.of_hashes(h), "size": len(h), "bands": bands(h)} for h in found]

    kind = pa.struct([("key", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("bands", pa.list_(pa.int64()))])
    of = mapped(run, kind, "struct<key: bigint, fp: bigint, size: int, bands: array<bigint>>", alone=True)
    return docs.select(named(id_col).cast("long").alias("doc_id"), of(named(text_col)).alias("x")).select("doc_id", "x.*")


def _sets(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(key, hashes) of the keys in `firsts` (key, first: an id that has it).

    A broadcast bitmap of hashed ids (2 MB, whatever the input) keeps other texts from being hashed and moved; what it
    lets pass by chance is dropped by key.
    """
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    maps = firsts.select(slot("first").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    held = docs.sparkSession.sparkContext.broadcast({r["b"]: bytes(r["bits"]) for r in maps.collect()})  # at most 2 ** (SLOT_BITS - 15) + 1 rows of 4 KB

    def wanted(slots: list) -> list:
        known, out = held.value, []
        for p in slots:
            # Bucket numbers begin at 1, with positions 1 to 32768 in the first; see bitmap_bucket_number.
            bucket, position = (1 + (p - 1) // 32768, (p - 1) % 32768) if p > 0 else (0, 0)
            bits = known.get(bucket)
            out.append(bits is not None and bool(bits[position // 8] >> (position % 8) & 1))
        return out

    def run(texts: list) -> list:
        found = (shingles(text, words) for text in texts)
        return [{"key": _key(h), "hashes": h.view(np.int64)} for h in found]

    kind = pa.struct([("key", pa.int64()), ("hashes", pa.list_(pa.int64()))])
    of = mapped(run, kind, "struct<key: bigint, hashes: array<bigint>>", alone=True)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    rows = rows.where(mapped(wanted, pa.bool_(), "boolean")(slot("doc_id"))).select(of("text").alias("x")).select("x.*")
    return rows.dropDuplicates(["key"]).join(firsts.select("key"), "key", "left_semi")


def _common(sets: DataFrame, tenths: int) -> DataFrame:
    """(key, n, hashes) of the keys in `sets` that can be alike with another: n is the size of a key's set, and hashes are
    those of it that another key has too. Where they are too small a part of the set, no other set can be alike.
    """
    each = sets.select("key", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("k"), F.min("key").alias("key"))
    own = each.where("k = 1").groupBy("key").agg(F.collect_list("h").alias("own"))  # no longer than the set of a text
    left = F.when(F.col("own").isNull(), F.col("hashes")).otherwise(F.array_except("hashes", "own"))
    rows = sets.join(own.hint("merge"), "key", "left").select("key", F.size("hashes").alias("n"), left.alias("hashes"))
    return rows.where(F.size("hashes") * 10 >= F.col("n") * tenths)


def _bins(sets: list) -> list:
    return [np.bincount(np.array(s, np.int64) & (BINS - 1), minlength=BINS).astype(np.int32) for s in sets]


def _enough(common: str, na: str, nb: str, tenths: int) -> str:
    """Whether sets of sizes `na` and `nb` are alike if they have `common` shingles in common."""
    return f"10 * {common} >= {tenths} * ({na} + {nb} - {common})"


def _alike(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """The rows of `pairs` (a, b: keys) whose sets have a likeness of `tenths` / 10 or more; `b` may repeat often.

    sets: of `_common`.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = salted(pairs, "a", parts)
    # A key with very many partners goes to the hashes among which they are dealt out, one with few to as few.
    places = dealt.groupBy("b").agg(F.collect_set("s").alias("s"))
    of = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("hashes").alias(f"h{c}")).hint("merge")
    hubs = places.join(of("b"), "b").select("b", F.explode("s").alias("s"), "nb", "hb")
    met = dealt.join(hubs.hint("merge"), ["b", "s"]).join(of("a"), "a")
    sized = met.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("common"))
    return cut(sized.where(_enough("common", "na", "nb", tenths)).select("a", "b"))


def _between_groups(held: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """(a, b), a > b: the pairs of keys of different groups in a band that bounds of their likeness don't rule out.

    held: (band, key, group). Members of a band's largest group are paired only with those outside it. The common part
    of two sets is no larger than the smaller one, nor than the sum of the smaller counts over bins of hashes; shingles
    that no other text has are in neither. Members of a large band are dealt out, those outside the largest group go
    to all its shares.
    """
    sizes = held.groupBy("band", "group").agg(F.count("*").alias("n"))
    several = sizes.groupBy("band").agg(F.max(F.struct("n", "group")).alias("m"), F.count("*").alias("k"), F.sum("n").alias("all")).where("k > 1")
    several = several.select("band", F.col("m.group").alias("largest"), F.expr(f"cast(1 + all div {SHARE} as int)").alias("shares"))
    of_band = held.join(several.hint("merge"), "band")
    counted = sets.join(of_band.select("key").distinct(), "key", "left_semi")
    bins = mapped(_bins, pa.list_(pa.int32()), "array<int>", alone=True)
    counted = counted.select("key", "n", F.size("hashes").alias("m"), bins("hashes").alias("bins"))
    members = cut(of_band.join(counted.hint("merge"), "key"))
    dealt = members.withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int"))
    outside = members.where("group <> largest").select("band", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), *[F.col(c).alias(f"{c}_x") for c in ("key", "group", "n", "m", "bins")])
    different = "group <> group_x and (group = largest or key < key_x)"
    met = dealt.join(outside.hint("merge"), ["band", "share"]).where(f"{different} and {_enough('least(m, m_x)', 'n', 'n_x', tenths)}")
    shared = F.aggregate(F.zip_with("bins", "bins_x", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    met = met.select("key", "key_x", "n", "n_x", shared.alias("common")).where(_enough("common", "n", "n_x", tenths))
    return met.select(F.greatest("key", "key_x").alias("a"), F.least("key", "key_x").alias("b")).distinct()


def _by_fingerprint(first: DataFrame) -> DataFrame:
    """Pairs (a, b) of the keys in `first` (key, fp) whose fingerprints are at most 2 bits apart: keys of one fingerprint in a
    star about the smallest, and the smallest ones of linked fingerprints."""
    hubs = cut(first.groupBy("fp").agg(F.min("key").alias("hub"), F.count("*").alias("n")))
    equal = join_hot(first.select("key", "fp"), hubs.where("n > 1"), "fp", first.count()).where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    linked = simhash.links(hubs.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    linked = linked.join(hubs.select(F.col("fp").alias("x"), F.col("hub").alias("a")).hint("merge"), "x").join(hubs.select(F.col("fp").alias("y"), F.col("hub").alias("b")).hint("merge"), "y")
    both = equal.unionByName(linked.select("a", "b"))
    return both.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, tenths: int = 8) -> DataFrame:
    """(doc_id, component_id) of every row: texts whose sets of shingles have a likeness of `tenths` / 10 or more are
    linked, and component_id is the smallest doc_id that links lead to.

    Equal sets are alike, also those of null texts and texts without words. Rows with a null id get the smallest id that
    is not null, if there is one. Repeated rows are returned as often as they came.
    """
    found, _ = stored(sketches(docs, id_col, text_col, words))
    first, _ = stored(found.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")))  # copies meet before they are banded
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    close = cut(_by_fingerprint(first.where("size > 0")))
    at = first.select("key", F.explode("bands").alias("band")).repartition(parts, "band")  # one shuffle for both uses
    shared = at.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
    met = cut(at.join(shared.hint("merge"), "band"))
    sought = met.select("key").unionByName(close.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    whole, _ = stored(_sets(docs, first.select("key", "first").join(sought, "key", "left_semi"), id_col, text_col, words))
    sets, _ = stored(_common(whole, tenths))
    met = cut(met.join(sets.select("key", (F.col("n") - F.size("hashes")).alias("own")).hint("merge"), "key").select("band", "key", "own"))
    # The key of a band with the fewest shingles of its own is likely to be in the middle of a group.
    middle = met.groupBy("band").agg(F.min(F.struct("own", "key"))["key"].alias("hub"))
    star = met.join(middle.hint("merge"), "band").where("key <> hub").groupBy("key", "hub").agg(F.count("*").alias("n"))
    star = cut(star.groupBy("key").agg(F.max(F.struct("n", "hub"))["hub"].alias("b")).select(F.col("key").alias("a"), "b"))
    compared = cut(star.unionByName(close).distinct())
    linked = _alike(compared, sets, tenths)
    groups = components(linked)
    held = cut(met.join(groups, met.key == groups.node, "left").select("band", "key", F.coalesce("component", "key").alias("group")))
    tried = compared.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = cut(_between_groups(held, sets, tenths).join(tried, ["a", "b"], "left_anti"))
    groups = components(linked.unionByName(_alike(pairs, sets, tenths)))
    joined = first.join(groups, first.key == groups.node, "left").select("key", "first", "n", F.coalesce("component", "key").alias("group"))
    named = joined.groupBy("group").agg(F.min("first").alias("component_id"))
    of_key = joined.select("key", "n", "group").join(named, "group").select("key", "n", "component_id")
    return join_hot(found.select("doc_id", "key"), of_key, "key", found.count()).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, tenths: int = 8) -> DataFrame:
    """The rows of `docs`, with all columns, whose id is the smallest of its group of near-duplicates.

    Of rows with equal ids that with the smallest text stays. Rows without an id stay, once for each text, if no row of
    their group has one. Null and empty texts are alike. An empty table gives an empty one; columns may have any names.
    """
    found = near_duplicates(docs, id_col, text_col, words, tenths)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), named(id_col).cast("long").alias("id"))
    same = F.col("id").eqNullSafe(F.col("doc_id"))
    once = rows.join(kept.where("n = 1"), same).select("row")
    several = rows.join(kept.where("n > 1"), same).groupBy("id", F.when(F.col("id").isNull(), F.col("row")[text_col]).alias("t")).agg(F.min_by("row", F.struct(F.col("row")[text_col])).alias("row"))
    return once.unionByName(several.select("row")).select("row.*")
