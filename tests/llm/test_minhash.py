"""Near-duplicates by Jaccard likeness against all pairs."""

import random

import corpus_pipeline as pipeline
from barloom.llm import minhash

SCHEMA = "doc_id long, text string"


def _sets(text, words=5):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def smallest(texts, least=0.8):
    """The smallest index of each text's group, by all pairs."""
    sets, group = [_sets(t) for t in texts], [*range(len(texts))]

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= round(10 * least) * len(a | b):
                x, y = sorted((top(i), top(j)))
                group[y] = x
    return [top(i) for i in range(len(texts))]


def near_copies(n=30, seed=4):
    """Texts of 60 to 200 words, and copies with one to eight words changed, some of copies: likenesses on both sides of 0.8."""
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(60, 200))) for _ in range(n)]
    for k in range(5 * n):
        parts = rng.choice(texts).split()
        for at in rng.sample(range(len(parts)), k % 8 + 1):
            parts[at] = f"c{k}"
        texts.append(" ".join(parts))
    return texts


def test_groups_equal_all_pairs(spark):
    texts = [*near_copies(), None, "", " ", "a", "A", "a b", "one two three four five", "one two three four five"]
    found = minhash.near_duplicates(spark.createDataFrame([*enumerate(texts)], SCHEMA))
    assert [r["component_id"] for r in found.orderBy("doc_id").collect()] == smallest(texts)


def test_stage_drops_copies_of_a_likeness_of_0_8(spark):
    words = [f"w{i}" for i in range(100)]
    near, far = [*words], [*words]
    near[20] = near[60] = "x"  # 86 of 106 shingles
    for at in (10, 30, 50, 70):
        far[at] = "y"  # 76 of 116 shingles
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], SCHEMA)
    assert {r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect()} == {1, 3}


def test_odd_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (7, "b"), (7, "c")], SCHEMA)
    assert sorted(map(str, (r["doc_id"] for r in minhash.near_duplicates(docs).collect()))) == ["7", "7", "None", "None"]
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def many_edits(n=120, seed=9):
    """One text of 146 words with one to six places changed, and unlike texts that hold its first 60 words."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(146)]
    texts = []
    for k in range(n):
        parts = [*base]
        for at in rng.sample(range(len(parts)), k % 6 + 1):
            parts[at] = f"e{rng.randrange(40)}"
        texts.append(" ".join(parts))
    return texts + [" ".join([*base[:60], *(f"u{k}x{i}" for i in range(70))]) for k in range(n)]


def test_one_large_family_and_a_shared_passage(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SHARE", 10)  # bands are dealt out
    texts = many_edits()
    found = minhash.near_duplicates(spark.createDataFrame([*enumerate(texts)], SCHEMA))
    assert [r["component_id"] for r in found.orderBy("doc_id").collect()] == smallest(texts)


def test_sets_without_a_partner_are_left_out(spark):
    rows = [(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4, 6]), (3, [1, 2, 7, 8, 9])]
    found = minhash._common(spark.createDataFrame(rows, "key long, hashes array<long>"), 8).collect()
    assert {(r["key"], r["n"], tuple(r["hashes"])) for r in found} == {(1, 5, (1, 2, 3, 4)), (2, 5, (1, 2, 3, 4))}


def test_bins_rule_out_no_alike_pair(spark):
    texts = many_edits(60)
    sets = [minhash.shingles(t) for t in texts]
    rows = [(i, [int(x) for x in s.view("int64")]) for i, s in enumerate(sets)]
    common = minhash._common(spark.createDataFrame(rows, "key long, hashes array<long>"), 8)
    held = spark.createDataFrame([(0, i, i) for i in range(len(texts))], "band long, key long, group long")
    kept = {(r["a"], r["b"]) for r in minhash._between_groups(held, common, 8).collect()}
    alike = {(i, j) for i in range(len(sets)) for j in range(i) if 10 * len({*sets[i]} & {*sets[j]}) >= 8 * len({*sets[i]} | {*sets[j]})}
    assert alike and alike <= kept and len(kept) < len(texts) ** 2 / 8


def test_fingerprints_find_alike_texts_without_bands(spark, monkeypatch):
    """SimHash alone, with all bands taken away, finds texts whose fingerprints are close; those that are not alike stay."""
    rng = random.Random(8)
    long = [f"w{rng.randrange(5_000)}" for _ in range(3_000)]
    texts = [" ".join(long), " ".join([*long[:-1], "other"]), " ".join(rng.choices("abcdefghij", k=300)), " ".join(["new", *long]), None, "", " ".join(long).upper()]
    docs = spark.createDataFrame([*enumerate(texts)], SCHEMA)
    sketched = minhash.sketches
    from pyspark.sql import functions as F

    monkeypatch.setattr(minhash, "sketches", lambda *a: sketched(*a).withColumn("bands", F.array().cast("array<bigint>")))
    found = dict(minhash.near_duplicates(docs).select("doc_id", "component_id").collect())
    assert [found[i] for i in range(len(texts))] == smallest(texts)
    first = spark.createDataFrame([(1, 0b111), (2, 0b111), (3, 0b100), (4, 1 << 40 | 1 << 50 | 1 << 60)], "key long, fp long")
    assert sorted(map(tuple, minhash._by_fingerprint(first).collect())) in ([(2, 1), (3, 1)], [(1, 3), (2, 1)])
