"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import bpe_count, components, decontam, fingerprint, linededup, minhash, pieces, quality, shards, simhash, support, tokenfile, toxicity

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, fp string, key string, shard int, __id long, label int"
ODD = [None, "", " ", "a", "A a", "\n\n", "Ünïcode ß Ⅷ ﬁ", "日本語 テキスト", "x " * 3000, "don't  stop <|endoftext|> now", "tab\tand\x0bmore", "😀 é", "aaaa" * 500]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "f", "k", 1, 2, 3) for i, t in zip(ids, texts)], SCHEMA)


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 4):
        copy = texts[i - 1].split()
        copy[rng.randrange(len(copy))] = "changed"
        texts[i] = " ".join(copy)
    return texts + ODD + ODD


# 1


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(support.UPPER, support.LOWER)))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("width", [4, 8])
def test_simhash_links_equal_all_pairs(spark, width):
    rng = random.Random(5)
    texts = corpus()
    want = [_fingerprint(t) for t in texts]
    found = rows(simhash.near_duplicates(frame(spark, texts), width=width))
    assert [found[i]["fingerprint"] for i in range(len(texts))] == [f"{w:016x}" for w in want]
    near = {i: {j for j, v in enumerate(want) if (v ^ w).bit_count() <= 2} for i, w in enumerate(want)}
    for i in near:  # component_id is the smallest id that links lead to
        reached, new = {i}, {i}
        while new:
            new = set().union(*(near[j] for j in new)) - reached
            reached |= new
        assert found[i]["component_id"] == min(reached)
    assert len({r["component_id"] for r in found.values()}) < len({*want})
    prints = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    for _ in range(150):
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(0, 3)):
            p ^= 1 << b
        prints.append(p)
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                root[max(top(a), top(b))] = min(top(a), top(b))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    links = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), width)
    classes = {r["node"]: r["component"] for r in components.components(links).collect()}
    group = lambda of: {frozenset(q for q in {*prints} if of(q) == of(p)) for p in prints}
    assert group(top) == group(lambda p: classes.get(signed(p), signed(p)))


@pytest.mark.parametrize("shape", ["chain", "hub", "random", "stars", "none"])
def test_components(spark, shape):
    rng = random.Random(6)
    nodes = rng.sample(range(-1000, 1000), 200)
    links = {
        "chain": [*zip(nodes, nodes[1:])],
        "hub": [(nodes[0], n) for n in nodes[1:]] + [(nodes[7], 5000), (5000, 5001)],
        "random": [tuple(rng.choices(nodes, k=2)) for _ in range(150)] + [(3, 3), (None, 4), (4, None)],
        "stars": [(b, n) for b in (-5000, -4000) for n in nodes[:3]][:4],
        "none": [],
    }[shape]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links * 2, "a long, b long")).collect()}
    near = {}
    for a, b in links:
        if a is not None and b is not None:
            near.setdefault(a, {a}).add(b)
            near.setdefault(b, {b}).add(a)
    want = {}
    for n in near:
        reached, new = {n}, {n}
        while new:
            new = set().union(*(near[m] for m in new)) - reached
            reached |= new
        if min(reached) != n:
            want[n] = min(reached)
    assert found == want


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, []).where("false")).count() == 0


# 2


def test_nbest_equals_all_segmentations():
    rng = random.Random(1)
    model = pieces.PieceModel.of({p: rng.uniform(-5, -1) for p in ["a", "b", "ab", "ba", "aab", "▁", "▁a", "bb", "▁ab"]})

    def every(s):
        if not s:
            return [(0.0, b"")]
        out = []
        for n in range(1, len(s) + 1):
            node, level = None, model.tree
            for c in s[:n]:
                node = level.get(c)
                level = node[0] if node else {}
            if node and node[1] is not None:
                out += [(node[1] + x, node[2] + ids) for x, ids in every(s[n:])]
            elif n == 1 and node is None:
                raw = np.array([*s[0].encode()], np.uint32).tobytes()
                out += [(model.unknown + x, raw + ids) for x, ids in every(s[1:])]
        return out

    for text in ["ab", "aabba", "ab ab", "abcab", "", "bbbb aab", "z"]:
        ways = every("▁" + text.replace(" ", "▁") if text else "")
        got, score = model.encode(text, 6), {ids: x for x, ids in ways}
        assert [x for x, _ in got] == pytest.approx(sorted((x for x, _ in ways), reverse=True)[:6])
        assert len({ids for _, ids in got}) == len(got) and all(score[ids] == pytest.approx(x) for x, ids in got)


def test_pieces_round_trip(spark):
    found = rows(pieces.encodings(frame(spark, ODD), "piece_bpe_32k.model", 4))
    for i, text in enumerate(ODD):
        assert found[i]["round_trip"] and found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert found[i]["nbest_scores"] == sorted(found[i]["nbest_scores"], reverse=True)


def test_new_spans_are_segmented_together():
    rng = random.Random(7)
    model = pieces.PieceModel(support.file_bytes("piece_bpe_32k.model"))
    words = ["".join(rng.choices(["th", "er", "on", "é", "ß", "ing", ",", ".\n", "3"], k=rng.randint(1, 9))) for _ in range(3000)]
    texts = [None, "", " ", *ODD, *(" ".join(rng.choices(words, k=60)) for _ in range(100)), "  two  spaces ", "a" * 70 + " " + "\u0e80é" * 40]
    seen = []

    def counted(span):
        seen.append(span)
        return pieces.PieceModel.viterbi(model, span)

    model.viterbi = counted
    got = [*model.encode_all(texts, 4)]
    # One by one are only long spans and those with a character that is no piece.
    assert all(len(s) > pieces.CACHED_LENGTH or not all(c in model.tree and model.tree[c][1] is not None for c in s) for s in seen)
    found = dict(model.viterbis(sorted({part for w in words for part in model.cut("▁" + w)}, key=len, reverse=True)))
    for span, record in found.items():
        score, loss, ids = pieces.PieceModel.viterbi(model, span)
        assert record == np.array([score, loss]).tobytes() + ids
    small = pieces.PieceModel(support.file_bytes("piece_bpe_32k.model"))
    small.cached = 50  # what is remembered changes nothing
    assert [small.encode(t, 4) for t in texts] == got
    assert not any(len(s) > pieces.CACHED_LENGTH for s in {**model.spans, **small.older})


def test_grouped_spans_equal_all_of_a_text():
    rng = random.Random(8)
    signs = ["a", "b", "ab", "ba", "aab", "▁", "▁a", "bb", "▁ab", "xy"]  # x and y are no pieces by themselves
    for prefix in (True, False):
        model = pieces.PieceModel.of({p: rng.uniform(-5, -1) for p in signs}, prefix)
        texts = ["".join(rng.choices("aabb xyz", k=rng.randint(0, 12))) for _ in range(300)]
        for text, got in zip(texts, model.encode_all(texts, 5)):
            lattice = model.nbest((("▁" if prefix else "") + text.replace(" ", "▁")) if text else "", 5)
            assert [s for s, _ in got] == [s for s, _ in lattice]
            assert model.decode(got[0][1]) == text
    assert pieces.PieceModel.of({}).encode("a b", 2)[0][0] < 0


def test_scores_of_merges_are_probabilities():
    n = 20_000
    assert sum(np.exp(pieces.zipf(k, n)) for k in range(1, n + 1)) == pytest.approx(1, abs=1e-6)
    model = pieces.PieceModel(support.file_bytes("piece_bpe_32k.model"))
    (score, ids), (second, _) = model.encode("the", 2)
    assert np.frombuffer(ids, "<u4").size == 1 and second < score < 0


# 3


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = corpus()
    found = rows(bpe_count.token_counts(frame(spark, texts), "byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (n, len((text or "").encode()), n > 1024)


# 4


def test_fingerprints_and_neighbours(spark):
    texts = corpus()
    found = rows(fingerprint.fingerprint_pairs(frame(spark, texts)))
    order = sorted(found, reverse=True)
    for i, doc in enumerate(order):
        text, after = texts[doc] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        row = found[doc]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        own, other, new = map(fingerprint.canonical, (text, after, changed))
        assert (row["near_edited"], row["near_next"]) == (float(own == new), float(own == other))
        assert (row["fingerprint"] == row["edited_fingerprint"]) == (own == new)
    by = Counter((found[d]["fingerprint"], fingerprint.canonical(texts[d])) for d in order)
    assert len({f for f, _ in by}) == len({c for _, c in by}) == len(by)


def test_equal_digests_of_different_texts_are_parted(spark):
    docs = frame(spark, ["one", "two", "three", "three"])
    weak = lambda data: "0" * 31 + ("1" if data == b"three" else "2")
    digests = spark.createDataFrame([("0" * 31 + c,) for c in "2211"], "digest string")
    assert [r["digest"] for r in fingerprint.collided(docs, digests, digest_of=weak).collect()] == ["0" * 31 + "2"]


# 5


def _dropped(texts, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(support.UPPER, support.LOWER))
    split = [(t or "").split("\n") for t in texts]
    count = Counter(k for lines in split for k in {key(line) for line in lines} if k)
    return [(len(lines), [line for line in lines if not key(line) or count[key(line)] < least]) for lines in split]


@pytest.mark.parametrize(("shard_keys", "groups"), [(1 << 16, 8), (1, 8), (2, 100)])
def test_line_dedup_equals_brute_force(spark, monkeypatch, shard_keys, groups):
    monkeypatch.setattr(linededup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(linededup, "GROUPS", groups)
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["Buy now", " buy NOW\t", f"own {i}", "", "rare", "ÄÖ", "äö"]) for _ in range(rng.randint(0, 9))) for i in range(60)] + ODD
    found = rows(linededup.dedup_lines(frame(spark, texts), 10))
    for i, (n, kept) in enumerate(_dropped(texts, 10)):
        assert (found[i]["n_lines"], found[i]["n_dropped"]) == (n, n - len(kept))
        assert found[i]["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_every_dropped_line_has_passed_a_filter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = linededup.line_counts(docs).cache()
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    lines = docs.select(F.col("doc_id").alias("id"), F.explode(split).alias("line"))
    of = support.mapped(lambda xs: [linededup.digest_of(x.encode()) for x in xs], pa.binary(), "binary")
    lines = lines.select("id", of("line").alias("key")).where("length(key) > 0").distinct().cache()
    for shards in (1, 5):
        filters, copies = linededup.build_filters(counts, 3, shards), linededup.spread(counts, 3, shards, 16)
        assert sum(r["copies"] for r in copies.collect()) > shards  # frequent lines are dealt out
        held = {bytes(r["keys"])[i : i + 16] for r in filters.collect() for i in range(0, len(r["keys"]), 16)}
        assert held == {bytes(r["key"]) for r in counts.where("n_docs >= 3").collect()}  # all frequent keys are in filters
        as_set = lambda exact: {(r["id"], bytes(r["key"])) for r in linededup.frequent_lines(lines, filters, copies, shards, exact).collect()}  # noqa: B023, E731
        passed, found = as_set(False), as_set(True)
        want = {(r["id"], bytes(r["key"])) for r in lines.collect() if bytes(r["key"]) in held}
        assert found == want and want <= passed and 0 < len(found) < lines.count()


def test_lines_after_a_deletion(spark):
    """Documents inserted and deleted again leave no trace in what is dropped."""
    texts = ["Shared\nown a", "shared \nown b", "Other\nown c", "other\nown d"]
    first, second = frame(spark, texts), frame(spark, ["SHARED\nx", "shared", "other"], [10, 11, 12])
    before = linededup.line_counts(first)
    both = linededup.inserted(before, second)
    kept = lambda counts: {i: r["kept"] for i, r in rows(linededup.dedup_lines(first, 3, counts=counts)).items()}
    assert kept(both) == {0: "own a", 1: "own b", 2: "own c", 3: "own d"}
    assert kept(linededup.deleted(both, second)) == kept(before) == dict(enumerate(texts))


def test_columns_with_dots(spark):
    docs = spark.createDataFrame([(i, "Same line\nand more words than five here " + "x " * i, "v", None) for i in range(12)], "doc_id long, text string, `a.b` string, `c``d` int")
    item = spark.createDataFrame([(1, "and more words than five here x x x x")], "item_id int, text string")
    for found in (linededup.drop_lines(docs, 10), minhash.drop_near_duplicates(docs), decontam.remove_documents(docs, item, 10)):
        assert found.columns == docs.columns and 0 < found.where("`a.b` = 'v'").count() <= 12


def test_empty_tables(spark):
    none, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    item = spark.createDataFrame([], "item_id int, text string")
    found = [
        pieces.encodings(none, "piece_bpe_32k.model", 4), bpe_count.token_counts(none, "byte_bpe_50k.json", 1024), fingerprint.fingerprint_pairs(none), linededup.dedup_lines(none, 10),
        decontam.contamination(none, item, 10), tokenfile.token_file(none, "word_bpe_49k.json", 2), linededup.drop_lines(none, 10), minhash.drop_near_duplicates(none), minhash.near_duplicates(none),
        decontam.remove_documents(none, item, 10), quality.quality(none, quality.train(none, labels)),
    ]
    assert all(df.collect() == [] for df in found)


def test_line_counts_are_reversible(spark):
    first, second = frame(spark, ["a\nb", "a", "c\na"]), frame(spark, ["a\nb", "d"])
    state = linededup.line_counts(first)
    both = linededup.inserted(state, second)
    as_set = lambda df: {(bytes(r["key"]), r["n_docs"]) for r in df.collect()}
    assert as_set(linededup.deleted(both, second)) == as_set(state)
    filters = linededup.build_filters(state, 2, 2)
    moved = linededup.refresh_filters(filters, state, both, 2, 2)
    frequent = {k for k, n in as_set(both) if n >= 2}
    keys = {bytes(r["keys"])[i : i + 16] for r in moved.collect() for i in range(0, len(r["keys"]), 16)}
    assert keys == frequent


def test_cuckoo_filter_inserts_and_deletes():
    rng = random.Random(4)
    digests = [rng.randbytes(16) for _ in range(3000)]
    made = linededup.CuckooFilter.of(digests)
    assert made.contains(digests).all()
    for d in digests[:1500]:
        assert made.delete(d)
    assert made.contains(digests[1500:]).all() and made.contains(digests[:1500]).mean() < 0.01


# 6


def test_kernel_equals_its_definition():
    def plain(a, b):
        from itertools import combinations

        def vector(w):
            s, out = toxicity.symbols(w), Counter()
            for p in combinations(range(len(s)), 3):
                out[tuple(s[i] for i in p)] += toxicity.DECAY ** (p[2] - p[0] + 1)
            return out

        x, y = vector(a), vector(b)
        dot = lambda u, v: sum(u[k] * v[k] for k in u)
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    words = ["idiot", "idi0t", "id.iot", "idxiot", "stupid", "banana", "aaaa"]
    got = toxicity.Kernel(["idiot", "stupid"]).full(words)
    for i, w in enumerate(words):
        for j, l in enumerate(["idiot", "stupid"]):
            want = plain(w, l)
            assert got[i, j] == pytest.approx(want if want >= toxicity.LEAST else 0, abs=1e-5)


def test_runs_are_also_seen_in_parts():
    assert toxicity.words_of("you,idiot/go") == ["you,idiot/go", "youidiotgo", "you", "idiot"]
    assert toxicity.words_of('"idiot"') == ["idiot"] and toxicity.words_of("--") == []


def test_toxicity_learns_and_takes_odd_texts(spark):
    rng = random.Random(6)
    plain = [f"calm{i} word" for i in range(40)]
    texts = [" ".join(rng.choices(plain, k=12)) + (" " + rng.choice(["grobnik", "vulshard", "muckwit"]) if i % 2 else "") for i in range(200)]
    docs = frame(spark, texts + ["you gr0bnik", "a gro-bnik here", *ODD])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    found = rows(toxicity.scores(docs, toxicity.train(docs, labels)))
    assert len(found) == len(texts) + 2 + len(ODD)
    assert all(found[i]["predicted"] == i % 2 for i in range(200)) and found[200]["predicted"] == found[201]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert toxicity.scores(docs, toxicity.train(docs, labels.where("false"))).count() == len(found)


# 7


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    items = [" ".join(rng.choices(words, k=k)) for k in (12, 10, 25, 3, 1)] + [None, "", "--", "only rare"]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(40)] + ["x " + items[2].upper() + " y", "a, " + items[0].replace(" ", "; ")] + ODD
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(support.UPPER, support.LOWER)))
    bench = spark.createDataFrame([(i, t, "z") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    for block in (64 << 20, 200):
        found = rows(decontam.contamination(frame(spark, texts), bench, 10, block_bytes=block))
        for d, text in enumerate(texts):
            w, hit, ids = find(text), set(), set()
            for i, item in enumerate(items):
                v = find(item)
                k = min(10, len(v))
                windows = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
                for j in range(len(w) - k + 1) if v else ():
                    if tuple(w[j : j + k]) in windows:
                        hit.update(range(j, j + k))
                        ids.add(str(i))
            sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
            assert [found[d][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")] == [len(w), len(hit), len(ids), sha, bool(hit)]
    left = rows(decontam.remove_documents(frame(spark, texts), bench, 10))
    assert {*left} == {d for d in range(len(texts)) if not found[d]["contaminated"]}
    spans = rows(decontam.remove_spans(frame(spark, ["one " + items[2] + " two"]), bench.where("item_id = 2"), 10))
    assert spans[0]["text"] == "one  two"


# 8


@pytest.mark.parametrize("law", shards.LAWS)
def test_shards(spark, law):
    texts = corpus(400) + ["hot"] * 300
    found = [r.asDict() for r in shards.shard(frame(spark, texts), 7, law, range_rows=100).collect()]
    assert len(found) == len(texts) and {r["doc_id"] for r in found} == {*range(len(texts))}
    by = {}
    for r in found:
        assert r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["size"] == len((texts[r["doc_id"]] or "").encode()) + 8
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in part) == [*range(len(part))] for part in by.values())
    if law == "rows":
        sizes = [len(by.get(s, [])) for s in range(7)]
        assert max(sizes) - min(sizes) <= 1
    else:
        sizes = [sum(r["size"] for r in by.get(s, [])) for s in range(7)]
        assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in found)


def test_shards_of_an_empty_table(spark):
    assert shards.shard(frame(spark, []), 5).count() == 0


# 9


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([5], np.uint32), rng.integers(0, 50_000, 10_001).astype(np.uint32), np.array([0, 2**32 - 1] * 50, np.uint32)):
        packed = tokenfile.pack(ids, 512)
        assert (tokenfile.unpack(packed) == ids).all()
        assert (tokenfile.unpack(packed, 100, 700) == ids[100:700]).all()


def test_token_file_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    texts = corpus()
    found = rows(tokenfile.token_file(frame(spark, texts), "word_bpe_49k.json", 2))
    start = 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert [found[i][c] for c in ("start", "n_tokens", "ids_crc32")] == [start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())]
        start += len(ids)


# 10


def test_quality_learns_ordered_grades(spark):
    rng = random.Random(9)
    grade = [i % 3 for i in range(240)]
    texts = [" ".join(rng.choices(["good", "plain", "clear"] if g == 2 else ["fine", "plain"] if g == 1 else ["JUNK!!!", "$$$", "plain"], k=30)) for g in grade]
    docs = frame(spark, texts + ODD)
    ratings = spark.createDataFrame([(i, g) for i, g in enumerate(grade)], "doc_id long, quality int")
    model = quality.train(docs, ratings)
    assert (np.diff(model.thresholds) > 0).all()
    found = rows(quality.quality(docs, model))
    assert all(round(found[i]["expected_grade"]) == g for i, g in enumerate(grade))
    p = model.probabilities(np.array([-1.0, 0.0, 2.0]))
    assert p.sum(axis=1) == pytest.approx([1, 1, 1])
    kept = rows(quality.select(docs, model))
    assert {*kept} == {i for i, r in found.items() if r["selected"]}
    assert quality.quality(docs, quality.train(docs, ratings.where("false"))).count() == len(found)


# Rows without ids, repeated rows


def test_null_ids_and_repeats(spark):
    docs = frame(spark, ["a b c d", None, "a b c d", "a b c d"], [None, None, 7, 7])
    bench = spark.createDataFrame([(1, "none here")], "item_id long, text string")
    labels = spark.createDataFrame([(7, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for found in (
        simhash.near_duplicates(docs),
        pieces.encodings(docs, "piece_bpe_32k.model"),
        bpe_count.token_counts(docs, "byte_bpe_50k.json"),
        fingerprint.fingerprint_pairs(docs),
        linededup.dedup_lines(docs),
        toxicity.scores(docs, toxicity.train(docs, labels)),
        decontam.contamination(docs, bench),
        shards.shard(docs, 3),
        tokenfile.token_file(docs, "word_bpe_49k.json", 2),
        quality.quality(docs, quality.train(docs, labels)),
    ):
        assert Counter(r["doc_id"] for r in found.collect()) == {None: 2, 7: 2}


def test_labels_and_bounds_are_documented_parameters(spark):
    docs = frame(spark, ["t"] * 50)
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, "toxic", sample=5).select(F.countDistinct("__id")).first()[0] == 5
