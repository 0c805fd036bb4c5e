"""Quality rules: measures against brute force, exact binomial sums, and what certificates promise."""

import random
import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from barloom.llm import riskrules

SCHEMA = "doc_id long, text string, lang string, n int, stratum string, good boolean, w string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0, "s", True, "w") for i, t, lang in rows], SCHEMA)


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(at)
    hit = {p for i, w in enumerate(at) if seen[w] > 1 for p in range(i, i + 8)}
    n, again = len(words), len(hit)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), again, n < 20 or 100 * again > 30 * n


def odd_texts():
    rng = random.Random(1)
    eight = " ".join("abcdefgh")
    texts = [None, "", " \t\n\x0b\f\r ", "a", eight, eight + " " + eight, eight + " x " + eight, "a " * 7, "a " * 8, "a " * 9, "a " * 5000, "\n\n\n", "x\nx\n x\nx", "é ü ß 日本語 z " * 30, "#*$%&|<> " * 25, "word\u0000 with\u0085signs " * 9]
    words = [f"w{i}" for i in range(12)]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(40)]
    texts += ["\n".join(rng.choices(["one two three", "four five", " four five", "", "six"], k=30)) for _ in range(10)]
    texts += [" ".join(f"u{i}" for i in range(100_000)), "y" * 200_000]
    return texts


def test_measures_equal_brute_force(spark):
    texts = odd_texts()
    found = riskrules.measured(frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()
    want = {i: measures(t) for i, t in enumerate(texts)}
    for r in found:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want[r["doc_id"]], texts[r["doc_id"]][:80]
    assert len(found) == len(texts)


def test_binomial_sums_are_exact(spark):
    cases = [(k, n, rate) for n in (0, 1, 5, 60, 700) for k in (0, 1, 2, n // 20, n // 2, n) if k <= n for rate in (0.01, 0.05, 0.3)]
    for rate in (0.01, 0.05, 0.3):
        mine = [(k, n) for k, n, r in cases if r == rate]
        rows = spark.createDataFrame(mine, "k long, n long").select("k", "n", riskrules.binomial_tail(F.col("k"), F.col("n"), rate).alias("p")).collect()
        for r in rows:
            want = sum(comb(r["n"], i) * rate**i * (1 - rate) ** (r["n"] - i) for i in range(r["k"] + 1))
            assert r["p"] == (1.0 if r["k"] > r["n"] * rate else pytest.approx(want, rel=1e-9))
    large = spark.createDataFrame([(0, 20_000), (900, 20_000)], "k long, n long").select(riskrules.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect()
    assert large[0]["p"] == 0.0 and 1e-4 < large[1]["p"] < 1e-2  # 0.95 ** 20000 is below the smallest double


def sample(rng, n, lang, symbols_in_good, start):
    """(documents, labels): good texts of plain words, of which a part has symbols, and bad ones full of symbols."""
    docs, labels = [], []
    for i in range(start, start + n):
        good = rng.random() < 0.8
        marked = not good or rng.random() < symbols_in_good
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6):06d}" + ("##$$" if marked else "") for _ in range(25)]
        docs.append((i, " ".join(words), lang))
        labels.append((i, int(good)))
    return docs, labels


def test_certified_cutoffs_hold_what_they_promise(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for k, (n, lang, part) in enumerate([(700, "clean", 0.0), (700, "mixed", 0.2), (30, "few", 0.0), (700, None, 0.01)]):
        d, y = sample(rng, n, lang, part, 1000 * k)
        docs, labels = docs + d, labels + y
    labels += [(0, None), (None, 1), (999_999, 1), labels[5], labels[5]]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    found = riskrules.cutoffs(riskrules.measured(frame(spark, docs)), table)
    limits = {r["stratum"]: r for r in found.collect()}
    assert limits.keys() == {"=clean", ""}  # symbols tell nothing of `mixed`, and `few` has too few labels
    for r in limits.values():
        assert r["rejected_bad"] == r["bad"] > 0 and r["p_value"] <= riskrules.DOUBT / 4
    kept = {r["doc_id"]: r["kept"] for r in riskrules.verdicts(frame(spark, docs), table).collect()}
    good = dict(y for y in labels if y[1] is not None)
    by = Counter((lang, good[i], kept[i]) for i, _, lang in docs)
    assert by["clean", 1, False] == 0 and by["clean", 0, True] == 0 and by[None, 0, True] == 0
    assert 0 < by[None, 1, False] <= riskrules.RISK * (by[None, 1, True] + by[None, 1, False])
    assert all(kept[i] for i, _, lang in docs if lang in ("mixed", "few"))


def test_more_than_the_risk_is_seldom_certified(spark):
    """Strata whose rule rejects a larger part of the good texts than allowed: almost none may be certified."""
    rng = random.Random(9)
    docs, labels = [], []
    for k in range(20):
        d, y = sample(rng, 160, f"s{k}", 0.08, 1000 * k)
        docs, labels = docs + d, labels + y
    found = riskrules.cutoffs(riskrules.measured(frame(spark, docs)), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert found.count() <= 1


def test_empty_tables_and_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert riskrules.verdicts(frame(spark, []), none).collect() == []
    rows = [(i % 50, t, None) for i, t in enumerate(odd_texts())] + [(None, "a b", "en"), (None, " ".join(map(str, range(40))), "en")]
    found = riskrules.verdicts(frame(spark, rows), none).collect()
    assert len(found) == len(rows) and all(r["kept"] != r["base_failed"] and r["tolerance"] is None for r in found)
    assert riskrules.verdicts(frame(spark, rows), spark.createDataFrame([(0, 1), (0, 0)], "doc_id long, quality int"), stratum_col=None).count() == len(rows)
