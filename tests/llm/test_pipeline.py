"""The pipeline's stages, each against its operator or brute force on its own input."""

import random
from collections import Counter

import corpus_pipeline as pipeline
from test_minhash import smallest


def test_stages_keep_the_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns, n = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    last = pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == n and last.where("not round_trip").count() == 0
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in pipeline.run(spark, sf).collect()} == {r["doc_id"] for r in docs.collect()}


def test_names_of_stages():
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "sentencepiece encoding"]


ODD = [None, "", " ", "\n\n", "x" * 100_000, "a b c " * 20_000]


def _odd_docs(spark):
    """Odd texts, repeated texts, lines of 10 documents, and a benchmark item's words; one column's name clashes."""
    rng = random.Random(7)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(200)], k=40)) + "\nShared line \n" + f"own {k}" for k in range(12)]
    texts += [*ODD, *ODD, texts[3], "Before " + BENCHMARK.upper() + " after", BENCHMARK[: BENCHMARK.rindex(" ")]]
    return spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, component_id long")


BENCHMARK = "one two three four five six seven eight nine ten"


def _found(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_brute_force_on_odd_texts(spark, tmp_path):
    spark.createDataFrame([("q", BENCHMARK), ("none", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = _odd_docs(spark)
    before = _found(docs)

    def key(line):
        return line.strip(" \t\n\v\f\r").lower()

    seen = Counter(k for t in before.values() for k in {key(x) for x in (t or "").split("\n")} if k)
    lines = _found(pipeline.line_dedup(spark, docs, ""))
    assert lines.keys() == before.keys() and seen["shared line"] >= 10
    for i, t in before.items():
        assert (lines[i] or "") == "\n".join(x for x in (t or "").split("\n") if seen[key(x)] < 10)
    near = _found(pipeline.near_dedup(spark, docs, ""))
    first = smallest([before[i] for i in sorted(before)])
    assert near == {i: t for i, t in before.items() if first[i] == i}
    clean = _found(pipeline.decontamination(spark, docs, str(tmp_path)))
    assert clean == {i: t for i, t in before.items() if BENCHMARK not in (t or "").lower()}
    last = pipeline.encoding(spark, docs, "").collect()
    assert {r["doc_id"] for r in last} == before.keys() and all(r["round_trip"] for r in last if before[r["doc_id"]])
