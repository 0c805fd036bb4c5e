"""The pipeline's encoding gives all that op2 does: the N best segmentations of every text, not the best alone."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from barloom.llm import pieces
from barloom.llm.support import file_bytes

TEXTS = [None, "", " ", "a", "\n\n", "x" * 3_000, "Some words, and some more of them; words again.", "naïve 漢字 \u0000 end", "a b c " * 500]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_the_n_best_of_every_text_as_op2_has_them(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    docs = given.unionByName(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")).cache()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {r["doc_id"]: r for r in pieces.encodings(docs, pipeline.PIECES, 4).collect()}
    rows = pipeline.encoding(spark, docs, "")
    found = {r["doc_id"]: r for r in rows.withColumn("ways", pieces.ways(F.col("ids"), F.col("score"), F.col("others"))).collect()}
    assert found.keys() == want.keys() == texts.keys()
    model = pieces.PieceModel(file_bytes(pipeline.PIECES))
    for i, r in found.items():
        ways = [(w["score"], w["ids"]) for w in r["ways"]]
        assert ways[0] == (r["score"], r["ids"])
        assert [s for s, _ in ways] == want[i]["nbest_scores"] == sorted((s for s, _ in ways), reverse=True), i
        assert [_crc(ids) for _, ids in ways] == want[i]["nbest_crc32"] and len({tuple(ids) for _, ids in ways}) == len(ways)
        assert all(model.decode(np.array(ids, "<u4").tobytes()) == texts[i] for _, ids in ways)
        assert r["n_pieces"] == len(r["ids"]) and len(ways) == 4 or not texts[i].strip() or len(texts[i]) < 2


@pytest.mark.parametrize(("best", "other"), [([], []), ([1], [2, 3]), ([1, 2, 3], [1, 3]), ([1, 1], [1]), ([1], [1, 1, 1]), ([1, 2, 1, 2], [1, 2]), ([5, 6, 7, 8, 9], [5, 1, 7, 2, 2, 9]), ([1, 2], [])])
def test_a_change_gives_the_other_back(best, other):
    start, dropped, ids = pieces.change(np.array(best, np.int32), np.array(other, np.int32))
    assert [*best[:start], *ids.tolist(), *best[start + dropped :]] == other and dropped >= 0
