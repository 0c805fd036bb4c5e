"""The corpus pipeline: five stages, each on all that its predecessor kept.

A quality classifier lets documents go that it rejects, frequent lines are dropped from texts, one document of each group
of near-duplicates stays, documents with benchmark passages go, and the rest is encoded into pieces, with the N best segmentations of each.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontam, linededup, minhash, pieces, quality
from barloom.llm.support import shared_folder, table

PIECES = "piece_bpe_32k.model"
#: Segmentations of a text, as many as op2 gives.
N_BEST = 4


#: Rows of a batch between Spark and Python workers. Texts are long: the default of 10,000 of them takes some 100 MB of buffers
#: on either side of every task.
BATCH = 1_000


def lean(stage):
    """`stage`, whose batches have BATCH rows."""

    @functools.wraps(stage)
    def run_lean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return run_lean


@lean
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of grade 1 or more is at least a half."""
    return quality.select(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@lean
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that 10 documents or more have; n_chars follows the text."""
    found = linededup.drop_lines(docs, 10)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


@lean
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word shingles, a Jaccard likeness of 0.8.

    SimHash fingerprints at most 2 bits apart are compared first; MinHash bands find alike texts that are further apart.
    """
    return minhash.drop_near_duplicates(docs)


@lean
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of 10 words of a benchmark item occurs."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"), 10)


@lean
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the best segmentation, their number and score, whether they decode to the text, and the others of
    the N_BEST best segmentations (fewer if there are fewer) as changes of the best one; `pieces.ways` has all of them whole."""
    found = docs.select("doc_id", pieces.best(docs, PIECES, N_BEST).alias("x"))
    return found.select("doc_id", "x.ids", F.size("x.ids").cast("long").alias("n_pieces"), "x.score", "x.round_trip", "x.others")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("sentencepiece encoding", encoding),
]
#: The classifier, the hashes and the lattice have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's result is written as Parquet to the cluster's shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
