"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next.

A stage works on every row that its predecessor kept. All but the last return the columns of
documents, whatever they are; the last returns what the encoder reports of each document that is left.

A null text is an empty one to every stage: the classifier scores it, equal ones are copies of each other, it has
no shingles, no benchmark window and no tokens. Rows of a null doc_id go through all stages; of several rows of one doc_id
each is judged by its own text, but near-duplicates link them. Empty documents give an empty result; without labels of both
classes every score is 0.5 and no document passes; an empty benchmark contaminates nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import bpe_tree, decontam, exact_dedup, near_dedup, quality
from veilframe.llm.common import fresh_folder, remove, table
from veilframe.llm.queries import vocabulary
from veilframe.session import ship


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of any benchmark window."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    # the executors hold what the stages before have left in memory: half the table of op5
    return bpe_tree.round_trip(docs, vocabulary("word_bpe_49k.json"), words=100_000)


STAGES = [
    ("quality_classifier", good),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("bpe_tree", encoded),
]

#: A learned classifier, ProbMinHash candidates and BPE can't be said in SQL; tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table is removed when the next one's is written."""
    ship(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = fresh_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
