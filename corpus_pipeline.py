"""A corpus pipeline of five stages; part of the corpus operators (tidewright.llm).

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, exact_dedup, jaccard_join, pieces, toxicity
from tidewright.llm.common import release, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon, learned from the labels' training rows, doesn't reject."""
    lexicon = toxicity.learn(docs, toxicity.train_rows(table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, lexicon)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest identifier."""
    release(spark)  # the shuffle files of the stage before
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (shingles of five words, similarity of 0.8 or more)."""
    release(spark)  # the shuffle files of the stage before
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    release(spark)  # the shuffle files of the stage before
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers and token ids of what is left."""
    release(spark)  # the shuffle files of the stage before
    return pieces.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("sentencepiece", encode),
]

#: SQL can't express the learned lexicon, SimHash windows and the piece search; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage_of) in enumerate(STAGES):
        docs = stage_of(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
