"""A training-corpus pipeline over the documents table; part of the ``llm`` subpackage.

Stages: toxic documents go; exact copies go (the longest original stays); of each group of
near duplicates one stays; sources are interleaved to their target weights; texts are
encoded into sampled pieces. Every stage works on all rows its predecessor kept.

Null columns pass through every stage; a null text counts as empty: it is not toxic, all
null and blank texts are exact copies of one another, and it has one segmentation without pieces. Rows repeated in identifier and
text are reduced to one by the second stage. Columns of ``documents`` may have any name that does not begin with two
underscores. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact, minhash, mixing, pieces, toxic
from tidemark.runtime import checkpoint_dir, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    return toxic.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the one with the most characters."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest identifier."""
    return minhash.near_dedup(docs)


def interleave(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: the order of the written parts and of the rows in them."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, with piece ids that decode to its text and its place in the mix."""
    return pieces.sample_segmentations(mixing.written_order(docs), keep=["doc_id", "lang", "source", "mix_file", "mix_row"])


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", interleave),
    ("sentencepiece", encode),
]

#: Learned scores, signatures and sampled pieces can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents table; stages are written to the shared folder and read again.

    A stage's files go when the next one is written; those that the result reads stay.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
