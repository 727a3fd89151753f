"""From raw documents to token ids, stage by stage.

``STAGES`` lists the stages in order; each takes what its predecessor left, and all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import byte_bpe, exact_dedup, mixing, quality, simhash


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    return quality.keep_good(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without exact copies; of each text the document with the largest id stays."""
    return exact_dedup.keep_one(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without near copies (five-word shingles 0.8 similar); of each group the document
    with the smallest id stays."""
    return simhash.keep_one(docs)


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: documents left out, taken once or repeated."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids`` of every document of the mix."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.PATTERN, offsets=False)


STAGES = [
    ("quality rules", good_documents),
    ("exact dedup", distinct_texts),
    ("simhash near-dedup", distinct_contents),
    ("mixing sources", weighted_mix),
    ("byte-level BPE", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reduce(lambda kept, stage: stage[1](spark, kept, sf_dir), STAGES, docs)
