"""The corpus pipeline: quality rules, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents, and further ones of any name as they are. An empty
table gives no rows at any stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecloom.llm.bpe import round_trip
from vecloom.llm.jaccard import keep_one
from vecloom.llm.mixing import mix_rows
from vecloom.llm.quality import keep_quality
from vecloom.llm.storage import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept. Null, empty and short texts go; a null id is no matter; repeated rows stay or go
    together."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, null ids last; of rows alike in every column one. Texts
    without words link with nothing and stay."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once, or up to three times. Null sources are one
    source; a null or empty text has size 0."""
    return mix_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document (and copy): the number of its token ids, and digests of ids and of the decoded bytes. A null text has no
    ids."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mixing), ("byte-level BPE", encoding)]

# SQL expresses neither the coverage rules, nor components of links, nor BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/vecloom-stage-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
