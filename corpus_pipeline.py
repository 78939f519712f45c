"""The corpus pipeline: five stages over documents, each one's rows written and read again for the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it left; all but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from firnline.llm import bpe_codec, line_dedup, minhash, mixing, quality_gam
from firnline.llm.common import discard, documents, settled


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_gam.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly, go; documents stay, if with less text."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays."""
    return minhash.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them; those that it does not take go."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix."""
    return bpe_codec.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: The classifier's and the codec's results can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of what is written on the way, only the last stage's input stays, and what that stage writes."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(spark, f"pipeline-{k}", lambda stage=stage, rows=docs: stage(spark, rows, sf_dir))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
