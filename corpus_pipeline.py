"""The corpus pipeline: documents through five stages, each a Parquet table that the next one reads.

quality rules -> language identification -> SimHash near-duplicates -> benchmark decontamination -> SentencePiece ids.
All but the last return the columns of documents. Rejected documents go; of each group of near-duplicates the smallest
doc_id stays; benchmark passages are cut out of texts, and a text with nothing left goes.

Null and empty texts, and those without a letter, go in the first two stages. Very long texts are read whole. Repeated rows of
one doc_id are judged each until the third stage, which keeps one of them; rows of one doc_id with unlike texts stay, and
so do rows without a doc_id. Columns of other names pass through all stages but the last. An empty table gives no row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plantmill.llm import decontaminate, language, lattice, quality, simhash
from plantmill.llm.common import new_folder, table

SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, SHINGLE)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lattice.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("sentencepiece_ids", sentencepiece_ids),
]

# The stages after the first rest on trained machines and hashes that SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids array<int>: what all stages keep of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
