"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; ``run`` writes each result to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scanloom.llm import decontaminate, mixing, quality, simhash, tokenfile
from scanloom.llm.common import shared_path, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.good_documents(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of near-duplicates."""
    return simhash.deduplicated(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: documents as often as they are taken."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written to binary files, and what reading them gives per document."""
    path = shared_path(spark, "pipeline-tokens")
    tokenfile.write_tokens(docs, tokenfile.Vocabulary(public_tokenizers.path("word_bpe_49k.json")), path)
    return tokenfile.read_tokens(spark, path, docs.schema["doc_id"].dataType.simpleString())


STAGES = [("quality", good), ("near-duplicates", distinct), ("decontamination", uncontaminated), ("mixing", mix), ("tokens", tokens)]

#: SQL expresses neither the classifier nor the tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
