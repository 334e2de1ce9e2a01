"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from scanloom.llm import decontaminate, hostrules, htmltext, licenses, mixing, oracles, pii, quality, simhash, tokencount, tokenfile
from scanloom.llm.common import shared_path, table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents; a document stands at source/lang/doc_id."""
    return licenses.license_scan(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labels that are not held out."""
    documents = table(spark, sf_dir, "documents")
    weights = quality.fit_quality(documents, table(spark, sf_dir, "labels"))
    return quality.score_quality(documents, weights)


def op3_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate sets of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token ids of all documents to files and read them back."""
    path = shared_path(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), tokenfile.Vocabulary(public_tokenizers.path("word_bpe_49k.json")), path)
    return tokenfile.read_tokens(spark, path)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op7_hostrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures and verdicts of all documents; the source is the host."""
    return hostrules.host_verdicts(table(spark, sf_dir, "documents"))


def op8_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and the terms that reveal it."""
    out = pii.personal_data(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_quality": op2_quality,
    "op3_tokencount": op3_tokencount,
    "op4_simhash": op4_simhash,
    "op5_tokenfile": op5_tokenfile,
    "op6_decontaminate": op6_decontaminate,
    "op7_hostrules": op7_hostrules,
    "op8_htmltext": op8_htmltext,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = dict(oracles.ORACLES)
