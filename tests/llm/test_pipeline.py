"""The pipeline's stages against what the operators say of each stage's input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from conftest import SMALL
from pyspark.sql import functions as F

from scanloom.llm import decontaminate, mixing, quality, simhash
from scanloom.llm.common import table, written


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), f"test-{name}")
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:-1])
    start, good, distinct, clean, mix, tokens = seen

    weights = quality.fit_quality(start, table(spark, SMALL, "labels"))
    kept = {r.doc_id for r in quality.score_quality(start, weights).collect() if r.predicted}
    assert {r.doc_id for r in good.collect()} == kept
    assert {r.doc_id for r in distinct.collect()} == {r.component_id for r in simhash.near_duplicates(good).collect()}
    bad = {r.doc_id for r in decontaminate.contamination(distinct, table(spark, SMALL, "benchmark")).collect() if r.contaminated}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in distinct.collect()} - bad
    taken = {r.doc_id: r.taken for r in mixing.mixed(clean).collect() if r.taken}
    given = {r.doc_id: r.n for r in mix.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert taken == given
    assert Counter(r.doc_id for r in tokens.collect()) == Counter(r.doc_id for r in mix.collect())


def test_run_is_repeatable(spark):
    columns = ("doc_id", "start", "n_tokens", "ids_crc32")
    first, second = (Counter(tuple(r[c] for c in columns) for r in corpus_pipeline.run(spark, SMALL).collect()) for _ in range(2))
    assert first == second and sum(first.values())
