"""Quality classifier: hashed word n-grams, follow-the-regularised-leader logistic regression.

A text becomes tokens (lower-cased runs of word characters, or single other
marks), and these become hashed features: every token, every pair of
neighbouring tokens, and one feature each for a token that repeats the one
before it and for the text's length class. A feature's value is its share of
the text's tokens times ``SCALE`` (the length class counts 1). The score is the
logistic function of the sparse dot product of features and weights.

Training reads at most ``max_train`` labelled rows (those of the smallest
seeded hash of ``doc_id``, so a bounded, repeatable sample over all of them);
scoring reads every text in whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import worker_cache

TOKEN = re.compile(r"\w+|[^\w\s]")
SCALE = 24.0
BITS = 18
#: Words of a text that are turned to features at a time; bounds memory, not the text.
CHUNK = 1 << 20
#: Distinct tokens whose hashes a worker remembers.
REMEMBERED = 200_000


@dataclass(frozen=True)
class QualityParams:
    """``max_train`` bounds the labelled rows that training reads."""

    bits: int = BITS
    max_train: int = 8_000
    epochs: int = 3
    alpha: float = 0.6
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.0005
    seed: int = 17
    threshold: float = 0.3


class _Hashes(dict):
    """Token to 32-bit hash, computed on first use."""

    def __missing__(self, token: str) -> int:
        value = crc32(token.encode("utf-8", "surrogatepass"))
        if len(self) < REMEMBERED:
            self[token] = value
        return value


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    """The upper ``bits`` bits of a multiplicative hash."""
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def token_slots(text: str, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slots of single tokens, of pairs, of repeats), a chunk of the text at a time."""
    last: np.ndarray | None = None
    tokens: list[str] = TOKEN.findall(text.lower())
    hashes = worker_cache("quality", _Hashes)
    repeat = int(_mixed(np.array([1], np.uint64), bits)[0])
    for at in range(0, len(tokens), CHUNK):
        part = tokens[at : at + CHUNK]
        h = np.fromiter(map(hashes.__getitem__, part), np.uint64, len(part))
        before = np.concatenate([last, h[:-1]]) if last is not None else h[:-1]
        here = h if last is not None else h[1:]
        pairs = _mixed(before * np.uint64(0xC2B2AE3D27D4EB4F) + here + np.uint64(7), bits)
        yield _mixed(h + np.uint64(3), bits), pairs, np.full(int((before == here).sum()), repeat)
        last = h[-1:]


def length_slot(n: int, bits: int = BITS) -> int:
    """The slot of the length class: the binary logarithm of the number of tokens."""
    return int(_mixed(np.array([100 + int(n).bit_length()], np.uint64), bits)[0])


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and their values. A null text counts as empty."""
    n, slots = 0, []
    for single, pairs, repeats in token_slots(text or "", bits):
        n += len(single)
        slots += [single, pairs, repeats]
    where, counts = np.unique(np.concatenate(slots), return_counts=True) if slots else (np.empty(0, np.int64), np.empty(0))
    return np.append(where, length_slot(n, bits)), np.append(counts * (SCALE / max(n, 1)), 1.0)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], params: QualityParams) -> np.ndarray:
    """Weights by FTRL-Proximal with per-slot rates; the last weight is the bias."""
    size = (1 << params.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(params.seed)

    def leader(at: np.ndarray) -> np.ndarray:
        held = z[at]
        return np.where(np.abs(held) <= params.l1, 0.0, (np.sign(held) * params.l1 - held) / ((params.beta + np.sqrt(n[at])) / params.alpha + params.l2))

    for _ in range(params.epochs):
        for k in order.permutation(len(rows)):
            slots, values, label = rows[k]
            at, x = np.append(slots, size - 1), np.append(values, 1.0)
            w = leader(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / params.alpha
            np.add.at(z, at, g - step * w)
            np.add.at(n, at, g * g)
    return leader(np.arange(size))


def score_text(text: str | None, weights: np.ndarray, bits: int = BITS) -> float:
    """The probability of label 1, from 0 to 1."""
    n, total = 0, 0.0
    for single, pairs, repeats in token_slots(text or "", bits):
        n += len(single)
        total += weights[single].sum() + weights[pairs].sum() + weights[repeats].sum()
    z = weights[-1] + weights[length_slot(n, bits)] + total * (SCALE / max(n, 1))
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit_quality(documents: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> np.ndarray:
    """Train on labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    Rows with a null ``doc_id`` or ``quality`` are no examples. A doc_id that is
    labelled repeatedly counts once, with the larger label, and one that several
    documents bear counts once, with the text that sorts first. With no example at
    all every weight is 0 and every score is 0.5.
    """
    bits = params.bits
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy("doc_id")
        .agg(F.max(F.col("quality").cast("int")).alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit(params.seed)), "doc_id")
        .limit(params.max_train)
    )
    # max_train rows of two numbers: bounded, so it may be broadcast
    examples = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py(), bits) for t in batch["text"]]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch["doc_id"], "label": batch["label"], "slots": pa.array([s.astype(np.int32).tobytes() for s, _ in made], pa.binary()), "vals": pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())}
            )

    id_type = documents.schema["doc_id"].dataType.simpleString()
    got = examples.select("doc_id", "text", "label").mapInArrow(featured, f"doc_id {id_type}, label int, slots binary, vals binary").toLocalIterator()
    rows = sorted(((r.doc_id, r.label, r.slots, r.vals) for r in got), key=lambda r: r[0])
    return train([(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32), y) for _, y, s, v in rows], params)


def score_quality(documents: DataFrame, weights: np.ndarray, params: QualityParams = QualityParams()) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted.

    A null or empty text has the score of no tokens; a null doc_id is kept and
    is not held out; repeated rows each give a row; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**bits floats
    bits, threshold = params.bits, params.threshold

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            s = np.array([score_text(t.as_py(), w, bits) for t in batch["text"]], dtype=float)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32), pa.int32())})

    id_type = documents.schema["doc_id"].dataType.simpleString()
    out = documents.select("doc_id", "text").mapInArrow(scored, f"doc_id {id_type}, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def good_documents(documents: DataFrame, weights: np.ndarray, params: QualityParams = QualityParams()) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    bits, threshold = params.bits, params.threshold

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            yield batch.filter(pa.array([score_text(t.as_py(), w, bits) >= threshold for t in batch["text"]], pa.bool_()))

    return documents.mapInArrow(kept, documents.schema)
