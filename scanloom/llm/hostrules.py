"""Quality rules with verdicts on hosts.

Every whole text is measured once. Rule failures are summed by host; each
host's failure rates are shrunk towards the corpus by a beta prior whose
strength is estimated from the spread of the hosts' own rates (method of
moments for the beta-binomial), so a host of few documents is not judged by
them alone. A host is rejected where a shrunk rate exceeds that rule's bound;
the verdict is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import written

WINDOW = 5
#: Tasks that the documents of one host are dealt to where verdicts join them.
SALTS = 16
SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: What a rule's failure is called, in the order of the host's rates.
RULES = ("base_failed", "symbols_failed", "lines_failed")


@dataclass(frozen=True)
class HostRuleParams:
    """Bounds of the document rules, and of each rule's shrunk rate for a host."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbols_per_word: float = 0.5
    max_dup_line_share: float = 0.5
    max_rates: tuple[float, float, float] = (0.6, 0.7, 0.7)
    default_strength: float = 10.0


def repeated_words(words: list[bytes]) -> int:
    """Words in 5-word windows that occur twice or more, first occurrences included."""
    m = len(words)
    if m <= WINDOW:
        return 0
    ids = dict(zip(words, range(m)))
    a = np.fromiter(map(ids.__getitem__, words), np.int64, m)
    with np.errstate(over="ignore"):
        h = np.zeros(m - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + a[k : m - WINDOW + 1 + k].view(np.uint64) + np.uint64(1)
    h.sort()
    if not (h[1:] == h[:-1]).any():  # no two hashes are equal, so no two windows are
        return 0
    code = a
    for k in range(1, WINDOW):  # exact: numbers of distinct prefixes, one word longer each time
        code = np.unique(code[: m - k] * m + a[k:], return_inverse=True)[1]
    twice = np.bincount(code)[code] > 1
    hit = np.zeros(m, bool)
    for k in range(WINDOW):
        hit[k : m - WINDOW + 1 + k] |= twice
    return int(hit.sum())


def measured(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(raw.count(s) for s in SYMBOLS)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measures(documents: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the measures of every whole text; a null text counts as empty."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([measured(t.as_py()) for t in batch["text"]], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "host": batch["host"]} | {k: pa.array(made[:, i]) for i, k in enumerate(names)})

    types = dict(documents.select("doc_id", F.col(host).alias("host")).dtypes)
    return documents.select("doc_id", F.col(host).alias("host"), "text").mapInArrow(rows, f"doc_id {types['doc_id']}, host {types['host']}, " + ", ".join(f"{n} long" for n in names))


def host_rates(failures: DataFrame, params: HostRuleParams = HostRuleParams()) -> DataFrame:
    """host (null for documents without one), n, each rule's shrunk rate, and host_ok."""
    hosts = failures.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in RULES))
    moments = [F.sum("n").alias("docs"), F.count("*").alias("hosts"), *(F.sum(r).alias(f"f_{r}") for r in RULES), *(F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"q_{r}") for r in RULES)]
    corpus = hosts.agg(*moments)
    out = hosts.crossJoin(F.broadcast(corpus))  # one row
    ok = F.lit(True)
    for rule, bound in zip(RULES, params.max_rates):
        mean = F.col(f"f_{rule}") / F.col("docs")
        even = mean * (1 - mean)
        spread = F.col(f"q_{rule}") / F.col("docs") - mean * mean  # of the hosts' rates, weighted by documents
        chance = F.col("hosts") / F.col("docs")  # the part of it that sampling alone gives
        between = F.when((even > 0) & (chance < 1), (spread - even * chance) / F.when((even > 0) & (chance < 1), even * (1 - chance)))
        strength = F.coalesce(1 / F.greatest(F.lit(1e-4), F.least(F.lit(0.999), between)) - 1, F.lit(params.default_strength))
        out = out.withColumn(f"{rule}_rate", (F.col(rule) + mean * strength) / (F.col("n") + strength))
        ok = ok & (F.col(f"{rule}_rate") <= bound)
    return out.select("host", "n", *(f"{r}_rate" for r in RULES), ok.alias("host_ok"))


def host_verdicts(documents: DataFrame, host: str = "source", params: HostRuleParams = HostRuleParams()) -> DataFrame:
    """Per document: its measures, base_failed, kept, and the other rules' failures.

    A null or empty text has no words and fails the base rule. Documents
    without a host form a host of their own. Repeated rows and repeated or null
    ids each give a row and each count for the host. Other columns are not read.
    """
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    failures = measures(documents, host).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") > params.max_symbols_per_word * per_word).alias("symbols_failed"),
        (F.col("n_dup_lines") > params.max_dup_line_share * F.greatest(F.col("n_lines"), F.lit(1))).alias("lines_failed"),
    )
    failures = written(failures, "hostrules-measures")
    rates = written(host_rates(failures, params), "hostrules-rates").select(F.col("host").alias("of_host"), "host_ok")
    # Hosts are few beside documents: each stands under every salt, so a host of a third of all rows meets its verdict in many tasks.
    rates = rates.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = failures.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    joined = salted.join(rates, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("salt") == F.col("of_salt")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"), "symbols_failed", "lines_failed")
