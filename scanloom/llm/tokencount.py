"""Token counts by a unigram model, its dynamic programme shared along a trie.

A pre-token is a run of anything but ASCII white space, with a word mark before
it. Its tokens are the pieces of the best-scoring segmentation (of equal ones,
that of fewest pieces). The best score of a prefix depends on the prefix alone,
so the distinct pre-tokens are inserted in a trie, which a worker keeps from
batch to batch: a prefix that pre-tokens share is computed once, and each
terminal's count is stored and looked up for every mention.

Pieces come from a public sentencepiece vocabulary, which gives their ranks; a
piece's score is that of Zipf's law, -log(rank + 2). A character that no piece
holds counts one token per byte, each at the score of the last rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scanloom.llm.common import worker_cache

MARK = "▁"
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBERED = 1_500_000
#: Nodes of a worker's trie, beyond which it starts anew.
NODES = 1_000_000


@dataclass(frozen=True)
class UnigramModel:
    """``scores``: by piece. ``ends``: every end of a piece, so that a walk back from a place knows when to stop."""

    scores: dict[str, float]
    ends: frozenset[str]
    unknown: float

    @staticmethod
    def of(pieces: list[str]) -> UnigramModel:
        """The model of pieces in order of rank."""
        scores: dict[str, float] = {}
        for rank, piece in enumerate(pieces):
            scores.setdefault(piece, -log(rank + 2))
        return UnigramModel(scores, frozenset(p[k:] for p in scores for k in range(len(p))), -log(len(pieces) + 2))


@lru_cache(maxsize=2)
def load_model(path: str) -> UnigramModel:
    """The model of a sentencepiece file: its pieces but for control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return UnigramModel.of([p.id_to_piece(k) for k in range(p.get_piece_size()) if not (p.is_control(k) or p.is_unknown(k) or p.is_byte(k))])


class Trie:
    """Pre-tokens by their characters: each node holds the best score of its prefix and that segmentation's number of tokens.

    A prefix is computed when its node is made and never again, until the trie
    starts anew at ``NODES``; a terminal's number is the count of its pre-token.
    """

    def __init__(self, model: UnigramModel):
        self.model = model
        self.children: dict[int, int] = {}
        self.best, self.number = [0.0], [0]

    def count(self, word: str) -> int:
        """The number of tokens of a pre-token (without its mark)."""
        if len(self.best) > NODES:
            self.children, self.best, self.number = {}, [0.0], [0]
        scores, ends, unknown, children = self.model.scores, self.model.ends, self.model.unknown, self.children
        text, node, path = MARK + word, 0, [0]
        for i, char in enumerate(text, 1):
            key = node << 21 | ord(char)
            node = children.get(key, -1)
            if node < 0:
                size = 1 if char in scores else len(char.encode("utf-8", "surrogatepass"))
                top = self.best[path[-1]] + (scores[char] if char in scores else unknown * size)
                n = self.number[path[-1]] + size
                for j in range(i - 2, -1, -1):
                    piece = text[j:i]
                    if piece not in ends:
                        break
                    score = scores.get(piece)
                    if score is not None:
                        score += self.best[path[j]]
                        if score > top or score == top and self.number[path[j]] + 1 < n:
                            top, n = score, self.number[path[j]] + 1
                node = children[key] = len(self.best)
                self.best.append(top)
                self.number.append(n)
            path.append(node)
        return self.number[node]


def terminal_counts(words: list[str], model: UnigramModel, trie: Trie | None = None) -> dict[str, int]:
    """The number of tokens of each distinct pre-token (without its mark), by a trie."""
    trie = Trie(model) if trie is None else trie
    return {word: trie.count(word) for word in set(words)}


def token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, n_words (pre-tokens) and n_tokens of its whole text.

    A null or empty text has none. Repeated rows each give a row, null ids are
    kept, an empty table gives no rows; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(vocabulary)
        known, trie = worker_cache(("token counts", vocabulary), lambda: ({}, Trie(model)))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                words = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in part["text"]]
                new = set().union(*words).difference(known)
                named = {w: w.decode("utf-8", "surrogatepass") for w in new}
                made = terminal_counts(list(named.values()), model, trie)
                fresh = {w: made[name] for w, name in named.items()}
                if len(known) + len(fresh) <= REMEMBERED:
                    known.update(fresh)
                    find = known.__getitem__
                else:

                    def find(w: bytes, fresh: dict[bytes, int] = fresh) -> int:
                        got = known.get(w)
                        return fresh[w] if got is None else got

                totals = np.array([sum(map(find, w)) for w in words], np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "n_words": pa.array([len(w) for w in words], pa.int64()), "n_tokens": pa.array(totals)})

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(rows, f"doc_id {id_type}, n_words long, n_tokens long")
