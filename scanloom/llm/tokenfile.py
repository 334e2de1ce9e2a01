"""Token ids in a binary format: frequency-ranked, byte-aligned, with separate control bytes.

Texts are tokenised in ascending doc_id order. Ids are replaced by their rank
in the corpus (0: the most frequent), so most take one byte. A block holds the
ids of whole documents in two streams: two control bits per id, which give its
length of 1 to 4 bytes, four to a control byte; and the ids' bytes, little
endian. Decoding looks each control byte up in numpy tables.

A file set is a folder with ``blocks`` (one row per block, in order of shard
and block: first position, document ids and lengths, and both streams) and
``ranks`` (id by rank). The container is Parquet, written by Spark's commit
protocol, so it needs no file system besides what Spark reaches and survives
the loss of executors.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import freed, removed, shared_path, worker_cache

#: Ids of a block, at least, unless it is a shard's last; a document is never cut.
BLOCK_IDS = 1 << 18
#: Bytes that a worker keeps of known pieces, their ids and places; beyond that it forgets those of the later half.
REMEMBERED = 36 << 20
#: Marks that part from a letter or digit before them (an apostrophe needn't).
MARKS = b".,;:!?*#%&$"
#: Documents that are encoded together.
TOGETHER = 1024
#: Characters of a text that part rows of one id.
TIE = 32
#: Bytes of text that are looked at together.
BUFFER = 1 << 19
GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Lengths of the four ids of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizers file, the id that ends a document and the number of ids, all below ``size``."""

    path: str
    end_id: int = 2
    size: int = 49_408

    @property
    def dtype(self) -> str:
        return "<u2" if self.size <= 1 << 16 else "<u4"


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: A known word: its hash and bytes, and its ids' place in the pool. A level is sorted by hash.
LEVEL = np.dtype([("hash", np.uint64), ("word", np.uint32), ("at", np.uint32), ("size", np.uint32), ("count", np.uint32)])
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class _Pool:
    """An array that grows."""

    def __init__(self, dtype) -> None:
        self.data, self.size = np.empty(1 << 16, dtype), 0

    def added(self, values: np.ndarray) -> int:
        """Put values at the end; where they begin."""
        begin, self.size = self.size, self.size + len(values)
        if self.size > len(self.data):
            grown = np.empty(max(self.size, 2 * len(self.data)), self.data.dtype)  # pages not written yet take no memory
            grown[:begin] = self.data[:begin]
            self.data = grown
        self.data[begin : self.size] = values
        return begin


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse."""
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _BACK))
    return up, down


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A buffer that ends in white space as an array; the places, sizes and hashes of its words, by differences of a running sum."""
    buffer = np.frombuffer(raw, np.uint8)
    space = _SPACE[buffer]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    up, down = _powers(1 << max(BUFFER.bit_length(), (len(raw) - 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return buffer, starts, ends - starts, hashes ^ (hashes >> np.uint64(29))


class _Encoder:
    """Ids of texts. What stands between ASCII white space is encoded apart, once per distinct piece.

    Distinct pieces, and what is known of them, are found by hashes in sorted
    arrays, and every piece's bytes are compared with those of the one it is
    taken for. Different pieces of one hash are encoded without this.

    New pieces are encoded many at a time: words of letters side by side, told
    apart by the ids that end a word; others between bars, as a bar by itself is
    one id, which no piece without a bar gives. Marks after a word are encoded apart
    where the tokenizer parts them anyway. Texts whose characters all are
    Latin-1 (so none combine) are lower-cased beforehand where the tokenizer's
    definition does so itself: fewer pieces are distinct. Added tokens are found
    before normalising, so texts that hold one in any case stay as they are.
    """

    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(vocabulary.path), vocabulary.dtype
        self.end = np.array([vocabulary.end_id], self.dtype).tobytes()
        self.levels: list[np.ndarray] = []
        self.pool, self.letters = _Pool(self.dtype), _Pool(np.uint8)
        self.half = 0, 0
        normalizer = self.tokenizer.normalizer
        steps = json.loads(normalizer.__getstate__()) if normalizer else {}  # its part of the definition alone
        steps = [n["type"] for n in steps.get("normalizers", [steps]) if n]
        self.lowers = "Lowercase" in steps and set(steps) <= {"NFC", "Replace", "Lowercase"}
        self.lowers = self.lowers and all(self._ids(c) == self._ids(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bar = self._ids("|")
        self.lean, self.ends = self._lean()
        self.bounds = all(self._ids(a + m + m) == self._ids(a) + self._ids(m + m) for a in ("the", "thx", "9") for m in MARKS.decode())

    def _lean(self):
        """For words of Latin-1 letters in lower case: the same model without normalising, and which ids end a word."""
        from tokenizers import Tokenizer, pre_tokenizers

        lean = Tokenizer(self.tokenizer.model)
        lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        ends = np.zeros(1 << 16 if self.dtype == "<u2" else 1 << 20, bool)
        if not suffix or not self.lowers:
            return None, ends
        ends[[k for piece, k in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
        letters = [chr(c) for c in range(256) if chr(c).isalpha() and chr(c) == chr(c).lower()]
        trial = [*letters, *(a + b for a in letters for b in "aez\xe9\xdf"), "thequickbrownfox"]
        same = all(self._ids(w) == lean.encode(w, add_special_tokens=False).ids for w in trial)
        return (lean if same else None), ends

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _raw(self, text: str) -> bytes:
        raw = text.encode()
        if not self.lowers or not _latin(text):
            return raw
        lower = raw.lower()
        return raw if any(t in lower for t in self.added) else lower

    def _fresh(self, new: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        split: dict[bytes, tuple[bytes, bytes]] = {}
        if self.bounds:  # a word with marks after it is the word's ids and the marks' ids
            for p in new:
                word = p.rstrip(MARKS)
                if word and word != p and word[-1:].isalnum():
                    split[p] = (word, p[len(word) :])
        if not split:
            made = self._encoded_once(new)
            return [made[p] for p in new]
        parts = list({*chain.from_iterable(split.values()), *(p for p in new if p not in split)})
        buffer = b" ".join(parts) + b" "
        ids, counts = self._resolved(buffer, *_words(buffer), plain=True)
        raw, size = ids.tobytes(), ids.itemsize
        ends = (np.cumsum(counts) * size).tolist()
        found = {p: raw[a:b] for p, a, b in zip(parts, [0, *ends], ends)}
        return [found[split[p][0]] + found[split[p][1]] if p in split else found[p] for p in new]

    def _encoded_once(self, new: list[bytes]) -> dict[bytes, bytes]:
        made: dict[bytes, bytes] = {}
        if self.lean is not None:
            words = [p for p in new if p.isalpha() and p.islower()]  # of ASCII letters
            words += [p for p in new if not p.isascii() and (t := p.decode()).isalpha() and t == t.lower() and _latin(t)]
            for at in range(0, len(words), 4096):
                some = words[at : at + 4096]
                lines = [b" ".join(some[k : k + 256]).decode() for k in range(0, len(some), 256)]
                ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.lean.encode_batch_fast(lines, add_special_tokens=False)])
                stops = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
                if len(stops) == len(some):
                    raw, stops = ids.tobytes(), stops.tolist()
                    made.update(zip(some, (raw[a:b] for a, b in zip([0, *stops], stops))))
        plain = [p for p in new if p not in made and b"|" not in p] if len(self.bar) == 1 else []
        chunks = [plain[at : at + 128] for at in range(0, len(plain), 128)]
        for some, encoding in zip(chunks, self.tokenizer.encode_batch_fast([b" | ".join(c).decode() for c in chunks], add_special_tokens=False)):
            ids = np.array(encoding.ids, self.dtype)
            cuts = np.flatnonzero(ids == self.bar[0])
            if len(cuts) == len(some) - 1:
                raw, size = ids.tobytes(), ids.itemsize
                starts, ends = [0, *((cuts + 1) * size).tolist()], [*(cuts * size).tolist(), len(raw)]
                made.update(zip(some, (raw[a:b] for a, b in zip(starts, ends))))
        rest = [p for p in new if p not in made]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)):
            made[p] = np.array(e.ids, self.dtype).tobytes()
        return made

    def _found(self, hashes: np.ndarray, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of words stand, and how many they are: -1 for words not known."""
        at, count = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        for level in self.levels:
            open_ = np.flatnonzero(count < 0)
            place = np.minimum(np.searchsorted(level["hash"], hashes[open_]), len(level) - 1)
            row = level[place]
            hit = (row["hash"] == hashes[open_]) & (row["size"] == sizes[open_])
            open_, row = open_[hit], row[hit]
            if len(open_):
                n = sizes[open_]
                same = buffer[_spread(starts[open_], n)] == self.letters.data[_spread(row["word"].astype(np.int64), n)]
                if not same.all():
                    right = np.logical_and.reduceat(same, np.cumsum(n) - n)
                    open_, row = open_[right], row[right]
                at[open_], count[open_] = row["at"], row["count"]
        return at, count

    def _remembered(self, hashes: np.ndarray, words: list[bytes], ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Put words (in order of hash) and their ids in the pools; small levels join larger ones."""
        rows = np.zeros(len(words), LEVEL)
        rows["hash"], rows["size"] = hashes, np.fromiter(map(len, words), np.int64, len(words))
        rows["count"] = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.dtype).itemsize
        counts, sizes = rows["count"].astype(np.int64), rows["size"].astype(np.int64)
        rows["at"] = self.pool.added(np.frombuffer(b"".join(ids), self.dtype)) + np.cumsum(counts) - counts
        rows["word"] = self.letters.added(np.frombuffer(b"".join(words), np.uint8)) + np.cumsum(sizes) - sizes
        self.levels.append(rows)
        if 2 * self._held() <= REMEMBERED:
            self.half = self.pool.size, self.letters.size
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            both = np.concatenate(self.levels[-2:])
            del self.levels[-2:]
            self.levels.append(both[np.argsort(both["hash"], kind="stable")])
        return rows["at"].astype(np.int64), counts

    def _held(self) -> int:
        """Bytes of known words, their ids and places."""
        return self.pool.size * self.pool.data.itemsize + self.letters.size + sum(level.nbytes for level in self.levels)

    def _forget(self) -> None:
        """Drop all but the words of the first half of ``REMEMBERED``: frequent ones come early."""
        self.pool.size, self.letters.size = self.half
        kept = [level[level["word"] < self.letters.size] for level in self.levels]
        self.levels = [level for level in kept if len(level)]

    def _resolved(self, raw: bytes, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of a buffer, one after the other, and how many each word has."""
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        alike = sizes == sizes[first][which]
        if not alike.all() or not (buffer[_spread(starts, sizes)] == buffer[_spread(starts[first][which], sizes)]).all():
            words = [raw[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist())]  # different words of one hash
            made = self._encoded_once(list(set(words)))
            ids = [np.frombuffer(made[w], self.dtype) for w in words]
            return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))
        if self._held() > REMEMBERED:
            self._forget()
        at, count = self._found(distinct, buffer, starts[first], sizes[first])
        new = np.flatnonzero(count < 0)
        if len(new):
            words = [raw[a : a + n] for a, n in zip(starts[first[new]].tolist(), sizes[first[new]].tolist())]
            if plain:
                made = self._encoded_once(words)
                ids = [made[w] for w in words]
            else:
                ids = self._fresh(words)
            at[new], count[new] = self._remembered(distinct[new], words, ids)
        counts = count[which]
        return self.pool.data[_spread(at[which], counts)], counts

    def _group(self, raws: list[bytes]) -> list[bytes]:
        """The ids of each of some texts, side by side in one buffer."""
        raw = b" ".join(raws) + b" "
        buffer, starts, sizes, hashes = _words(raw)
        if not len(starts):
            return [b""] * len(raws)
        ids, counts = self._resolved(raw, buffer, starts, sizes, hashes)
        # Words that begin before a text's end are its own or earlier ones.
        until = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1) - 1)
        ends = (np.concatenate([[0], np.cumsum(counts)])[until] * ids.itemsize).tolist()
        out = ids.tobytes()
        return [out[a:b] for a, b in zip([0, *ends], ends)]

    def _long(self, raw: bytes) -> bytes:
        """The ids of a text over the buffer's size, cut at white space; a single word over it is encoded as it is."""
        out, at = [], 0
        while at < len(raw):
            end = at + BUFFER
            if end < len(raw):
                end = max(raw.rfind(c, at, end) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
                if end <= at:
                    gap = GAP.search(raw, at + 1)
                    end = gap.start() if gap else len(raw)
            part = raw[at:end]
            if len(part) > BUFFER:
                part = part.strip()
                out.append(self._encoded_once([part])[part])
            else:
                out += self._group([part])
            at = end
        return b"".join(out)

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Each text's ids with the end id, as little-endian bytes; memory is bounded by ``BUFFER`` and the longest text."""
        out: list[bytes] = []
        group: list[bytes] = []
        held = 0
        for raw in map(self._raw, texts):
            if group and held + len(raw) > BUFFER:
                out += self._group(group)
                group, held = [], 0
            if len(raw) > BUFFER:
                out.append(self._long(raw))
            else:
                group.append(raw)
                held += len(raw) + 1
        if group:
            out += self._group(group)
        return [ids + self.end for ids in out]


def encoder(vocabulary: Vocabulary) -> _Encoder:
    """This process's encoder of a vocabulary."""
    return worker_cache(vocabulary, lambda: _Encoder(vocabulary))


def packed(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2**32."""
    r = ranks.astype("<u4")
    width = max(1, (int(r.max()).bit_length() + 7) // 8) if len(r) else 1
    extra = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    used = np.ones((len(r), width), bool)
    for k in range(1, width):
        np.greater(r, (1 << 8 * k) - 1, out=used[:, k])
        extra[: len(r)] += used[:, k]
    control = extra[0::4] | extra[1::4] << 2 | extra[2::4] << 4 | extra[3::4] << 6
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[:, :width][used].tobytes()


def unpacked(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of two streams, by table lookup of the control bytes."""
    codes = np.frombuffer(control, np.uint8)
    lengths = LENGTHS[codes].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: Rows of blocks, and one row per shard with the counts of all ids in place of a block.
RAW = "shard int, block int, within long, doc_ids array<{0}>, lengths array<long>, ids binary, counts binary"
BLOCKS = "shard int, block int, start long, doc_ids array<{0}>, lengths array<long>, n_ids long, control binary, data binary"


def tokenised(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Raw blocks of whole documents in ascending order of doc_id (nulls first), ties in order of text.

    Rows of one id are dealt to shards by the first ``TIE`` characters of their
    texts and then by their place, so any number may bear it; where more than
    these agree, texts are in order within their shard only.
    """
    keyed = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"__tie": F.substring("text", 1, TIE), "__place": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "__tie", "__place").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = encoder(vocabulary), np.dtype(vocabulary.dtype).itemsize
        block, within, held, ids, lengths = 0, 0, 0, [], []
        made: list[bytes] = []

        def row(raw: bytes | None, counts: bytes | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([0], pa.int32()), "block": pa.array([block], pa.int32()), "within": pa.array([within], pa.int64()), "doc_ids": pa.array([ids], pa.list_(kind)), "lengths": pa.array([lengths], pa.list_(pa.int64())), "ids": pa.array([raw], pa.binary()), "counts": pa.array([counts], pa.binary())})

        def full() -> bytes:
            raw = b"".join(made)
            total[:] += np.bincount(np.frombuffer(raw, vocabulary.dtype), minlength=vocabulary.size)
            return raw

        kind = pa.int64()
        total = np.zeros(vocabulary.size, np.int64)
        for batch in batches:
            kind = batch["doc_id"].type
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                for d, b in zip(part["doc_id"].to_pylist(), encode.encoded(part["text"].to_pylist())):
                    ids.append(d)
                    lengths.append(len(b) // width)
                    made.append(b)
                    held += lengths[-1]
                    if held >= BLOCK_IDS:
                        yield row(full())
                        block, within, held, ids, lengths, made = block + 1, within + held, 0, [], [], []
        if ids:
            yield row(full())
        ids, lengths = [], []
        if total.any():
            yield row(None, total.tobytes())
        freed()

    made = ordered.mapInArrow(blocks, RAW.format(id_type))
    return made.withColumn("shard", F.spark_partition_id())


def ranked(raw: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """All ids of the vocabulary by falling corpus frequency, ties by id."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary.size, np.int64)
        for batch in batches:
            for counts in batch["counts"]:
                total += np.frombuffer(counts.as_buffer(), np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})

    counts = raw.select("counts").where("counts is not null")
    sums = counts.mapInArrow(summed, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    n = np.zeros(vocabulary.size, np.int64)
    for r in sums:
        n[r.id] = r.n
    return np.lexsort((np.arange(vocabulary.size), -n)).astype(np.int32)


def write_tokens(documents: DataFrame, vocabulary: Vocabulary, path: str) -> None:
    """Tokenise every whole text and write the file set to ``path``.

    A null text counts as empty; an empty text is its end id. Null ids come
    first, repeated rows are written each, an empty table gives an empty set.
    Other columns are not read.
    """
    spark = documents.sparkSession
    id_type = documents.schema["doc_id"].dataType.simpleString()
    raw_path = shared_path(spark, "tokenfile-raw")
    tokenised(documents, vocabulary).write.option("compression", "uncompressed").parquet(raw_path)
    raw = spark.read.schema(RAW.format(id_type)).parquet(raw_path)
    by_rank = ranked(raw, vocabulary)
    raw = raw.where("counts is null").drop("counts")
    rank_of = np.empty(len(by_rank), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)  # one number per id of the vocabulary

    # A shard's first position: the sum of those before it. One row per partition of the job comes here.
    sums = raw.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    before, total = {}, 0
    for r in sorted(sums, key=lambda r: r.shard):
        before[r.shard], total = total, total + r.n

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch["ids"][k].as_buffer(), vocabulary.dtype)
                control, data = packed(rank[ids])
                one = batch.slice(k, 1)
                start = pa.array([before[one["shard"][0].as_py()] + one["within"][0].as_py()], pa.int64())
                yield pa.RecordBatch.from_pydict({"shard": one["shard"], "block": one["block"], "start": start, "doc_ids": one["doc_ids"], "lengths": one["lengths"], "n_ids": pa.array([len(ids)], pa.int64()), "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary())})

    raw.mapInArrow(coded, BLOCKS.format(id_type)).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame([(k, int(v)) for k, v in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    removed(spark, raw_path)


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """Per document of a file set: doc_id, start, n_tokens, ids_crc32, and the ids where asked for."""
    by_rank = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")  # the vocabulary
    shared = spark.sparkContext.broadcast(by_rank)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids = table[unpacked(batch["control"][k].as_py(), batch["data"][k].as_py(), batch["n_ids"][k].as_py())]
                lengths = batch["lengths"][k].values.to_numpy()
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e] for e, n in zip(ends, lengths)]
                cols = {"doc_id": batch["doc_ids"][k].values, "start": pa.array(ends - lengths + batch["start"][k].as_py()), "n_tokens": pa.array(lengths), "ids_crc32": pa.array([crc32(p) for p in parts], pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(cols)

    blocks = spark.read.schema(BLOCKS.format(id_type)).parquet(f"{path}/blocks").select("start", "doc_ids", "lengths", "n_ids", "control", "data")
    return blocks.mapInArrow(decoded, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
