"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are grouped by value, so copies of one text are one node. Two
fingerprints with at most 3 differing bits agree in at least two of five
blocks of their bits; each of the ten pairs of blocks is a table of buckets. A
bucket's fingerprints are stored as vertical bit planes, and the distances of
many pairs advance together, two planes at a time, in carry-save counters (one
bit of each counter per machine word lane); words all of whose lanes exceed the
radius are abandoned. A bucket gives at most one link per member, to the
first member of its linked set, never all pairs.

Buckets over ``CAP`` members are dealt anew before any task holds them: by
three of six further blocks, and what is still over ``CAP`` as pairs of chunks,
each a task of its own. Every pair within the radius is met in one of them, so
the result is exact at every size. Connected sets come from alternating star
contractions, each round written to the shared folder. Keys that many rows
share (a centre, a set, a fingerprint, a bucket, a repeated row) are joined by
``common.joined``, which leaves their rows where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from scanloom.llm.common import HOT_SHARES, joined, worker_cache, written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Most members of a bucket that one task compares with each other.
CAP = 4096
#: Hashes whose bits are counted at a time; bounds memory, not the text.
CHUNK = 255 * 1024


def _blocks(low: int, high: int, parts: int) -> list[int]:
    """Masks of ``parts`` even blocks of the bits from ``low`` to ``high``."""
    cuts = [low + (high - low) * k // parts for k in range(parts + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


FIVE = _blocks(0, 64, 5)
#: Of each pair of five blocks: its mask.
TABLES = [a | b for a, b in combinations(FIVE, 2)]
#: Of each table: the masks of three of the six halves of the other three blocks, with the table's own.
FINER = [[t | a | b | c for a, b, c in combinations([h for blk in FIVE if not blk & t for h in _blocks(blk.bit_length() - blk.bit_count(), blk.bit_length(), 2)], 3)] for t in TABLES]


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        some = words[at : at + CHUNK + SHINGLE - 1]
        m = max(1, len(some) - SHINGLE + 1)
        shingles = map(b" ".join, zip(*(some[k:] for k in range(SHINGLE)))) if len(some) >= SHINGLE else iter([b" ".join(some)])
        hashes = np.zeros(-(-m // 255) * 255, "<u8")
        hashes[:m] = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, m)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 255, 64)
        set_bits += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text) and fp (fingerprint as a signed long) of every whole text; a null text has no words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash", dict)  # nothing: what another operator kept goes
        for batch in batches:
            made = np.array([fingerprint(t.as_py()) for t in batch["text"]], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "row": batch["row"], "fp": pa.array(made.view(np.int64), pa.int64())})

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(hashed, f"doc_id {id_type}, row long, fp long")


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 rows, one of each bit: bit planes of the values, 64 lanes to a word."""
    padded = np.zeros(-(-len(values) // 64) * 64, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(-1, 64)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within_radius(plane, words: int) -> np.ndarray:
    """Lanes whose differing bits number at most 3, as a word array.

    ``plane(k, at)`` gives bit k's difference plane at the words ``at``. Each
    lane has a saturating counter: ones, twos and "over". Words whose lanes all
    are over drop out.
    """
    at = np.arange(words)
    ones, twos, over = (np.zeros(words, np.uint64) for _ in range(3))
    for k in range(0, 64, 2):
        a, b = plane(k, at), plane(k + 1, at)
        both = a ^ b
        carry = (a & b) | (ones & both)
        ones = ones ^ both
        over |= twos & carry
        twos = twos ^ carry
        if k % 8 == 6:
            alive = over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not alive.all():
                at, ones, twos, over = at[alive], ones[alive], twos[alive], over[alive]
                if not len(at):
                    break
    out = np.zeros(words, np.uint64)
    out[at] = ~over
    return out


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    """The first n lanes as booleans."""
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)


def small_links(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within many small groups at once, by distance in the sorted order."""
    left, right = [], []
    for d in range(1, len(fps)):
        same = np.flatnonzero(group[d:] == group[:-d])
        if not len(same):
            break
        a, b = fps[same], fps[same + d]
        p = planes_of(a ^ b)
        near = _lanes(within_radius(lambda k, at: p[k][at], p.shape[1]), len(a))
        left.append(b[near])
        right.append(a[near])
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def large_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link per linked member of one group, to the first of its set: 64 queries at a time against all."""
    n = len(fps)
    p, label = planes_of(fps), np.arange(n)
    width = p.shape[1]
    for at in range(0, n, 64):
        queries = fps[at : at + 64]
        bits = np.unpackbits(queries.view(np.uint8), bitorder="little").reshape(len(queries), 64)
        flips = np.where(bits.T == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))

        def plane(k: int, where: np.ndarray, flips=flips) -> np.ndarray:
            q, w = np.divmod(where, width)
            return p[k][w] ^ flips[k][q]

        near = _lanes(within_radius(plane, len(queries) * width), len(queries) * width * 64).reshape(len(queries), -1)[:, :n]
        for q in np.flatnonzero(near.sum(axis=1) > 1):
            labels = np.unique(label[near[q]])
            if len(labels) > 1:
                label[np.isin(label, labels[1:])] = labels[0]
    moved = label != np.arange(n)
    return fps[moved], fps[label[moved]]


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u > v) within each bucket of rows that come sorted by bucket."""
    rest: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.uint64))

    def linked(g: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.diff(g, prepend=g[0] - 1 if len(g) else 0)) if len(g) else np.empty(0, int)
        sizes = np.diff(np.append(starts, len(g)))
        found = []
        small = np.repeat((sizes > 1) & (sizes <= 32), sizes)
        if small.any():
            found.append(small_links(f[small], g[small]))
        for s, n in zip(starts[sizes > 32], sizes[sizes > 32]):
            found.append(large_links(np.unique(f[s : s + n])))
        a, b = (np.concatenate([x[k] for x in found]).astype(np.uint64).view(np.int64) if found else np.empty(0, np.int64) for k in (0, 1))
        keep = a != b
        return pa.RecordBatch.from_pydict({"u": pa.array(np.maximum(a, b)[keep], pa.int64()), "v": pa.array(np.minimum(a, b)[keep], pa.int64())})

    for batch in batches:
        g = np.concatenate([rest[0], batch["g"].to_numpy()])
        f = np.concatenate([rest[1], batch["fp"].to_numpy().view(np.uint64)])
        if not len(g):
            continue
        last = np.searchsorted(g, g[-1])  # the last bucket may go on in the next batch
        rest = (g[last:], f[last:])
        if last:
            yield linked(g[:last], f[:last])
    if len(rest[0]):
        yield linked(*rest)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(masks: list[int]):
    return F.array(*(F.lit(_signed(m)).cast("long") for m in masks))


def links(nodes: DataFrame, cap: int = CAP) -> DataFrame:
    """Links (u > v) that connect all distinct fingerprints ``fp`` within the radius, and no others."""
    keyed = nodes.select("fp", F.posexplode(_masks(TABLES)).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    big = written(keyed.groupBy("t", "key").agg(F.count("*").alias("__n")).where(F.col("__n") > cap).withColumn("big", F.lit(True)), "simhash-big")
    plain = keyed
    parts = []
    members = big.agg(F.sum("__n")).first()[0]
    if members:
        sorted_out = joined(keyed, big, ["t", "key"], members, "left")
        plain = sorted_out.where("big is null").drop("big")
        hot = sorted_out.where("big").drop("big")
        masks = F.array(*(_masks(m) for m in FINER))
        finer = hot.select("fp", "t", F.posexplode(F.get(masks, F.col("t"))).alias("s", "mask")).select("fp", "t", "s", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        sizes = finer.groupBy("t", "s", "key").agg(F.count("*").alias("__n")).where(F.col("__n") > cap).withColumn("chunks", F.ceil(F.col("__n") / cap).cast("int"))
        dealt = joined(written(finer, "simhash-finer"), written(sizes, "simhash-sizes"), ["t", "s", "key"], members * len(FINER[0]), "left")
        parts.append(dealt.where(F.col("chunks").isNull()).select(F.xxhash64(F.lit(1), "t", "s", "key").alias("g"), "fp"))
        chunk = F.pmod(F.xxhash64("fp", F.lit(5)), F.col("chunks")).cast("int")
        pairs = dealt.where(F.col("chunks").isNotNull()).select("fp", "t", "s", "key", chunk.alias("c"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
        parts.append(pairs.select(F.xxhash64(F.lit(2), "t", "s", "key", F.least("c", "o"), F.greatest("c", "o")).alias("g"), "fp"))
    # Buckets that share a hash are merely compared with each other: distances decide.
    grouped = plain.select(F.xxhash64(F.lit(0), "t", "key").alias("g"), "fp")
    for part in parts:
        grouped = grouped.unionByName(part)
    return grouped.repartition("g").sortWithinPartitions("g").mapInArrow(bucket_links, "u long, v long").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v): every node u of a connected set but the smallest, and the smallest, v."""

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = written(edges, "simhash-links")
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n")).withColumn("m", F.least("u", "m"))
        large = joined(both, least, ["u"], 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "simhash-large")  # at most one row per link
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))
        small = joined(large, least, ["u"], before[0]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "simhash-links")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges


def components(documents: DataFrame, cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, row, fp, component_id and root (the least fingerprint of its set)."""
    fps = written(fingerprints(documents), "simhash-fps")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "simhash-nodes")
    stars = contracted(links(nodes, cap))
    rooted = nodes.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", "copies", F.coalesce("v", "fp").alias("root"))
    rooted = written(rooted, "simhash-rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("__n"))
    named = joined(rooted, smallest, ["root"], rooted.count()).select("fp", "component_id", "root", F.col("copies").alias("__n"))
    return joined(fps, written(named, "simhash-named"), ["fp"], fps.count()).select("doc_id", "row", "fp", "component_id", "root")


def near_duplicates(documents: DataFrame, cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id of its set).

    A null or empty text has fingerprint zero and is linked like any other.
    Repeated rows each give a row. A null doc_id is kept, and stands for its
    set only if the set has no other id. Other columns are not read.
    """
    return components(documents, cap).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(documents: DataFrame, cap: int = CAP) -> DataFrame:
    """The documents, all columns, one of each set: that of the smallest doc_id, then the least fingerprint and text hash."""
    # A null id sorts last here, so it stands only for sets without another.
    alike = components(documents, cap).groupBy("root", "doc_id", "fp", "row").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "row", "n")).alias("m")
    kept = alike.groupBy("root").agg(first, F.sum("n").alias("__rows")).select(F.col("m.doc_id").alias("__kept_id"), F.col("m.row").alias("__kept_row"), F.col("m.n").alias("__n"), "__rows")
    kept = written(kept, "simhash-kept")
    keyed = documents.withColumn("__row", F.xxhash64("doc_id", "text"))
    on = F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("__row") == F.col("__kept_row"))
    rows, again = kept.agg(F.sum("__rows"), F.max("__n")).first()
    # Texts move once; only those of rows that are there more than once move again.
    hot = F.col("__n") * HOT_SHARES > F.greatest(F.lit(rows), F.lit(HOT_SHARES))
    few = F.broadcast(kept.where(hot))  # fewer than HOT_SHARES, as rows of each number more than that part of all
    often = (again or 0) * HOT_SHARES > max(rows or 0, HOT_SHARES)
    moved = (keyed.join(few, on, "left_anti") if often else keyed).join(kept.where(~hot) if often else kept, on)
    out = moved.where("__n = 1").select(*documents.columns)
    if (again or 0) < 2:
        return out
    repeats = moved.where("__n > 1")
    if often:
        repeats = repeats.unionByName(keyed.join(few, on))
    return out.unionByName(repeats.dropDuplicates(["doc_id", "__row"]).select(*documents.columns))
