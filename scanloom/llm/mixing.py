"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's documents are dealt by a seeded hash to shards, about
``shard_docs`` each, and stand in seeded order within their shard: a stream of
words, cut to equal blocks of ``block_words``. The blocks that the mix takes
are apportioned by highest quotients, first among the sources by their targets,
then among each source's shards by their blocks. A shard whose quota is k times
its blocks and r more takes every block k times, and the r blocks from a seeded
one on (going round) once more. As the order of documents is random, so is that
run, and all documents but the two at its ends are taken whole. What a document
gives is a closed form of its place in the stream: no block becomes a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import written

WORDS = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class MixParams:
    """``cycle``: weights of the sources in order of code point, repeating. Beyond ``max_shards`` shards of a source they grow instead, so one task may rank them."""

    cycle: tuple[float, ...] = (5.0, 2.0, 1.0)
    total_share: float = 1.5
    max_repeat: int = 2
    block_words: int = 16
    shard_docs: int = 4_000
    max_shards: int = 1 << 16
    seed: int = 29


def word_count(text: Column) -> Column:
    """The number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def seeded(seed: int, *parts: Column) -> Column:
    """A number below 2**60 of some columns: the first 15 hexadecimal digits of their MD5."""
    told = [F.coalesce(p.cast("string"), F.lit("\x01")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("\x02", F.lit(str(seed)), *told)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """source, source_size, blocks and target from (source, size, n_docs, blocks) sums.

    A target is ``total_share`` of all sizes, shared by weight, but at most
    ``max_repeat`` times the source's size; the excess is reshared by weight
    among the others until none is above. With sources in order of size per
    weight the capped ones come first, so running sums find the share at once.
    One row per source: a table of sums, ordered in one task.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(float(w)) for w in params.cycle))
    weighed = sizes.withColumn("weight", F.get(weights, (F.row_number().over(place) - 1) % len(params.cycle)))
    everything = Window.partitionBy()
    poorest = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = poorest.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * params.max_repeat
    rated = (
        weighed.withColumn("pot", F.sum("source_size").over(everything) * params.total_share)
        .withColumn("given", F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("rate", (F.col("pot") - F.col("given")) / F.col("rest"))
        .withColumn("capped", F.col("rate") * F.col("weight") >= cap)
        .withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("given"), F.col("rate")))).over(everything))
    )
    # Sources before the first that isn't capped are capped; the level is that first one's rate.
    return rated.select("source", "source_size", "blocks", "weight", F.when(F.col("level").isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), F.col("weight") * F.col("level.rate"))).alias("target"))


def apportioned(votes: DataFrame, group: list[str], vote: str, seats: Column, tie: list[str]) -> DataFrame:
    """``quota``: seats of each row by Sainte-Laguë, within each group.

    The highest-quotient method gives row i a seat for each k with
    vote / (2k + 1) above a common level. With all seats filled the levels lie
    near half of votes per seat, so every row surely has the seats of a
    slightly higher level, and only the few next ones of each row are ranked.
    """
    whole = Window.partitionBy(*group)
    total, rows = F.sum(vote).over(whole), F.count("*").over(whole)
    based = votes.withColumn("seats", seats).withColumn("sum_votes", total).withColumn("rows", rows)
    # At the divisor total / (seats - rows / 2) or less, rounding gives seats or more; at
    # total / (seats + rows / 2) or more, seats or fewer. So the quota lies between them.
    share = F.when(F.col("sum_votes") > 0, F.col(vote) / F.col("sum_votes")).otherwise(F.lit(0.0))
    low = F.greatest(F.lit(0), F.floor(share * F.greatest(F.col("seats") - F.col("rows") / 2, F.lit(0)) - 0.5)).cast("long")
    high = F.ceil(share * (F.col("seats") + F.col("rows") / 2) + 1.5).cast("long")
    based = based.withColumn("low", low).withColumn("high", F.greatest(high, F.col("low")))
    left = F.col("seats") - F.sum("low").over(whole)
    based = based.withColumn("left", left)
    tries = based.withColumn("k", F.explode(F.sequence("low", "high")))
    ranked = tries.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy((F.col(vote) / (2 * F.col("k") + 1)).desc(), *tie)))
    keys = [c for c in votes.columns]
    given = ranked.groupBy(*keys, "low").agg(F.sum((F.col("place") <= F.col("left")).cast("long")).alias("more"))
    return given.select(*keys, (F.col("low") + F.when(F.col(vote) > 0, F.col("more")).otherwise(0)).alias("quota"))


def taken_before(x: Column, blocks: Column, quota: Column, first: Column, size: int) -> Column:
    """Words that the mix takes of a shard's first x words."""
    some = F.greatest(blocks, F.lit(1))
    each, more = F.floor(quota / some), quota % some
    runs = [(first, F.least(first + more, blocks)), (F.lit(0).cast("long"), F.greatest(first + more - blocks, F.lit(0)))]
    out = each * x
    for a, b in runs:
        out = out + F.greatest(F.least(x, b * size) - a * size, F.lit(0))
    return out


def mixed(documents: DataFrame, params: MixParams = MixParams(), text: str = "text", source: str = "source") -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken; and its place and its shard's quota: source, order, begin, blocks, quota, first.

    A null text has no words and is taken 0 times; a null source is a source of
    its own, last in order. Repeated rows and null ids each are documents (rows
    alike in id and size share their places in some order). An empty table
    gives no rows. Other columns are not read.
    """
    sized = written(documents.select("doc_id", F.col(source).alias("source"), seeded(params.seed, F.col("doc_id"), F.col(source), F.col(text)).alias("order"), word_count(F.col(text)).alias("size")), "mixing-sizes")
    per_source = written(sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")), "mixing-sources")
    shards = per_source.select(F.col("source").alias("of"), "source_size", F.least(F.ceil(F.col("n_docs") / params.shard_docs), F.lit(params.max_shards)).cast("long").alias("n_shards"))
    dealt = sized.join(shards, F.col("source").eqNullSafe(F.col("of"))).withColumn("shard", F.pmod("order", "n_shards")).drop("of", "n_shards")
    per_shard = written(dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size")).withColumn("blocks", F.ceil(F.col("words") / params.block_words).cast("long")), "mixing-shards")
    sums = per_shard.groupBy("source").agg(F.first("source_size").alias("source_size"), F.sum("blocks").alias("blocks"))
    targets = written(source_targets(sums, params), "mixing-targets")
    votes = targets.withColumn("vote", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(F.lit(0.0)))
    seats = F.round(F.sum("vote").over(Window.partitionBy())).cast("long")
    quotas = apportioned(votes.select("source", "target", "blocks", "vote"), [], "vote", seats, ["source"]).select(F.col("source").alias("of"), "target", F.least("quota", F.col("blocks") * params.max_repeat).alias("source_quota"))
    shard_votes = per_shard.join(quotas, F.col("source").eqNullSafe(F.col("of"))).select("source", "shard", "target", "blocks", "source_quota", F.col("blocks").cast("double").alias("vote"))
    shares = written(apportioned(shard_votes, ["source"], "vote", F.col("source_quota"), ["shard"]), "mixing-quotas").select(
        F.col("source").alias("of"), F.col("shard").alias("of_shard"), "target", "blocks", F.least("quota", F.col("blocks") * params.max_repeat).alias("quota"),
        F.when(F.col("blocks") > 0, F.pmod(seeded(params.seed, F.col("source"), F.col("shard")), F.greatest("blocks", F.lit(1)))).otherwise(0).alias("first"),
    )
    stream = Window.partitionBy("source", "shard").orderBy("order", F.col("doc_id"), "size")
    placed = dealt.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    joined = placed.join(shares, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("of_shard")))
    terms = (F.col("blocks"), F.col("quota"), F.col("first"), params.block_words)
    taken = F.when(F.col("size") > 0, taken_before(F.col("end"), *terms) - taken_before(F.col("begin"), *terms)).otherwise(0).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "order", "begin", "blocks", "quota", "first")


def _cut(text: str, begin: int, end: int, size: int) -> str:
    """Words from ``begin`` to ``end`` of a text of ``size`` words, as they stand in it."""
    if begin == 0 and end == size:
        return text
    places = [m.span() for m in re.finditer(WORDS, text)]
    return text[places[begin][0] : places[end - 1][1]]


def mixed_documents(documents: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The documents of the mix, all columns: each as often as it is taken, cut to the words taken where a run ends in it."""
    sources = mixed(documents, params)
    size = params.block_words
    more = F.col("quota") % F.greatest("blocks", F.lit(1))
    last = F.col("first") + more
    runs = [(F.col("first"), F.least(last, F.col("blocks"))), (F.lit(0), F.greatest(last - F.col("blocks"), F.lit(0)))]
    ranges = [F.struct((F.greatest(a * size, F.col("begin")) - F.col("begin")).cast("long").alias("a"), (F.least(b * size, F.col("begin") + F.col("size")) - F.col("begin")).cast("long").alias("b")) for a, b in runs]
    whole = F.floor(F.col("quota") / F.greatest("blocks", F.lit(1))).cast("int")
    alike = Window.partitionBy("of", "order")
    plan = sources.select(F.col("doc_id").alias("of"), F.col("order").alias("order"), "begin", "size", "taken", whole.alias("whole"), F.array(*ranges).alias("ranges"))
    plan = plan.withColumns({"n": F.count("*").over(alike), "nth": F.row_number().over(alike.orderBy((F.col("taken") == 0), "begin"))}).where("taken > 0")
    plan = plan.select(F.col("of").alias("__of"), F.col("order").alias("__of_order"), F.col("nth").alias("__of_nth"), (F.col("n") > 1).alias("__again"), F.struct("size", "whole", "ranges").alias("__plan"))
    plan = written(plan, "mixing-plan")
    keyed = documents.withColumn("__order", seeded(params.seed, F.col("doc_id"), F.col("source"), F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__of")) & (F.col("__order") == F.col("__of_order"))
    # Texts move once; rows alike in id, source and text are numbered to tell their places apart, and move again.
    joined = keyed.join(plan.where("not __again"), same).select(*documents.columns, "__plan")
    again = plan.where("__again")
    if not again.isEmpty():
        doubled = again.select(F.col("__of").alias("__is"), F.col("__of_order").alias("__is_order")).distinct()
        some = keyed.join(doubled, F.col("doc_id").eqNullSafe(F.col("__is")) & (F.col("__order") == F.col("__is_order")), "left_semi")
        some = some.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", "__order").orderBy(F.lit(0))))
        joined = joined.unionByName(some.join(again, same & (F.col("__nth") == F.col("__of_nth"))).select(*documents.columns, "__plan"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked, texts = [], []
            for k, (text, plan) in enumerate(zip(batch["text"], batch["__plan"].to_pylist())):
                full = text.as_py()
                made = [full] * plan["whole"] + [_cut(full, r["a"], r["b"], plan["size"]) for r in plan["ranges"] if r["b"] > r["a"]]
                picked += [k] * len(made)
                texts += made
            out = batch.drop_columns(["__plan"]).take(pa.array(picked, pa.int64()))
            out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, out.schema.field("text").type))
            if "n_chars" in out.schema.names:
                at = out.schema.get_field_index("n_chars")
                out = out.set_column(at, "n_chars", pa.array([len(t) for t in texts]).cast(out.schema.field(at).type))
            yield out

    return joined.mapInArrow(rows, documents.schema)
