"""Benchmark decontamination: a prefix-filtered set join, verified exactly.

An item's windows are its runs of 10 words (all its words, if fewer). A window
that occurs in a document has all its words there, so it suffices to join
one necessary word per window, its prefix: the rarest by corpus count. A
document word that is some window's prefix is a candidate, with the words
around it; positional bounds (the window must begin at or after the document's
first word) and length bounds (and end at or before its last) drop
candidates, and the words of the rest are compared one by one.

A bitmap of the prefixes, of fixed size, lets candidates out of each row before
they become rows of their own; it only errs towards more candidates. All steps
are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import bitmap, in_bitmap, written

WINDOW = 10
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAPS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, letters and all that is not ASCII; none for null."""
    spaced = F.translate(text, _UPPER + _GAPS, _UPPER.lower() + " " * len(_GAPS))
    return F.array_remove(F.split(F.coalesce(spaced, F.lit("")), " "), "")


def windows_of(benchmark: DataFrame) -> DataFrame:
    """item_id (as string), win (words joined by a space), k (its number of words), words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - WINDOW, F.lit(0))
    cut = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, WINDOW))).alias("words"))
    return cut.select("item_id", F.array_join("words", " ").alias("win"), F.size("words").alias("k"), "words").distinct()


def corpus_counts(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``word`` and its number ``n`` in all documents, for each word of the vocabulary; 0 for those not found."""
    listed = documents.select(words_of(F.col("text")).alias("words"), bitmap(vocabulary).alias("bits"))
    found = listed.select(F.explode(F.expr(f"filter(words, w -> {in_bitmap('w')})")).alias("word")).join(vocabulary, "word", "left_semi")
    return vocabulary.join(found.groupBy("word").agg(F.count("*").alias("n")), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each distinct window with its rarest word: token, off (its first place in the window), win, k."""
    spread = windows.select("win", "k", "words").distinct().select("win", "k", F.posexplode("words").alias("off", "word"))
    ranked = spread.join(counts, "word").groupBy("win", "k").agg(F.min(F.struct("n", "word", "off")).alias("m"))
    return ranked.select(F.col("m.word").alias("token"), F.col("m.off").alias("off"), "win", "k")


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and row, a hash of id and text.

    Null and empty texts have no words; items without words have no window.
    Items that repeat count once by id. Each document row is judged by its own
    text, repeated rows alike; null ids are kept. An empty benchmark hits
    nothing. Other columns are not read.
    """
    windows = written(windows_of(benchmark), "decontam-windows")
    vocabulary = written(windows.select(F.explode("words").alias("word")).distinct(), "decontam-vocabulary")
    counts = written(corpus_counts(documents, vocabulary), "decontam-counts")
    tokens = written(prefixes(windows, counts), "decontam-prefixes")

    listed = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), words_of(F.col("text")).alias("words"), bitmap(tokens.select(F.col("token").alias("word"))).alias("bits"))
    listed = listed.withColumn("n_words", F.size("words").cast("long"))
    picked = F.expr(
        f"transform(filter(sequence(0, greatest(size(words) - 1, 0)), i -> coalesce({in_bitmap('get(words, i)')}, false)),"
        f" i -> named_struct('pos', i, 'token', get(words, i), 'from', greatest(i - {WINDOW - 1}, 0), 'ctx', slice(words, greatest(i - {WINDOW - 1}, 0) + 1, {2 * WINDOW - 1})))"
    )
    # A row of its own for each document, under a token that no window has (it holds a gap character).
    own = F.expr("named_struct('pos', cast(null as int), 'token', concat(' ', cast(row as string)), 'from', cast(null as int), 'ctx', cast(null as array<string>))")
    rows = listed.select("doc_id", "row", "n_words", F.explode(F.concat(F.array(own), picked)).alias("c")).select("doc_id", "row", "n_words", "c.*")
    begin = F.col("pos") - F.col("off")
    bounded = (begin >= 0) & (begin + F.col("k") <= F.col("n_words"))
    same = F.array_join(F.expr("slice(ctx, pos - off - from + 1, k)"), " ") == F.col("win")
    joined = rows.join(tokens, "token", "left").where(F.col("pos").isNull() | F.when(bounded, same))
    found = written(joined.select("doc_id", "row", "n_words", begin.alias("begin"), (begin + F.col("k")).alias("end"), "win"), "decontam-found")

    hits = found.where("win is not null")
    spans = hits.select("doc_id", "row", "begin", "end").distinct()
    earlier = Window.partitionBy("doc_id", "row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(earlier), F.lit(0))), F.lit(0))
    covered = spans.withColumn("fresh", fresh).groupBy("doc_id", "row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    items = hits.select("doc_id", "row", "win").distinct().join(windows.select("win", "item_id"), "win").groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    per_row = covered.join(items, covered["doc_id"].eqNullSafe(items["doc_id"]) & (covered["row"] == items["row"])).select(covered["doc_id"].alias("of"), covered["row"].alias("of_row"), "n_hit", "items")
    base = found.where("win is null").select("doc_id", "row", "n_words")
    joined = base.join(per_row, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed_items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed_items).cast("long").alias("n_items"), F.sha2(F.array_join(listed_items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "row")


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that hold no window of the benchmark."""
    bad = written(contamination(documents, benchmark).where("contaminated").select(F.col("doc_id").alias("__bad_id"), F.col("row").alias("__bad_row")).distinct(), "decontam-bad")
    keyed = documents.withColumn("__row", F.xxhash64("doc_id", "text"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad_id")) & (F.col("__row") == F.col("__bad_row")), "left_anti").drop("__row")


#: The same in DuckDB's SQL: every window of every document against every window of every item.
ORACLE = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w, row_number() over () r from documents),
i as (select distinct cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
iw as (select distinct item_id, k, array_to_string(w[p + 1 : p + k], ' ') win from (select item_id, w, least(len(w), {WINDOW}) k, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) p from i where len(w) > 0)),
ks as (select distinct k from iw),
dw as (select r, p, k, array_to_string(w[p + 1 : p + k], ' ') win from (select r, w, k, unnest(range(len(w) - k + 1)) p from d, ks where len(w) >= k)),
m as (select r, p, dw.k, item_id from dw join iw on dw.win = iw.win and dw.k = iw.k),
h as (select r, count(distinct q) n from (select r, unnest(range(p, p + k)) q from m) group by r),
t as (select r, count(*) n, string_agg(item_id, ',' order by item_id) s from (select distinct r, item_id from m) group by r)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(h.n, 0) as bigint) n_hit, cast(coalesce(t.n, 0) as bigint) n_items, sha256(coalesce(t.s, '')) items_sha256, coalesce(h.n, 0) > 0 contaminated
from d left join h using (r) left join t using (r)
"""
