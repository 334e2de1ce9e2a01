"""Personal data: patterns, and terms that reveal them by corpus co-occurrence.

Base spans come from four patterns. Each distinct value found is a protected
entity e. All words t of the documents that hold e are its candidates. Over all
documents, the information content of e is IC(e) = -log2 p(e), and t's disclosure is the
pointwise mutual information PMI(e; t) = log2 p(e, t) / (p(e) p(t)). PMI reaches
IC exactly where t never occurs without e. A term is disclosing where
PMI(e; t) >= IC(e) - slack, and at least ``support`` documents show the pair;
every occurrence of it, in any document, becomes a span of kind ``term``, save
those that overlap base spans. Sanitising replaces base
spans by their kind, generalises capitalised terms and removes the rest.

All steps are DataFrame functions. Positions come from the lengths of what a
pattern matches and of what stands between, in code points. The patterns are
written for Java's matcher so that none backtracks into, or recurses over, a
long run; each is equal to the plain one given beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import bitmap, in_bitmap, written

KINDS = ("email", "ip", "card", "phone")
#: What every match of a kind holds, as a cheap test of whole texts ("" for none).
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ : a match begins where its run does, or where the last match ended
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 16 to 19 digits : matches are the maximal chains
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
WORD = r"\p{L}+"


@dataclass(frozen=True)
class PiiParams:
    """``support``: least documents of a pair (most personal data stand in one); ``slack``: bits below the entity's information content."""

    support: int = 1
    slack: float = 0.5
    min_letters: int = 3


def placed(text: Column) -> Column:
    """All words of a text in order, each with the length of what stands before it since the last one."""
    pieces, words = F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.zip_with(F.transform(F.slice(pieces, 1, F.size(pieces) - 1), F.length), words, lambda gap, word: F.struct(gap.alias("gap"), word.alias("word")))


def _terms(words: Column, params: PiiParams) -> Column:
    """The distinct terms among words: in lower case, of ``min_letters`` or more."""
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= params.min_letters), F.lower))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _found(kind: str) -> Column:
    """Of each match of a kind: how much stands before it since the last one, and its value."""
    pieces, matches = F.col(f"p_{kind}"), F.col(f"m_{kind}")

    def of(i: Column) -> Column:
        value = F.get(matches, i)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(F.get(pieces, i)).alias("gap"), F.length(value).alias("len"), value.alias("value"))

    made = F.transform(F.sequence(F.lit(0), F.greatest(F.size(matches) - 1, F.lit(0))), of)
    return F.filter(made, lambda x: x["i"] < F.size(matches))


def mentions(documents: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text), all matches of each document, valid or not, and all words of those that have any."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), text.alias("text"))
    none = F.array().cast("array<string>")
    for kind in KINDS:
        may = F.col("text").rlike(PATTERNS[kind])
        out = out.withColumn(f"may_{kind}", F.contains("text", F.lit(HINTS[kind])) & may if HINTS[kind] else may)
    split = [F.when(F.col(f"may_{k}"), F.split("text", PATTERNS[k], -1)).otherwise(none).alias(f"p_{k}") for k in KINDS]
    matched = [F.when(F.col(f"may_{k}"), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"m_{k}") for k in KINDS]
    words = F.when(F.greatest(*(F.col(f"may_{k}") for k in KINDS)), placed(F.col("text"))).alias("words")
    return out.select("doc_id", "row", words, *split, *matched).select("doc_id", "row", "words", F.concat(*(_found(k) for k in KINDS)).alias("found"))


def base_spans(found: DataFrame) -> DataFrame:
    """A row per valid match: doc_id, row, kind (its place in ``KINDS``), start, end, value (lower case).

    Positions are running sums within a document, so a document may have any
    number of matches. Repeated rows give their spans once.
    """
    one = found.where(F.size("found") > 0).select("doc_id", "row", F.explode("found").alias("s")).select("doc_id", "row", "s.*")
    once = one.repartition("doc_id", "row").dropDuplicates(["doc_id", "row", "kind", "i"])
    so_far = Window.partitionBy("doc_id", "row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = once.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far).cast("int")).withColumn("start", F.col("end") - F.col("len"))
    valid = F.lit(True)
    for k, kind in enumerate(KINDS):
        valid = F.when(F.col("kind") == k, _valid(kind, F.col("value"))).otherwise(valid)
    return placed.where(valid).select("doc_id", "row", "kind", "start", "end", F.lower("value").alias("value"))


def disclosing(documents: DataFrame, found: DataFrame, base: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """(kind, value, term) of each entity and each term that reveals it, with ic and pmi in bits, and whether the term stands in documents without an entity.

    A pair's PMI comes within ``slack`` of the IC exactly where its documents
    are 2 ** -slack of the term's or more, and the documents that hold any
    entity are no fewer than the pair's: by them most words drop out before
    they meet entities.
    """
    share = 2.0**-params.slack
    of = base.groupBy(F.col("doc_id").alias("of"), F.col("row").alias("of_row")).agg(F.collect_set(F.struct("kind", "value")).alias("entities"))
    joined = found.where(F.size("found") > 0).join(of, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row")))
    holding = written(joined.select("entities", _terms(F.col("words.word"), params).alias("terms")), "pii-holding")
    near = holding.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    words = _terms(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}]+"), params)
    held = documents.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    may = (F.col("n_near") >= params.support) & (F.col("n_near") >= F.col("n_term") * share)
    wanted = written(near.join(held, "term").where(may).select(F.col("term").alias("word"), "n_term", "n_near"), "pii-wanted")
    asked = holding.select("entities", "terms", bitmap(wanted).alias("bits")).select("entities", F.explode(F.expr(f"filter(terms, t -> {in_bitmap('t')})")).alias("word"))
    # Written before the pairs are counted: a frequent term's rows may then be dealt to many tasks.
    shown = written(asked.join(wanted, "word"), "pii-shown")
    pairs = shown.select(F.explode("entities").alias("e"), F.col("word").alias("term"), "n_term", "n_near").groupBy("e.kind", "e.value", "term", "n_term", "n_near").agg(F.count("*").alias("both"))
    pairs = pairs.where((F.col("both") >= params.support) & (F.col("both") >= F.col("n_term") * share))
    entity = holding.select(F.explode("entities").alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("n_entity"))
    rated = pairs.join(entity, ["kind", "value"]).withColumn("n_docs", F.lit(found.count()))
    ic = -F.log2(F.col("n_entity") / F.col("n_docs"))
    pmi = F.log2(F.col("both") * F.col("n_docs") / (F.col("n_term") * F.col("n_entity")))
    return rated.select("kind", "value", "term", ic.alias("ic"), pmi.alias("pmi"), (F.col("n_near") < F.col("n_term")).alias("outside"))


def occurrences(worded: DataFrame, terms: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """doc_id, row, start, end of every occurrence of a term (column ``word`` of ``terms``); ``worded`` has doc_id, row and words as ``placed`` gives them.

    Positions are running sums within a document, of any number of words.
    Repeated rows give theirs once.
    """
    # Two bitmaps, of words and of words read backwards: few documents pass that hold no term.
    both = f"{in_bitmap('lower(w.word)')} and {in_bitmap('reverse(lower(w.word))', 'again')}"
    asked = worded.withColumns({"bits": bitmap(terms), "again": bitmap(terms.select(F.reverse("word").alias("word")))})
    one = asked.where(F.expr(f"exists(words, w -> {both})")).select("doc_id", "row", "bits", "again", F.posexplode("words").alias("i", "w"))
    may = (F.length("w.word") >= params.min_letters) & F.expr(both)
    one = one.select("doc_id", "row", "i", "w.gap", F.length("w.word").alias("len"), F.when(may, F.lower("w.word")).alias("word"))
    once = one.repartition("doc_id", "row").dropDuplicates(["doc_id", "row", "i"])
    so_far = Window.partitionBy("doc_id", "row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ended = once.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far).cast("int")).where(F.col("word").isNotNull())
    return ended.join(terms, "word", "left_semi").select("doc_id", "row", (F.col("end") - F.col("len")).alias("start"), "end")


def personal_data(documents: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms; and row and all spans as an array.

    A null text counts as empty and has no spans. Repeated rows each give a row
    and each count as documents; null ids are kept. An empty table gives no
    rows. Other columns are not read.
    """
    found = written(mentions(documents), "pii-found")
    base = written(base_spans(found), "pii-base")
    revealing = written(disclosing(documents, found, base, params), "pii-disclosing")
    terms = written(revealing.groupBy(F.col("term").alias("word")).agg(F.max("outside").alias("outside")), "pii-terms")
    # Documents with matches have their words at hand; of the others only those are split that hold a term that stands outside.
    text = F.coalesce(F.col("text"), F.lit(""))
    others = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), placed(text).alias("words"))
    inside = occurrences(found.where(F.size("found") > 0).select("doc_id", "row", "words"), terms, params)
    outside = occurrences(others, terms.where("outside"), params)
    added = written(inside.unionByName(outside).withColumn("kind", F.lit(len(KINDS))).distinct(), "pii-added").select("doc_id", "row", "kind", "start", "end")
    # Terms that overlap base spans go: those that an earlier span reaches into, or that reach into a later one.
    spans = base.select("doc_id", "row", "kind", "start", "end").unionByName(added)
    order = Window.partitionBy("doc_id", "row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("doc_id", "row").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    is_base = F.col("kind") < len(KINDS)
    reach = F.max(F.when(is_base, F.col("end"))).over(order)
    ahead = F.min(F.when(is_base, F.col("start"))).over(back)
    spans = spans.withColumn("apart", (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))).where(is_base | F.col("apart"))
    per_row = spans.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("all"))
    per_row = per_row.select(F.col("doc_id").alias("of"), F.col("row").alias("of_row"), "all")
    joined = found.select("doc_id", "row").join(per_row, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row")), "left")
    out = joined.select("doc_id", "row", F.coalesce("all", F.array().cast("array<struct<kind:int,start:int,end:int>>")).alias("all"))
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))

    def written_out(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    digest = F.sha2(written_out(F.filter("all", lambda s: s["kind"] < len(KINDS))), 256)
    return out.select("doc_id", *counts, digest.alias("base_sha256"), written_out(F.col("all")).alias("spans"), number(len(KINDS)).alias("n_terms"), "row", "all")


def sanitised(documents: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """doc_id and text with personal data replaced: [EMAIL] and so on, [TERM] for capitalised terms, nothing for others.

    Of spans that overlap, the one that begins first (then the longer) counts.
    """
    names = F.array(*(F.lit(k.upper()) for k in (*KINDS, "term")))
    sorted_spans = F.sort_array(F.transform("all", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), F.get(names, s["kind"]).alias("kind"))))
    spans = personal_data(documents, params).select(F.col("doc_id").alias("of"), F.col("row").alias("of_row"), sorted_spans.alias("all")).distinct()
    texts = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(spans, texts["doc_id"].eqNullSafe(spans["of"]) & (F.col("row") == F.col("of_row")), "left")

    def further(acc: Column, s: Column) -> Column:
        end = -s["neg"]
        term = F.substring(F.col("text"), s["start"] + 1, F.lit(1))
        mark = F.when((s["kind"] == "TERM") & (F.lower(term) == term), F.lit("")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        grown = F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), mark).alias("out"))
        return F.when(s["start"] >= acc["at"], grown).otherwise(acc)

    made = F.aggregate("all", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), further, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return joined.select("doc_id", F.when(F.size("all") > 0, made).otherwise(F.col("text")).alias("text"))
