"""Document operators against brute force: real tables, and the odd rows of ``ODD``."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import subprocess
import sys
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from scanloom.llm import common, decontaminate, hostrules, htmltext, licenses, mixing, oracles, pii, quality, simhash, tokencount, tokenfile
from scanloom.llm.common import table, written
from scanloom.llm.queries import ORACLES, QUERIES

#: Nulls, empty and long texts, ties, repeated rows, null ids, and columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score double, n_words string, shard int, term string, `key` string, fp string, size int, kept int, kept_id int, bad_row int, `of` int, `order` int, nth int"
LONG = "word other " * 20_000 + "Licensed under the Apache License, Version 2.0. a@b.example 10.0.0.1"


def odd(spark):
    texts = [(1, None), (2, ""), (2, ""), (3, " \t\n"), (None, "one two three four five"), (None, None), (4, "é ÀB ß"), (5, LONG), (5, LONG), (6, LONG + "!"), (7, "one two three four five"), (8, "x"), (8, "y z\x85w")]
    extra = (None, 7, 0.5, "n", 3, "t", "k", "f", 9, 0, 1, 2, 3, 4, 5)
    rows = [(i, t, "en", [None, "a", "b"][k % 3], *extra[:1], *extra[1:]) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SMALL, "documents")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def both(spark, documents):
    return (documents, odd(spark))


# 1: licences


def license_of(text):
    counts = [(name, Counter(re.findall(licenses.WORDS, s.lower()))) for name, s in licenses.NOTICES]
    seen = Counter(w for _, c in counts for w in c)

    def unit(c):
        v = {w: k * (math.log((1 + len(counts)) / (1 + seen.get(w, 0))) + 1) for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    best = None
    joined = re.sub(licenses.LINE_MARK.replace("(?dm)", "(?m)"), " ", text or "")
    for sentence in re.split(licenses.SENTENCE_END, text or "") + re.split(licenses.PARAGRAPH_END, joined):
        terms = re.findall(licenses.WORDS, sentence.lower())
        if terms:
            u = unit(Counter(terms))
            for name, c in counts:
                v = unit(c)
                score = round(sum(x * v.get(w, 0) for w, x in u.items()), 6)
                if score >= 0.7 and (best is None or (-score, name) < best):
                    best = (-score, name)
    return best and best[1]


def test_licenses_match_brute_force(spark, documents):
    for docs in both(spark, documents):
        got = licenses.license_scan(docs, F.concat_ws("/", F.col("source"), F.col("lang")))
        own = rows_of(got.select("doc_id", F.when(F.col("origin").isin("file", "header"), F.col("license")).alias("own")), "doc_id", "own")
        assert own == Counter((r.doc_id, license_of(r.text)) for r in docs.collect())


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code"), (3, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "a/b/c/y.py", None), (5, "z.py", "code"), (6, "a/b/h.py", "x\n# Licensed under the Apache License, Version 2.0. " + "w " * 50), (7, None, None), (8, "ab/x.py", "code"),
    ]
    got = {r.doc_id: (r.license, r.origin, r.licensed_by) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert got == {
        1: ("MIT", "file", None), 2: ("MIT", "inherited", "a"), 3: ("GPL-3.0", "file", None), 4: ("GPL-3.0", "inherited", "a/b/c"),
        5: (None, "none", None), 6: ("Apache-2.0", "header", None), 7: (None, "none", None), 8: (None, "none", None),
    }


def test_wrapped_headers_and_licence_texts_are_found(spark):
    import textwrap

    code = "int main(void) {\n" + "\n".join(f"    call_{k}(alpha, beta[{k}]);" for k in range(150)) + "\n}\n"
    gnu = "foo does things\n\nCopyright (C) 2020 Jane Doe\n\nThis {0} is free software{3} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.\n\nThis {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details.\n\nYou should have received a copy of the GNU {1} along with this {0}. If not, see <http://www.gnu.org/licenses/>."
    bsd = dict(licenses.HEADERS)["BSD-2-Clause"].replace("(c)", "(c) 2019, Jane Doe.")
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    headers = {
        "GPL-2.0": gnu.format("program", "General Public License", 2, ";"), "GPL-3.0": gnu.format("program", "General Public License", 3, ":"),
        "LGPL-2.1": gnu.format("library", "Lesser General Public License", 2.1, ";"), "BSD-2-Clause": bsd, "MPL-2.0": mpl,
    }
    rows, expected = [], {}
    for name, text in headers.items():
        lines = [x for part in text.split("\n") for x in (textwrap.wrap(part, 60) or [""])]
        shapes = ("# " + "\n# ".join(lines), "/*\n * " + "\n * ".join(lines) + "\n */", "/* " + "\n   ".join(lines) + " */", "<!--\n" + "\n".join(lines) + "\n-->")
        for shape in shapes:
            expected[len(rows)] = (name, "header")
            rows.append((len(rows), f"{name}/{len(rows)}/x.c", f"{shape}\n{code}"))
    for name, text in licenses.whole_templates()[-len(licenses.TEXTS) - 1 :]:
        expected[len(rows)] = (name, "file")
        rows.append((len(rows), f"all/{name}/COPYING", text))
    expected[len(rows)] = (None, "none")
    rows.append((len(rows), "none/x.c", f"# copyright checks happen here\n{code}"))
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path"))
    assert {r.doc_id: (r.license, r.origin) for r in got.collect()} == expected


# 2: quality


def test_quality_on_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    scored = QUERIES["op2_quality"](spark, big).join(table(spark, big, "labels"), "doc_id").where("held_out").toPandas()
    assert len(scored) > 500 and ((scored.predicted == 1) == (scored.quality == 1)).mean() > 0.97
    assert scored.predicted[scored.quality == 1].mean() > 0.995
    assert all(h == (crc32(str(i).encode()) % 5 == 0) for i, h in zip(scored.doc_id, scored.held_out))


def test_quality_of_odd_rows(spark, documents):
    weights = quality.fit_quality(documents, table(spark, SMALL, "labels"))
    docs = odd(spark)
    got = quality.score_quality(docs, weights).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2)} == {quality.score_text("", weights.astype(np.float32))}
    kept = quality.good_documents(docs, weights)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    none = quality.fit_quality(documents.limit(0), table(spark, SMALL, "labels"))
    assert not none.any()


def test_quality_learns_from_no_held_out_row(spark, documents):
    labels = table(spark, SMALL, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit_quality(documents, labels) == quality.fit_quality(documents, turned)).all()


# 3: token counts


def segmented(word, model):
    """Fewest tokens of the best segmentation, without sharing anything."""
    text = tokencount.MARK + word
    best = [(0.0, 0)]
    for i in range(1, len(text) + 1):
        char, size = text[i - 1], len(text[i - 1].encode())
        options = [(best[j][0] + model.scores[text[j:i]], -best[j][1] - 1) for j in range(i) if text[j:i] in model.scores]
        if char not in model.scores:
            options.append((best[i - 1][0] + model.unknown * size, -best[i - 1][1] - size))
        score, n = max(options)
        best.append((score, -n))
    return best[-1][1]


def test_token_counts_match_brute_force(spark, documents):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = tokencount.load_model(path)
    known: dict[str, int] = {}

    def total(words):
        for w in words:
            if w not in known:
                known[w] = segmented(w, model)
        return sum(known[w] for w in words)

    for docs in both(spark, documents):
        got = tokencount.token_counts(docs, path)
        assert rows_of(got, "doc_id", "n_words", "n_tokens") == Counter((r.doc_id, len(words_of(r.text)), total(words_of(r.text))) for r in docs.collect())


def test_terminal_counts_of_small_models():
    model = tokencount.UnigramModel.of(["ab", "abc", "c", "a", "b", "▁", "▁a"])
    words = ["", "a", "ab", "abc", "abcc", "b", "zz", "é", "abab", "ab" * 50]
    assert tokencount.terminal_counts(words, model) == {w: segmented(w, model) for w in words}


# 4: near-duplicates


def fingerprint(text):
    w = words_of(lowered(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def sets_of(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_near_duplicates_match_brute_force(spark, documents):
    for docs in both(spark, documents):
        rows = docs.collect()
        prints = [fingerprint(r.text) for r in rows]
        sets = sets_of(prints)
        least = {s: min((r.doc_id for r, t in zip(rows, sets) if t == s and r.doc_id is not None), default=None) for s in set(sets)}
        expected = Counter((r.doc_id, f"{p:016x}", least[s]) for r, p, s in zip(rows, prints, sets))
        assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
        assert simhash.deduplicated(docs).count() == len(set(sets))
        assert simhash.deduplicated(docs).columns == docs.columns


@pytest.mark.parametrize("shares", [1, 4])
def test_keys_on_a_third_of_the_rows(spark, monkeypatch, shares):
    for module in (common, simhash):
        monkeypatch.setattr(module, "HOT_SHARES", shares)
    texts = {k: f"text number {k} of its own kind {k * k} {k % 7}" for k in range(30)}
    rows = [(100, texts[0], "hot")] * 30 + [(k, texts[1], "copy") for k in range(200, 230)] + [(None, texts[2], "no id")] * 2 + [(k, texts[k], "alone") for k in range(3, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, u string")
    sets = sets_of([fingerprint(r[1]) for r in rows])
    expected = Counter((r[0], min((x[0] for x, t in zip(rows, sets) if t == s and x[0] is not None), default=None)) for r, s in zip(rows, sets))
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "component_id") == expected
    kept = simhash.deduplicated(docs).collect()
    assert len(kept) == len(set(sets)) and {r.doc_id for r in kept} == {c for _, c in expected}
    facts = docs.where("doc_id is not null and u <> 'alone'").groupBy("doc_id").agg(F.count("*").alias("__n"), F.max("u").alias("fact"))
    got = common.joined(docs.where("doc_id is not null"), facts, ["doc_id"], len(rows), "left")
    assert rows_of(got, "doc_id", "fact") == Counter((r[0], None if r[2] == "alone" else r[2]) for r in rows if r[0] is not None)


@pytest.mark.parametrize("cap, shares", [(4096, 1000), (8, 1000), (8, 4)])
def test_links_find_all_sets(spark, monkeypatch, cap, shares):
    monkeypatch.setattr(common, "HOT_SHARES", shares)
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            v = base
            for _ in range(rng.randrange(7)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)

    def signed(v):
        return v - (1 << 64) if v >> 63 else v

    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    root = {r.u: r.v for r in simhash.contracted(simhash.links(nodes, cap)).collect()}
    got = [root.get(signed(v), signed(v)) for v in values]
    expected = sets_of(values)
    assert len(set(zip(got, expected))) == len(set(expected)) == len(set(got))


def test_large_bucket_links():
    rng = np.random.default_rng(1)
    values = np.unique(np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << rng.integers(0, 64, (300, 2)).astype(np.uint64)).sum(axis=1, dtype=np.uint64))
    member, first = simhash.large_links(values)
    root = dict(zip(member.tolist(), first.tolist()))
    got = [root.get(int(v), int(v)) for v in values]
    expected = sets_of([int(v) for v in values])
    assert len(set(zip(got, expected))) == len(set(expected)) == len(set(got))


# 5: token files


def test_tokens_round_trip(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k, docs in enumerate(both(spark, documents)):
        path = f"{tmp_path}/{k}"
        tokenfile.write_tokens(docs, tokenfile.Vocabulary(public_tokenizers.path("word_bpe_49k.json")), path)
        at, expected = 0, []
        for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
            expected.append((r.doc_id, at, len(ids), crc32(np.array(ids, "<u4").tobytes()), tuple(ids)))
            at += len(ids)
        got = tokenfile.read_tokens(spark, path, with_ids=True).collect()
        assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in got), key=lambda r: r[1]) == expected


@pytest.mark.parametrize("buffer", [1 << 20, 40])
def test_encoder_agrees_with_the_tokenizer(monkeypatch, buffer):
    monkeypatch.setattr(tokenfile, "BUFFER", buffer)
    vocabulary = tokenfile.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    encoder = tokenfile.encoder(vocabulary)
    rng = random.Random(1)
    atoms = ["a", "B", "é", "É", "é", "J̌", "Σ", "|", " | ", ".", "'s", "'", "!!", "%%%", " ", "\n", "\x85", "\xa0", " ", "\x1c", "9", "٣", "<|endoftext|>", "😀", "the", "Thing,", "İ", "\x00", "_", "$$$"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(25))) for _ in range(3000)]
    for text, got in zip(texts, encoder.encoded(texts)):
        assert np.frombuffer(got, "<u2").tolist() == [*encoder._ids(text), 2], text


def test_added_tokens_in_any_case():
    encoder = tokenfile.encoder(tokenfile.Vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    rng = random.Random(3)
    texts = ["<|EndOfText|>", "x <|STARTOFTEXT|> y", "Thing<|endoftext|>THE", "<|endoftext|>.", "<|endoftext|>é", "<|ENDOFTEXT|>\u0301A", "A <|endoftext| >"]
    for token in encoder.tokenizer.get_added_tokens_decoder().values():
        for _ in range(150):
            cased = "".join(rng.choice((c, c.upper())) if rng.random() < 0.2 else c for c in token.content)
            texts.append("".join(rng.choice(["Aé ", cased, token.content, "B", ".", "|", " "]) for _ in range(rng.randrange(1, 9))))
    for text, got in zip(texts, encoder.encoded(texts)):
        assert np.frombuffer(got, "<u2").tolist() == [*encoder._ids(text), 2], text


def test_rows_of_one_id_are_dealt_to_many_shards(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.range(40_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("same beginning of all the texts, then "), (F.col("id") % 3).cast("string")).alias("text"))
    raw = tokenfile.tokenised(docs, tokenfile.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))).where("counts is null")
    sizes = [r.n for r in raw.groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 40_000 and max(sizes) < 20_000


def test_words_of_one_hash_are_told_apart(monkeypatch):
    real = tokenfile._words

    def colliding(raw):
        buffer, starts, sizes, hashes = real(raw)
        return buffer, starts, sizes, hashes % np.uint64(5)

    monkeypatch.setattr(tokenfile, "_words", colliding)
    encoder = tokenfile._Encoder(tokenfile.Vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    rng = random.Random(8)
    for n in (1, 2, 3, 40):
        for _ in range(60):
            text = " ".join(rng.choice(["the", "thing", "thing,", "a", "bb!", "|", "x.y", "Étage"]) for _ in range(n))
            assert np.frombuffer(encoder.encoded([text])[0], "<u2").tolist() == [*encoder._ids(text), 2]


MANY_WORDS = """
import random, re, sys
import numpy as np
from scanloom.llm import tokenfile

def memory(what):
    return int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10

encoder = tokenfile.encoder(tokenfile.Vocabulary(sys.argv[1]))
begin, rng = memory("VmRSS"), random.Random(5)
texts = [" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(500)) for _ in range(256)]
first = encoder.encoded(texts)
for _ in range(8):
    encoder.encoded([" ".join("".join(w) for w in zip(*[iter(rng.choices("abcdefghij", k=8 * 500))] * 8)) for _ in range(256)])
assert encoder.encoded(texts) == first
print(memory("VmHWM") - begin)
"""


def test_memory_of_many_distinct_words():
    """Over a million distinct words; a process of its own, whose peak of memory is known."""
    made = subprocess.run([sys.executable, "-c", MANY_WORDS, public_tokenizers.path("word_bpe_49k.json")], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert made.returncode == 0, made.stderr
    assert int(made.stdout) < 140  # MB


def test_streams_round_trip():
    rng = np.random.default_rng(2)
    for top in (1, 5, 256, 257, 70_000, 1 << 24, 1 << 31):
        for n in (0, 1, 3, 4, 1000):
            ranks = rng.integers(0, top, n).astype(np.uint32)
            assert (tokenfile.unpacked(*tokenfile.packed(ranks), n) == ranks).all()


# 6: decontamination


def contaminated(docs, items):
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))

    windows: dict[tuple, set] = {}
    for r in items:
        w = split(r.item_text)
        for i in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(r.item_id))
    sizes = {len(w) for w in windows}
    out = Counter()
    for r in docs:
        w, hit, found = split(r.text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                ids = windows.get(tuple(w[i : i + k]))
                if ids:
                    found |= ids
                    hit |= set(range(i, i + k))
        out[(r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    return out


def test_contamination_matches_brute_force(spark, documents):
    real = table(spark, SMALL, "benchmark")
    made = spark.createDataFrame([(1, "two three"), (1, "two three"), (2, None), (3, "!?"), (10, "word other " * 8), (4, "ß"), (None, "x")], "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for docs, items in ((documents, real), (odd(spark), made), (odd(spark), made.limit(0)), (odd(spark).limit(0), made)):
        items_rows = items.where("item_id is not null").select("item_id", F.col("text").alias("item_text")).collect()
        expected = contaminated(docs.collect(), items_rows)
        assert rows_of(decontaminate.contamination(docs, items.where("item_id is not null")), *columns) == expected
        clean = decontaminate.clean_documents(docs, items.where("item_id is not null"))
        assert clean.columns == docs.columns and clean.count() == sum(n for k, n in expected.items() if not k[-1])
    assert decontaminate.contamination(odd(spark), made).count() == odd(spark).count()  # an item without an id


def test_contamination_matches_its_sql(spark, duck):
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    theirs = Counter(duck.execute(f"select {', '.join(columns)} from ({ORACLES['op6_decontaminate']})").fetchall())
    assert rows_of(QUERIES["op6_decontaminate"](spark, SMALL), *columns) == theirs


# 7: host rules


def measures(text):
    w = words_of(text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_host_rules_match_brute_force(spark, documents):
    rng = random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choice("aab é\n\t|\x0b\x85  ") for _ in range(rng.randrange(80)))
        assert hostrules.measured(text)[:5] == measures(text)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for docs in both(spark, documents):
        expected = Counter()
        for r in docs.collect():
            m = measures(r.text)
            failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
            expected[(r.doc_id, *m, failed)] += 1
        got = hostrules.host_verdicts(docs)
        assert rows_of(got, *columns[:-1]) == expected
        assert got.where("kept and base_failed").count() == 0


def test_bad_hosts_lose_their_documents_and_small_ones_are_shrunk(spark):
    good = "the quick brown fox jumps over the lazy dog and then some more words follow here"
    rows = [(k, good if k % 10 else "x", f"good{k % 7}") for k in range(700)]
    rows += [(1000 + k, "x" if k % 20 else good, "bad") for k in range(200)] + [(2000, "x", "tiny"), (2001, good, "tiny")]
    got = {r.doc_id: r for r in hostrules.host_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[1000 + k].kept for k in range(200)) and got[2001].kept and all(got[k].kept == (k % 10 != 0) for k in range(700))


# 8: web pages


def test_only_hidden_attributes_hide_an_element():
    for shown in ('aria-hidden="false"', 'data-hidden="no"', 'title="A hidden gem"', "title='x hidden y'", "data-x=hidden", 'data-role="dialog"', 'aria-hidden = "false" lang=en', ""):
        assert htmltext._standing("div", f" {shown} ") == ""
    for apart in ("hidden", "HIDDEN", 'hidden=""', "hidden=until-found", 'class="x" hidden', 'aria-hidden="true"', "aria-hidden=TRUE", "aria-hidden = 'true'", 'style="display: none"', "role=dialog"):
        assert htmltext._standing("div", f" {apart} ") == "apart"
    text = "The quick brown fox jumps over the lazy dog and then walks home through the old town. " * 6
    page = f'<html><body><div title="A hidden gem"><p>{text}</p></div></body></html>'
    assert text.strip() in htmltext.main_text(page)


# 9: personal data


def spans_of(text):
    def luhn(digits):
        return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0

    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 16 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 8 <= len(d) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in tests.items() for m in re.finditer(p, text or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]


def test_base_spans_match_brute_force(spark, documents):
    rng = random.Random(3)
    atoms = ["1", "2", "4", "0", "9", "25", "255", ".", ".", " ", "-", "@", "a", "b.", "+", "(", ")", "%", "😀", "é", "4111111111111111", "4111 1111-1111 1111", "x@y.z", "+1 (555) 123-4567", "10.0.0.1"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(30))) for _ in range(1500)]
    texts += ["1 " * 60_000, "a" * 100_000, "a." * 50_000 + "@", "+" + "1 " * 50_000, "1.2.3." * 5_000, "4" * 100_000, "a@b" + ".c" * 50_000]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (documents, odd(spark), made):
        expected = Counter()
        for r in docs.collect():
            spans = spans_of(r.text)
            n = Counter(s.split(":")[0] for s in spans)
            expected[(r.doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans))] += 1
        got = pii.personal_data(docs).withColumn("base", F.regexp_replace("spans", ",?term:[0-9]+:[0-9]+", ""))
        assert rows_of(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base") == expected


def test_disclosing_terms_are_spans_and_go(spark):
    rows = [(k, f"please ask Zorblatt or zinkum at jane@x.example now number {k}") for k in range(6)]
    rows += [(10 + k, f"please ask anyone at all now about number {k}, or mail p{k}@x.example") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in pii.personal_data(docs).collect()}
    assert got[0] == ["email:33:47", "term:11:19", "term:23:29"]
    assert all(len(got[10 + k]) == 1 for k in range(30))
    assert pii.sanitised(docs).where("doc_id = 0").first().text == "please ask [TERM] or  at [EMAIL] now number 0"


def terms_of(docs, params=pii.PiiParams()):
    """(doc_id, term) of each marked occurrence by brute force: every word of every document, all entities."""
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    held, shown, seen = Counter(), Counter(), {}
    for k, (_, text) in enumerate(rows):
        entities = {(s.split(":")[0], text[int(s.split(":")[1]) : int(s.split(":")[2])].lower()) for s in spans_of(text)}
        seen[k] = {w.lower() for w in re.findall(r"[^\W\d_]+", text) if len(w) >= params.min_letters}
        held.update(seen[k])
        shown.update((e, t) for e in entities for t in seen[k])
    revealing = {t for (e, t), n in shown.items() if n >= params.support and n >= held[t] * 2**-params.slack}
    out = Counter()
    for doc_id, text in rows:
        spans = [tuple(map(int, s.split(":")[1:])) for s in spans_of(text)]
        for m in re.finditer(r"[^\W\d_]+", text):
            if m[0].lower() in revealing and all(m.end() <= a or m.start() >= b for a, b in spans):
                out[(doc_id, m.start(), m.end())] += 1
    return out


def marked(docs, params=pii.PiiParams()):
    spans = pii.personal_data(docs, params).select("doc_id", F.explode(F.split("spans", ",")).alias("s")).where("s like 'term:%'")
    return Counter((r.doc_id, *map(int, r.s.split(":")[1:])) for r in spans.collect())


def test_terms_of_whole_documents_are_marked_everywhere(spark, documents):
    far = "and " * 60
    rows = [(k, f"Zorblatt asks {far} at jane@x.example or joe@y.example now {far} then zorblatt again") for k in range(3)] + [(3, f"a letter to Zorblatt {far}")]
    rows += [(10 + k, f"asks {far} at p{k}@x.example or then again now letter") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = marked(docs)
    assert got == terms_of(docs)
    assert got[(0, 0, 8)] == got[(3, 12, 20)] == 1 and sum(n for (k, *_), n in got.items() if k == 0) == 2
    assert "orblatt" not in "".join(r.text for r in pii.sanitised(docs).collect())
    assert marked(documents) == terms_of(documents)


def test_terms_of_an_entity_in_one_document_are_marked(spark):
    rows = [(0, "please ask Quxley at jane@x.example now")] + [(k, "please ask anyone at all now") for k in range(1, 20)]
    rows += [(20, "mail Zorblatt at +1 555 123 4567 now"), (21, "mail Zorblatt now, or mail Wobbet")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert marked(docs) == terms_of(docs) == Counter({(0, 11, 17): 1})


# 10: mixing


def test_apportionment_gives_the_highest_quotients(spark):
    rng = random.Random(7)
    seats = {"a": 7, "b": 50, "c": 133, "d": 0}
    rows = [(rng.choice("abcd"), i, float(rng.randrange(50))) for i in range(60)]
    df = spark.createDataFrame([(g, i, v, seats[g]) for g, i, v in rows], "g string, i long, v double, s long")
    got = {(r.g, r.i): r.quota for r in mixing.apportioned(df, ["g"], "v", F.col("s"), ["i"]).collect()}
    for g, n in seats.items():
        votes = {i: v for h, i, v in rows if h == g}
        quota = dict.fromkeys(votes, 0)
        for _ in range(n):
            quota[min(votes, key=lambda i: (-votes[i] / (2 * quota[i] + 1), i))] += 1
        assert {i: got[g, i] for i in votes} == quota


def test_mixing_over_several_shards_matches_sql(spark, documents, duck):
    for params in (mixing.MixParams(shard_docs=15), mixing.MixParams(shard_docs=15, max_shards=2, block_words=5, seed=3), mixing.MixParams(cycle=(1.0, 9.0), total_share=1.9)):
        ours = mixing.mixed(documents, params).select("doc_id", "size", "source_size", "target", "taken")
        theirs = duck.execute(oracles.mixing_sql(params)).fetchall()
        assert len(theirs) == documents.count()
        assert Counter((*r[:3], round(r[3], 6), r[4]) for r in ours.collect()) == Counter((*r[:3], round(r[3], 6), r[4]) for r in theirs)


def test_mix_meets_its_targets(spark, documents):
    for docs, near in ((documents, 0.02), (odd(spark), 0.05), (odd(spark).limit(0), 0)):
        rows = docs.collect()
        got = mixing.mixed(docs).collect()
        assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len(words_of(r.text))) for r in rows)
        sizes = Counter()
        for r in rows:
            sizes[r.source] += len(words_of(r.text))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        pot, live, target = 1.5 * sum(sizes.values()), set(order), {}
        while live:
            rest, total = pot - sum(target.values()), sum(weights[s] for s in live)
            over = [s for s in live if rest * weights[s] / total > 2 * sizes[s]]
            target.update({s: 2.0 * sizes[s] for s in over} if over else {s: rest * weights[s] / total for s in live})
            live = live.difference(over) if over else set()
        taken = Counter()
        for r in got:
            assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6) and 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - target[s]) <= max(32, near * target[s]) for s in order)
        again = mixing.mixed(docs.repartition(3))
        assert rows_of(again, "doc_id", "size", "taken") == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_mixed_documents_hold_the_words_taken(spark, documents):
    for docs in both(spark, documents):
        taken = mixing.mixed(docs).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0")
        made = mixing.mixed_documents(docs)
        assert made.columns == docs.columns
        given = made.withColumn("n", mixing.word_count(F.col("text"))).groupBy("doc_id").agg(F.sum("n").alias("n"))
        assert rows_of(given, "doc_id", "n") == rows_of(taken, "doc_id", "n")


# all


def test_empty_tables(spark, tmp_path):
    none = odd(spark).limit(0)
    assert licenses.license_scan(none, F.col("source")).count() == 0
    assert tokencount.token_counts(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert simhash.near_duplicates(none).count() == simhash.deduplicated(none).count() == 0
    assert hostrules.host_verdicts(none).count() == pii.personal_data(none).count() == mixing.mixed_documents(none).count() == 0
    tokenfile.write_tokens(none, tokenfile.Vocabulary(public_tokenizers.path("word_bpe_49k.json")), f"{tmp_path}/none")
    assert tokenfile.read_tokens(spark, f"{tmp_path}/none").count() == 0
    assert htmltext.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert written(none, "none").count() == 0
