"""Operators against brute force, exact round trips and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from bags import bag
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwright.llm import byte_bpe, licenses, line_dedup, near_dup, pii, quality, suffix_dedup, topk, toxicity
from sparkwright.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", [*ORACLES])
def test_oracle(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    columns, expected = oracle(ORACLES[name])
    assert sorted(df.columns) == columns
    assert bag(df.collect()) == expected


# line dedup


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


text = st.text("abé", max_size=14)


@settings(max_examples=300, deadline=None)
@given(text, text, st.integers(1, 3))
def test_edit_distance(a, b, edits):
    assert line_dedup.edit_distance_at_most([(a, b)], edits)[0] == (edit_distance(a, b) <= edits)


def mutated(line, rng, edits):
    out = list(line)
    for _ in range(edits):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.insert(at, rng.choice("xyz")), lambda: out.__delitem__(at), lambda: out.__setitem__(at, rng.choice("xyz"))])()
    return "".join(out)


def test_lines_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    rng, docs = random.Random(5), []
    seeds = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 60))) for _ in range(12)]
    for i in range(60):
        lines = [mutated(rng.choice(seeds), rng, rng.randint(0, 3)) if rng.random() < 0.7 else "".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
        docs.append((i, "\n".join(lines)))
    lines = sorted({x for _, t in docs for x in t.split("\n") if len(x) >= 20})
    links = {x: [y for y in lines if y != x and edit_distance(x, y) <= 2] for x in lines}
    name = {x: x for x in lines}
    for _ in lines:
        name = {x: min([name[x], *(name[y] for y in links[x])]) for x in lines}
    seen, expected = set(), {}
    for i, t in docs:
        kept, n = [], 0
        for x in t.split("\n"):
            if x in name:
                n += len(links[x])
                if name[x] in seen:
                    continue
                seen.add(name[x])
            kept.append(x)
        expected[i] = ("\n".join(kept), n)
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r["_kept"], r["_n_links"]) for r in got.collect()} == expected
    assert sum(n for _, n in expected.values()) > 100


def test_short_lines_by_equality(spark):
    """Short lines lose their exact repeats and nothing else; empty lines stay."""
    docs = [(1, "Read more\n\nRead mores\nRead more"), (2, "全著作権所有。\n\nRead more"), (3, "全著作権所有。\nRead mor"), (4, "a line that is long enough\nx"), (5, "x\na line that is long enoughs")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r["_kept"], r["_n_removed"], r["_n_links"]) for r in line_dedup.dedup(df, equal=1).collect()}
    assert got == {1: ("Read more\n\nRead mores", 1, 0), 2: ("全著作権所有。\n", 1, 0), 3: ("Read mor", 1, 0), 4: ("a line that is long enough\nx", 0, 1), 5: ("", 2, 1)}
    got = {r.doc_id: r["_n_removed"] for r in line_dedup.dedup(df, equal=8).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    got = {r.doc_id: r["_n_removed"] for r in line_dedup.dedup(df, equal=None).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_lines_of_repeated_rows(spark):
    """Of rows that are equal in doc_id and text one is first; links count once a line."""
    docs = [(1, "the first line of them all"), (2, "the first line of them all\nand a second, other one"), (2, "the first line of them all\nand a second, other one"), (None, "the first line of them, all"), (None, "the first line of them, all")]
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id or 9, r["_kept"], r["_n_removed"], r["_n_links"]) for r in got.collect()) == [
        (1, "the first line of them all", 0, 1), (2, "", 2, 1), (2, "and a second, other one", 1, 1), (9, "", 1, 1), (9, "", 1, 1),
    ]


def test_text_of_many_lines(spark):
    """100,000 equal lines take no longer than their number."""
    df = spark.createDataFrame([(1, "a line that comes again and again\n" * 100_000)], "doc_id long, text string")
    r = line_dedup.dedup(df).first()
    assert (r["_n_lines"], r["_n_removed"], r["_kept"]) == (100_001, 99_999, "a line that comes again and again\n")


def test_hot_line_keys(spark, monkeypatch):
    """Keys that overfill a bucket, links over several blocks and a class over all documents."""
    monkeypatch.setattr(line_dedup, "KEYS_HELD", 150)
    monkeypatch.setattr(line_dedup, "SLICE", 200)
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    docs = [(i, f"the very same beginning {i:02d} of every line here") for i in range(40)]
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert [(r["_n_removed"], r["_n_links"]) for r in sorted(got)] == [(0, 39)] + [(1, 39)] * 39


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=6, max_size=14), st.integers(1, 2), st.randoms())
def test_linked_lines_share_a_key(line, edits, rng):
    """Lines within the distance meet in a key that one of them has as a segment; the scalar and the batch form agree."""
    other = mutated(line, rng, rng.randint(0, edits))
    if len(other) < 6:
        return
    key, owner, own = line_dedup.line_keys([line, other], edits)
    pick = lambda k: dict(sorted(zip(key[owner == k].tolist(), own[owner == k].tolist(), strict=True), key=lambda x: x[1]))
    a, b = pick(0), pick(1)
    assert line == other or any(a[k] or b[k] for k in a.keys() & b.keys())
    assert len(owner[owner == 0]) == len(line_dedup.probes(len(line), edits))


# licenses


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL %s BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
NAMES = "3. Neither the name of Some Such University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


def test_license_templates(spark):
    holders = "THE AUTHORS OR COPYRIGHT HOLDERS"
    cases = [
        ("Under the MIT License. under the mit license", ["mit"]),
        (MIT % holders, ["mit", "mit-grant"]),
        ("Copyright 2020 Them\n\n" + MIT % "SOME SUCH COMPANY", ["mit", "mit-grant"]),
        ((MIT % holders).replace("\n\nTHE", "\n\nThe Software shall be used for Good, not Evil.\n\nTHE"), ["mit-grant"]),
        ((MIT % holders).replace("sublicense, ", ""), ["mit-grant"]),
        ((MIT % holders)[:220], ["mit-grant"]),
        (BSD % "", ["bsd-2", "bsd-grant"]),
        (BSD % NAMES, ["bsd-3", "bsd-grant"]),
        (BSD % "3. All advertising materials must say so.\n", ["bsd-grant"]),
        ("Licensed to the Some Such Body under one or more contributor license agreements", []),
        ("licensed under the Apache License, Version 1.1", []),
        ("permission is hereby granted free of any charge", []),
        ("the Apache License, Version 2.0; CC-BY-NC", ["apache-2", "cc-by-nc"]),
        ("GNU General Public License, version 3", ["gpl-3"]),
        ("a Creative Commons Attribution 4.0 International License", ["cc-by"]),
        ("a Creative Commons Attribution-NonCommercial 4.0 International License", ["cc-by-nc"]),
    ]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([*enumerate(t for t, _ in cases)], "doc_id long, text string")).collect()}
    assert [sorted({m.label for m in found[i].matches}) for i in range(len(cases))] == [labels for _, labels in cases]
    assert [m.first for m in found[0].matches if m.base] == [0, 4]


words = st.lists(st.sampled_from("abc"), max_size=12)


@settings(max_examples=300, deadline=None)
@given(words)
def test_automaton_against_expressions(found):
    """Every template's longest match at every place, as a regular expression over the words finds it."""
    templates = {"a b": r"a b ", "a [b] c": r"a (?:b )?c ", "b {2} c": r"b (?:\w ){0,2}c ", "(a | b c) [a | b] c": r"(?:a |b c )(?:a |b )?c "}
    text, expected = "".join(w + " " for w in found), []
    for i in range(len(found)):
        for k, pattern in enumerate(templates.values()):
            ends = [j for j in range(i, len(found) + 1) if re.fullmatch(pattern, text[2 * i : 2 * j])]
            expected += [(k, i, max(ends))] if ends else []
    assert licenses.Automaton([*templates]).find(found) == expected


def test_license_base_against_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op3_licenses"](spark, sf_dir).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    for i, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        words = word.findall(t.encode().lower().decode())
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        first, last = (min(p[0] for p in places), max(p[0] for p in places)) if places else (None, None)
        labels = ",".join(sorted({p[1] for p in places}))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), first, last, labels)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


# near-duplicates


def test_near_dup_blocks(spark, monkeypatch):
    """A family over several blocks, with links that only some members have."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 4)
    monkeypatch.setattr(near_dup, "SKETCH_BLOCK", 4)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(40):
        words = [*base]
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = f"x{rng.random()}"
        docs.append((i, " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in docs)]
    name = list(range(40))
    for _ in range(40):
        for a in range(40):
            for b in range(40):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    name[a] = min(name[a], name[b])
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(name))
    assert 1 < len(set(name)) < 40


def test_near_dup_strangers(spark, monkeypatch):
    """Documents of smaller ids that share buckets with a linked pair, and with nothing else, do not hide its link.

    Strangers are made from the pair's own smallest shingles under single hash functions, so that every table in which
    the pair meets has a stranger as its smallest member.
    """
    rng = random.Random(9)
    a = [f"w{i}" for i in range(60)]
    b = [*a[:-3], "x1", "x2", "x3"]
    pair = [near_dup.Shingler(5)(" ".join(w)) for w in (a, b)]
    assert 0.8 <= len(np.intersect1d(*pair)) / len(np.union1d(*pair)) < 0.95
    words = lambda n: " ".join(f"y{rng.random()}" for _ in range(n))
    docs = [(1000, " ".join(a)), (1001, " ".join(b))]
    # pieces of the common words: each keeps some sketches of the pair and has many shingles of its own
    docs += [(i, " ".join(a[k : k + 14]) + " " + words(8)) for i, k in enumerate(range(0, 44, 2))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(near_dup, "ROWS", 1)
    for least in (4, 8, 12):
        monkeypatch.setattr(near_dup, "LEAST_EQUAL", least)
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
        assert got == {i: 1000 if i >= 1000 else i for i, _ in docs}


@pytest.mark.parametrize("block", [2, 512])
def test_candidates_lose_no_pair(spark, monkeypatch, block):
    """All pairs of a bucket with enough equal sketches are in one family, whatever else is in the bucket."""
    from sparkwright.llm.common import Tables

    monkeypatch.setattr(near_dup, "SKETCH_BLOCK", block)
    rng = np.random.default_rng(4)
    n, width = 60, 2 * near_dup.SKETCHES
    sketches = rng.integers(0, 2**60, (n, width))
    base = rng.integers(0, 2**60, (6, width))
    for i in range(n):  # every document takes a few sketches of every base, and two of a common one
        for k in range(6):
            some = rng.choice(width, rng.integers(0, 5), replace=False)
            sketches[i, some] = base[k, some]
        sketches[i, [0, width - 1]] = base[0, [0, width - 1]]
    near = (sketches[:, None] == sketches[None]).sum(2) >= near_dup.LEAST_EQUAL
    root = list(range(n))
    for _ in range(n):
        root = [min(root[j] for j in range(n) if near[i, j] or i == j) for i in range(n)]
    reps = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sketches)], "doc_id long, sketches array<long>")
    edges = [tuple(r) for r in near_dup.candidates(reps, Tables(spark, "test")).collect()]
    assert all(near[a, b] for a, b in edges)
    got = list(range(n))
    for _ in range(n):
        for a, b in edges:
            got[a] = got[b] = min(got[a], got[b])
    assert got == root and len(set(root)) < n


def test_near_dup_rows_of_one_id(spark):
    """Rows of one doc_id are one document with the shingles of all its texts, as in the SQL."""
    import duckdb

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = [(1, a), (2, a + " end"), (2, b), (2, b), (3, b + " end"), (4, b + " more"), (5, c), (5, ""), (6, c + " end"), (7, a), (7, b), (8, b), (8, a), (9, "")]
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    expected = sorted(con.sql(ORACLES["op4_near_dup"]).fetchall())
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == expected
    assert {r[0]: r[2] for r in expected} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 2, 8: 2, 9: 9}


# personal data

#: The contract's patterns, as they stand.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(t):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text("a1.@+-% ()40", max_size=40))
def test_base_spans(t):
    assert pii.base_spans(t) == plain_spans(t)


def test_base_spans_of_documents(docs):
    for (t,) in docs.select("text").collect():
        assert pii.base_spans(t) == plain_spans(t)


def test_base_spans_linear():
    for t in ("1" * 200_000, "a" * 200_000, "a." * 100_000 + "@", "1." * 100_000, "+" * 100_000, "@" * 100_000):
        pii.base_spans(t)
        pii.tokens(t)


def held_out_mentions(field, texts):
    """(found, planted, wrongly found, decoys) of mentions in texts that the field was not fitted to."""
    found = mentions = wrong = decoys = 0
    for text in texts:
        text, marks = pii.planted(text, pii.base_spans(text))
        spans = set(pii.added_spans([text], [pii.base_spans(text)], field)[0])
        for kind, a, b in marks:
            hit = any(x < b and a < y for _, x, y in spans)
            if kind:
                mentions, found = mentions + 1, found + ((kind, a, b) in spans)
            else:
                decoys, wrong = decoys + 1, wrong + hit
    return found, mentions, wrong, decoys


def test_pii_held_out_mentions(spark):
    """Mentions in other forms are found in texts outside the sample; without skip potentials most numbers are not."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike '[0-9@]' and length(text) < 5000").orderBy("doc_id").select("text").limit(3000).collect()]
    field = pii.fit(texts[::2])
    found, mentions, wrong, decoys = held_out_mentions(field, texts[1::2])
    assert mentions > 30 and decoys > 10
    assert found >= 0.85 * mentions and wrong <= 0.1 * decoys
    plain = pii.Field(field.node, field.chain, np.zeros_like(field.skip))
    assert held_out_mentions(plain, texts[1::2])[0] < 0.7 * found


def test_pii_skip_edges_decide():
    """A number is personal data because the same number is so elsewhere; without the skip potential it is not."""
    rng = random.Random(7)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    field = pii.fit([f"call +1 {number()} now, or pay by {rng.randint(1, 900)} in {rng.randint(1900, 2030)}" for _ in range(300)])
    t = "call +1 (741) 555-3069 now. " + "Nothing here. " * 500 + "It was (741) 555-3069 then, not (233) 867-5301."
    a = t.rindex("(741)")
    assert pii.added_spans([t], [pii.base_spans(t)], field) == [[("phone", a, a + 14)]]
    plain = pii.Field(field.node, field.chain, np.zeros_like(field.skip))
    assert pii.added_spans([t], [pii.base_spans(t)], plain) == [[]]


def test_pii_long_tokens():
    """Tokens of a million code points take linear time."""
    import time

    for t in ("1" + "." * 1_000_000 + "a", "1" * 1_000_000, "." * 1_000_000 + "1", "(" * 1_000_000 + "@", "a(at)" * 200_000, "1 " * 200_000):
        began = time.perf_counter()
        spans = pii.tokens(t)
        pii.features(t, spans[:1])
        pii.labelled(spans, pii.base_spans(t))
        assert time.perf_counter() - began < 4


def test_pii_adds_the_repeat(spark, docs):
    """The second of the two numbers is added, whole and alone; also where the sample has such repeats itself."""
    t = "call +1 (741) 555-3069 now. Later (741) 555-3069 again."
    assert pii.added_spans([t], [pii.base_spans(t)], pii.train(docs)) == [[("phone", 34, 48)]]
    rng = random.Random(2)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    texts = [f"call +1 {(n := number())} now. Later {n} again, in {rng.randint(1900, 2030)} or {rng.randint(2, 60)} more." for _ in range(200)]
    free = [pii.unknown(x, s := pii.tokens(x), np.array([int(a < x.find(" now.")) for a, _ in s])).tolist() for x in texts]
    assert free == [[False, False, False, True, True, False, False]] * 200
    assert pii.added_spans([t], [pii.base_spans(t)], pii.fit(texts)) == [[("phone", 34, 48)]]


def test_features_of_whole_tokens():
    """What a long token has after any number of letters counts as what it has at once."""
    on = lambda t: {n for n, x in zip(pii.FEATURES, pii.features(t, [(0, len(t))])[0], strict=True) if x}
    assert on("字" * 500 + "x@y.z:/(12345)") == on("字x@y.z:/(12345)") >= {"at", "domain", "colon", "slash", "paren", "digits_5_6"}
    assert "digits_more" in on("字" * 300 + "1" * 20)


# passages


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40))
def test_smaller_before(values):
    expected = [max([j for j in range(i) if values[j] < v], default=-1) for i, v in enumerate(values)]
    assert suffix_dedup.smaller_before(np.array(values, np.int64)).tolist() == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2)] * 3), min_size=1, max_size=30))
def test_suffix_order(rows):
    keys = [np.array([r[k] for r in rows], np.uint64) for k in range(3)]
    assert [rows[i] for i in suffix_dedup.suffix_order(keys)] == sorted(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=48, max_size=60).map(lambda b: bytes(x % 2 + 97 for x in b[:4]) + b"c" * 44 + bytes(x % 2 + 97 for x in b[4:12])), min_size=1, max_size=8), st.randoms())
def test_longest_previous_factors(texts, rng):
    """Factors to 50 bytes, of documents in any order, against all pairs; strings that are alone have none."""
    n = suffix_dedup.LENGTH
    ids = [rng.randrange(5) for _ in texts]
    windows = [(ids[k], t[p : p + n], sum(map(len, texts[:k])) + p) for k, t in enumerate(texts) for p in range(len(t) - n + 1)]
    strings = [w for _, w, _ in windows]
    common = lambda a, b: next((k for k in range(n) if a[k] != b[k]), n)
    got = suffix_dedup.longest_previous_factors(np.frombuffer(b"".join(texts), np.uint8), np.array([p for _, _, p in windows]), np.array([i for i, _, _ in windows]))
    several = [(i, w) for i, w, _ in windows if strings.count(w) > 1]
    for (i, w, _), k in zip(windows, got.tolist(), strict=True):
        assert k == (max([common(w, v) for j, v in several if j < i], default=0) if strings.count(w) > 1 else 0)


def test_passages_go_by_factors(spark, monkeypatch):
    """The operator's answer comes from the factors: without them nothing goes."""
    docs = spark.createDataFrame([(1, "a passage of more than fifty bytes that stands in two documents"), (2, "see: a passage of more than fifty bytes that stands in two documents")], "doc_id long, text string").repartition(2)
    assert {r.doc_id: len(r.kept) for r in suffix_dedup.dedup(docs).collect()} == {1: 63, 2: 5}
    monkeypatch.setattr(suffix_dedup, "longest_previous_factors", lambda data, starts, ids: np.zeros(len(starts), np.int64))
    assert {r.doc_id: len(r.kept) for r in suffix_dedup.dedup(docs).collect()} == {1: 63, 2: 68}


@pytest.mark.parametrize("hot", [4_000, 2])
def test_passages_against_brute_force(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "LEAST_HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", 4_000)
    rng = random.Random(1)
    texts = sorted((i, t) for i, t in docs.select("doc_id", "text").collect())
    long = [t for _, t in texts if len(t) > 300]
    texts += [(1000 + i, (p := rng.choice(long))[(a := rng.randrange(len(p) - 200)) : a + rng.randint(40, 200)] + rng.choice(["é", "x"]) * rng.randint(0, 80)) for i in range(60)]
    first, expected = {}, {}
    for i, t in texts:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        expected[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    got = suffix_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    assert {r.doc_id: bytes(r.kept) for r in got.collect()} == expected


# toxicity and quality


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = QUERIES["op7_toxicity"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").toPandas()
    assert set(found["held_out"] == (found["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0)) == {True}
    held = found[found["held_out"]]
    rank = held["score"].rank()
    good, bad = rank[held["toxic"] == 1], (held["toxic"] == 0).sum()
    assert (good.mean() - (len(good) + 1) / 2) / bad > 0.75
    assert (held[held["toxic"] == 0]["predicted"] == 0).mean() > 0.95


def test_toxicity_finds_sentences():
    rng = random.Random(4)
    fill = lambda: " ".join(rng.choice("all is well with the good people of this town".split()) for _ in range(6))
    texts = [f"{fill()}. {fill() + ' moron ' + fill() if i % 8 == 0 else fill()}. {fill()}." for i in range(1600)]
    lexicon = toxicity.fit(texts, np.array([i % 8 == 0 for i in range(1600)], float))
    p, spans = toxicity.score(lexicon, "So it goes. A moron came. The end.")
    assert p > 0.5 and [("So it goes. A moron came. The end."[a:b]) for a, b, _ in spans] == [" A moron came"]
    assert toxicity.score(lexicon, "So it goes. The end.")[0] < 0.5


def test_length_is_not_toxic(spark):
    """Any number of neutral sentences stays below the threshold."""
    sf_dir = "/root/testdata/sf0.01"
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.train(docs, labels, ~held_out)
    for sentence in ("The train leaves at noon. ", "We went home and had some tea. ", "Das Haus steht am Fluss. "):
        assert toxicity.score(lexicon, sentence * 100_000)[0] < 0.5
    clean = docs.join(labels.where("toxic = 0"), "doc_id").orderBy("doc_id").select("text").limit(400).collect()
    calm = [r.text for r in clean if toxicity.score(lexicon, r.text)[0] == 0]
    assert len(calm) > 300 and toxicity.score(lexicon, "\n".join(calm))[0] < 0.5


@pytest.mark.parametrize("n", [0, 5, 4_000, 10**11, 10**15])
def test_sample_never_vanishes(spark, n):
    from sparkwright.llm.common import in_sample

    ids = spark.range(200_000).select(F.col("id").alias("doc_id"))
    got = ids.where(in_sample(F.col("doc_id"), "x", max(n, 200_000) if n > 4_000 else n, 20_000 if n <= 10**11 else 10**12)).count()
    share = 1 if n <= 4_000 else 20_000 / n if n == 10**11 else 10**12 / n
    assert abs(got - 200_000 * share) <= 6 * (200_000 * share) ** 0.5 + 1
    assert (20_000 << 63) // 10**15 > 0


def test_repeat_words():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 30))]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        assert quality.repeat_words(words) == len(covered)


def test_quality_base(spark, sf_dir):
    found = {r.doc_id: r for r in QUERIES["op10_quality"](spark, sf_dir).collect()}
    for i, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        words, seen, dup = WORD.findall(t), set(), 0
        for x in t.split("\n"):
            dup += bool(WORD.search(x)) and x in seen
            seen.add(x)
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup)
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words)) and (not r.kept or not r.base_failed)


def test_trees_monotone_and_accurate():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 2))
    y = ((x[:, 0] < 0.5) ^ (rng.random(2000) < 0.1)).astype(float)
    trees = quality.fit(x, y, [-1, 0])
    assert ((trees.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.95
    line = np.stack([np.linspace(0, 1, 200), np.full(200, 0.3)], axis=1)
    assert (np.diff(trees.score(line)) <= 1e-12).all()


def test_quality_learns(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = QUERIES["op10_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert (found["kept"] == (found["quality"] == 1)).mean() > 0.97


# tokens


@pytest.fixture(scope="module")
def codec():
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = byte_bpe.read_ranks(path)
    return byte_bpe._codec(byte_bpe.vocabulary(path, pattern)), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_tokens_of_any_text(codec):
    ours, theirs = codec

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def check(t):
        ids = ours.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t)
        assert ours.decode(ids).decode() == t
        spans = ours.spans(t)
        assert len(spans) == len(ids) // 4 and "".join(dict.fromkeys(t[a:b] for a, b in spans)) in t or len(set(spans)) <= len(spans)
        assert all(0 <= a <= b <= len(t) for a, b in spans)

    check()


def test_tokens_of_documents(spark, sf_dir, codec):
    got = {r.doc_id: r for r in QUERIES["op9_byte_bpe"](spark, sf_dir).collect()}
    for i, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = codec[1].encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_offsets_column(spark):
    df = spark.createDataFrame([(1, "naïve 😀 day")], "doc_id long, text string")
    r = byte_bpe.encode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, offsets=True).first()
    assert len(r.starts) == len(r.ends) == r.n_tokens and r.starts[0] == 0 and r.ends[-1] == 11


# search


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(1, 8), st.integers(1, 6))
def test_search_block(seed, n, dims, k):
    rng = np.random.default_rng(seed)
    rows, ids = rng.integers(-4, 5, (n, dims)), np.arange(n)
    got = topk.search_block(ids[:3], rows[:3], ids, rows, k)
    for q in range(min(3, n)):
        scores = rows @ rows[q]
        expected = sorted(((-s, i) for i, s in enumerate(scores.tolist()) if i != q))[:k]
        assert [(-s, i) for _, i, s in [x for x in got if x[0] == q]] == [(s, i) for s, i in expected]


def test_search_traverses_fewer_rows(monkeypatch):
    """Postings and bounds leave most rows of a skewed shard alone."""
    monkeypatch.setattr(topk, "CHUNK", 64)
    rng = np.random.default_rng(2)
    rows = np.where(rng.random((4_000, 32)) < 0.1, rng.integers(-200, 200, (4_000, 32)), 0).astype(float)
    shard = topk.Shard(np.arange(4_000), rows)
    for q in range(0, 4_000, 200):
        scores = rows @ rows[q]
        expected = sorted(((-int(s), i) for i, s in enumerate(scores.tolist()) if i != q))[:5]
        assert [(-s, i) for i, s in shard.search(q, rows[q], 5)] == expected
    assert shard.traversed < 0.6 * 20 * 4_000


def test_search_of_large_components(spark):
    """Scores of any finite components are ranked by their exact values."""
    rows = [(0, [1e17, 1.0]), (1, [1e17, -1.0]), (2, [2e17, 1.0]), (3, [-1e17, 0.0]), (4, [0.5, 0.25]), (5, [1e300, 0.0]), (6, [2e300, 0.0]), (7, [-1e300, 1.0]), (8, [-2e300, 1.0])]
    exact = {i: [int(v) * 256 if abs(v) > 2**53 else int(v * 256) for v in x] for i, x in rows}
    expected = sorted((-sum(a * b for a, b in zip(exact[0], exact[i], strict=True)), i) for i in range(1, 9))
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 8).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in expected]


def test_search_in_many_blocks(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)
    cut = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5, query_block=3, candidate_block=70)
    assert bag(whole.collect()) == bag(cut.collect())
