"""Operators over documents against brute force on a small corpus with planted cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from railweave.llm import ngram_join as ngram_module
from railweave.llm import spotsigs
from railweave.llm.licences import scan_licences
from railweave.llm.mixing import mix_sources
from railweave.llm.ngram_join import ngram_join
from railweave.llm.spotsigs import fingerprint_query, near_classes
from railweave.llm.substring_dedup import strip_repeats, substring_digest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    docs, passage = [], make(70)
    for i in range(60):
        docs.append(" ".join(make(rng.randint(1, 200))))
    base = make(150)
    for i in range(150):  # a large group of near copies
        w = list(base)
        w[rng.randrange(150)] = f"new{i}"
        docs.append(" ".join(w))
    docs += [docs[3]] * 40  # a large group of copies
    for _ in range(30):  # a passage that many documents share
        docs.append(" ".join(make(30) + passage + make(30)))
    docs += [None, "", "   \n", "one", "ONE", "x " * 9000, " ".join(make(20_000)), "a b c"]
    rng.shuffle(docs)
    return [(i * 3, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(docs)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs).collect()}
    assert got == brute_components(ROWS)


def test_ngram_join_without_rows_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ngram_join(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f", 0), (1, "a b c d e f", 0), (None, "x", 0), (2, "a b c d e f", 0)], "doc_id long, text string, n int")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join(twice).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1)]


def test_ngram_join_of_one_id_with_several_texts(spark):
    rng = random.Random(8)
    a, b, c = ([f"{k}{rng.random()}" for _ in range(100)] for k in "abc")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (5, ""), (6, " ".join(b))]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.class_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 96, 2, 5), (2, 96, 2, 2), (3, 96, 2, 3), (4, 96, 4, 4), (5, 0, 2, 5), (6, 96, 2, 5)}


def test_substring_digest_of_one_id_with_several_texts(spark):
    a, c, tail = (" ".join(f"{k}{i}" for i in range(60)) for k in "act")
    rows = [(0, a), (5, f"{a} {tail}"), (5, c), (5, f"{a} {tail}"), (None, a), (6, "")]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 60, 0), (-1, 60, 0), (5, 60, 0), (5, 120, 60), (5, 120, 60), (6, 0, 0)]
    assert sorted(len((r.text or "").split()) for r in strip_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [0, 60, 60, 60, 60, 60]


def long_words():
    """Two words of 2,048 bytes that polynomials modulo 2**64 cannot tell apart."""
    return tuple("".join(pair[bin(i).count("1") % 2] for i in range(2048)) for pair in ("ab", "ba"))


def test_words_that_hash_alike_modulo_a_power_of_two(spark):
    x, y = long_words()
    tail = " ".join(f"t{i}" for i in range(60))
    rows = [(1, f"{x} " * 4 + x), (2, f"{y} " * 4 + y), (3, f"{x} {tail}"), (4, " ".join([y, *tail.split()[:49], "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.n_removed for r in substring_digest(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_ngram_join_splits_tokens_and_groups(spark, docs, monkeypatch):
    for name, value in (("HOT", 20), ("GROUP", 16), ("QUERIES", 8), ("LED", 2), ("DEALT", 3000), ("CELLS", 200)):
        monkeypatch.setattr(ngram_module, name, value)
    want = brute_components(ROWS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs).collect()} == want


def test_substring_digest(docs):
    least = {}
    for i, t, *_ in ROWS:
        w = words(t)
        for k in range(len(w) - 49):
            least.setdefault(tuple(w[k : k + 50]), i)
    want = {}
    for i, t, *_ in ROWS:
        w = words(t)
        stay = [True] * len(w)
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < i:
                stay[k : k + 50] = [False] * 50
        kept = [x for x, s in zip(w, stay, strict=True) if s]
        want[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_digest(docs).collect()}
    assert got == want
    assert sum(1 for v in want.values() if v[1]) > 50


def test_strip_repeats_keeps_columns(spark, docs):
    out = strip_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    kept = {r.doc_id: r.text for r in out.collect()}
    untouched = [r for r in ROWS if r[1] is None or len(words(r[1])) < 50]
    assert all(kept[r[0]] == r[1] for r in untouched)
    clash = spark.createDataFrame([(1, "a", "g", "h")], "doc_id long, text string, gone string, a string")
    assert strip_repeats(clash).collect()[0].text == "a"


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprint_query(docs).collect()}
    text = {r[0]: r[1] or "" for r in ROWS}
    ids = sorted(text, reverse=True)
    for k, i in enumerate(ids):
        after = text[ids[(k + 1) % len(ids)]]
        cut = len(text[i]) // 3
        edited = text[i][: len(text[i]) - cut] + after[:cut]
        assert got[i].n_chars == len(text[i])
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sets = [set(f.split()) for f in (got[i].fingerprint, got[i].edited_fingerprint, got[ids[(k + 1) % len(ids)]].fingerprint)]
        like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        assert got[i].near_edited == pytest.approx(like(sets[0], sets[1]))
        assert got[i].near_next == pytest.approx(like(sets[0], sets[2]))
    by_text = {}
    for i, t in text.items():
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def brute_signatures(text):
    w = [x for x in re.split(r"[^\w]+|_+", (text or "").lower()) if x]
    found = set()
    for i, x in enumerate(w):
        chain = [y for y in w[i + 1 : i + 9] if y not in spotsigs.COMMON][:2]
        if x in spotsigs.COMMON and chain:
            found.add((x, *chain))
    return found or {("", x) for x in w} or ({("", text)} if text else set())


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(3)
    pool = [*spotsigs.COMMON[:30], *(f"w{i}" for i in range(50)), "Ünï"]
    edge = [(-9_000_000_000_000_000_000, "the cat sat on a mat"), (9_000_000_000_000_000_000, "The cat sat, on a mat!"), (None, "the cat"), (7, None), (7, ""), (8, "--"), (9, "the of"), (10, "x " * 30_000)]
    rows = [(i * 11, " ".join(rng.choices(pool, k=rng.randint(0, 60)))) for i in range(40)] + edge
    rows = [(d, t, "x", "y", "z", 0, 0) for d, t in rows]
    got = fingerprint_query(spark.createDataFrame(rows, "doc_id long, text string, spots string, part string, spot_words string, run int, copy int").repartition(4)).collect()
    assert len(got) == len(rows)
    order = sorted((r for r in rows if r[0] is not None and r[0] != 7), key=lambda r: -r[0])
    by = {r.doc_id: r for r in got}
    jaccard = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for r, nxt in zip(order, [*order[1:], order[0]], strict=True):
        want = brute_signatures(r[1])
        assert len(by[r[0]].fingerprint.split()) == len(want)
        if 7 not in (r[0], nxt[0]) and r[0] != 8:
            assert by[r[0]].near_next == pytest.approx(jaccard(want, brute_signatures(nxt[1])))
    assert by[None].n_chars == 7 and by[None].near_next == 0
    assert fingerprint_query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spotsigs_near_classes(spark):
    text = "the quick brown fox jumps over a lazy dog and it runs to the green hill of many stones in summer for joy"
    rows = [(1, text), (2, text), (3, text + " again"), (4, "nothing of this kind is in the other texts here"), (5, None)]
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_near_classes_compares_a_family_with_its_leader(spark, monkeypatch):
    base = [w for i in range(40) for w in ("the", f"x{i}", f"y{i}")]
    rows = [(i, " ".join([*base, "the", f"n{i}", f"m{i}"])) for i in range(60)]
    rows += [(100 + i, " ".join(f"the o{i}p{k} q{i}q{k}" for k in range(40))) for i in range(3)]
    # The sets left to components() are the links found: about one a member, not all pairs.
    links = []
    real = spotsigs.components
    monkeypatch.setattr(spotsigs, "components", lambda edges: links.append(edges.count()) or real(edges))
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 60 else i for i, _ in rows}
    assert 59 <= links[0] <= 3 * 60


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nFoo."
    rows = [(1, "Text.\nReleased under the MIT License."), (2, mit), (3, "A licence of my own."), (4, None), (5, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.\nAll rights reserved.")]
    got = {r.doc_id: (r.sentence_ids, r.licences, r.n_known, r.n_unknown) for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("MIT-REF", "MIT", 1, 0)
    assert got[2][1] == "MIT" and got[2][0] == "MIT-GRANT MIT-NOTICE"
    assert got[3] == ("UNKNOWN", "", 0, 1) and got[4] == ("", "", 0, 0)
    assert got[5] == ("CC-BY-NC-REF CC-BY-NC-REF ARR", "CC-BY-NC-4.0 LicenseRef-all-rights-reserved", 3, 0)


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_ASIS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
GPL = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>. */"""


def test_licences_in_wrapped_lines(spark):
    texts = [MIT, APACHE, APACHE.replace("\n# you may", " you may"), BSD2 + BSD_ASIS, BSD2 + ENDORSE + BSD_ASIS, GPL, "This work is licensed under the MIT License.", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;"]
    texts += ["SPDX-License-Identifier: MIT OR Apache-2.0", "It is not licensed under the MIT License.", "A sentence about the licences of other people that is wrapped\nand that speaks of a copyright."]
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].licences for i in range(len(texts))] == ["MIT", "Apache-2.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0-or-later", "MIT", "GPL-2.0-or-later", "", "", ""]
    apache = "APACHE2-REF APACHE2-COMPLY APACHE2-OBTAIN APACHE2-ASIS APACHE2-SEE"
    assert got[1].sentence_ids == got[2].sentence_ids == apache
    assert [got[i].n_unknown for i in range(1, len(texts))] == [0] * 7 + [1] * 3
    assert "MIT-GRANT MIT-NOTICE AS-IS" in got[0].sentence_ids and "GPL-FREE3 GPL-HOPE GPL-SEE GPL-COPY GPL-SITE" == got[5].sentence_ids


def test_mixing(spark):
    rows = [(i, "t", "a" if i < 4000 else "b" if i < 5000 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df).groupBy("source").count().collect()
    assert all(abs(r["count"] - 2000) < 250 for r in out) and len(out) == 3
    heavy = mix_sources(df, {"b": 3.0, "a": 1.0}).groupBy("source").count().collect()
    assert {r.source: round(r["count"] / 1500) for r in heavy} == {"a": 1, "b": 3}
    one = mix_sources(spark.createDataFrame(rows[:1] + [(i, "t", "z") for i in range(1, 400)], "doc_id long, text string, source string"), seed="x")
    assert 120 < one.filter("source = 'a'").count() < 280  # a mean far over one draw's
    assert sorted(map(tuple, mix_sources(df).collect())) == sorted(map(tuple, mix_sources(df.repartition(7)).collect()))
    assert mix_sources(df.limit(0)).count() == 0


def test_digest_has_no_global_state(docs):
    assert substring_digest(docs.filter(F.col("doc_id") < 0)).count() == 0
