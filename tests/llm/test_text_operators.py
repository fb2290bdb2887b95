"""Language ID, toxicity, licences, near-duplicates: small cases against brute force."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailmark.llm import language_id as lid
from trailmark.llm import licenses, near_text, toxicity
from trailmark.llm.common import components, text_slices

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, lang="en", extra=False):
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    # columns that clash with the operators' own names
    return df.selectExpr("*", "doc_id as id", "1 as score", "'x' as key", "2 as n", "3 as component_id") if extra else df


# ---------------------------------------------------------------- helpers

def test_text_slices_keep_every_character_and_cut_after_blanks():
    texts = ["a b c", None, "", "w" * 50, "one two three four five six"]
    got = {}
    for rows, parts in text_slices(texts, 8):
        for i, p in zip(rows, parts):
            got[i] = got.get(i, "") + p
    assert got == {0: "a b c", 1: "", 2: "", 3: "w" * 50, 4: "one two three four five six"}


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(4)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(1, x) for x in range(2, 30)] + [(70, 70), (5, 1), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[x] for x in chain} == {100}
    assert {got[x] for x in range(1, 30)} == {1} and got[201] == 200 and 70 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- language ID

def greedy_phrases(word, text):
    """Longest-match phrases of the word with its blanks, by substring search."""
    return greedy_pieces(f" {word} ", text)


def greedy_pieces(piece, text):
    n = at = 0
    while at < len(piece):
        end = at + 1
        while end < len(piece) and piece[at:end + 1] in text:
            end += 1
        n, at = n + 1, end
    return n


def test_cross_parse_equals_substring_search():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    parser = lid.CrossParser({"x": [(w, 1) for w in sorted(set(words[:40]))], "y": [(w, 1) for w in sorted(set(words[20:]))]}, 10_000)
    room = min(sum(len(w) + 1 for w in set(words[:40])), sum(len(w) + 1 for w in set(words[20:])))
    for k, own in enumerate((words[:40], words[20:])):
        text, held = " ", 1
        for w in sorted(set(own)):
            if held >= room:
                break
            text, held = text + w + " ", held + len(w) + 1
        asked = words + ["zzz", "azb", "a" * 64]
        assert parser.counts(asked)[:, k].tolist() == [greedy_phrases(w, text) for w in asked]


def test_running_parse_equals_substring_search(monkeypatch):
    monkeypatch.setattr(lid, "PIECE", 40)
    rng = random.Random(4)
    own = lambda n: " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(n))
    texts = {"x": f" {own(60)} ", "y": f" {own(30)} "}
    parser = lid.CrossParser.of_texts(texts)
    asked = [own(1), own(40), None, "", "12!", "zz " + own(3), own(9).replace(" ", " 7 ").upper()]
    total, letters = lid.running_totals(asked, parser)
    for i, t in enumerate(asked):
        words = re.findall("[a-z]+", (t or "").lower())
        stream = f" {' '.join(words)} " if words else ""
        assert letters[i] == max(0, len(stream) - 1)
        for k, x in enumerate("xy"):
            assert total[i, k] == sum(greedy_pieces(stream[at:at + 40], texts[x]) for at in range(0, len(stream), 40))
    # phrases run over words
    assert lid.running_totals([texts["y"][:39]], parser)[0][0, 1] == 1


def test_training_text_takes_passages_of_all_rows_in_turn(spark):
    long_ = " ".join(["walrus"] * 3000)
    d = docs_of(spark, [long_, *[f"row number {x} of the sample" for x in "abcdefgh"]])
    text = lid.train_running(d, max_chars=1000).texts[0]
    assert all(f"row number {x} of the sample" in text for x in "abcdefgh") and 1000 <= len(text) <= 1000 + lid.PASSAGE + 10


def test_rare_or_mislabelled_language_leaves_the_others_their_words(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    first = d.filter("lang = 'en' and length(text) > 700").orderBy("doc_id").first().text
    rare = [(10 ** 7 + 1, "the of and to", "rare", "s", 13), (10 ** 7 + 3, first[:600], "wrong", "s", 600),
            (10 ** 7 + 4, "žluťoučký kůň úpěl ďábelské ódy příliš", "own", "s", 38)]
    more = d.unionByName(spark.createDataFrame(rare, d.schema))  # none of them is held out
    plain, parser = lid.train_running(d.filter(~lid.held_out(d))), lid.train_running(more.filter(~lid.held_out(more)))
    assert len(parser.langs) == len(plain.langs) + 3
    kept = dict(zip(parser.langs, parser.texts, strict=True))
    assert [kept[x] for x in plain.langs] == list(plain.texts)
    asked = d.unionByName(spark.createDataFrame([(10 ** 7 + 9, "kůň úpěl příliš žluťoučký ódy", None, "s", 30)], d.schema))
    got = {r.doc_id: r.lang_pred for r in lid.identify(asked, parser).collect()}
    assert got[10 ** 7 + 9] == "own"
    want = {r.doc_id: r.lang for r in d.filter(lid.held_out(d) & F.col("lang").isNotNull()).select("doc_id", "lang").collect()}
    assert sum(got[i] == x for i, x in want.items()) >= 0.99 * len(want)


def test_language_of_held_out_rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = lid.predict_languages(d).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == d.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edge_cases(spark):
    base = [f"the cat and the dog {i}" for i in range(30)]
    d = docs_of(spark, base + [None, "", "12 3!", "the " * 30_000 + "x" * 500, "the dog"] + base[:1], extra=True)
    got = [r.asDict() for r in lid.predict_languages(d).orderBy("doc_id").collect()]
    assert [g["lang_pred"] for g in got[30:33]] == ["und"] * 3 and [g["score"] for g in got[30:33]] == [0.0] * 3
    assert {g["lang_pred"] for g in got[:30] + got[33:]} == {"en"}
    kept = lid.keep_identified(d)
    assert kept.columns == d.columns and kept.count() == len(base) + 3
    none = docs_of(spark, base, lang=None)
    assert {r.lang_pred for r in lid.predict_languages(none).collect()} == {"und"}
    assert lid.predict_languages(d.limit(0)).count() == 0


# ---------------------------------------------------------------- toxicity

def toxic_rows(n=400):
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts, marks = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = i % 3 == 0
        if bad:
            body.insert(rng.randrange(len(body)), rng.choice(["scumbag", "wretch", "dimwit"]))
        texts.append(" ".join(body))
        marks.append(int(bad))
    return texts, marks


def test_toxicity_of_held_out_rows_and_edge_cases(spark):
    texts, marks = toxic_rows()
    texts += [None, "", "word " * 40_000 + "dimwit"]
    d = docs_of(spark, texts, extra=True)
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(400, 1, None), (9999, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.predict_toxicity(d, labels).orderBy("doc_id").toPandas()
    assert len(got) == len(texts) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    held = got.held_out[:400]
    assert (held == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(400)]).all()
    assert ((got.predicted[:400] == marks)[held]).mean() > 0.95
    assert got.predicted[402] == 1  # a word at the end of a very long text
    kept = {r.doc_id for r in toxicity.keep_clean(d, labels).collect()}
    assert kept == set(got.doc_id[got.predicted == 0])


def test_toxicity_without_labels_and_without_rows(spark):
    d = docs_of(spark, ["a b", None, "c"])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.predict_toxicity(d, none).collect()] == [0.0] * 3
    one = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert toxicity.predict_toxicity(d, one).count() == 3
    assert toxicity.predict_toxicity(d.limit(0), none).count() == 0


def test_pooling_never_crosses_texts():
    net = toxicity.Network(3)
    words = [["aa", "bb", "cc"], [], ["dd"], ["ee", "ff"]]
    alone = []
    pad = np.zeros((3, toxicity.PARTS), np.int64)
    rows = [np.concatenate([toxicity.word_rows(w), pad]) for w in words]
    for r in rows:
        alone.append(net.pooled(net.projections(r), np.array([0]))[0])
    starts = np.cumsum([0, *[len(r) for r in rows[:-1]]])
    together = net.pooled(net.projections(np.concatenate(rows)), starts)
    # the last rows of a text meet padding and, at the very end, nothing
    assert np.allclose(together[:-1, :toxicity.FILTERS], np.array(alone)[:-1, :toxicity.FILTERS], atol=1e-6)


# ---------------------------------------------------------------- licences

def test_licence_forms_and_notices(spark):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    changed = "the MIT license\n".title().replace("The Mit License", "MIT License") + "Copyright 2020 Some One\n(c) others\n" \
        + mit.split("holders\n")[-1].upper().replace("SUBLICENSE", "sublicence").replace(",", " ,")
    texts = [mit, changed, "prose\nReleased under the M.I.T. licence\nmore", "prose\nReleased under the MIT licence!\nAll  rights reserved",
             None, "", "Copyright 2000 Me", mit + " and more", "Licensed under the Apache License, version 2.0"]
    got = licenses.scan(docs_of(spark, texts + texts[:1], extra=True)).orderBy("doc_id").collect()
    assert [g.license_id for g in got] == ["MIT", "MIT", None, None, None, None, None, None, "notice-Apache-2.0", "MIT"]
    assert got[3].notices == ["notice-MIT", "notice-all-rights-reserved"] and got[2].notices == []
    assert got[4].digest is None and got[4].canonical_chars == 0 and got[6].canonical_chars == 0
    assert got[0].digest == got[1].digest
    assert licenses.scan(docs_of(spark, texts).limit(0)).count() == 0


APACHE_HEADER = """# Copyright 2019 Some Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL_HEADER = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MPL_HEADER = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
"""
BSD_2 = """BSD 2-Clause License

Copyright (c) 2021, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
BSD_3_CLAUSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
ZLIB = """Copyright (C) 1995 A and B

This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""


def test_standard_texts_headers_and_other_notices(spark):
    apache = max((t for k, t in licenses.KNOWN if k == "Apache-2.0"), key=len)
    texts = [APACHE_HEADER, GPL_HEADER, MPL_HEADER, BSD_2, BSD_2.replace("BSD 2-Clause License\n", "").replace("THIS SOFT", BSD_3_CLAUSE + "THIS SOFT", 1),
             ZLIB, apache.upper().replace("[YYYY]", "2020"), "prose\n// SPDX-License-Identifier: MPL-2.0\nThis project is licensed under the MIT license.",
             "Distributed under the terms of the BSD 3-Clause License", "Licensed under the moon.", ZLIB.replace("commercial", "no")]
    got = licenses.scan(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [g.license_id for g in got] == ["notice-Apache-2.0", "notice-GPL-3.0-or-later", "notice-MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "Zlib",
                                           "Apache-2.0", None, "notice-BSD-3-Clause", None, None]
    assert got[7].notices == ["notice-MIT", "notice-MPL-2.0"]
    whole = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(licenses.KNOWN) if "License" in t and len(t) > 1000], "doc_id long, text string")
    found = {r.doc_id: r.license_id for r in licenses.scan(whole).collect()}
    assert found == {i: k for i, (k, t) in enumerate(licenses.KNOWN) if i in found} and len(found) == whole.count()


def test_licence_table_is_a_parameter(spark):
    known = spark.createDataFrame([("b", "Some Terms"), ("a", "some, terms!"), ("none", "")], "license_id string, text string")
    got = licenses.scan(docs_of(spark, ["SOME TERMS", "other"]), known).orderBy("doc_id").collect()
    assert [g.license_id for g in got] == ["a", None]
    assert licenses.scan(docs_of(spark, ["x"]), known.limit(0)).first().license_id is None


# ---------------------------------------------------------------- near-duplicates

def word_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()


def brute_components(ids, texts):
    sets = [word_set(t) for t in texts]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[a] = b
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


def near_texts(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "One", "one", "ONE two", "one\x0btwo", "one two three", "É à", "é à", " x", "end"]
    passage = [rng.choice(vocab) for _ in range(60)]
    for _ in range(40):  # a family that shares a passage but is not near enough
        texts.append(" ".join(passage + [rng.choice(vocab) for _ in range(22)]))
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append(" ".join(own) if rng.random() < 0.7 else "\n".join(own).upper())
            base = own if rng.random() < 0.5 else base
    return texts + ["same text here for all"] * 30 + ["long " + " ".join(vocab) * 40]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts()
    rng = random.Random(1)
    ids = rng.sample(range(10_000), len(texts))
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], DOCS).selectExpr(
        "*", "'k' as key", "1 as id", "2 as root", "3 as sig").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_text.near_duplicates(rows).collect()}
    want = brute_components(ids, texts)
    assert len(got) == len(ids)
    for i, (n, c) in zip(ids, want):
        assert got[i] == (n, c, c == i)
    kept = near_text.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want})


def test_near_dedup_stage_equals_five_word_brute_force(spark):
    rng = random.Random(12)
    texts = [t for t in near_texts(6) if t is None or len(t) < 2000] + ["a b", "a b", "a b c", "a b c d", "a b c d e", "A b c d E", "a b c d e f"]
    for _ in range(12):  # every 20th or every 60th word changed: near by pairs of words, or by five words too
        base = [f"u{rng.randrange(10 ** 6)}" for _ in range(240)]
        texts.append(" ".join(base))
        for step in (20, 60):
            texts.append(" ".join(f"z{rng.randrange(10 ** 6)}" if i % step == 10 else w for i, w in enumerate(base)))

    def five(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    sets = [five(t) for t in texts]
    root = list(range(len(texts)))
    changed = True
    near = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in near:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(5)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect())
    assert kept == sorted(set(root)) and len(kept) > near_text.keep_one(docs).count()


def test_near_duplicates_repeated_rows_null_ids_and_empty(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "A b C"), (None, "a b c"), (None, None), (3, None)],
                                 "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_text.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (None, 0, None, True),
                          (3, 0, 3, True)], key=str)
    assert near_text.near_duplicates(rows.limit(0)).count() == 0
    assert near_text.keep_one(rows).count() == 4


def test_signatures_estimate_similarity_and_all_near_pairs_share_a_key():
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.integers(0, 1 << 63, 900, dtype=np.uint64)) for _ in range(20)]
    near = [np.sort(np.r_[s[:820], rng.integers(0, 1 << 63, 80, dtype=np.uint64)]) for s in sets]
    sig = near_text.signatures(np.concatenate(sets + near), np.array([900] * 40))
    keys, sketch = near_text.posting_keys(sig)
    for a in range(20):
        same = (sig[a] == sig[a + 20]).mean()
        assert abs(same - 820 / 980) < 0.2
        if (sig[a] != sig[a + 20]).sum() < 2 * near_text.CHUNKS:
            assert len(np.intersect1d(keys[a], keys[a + 20]))
    # pigeonhole: any errors up to the distance leave a common key
    for _ in range(200):
        other = sig[0].copy()
        at = rng.choice(near_text.SYMBOLS, 2 * near_text.CHUNKS - 1, replace=False)
        other[at] ^= 12345
        assert len(np.intersect1d(keys[0], near_text.posting_keys(other[None])[0][0]))


def test_word_hashes_of_texts_longer_than_the_working_size(monkeypatch):
    texts = [b"aa bb  cc\tdd", b"", b"x" * 300 + b" yy zz", b"AA bb"]
    whole = near_text.word_hashes(texts)
    monkeypatch.setattr(near_text, "SLICE_BYTES", 5)
    parts = near_text.word_hashes(texts)
    assert whole[1].tolist() == parts[1].tolist() == [4, 0, 3, 2]
    assert (whole[0] == parts[0]).all()
    assert whole[0][0] == whole[0][7] and math.isclose(len(set(whole[0].tolist())), 7)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_rare_prefix_join_is_complete(spark, percent):
    """The completing join by itself finds every pair across components."""
    texts = [t for t in near_texts(9) if word_set(t)][:120]
    rows = [(i, np.sort(np.array([zlib.crc32(repr(p).encode()) * 2654435761 + 7 for p in word_set(t)], np.uint64)).tobytes())
            for i, t in enumerate(texts)]
    sc = spark.sparkContext
    sets = spark.createDataFrame(rows, "id long, set binary").selectExpr("id", "set", "id as root")
    counts = sc.broadcast(np.zeros(near_text.BUCKETS, np.int64))
    rare = sets.mapInArrow(near_text._prefixes(percent, counts), "token long, id long, root long, n long, place long")
    met = rare.repartition("token").sortWithinPartitions("token", "root").mapInArrow(near_text._prefix_pairs(percent), "a long, b long")
    got = {(r.a, r.b) for r in near_text.confirmed(met.distinct(), sets, percent).collect()}
    w = [word_set(t) for t in texts]
    assert got == {(j, i) for i in range(len(w)) for j in range(i) if 100 * len(w[i] & w[j]) >= percent * len(w[i] | w[j])}
