"""Decontamination, quality, toxicity, language-model scores, licences and HTML: definitions, odd rows, brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spacelab.llm import common, decontam, html_text, licenses, lm_score, packing, quality, simhash, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score double, n_words string, items string, lang string"


def docs(spark, texts, start=0):
    """Documents with columns that clash with what operators add."""
    return spark.createDataFrame([(start + i, t, 0.5, "x", "y", None) for i, t in enumerate(texts)], DOCS)


def frame(df):
    return [tuple(r) for r in df.collect()]


# ----- decontamination -----


def brute_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, items, size=10):
    w, hit, found = brute_words(text), set(), set()
    for item, t in items:
        v = brute_words(t)
        for window in [v[i : i + size] for i in range(max(1, len(v) - size + 1))] if v else []:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [
    (10, "One two three four five six seven eight nine ten eleven twelve"), (9, "ONE two, three; four five six seven eight nine ten"),
    (3, "short item"), (4, ""), (5, None), (None, "a null id item"), (7, "éa bé Ünder x1"), (3, "short item"), (11, "x x x x x x x x x x x x"), (12, "ab"),
]
TEXTS = [
    None, "", " .,; ", "nothing here at all", "say: one two three four five six seven eight nine ten! eleven twelve; short item",
    "x " * 50, "A NULL ID ITEM", "éa bé Ünder x1 éa bé Ünder x1", "éa bé ünder x1", "ab ab", "abc cab", "one two three four five six seven eight nine",
    "zero " + "one two three four five six seven eight nine ten " * 3, "short\titem\nshort  item",
]


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 200])
def test_decontamination(spark, block_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    table = docs(spark, TEXTS).union(docs(spark, [TEXTS[4]], start=4))
    got = frame(decontam.digest(decontam.contamination(table, bench, block_bytes=block_bytes)))
    want = []
    for i, t in [*enumerate(TEXTS), (4, TEXTS[4])]:
        n, hit, found = brute_hits(t, ITEMS)
        want.append((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert sorted(got) == sorted(want)
    clean = decontam.decontaminated(table, bench, block_bytes=block_bytes)
    assert clean.schema == table.schema
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(w[0] for w in want if not w[5])


def test_texts_searched_together_are_searched_alone(monkeypatch):
    monkeypatch.setattr(decontam, "LONG", 60)
    searcher = decontam.WuManber([(str(i), decontam.split_words((t or "").encode())) for i, t in ITEMS])
    texts = [t and t.encode() for t in [*TEXTS, "short", "item", "one two three four five", "six seven eight nine ten"]]
    assert searcher.scan_all(texts) == [searcher.scan(t) for t in texts]
    assert searcher.scan_all([]) == [] and decontam.WuManber([]).scan_all([b"a b", None]) == [(2, [], set()), (0, [], set())]


def test_a_benchmark_of_a_million_words_fits():
    import tracemalloc

    rng = np.random.default_rng(31)
    names = [b"w%d" % i for i in range(50_000)]
    items = [(str(k), [names[i] for i in rng.integers(0, 50_000, 100)]) for k in range(10_000)]
    tracemalloc.start()
    searcher = decontam.WuManber(items)
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    text = [b"x"] * 20 + items[77][1][5:40] + [b"y"] + items[9999][1][90:]
    assert searcher.search(text) == ([(20, 55), (56, 66)], {"77", "9999"})


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contamination(docs(spark, []), bench).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(docs(spark, TEXTS), bench.limit(0)).collect()} == {0}
    assert decontam.decontaminated(docs(spark, TEXTS), bench.limit(0)).count() == len(TEXTS)


def test_wu_manber_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    letters = [b"a", b"b", b"c"]
    for _ in range(30):
        patterns = {tuple(letters[i] for i in rng.integers(0, 3, n)): {str(n)} for n in rng.integers(1, 7, 8)}
        text = [letters[i] for i in rng.integers(0, 3, 60)]
        spans = [(i, i + len(p)) for p in patterns for i in range(60 - len(p) + 1) if tuple(text[i : i + len(p)]) == p]
        got, items = decontam.WuManber([(name, list(p)) for p, names in patterns.items() for name in names]).search(text)
        assert got == decontam.merged(spans)
        assert items == set().union(*(o for p, o in patterns.items() if any(tuple(text[a:b]) == p for a, b in spans)), set())


# ----- quality -----


def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 1, 5, 2])
    unary, move = rng.normal(size=11), rng.normal(size=(2, 2))
    ahead, back = quality.forward_backward(unary, sizes, move)
    got, at = 1 / (1 + np.exp(-(ahead + back))), 0
    for n in sizes:
        total, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [(code >> i) & 1 for i in range(n)]
            p = math.exp(sum(unary[at + i] for i in range(n) if y[i]) + sum(move[y[i], y[i + 1]] for i in range(n - 1)))
            total, good = total + p, good + p * np.array(y)
        assert np.allclose(got[at : at + n], good / total)
        at += n


def test_line_features_do_not_depend_on_the_batch():
    texts = [b"", None, b"One line.", b"A\n\nB!! C!!\n", "Ünïcode # # | |\nsame\nsame".encode(), b"x" * 3000, b"word word word word " * 40]
    whole, length, per_text = quality.line_features(texts)
    assert per_text.tolist() == [1, 1, 1, 4, 3, 1, 1] and length[-2] == 3000
    at = 0
    for t, n in zip(texts, per_text):
        alone, own, _ = quality.line_features([t])
        assert np.allclose(alone, whole[at : at + n]) and np.array_equal(own, length[at : at + n])
        at += n


def test_features_of_long_lines_do_not_depend_on_chunks(monkeypatch):
    text = [b"ab cd\n" * 500 + b"Z" * 5000 + b"\nend " * 300, b"tail"]
    want = quality.line_features(text)
    monkeypatch.setattr(quality, "CHUNK", 256)
    assert all(np.allclose(a, b) for a, b in zip(want, quality.line_features(text)))


def test_long_lines_are_put_together_from_pieces(monkeypatch):
    rng = np.random.default_rng(21)
    texts = []
    for n in (300, 700, 2000):
        words = [bytes(rng.choice(list(b"aB9#|,\xc3\xa9"), int(rng.integers(1, 40)))) for _ in range(n // 10)]
        words[3:3] = [words[2]] * 4
        texts += [b" ".join(words), b"  " + b"  ".join(words) + b" #", b"\n".join((words[0], b" ".join(words), b"", b"#" * n, b"end"))]
    want = quality.line_features(texts)
    for size in (64, 97, 256):
        monkeypatch.setattr(quality, "CHUNK", size)
        monkeypatch.setattr(quality, "CHUNK_LINES", 3)
        for a, b in zip(want, quality.line_features(texts)):
            assert np.allclose(a, b)


def test_one_long_chain_is_walked_like_many(monkeypatch):
    rng = np.random.default_rng(22)
    sizes, move = np.array([5, 40, 1, 23]), rng.normal(size=(2, 2))
    unary = rng.normal(size=69)
    want = quality.forward_backward(unary, sizes, move)
    monkeypatch.setattr(quality, "LONG_CHAIN", 20)
    assert all(np.allclose(a, b) for a, b in zip(want, quality.forward_backward(unary, sizes, move)))


def test_training_reads_runs_of_the_lines_of_a_long_text():
    short, long = b"a\n" * 20, b"\n".join(b"line %d" % i for i in range(5000))
    assert quality.sampled(short) == short
    lines = quality.sampled(long).split(b"\n")
    assert len(lines) == quality.TRAIN_LINES and lines[0] == b"line 0" and lines[-1] == b"line 4999" and len(set(lines)) == len(lines)


@pytest.mark.parametrize("kind", ["quality line", "quality solid", "toxicity line", "toxicity solid"])
def test_texts_of_64_mb_stay_in_bounded_memory(kind):
    import pathlib
    import subprocess
    import sys

    code = """
import resource, sys
sys.path.insert(0, sys.argv[1])
import numpy as np
from spacelab.llm import quality, toxicity
which, kind = sys.argv[2].split()
text = b"some words and " * (64 << 16) if kind == "line" else "\u65e5\u672c\u8a9e".encode() * ((64 << 20) // 9)
if which == "quality":
    model = quality.Model(np.ones(quality.line_features([b"a"])[0].shape[1]), np.zeros((2, 2)), np.ones(3), 0.5)
else:
    model = toxicity.Model(np.arange(1 << 40, (1 << 40) + 4000, dtype=np.uint64), np.ones(4000), 0.0, 0.5)
assert 0 <= model.scores([text])[0] <= 1
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code, str(pathlib.Path(__file__).parents[2]), kind], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 500


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("module, target, keep", [(quality, "quality", "keep_good"), (toxicity, "toxic", "keep_clean")])
def test_classifiers_on_odd_rows(spark, module, target, keep):
    good = ["The quick fox runs over a hill. It sees the sea."] * 30
    bad = ["BUY!! NOW!! idiot | scum | trash\nBUY!! idiot"] * 30
    train = docs(spark, good + bad)
    one = 1 if target == "quality" else 0
    rows = [(i, one if i < 30 else 1 - one) for i in range(60)] + [(3, one), (None, 1), (5, None), (9999, 1)]
    labels = spark.createDataFrame(rows, f"doc_id long, {target} int")
    model = module.train(train, labels, target)
    odd = docs(spark, [None, "", "\n\n\n", good[0], bad[0], "é" * 50000, bad[0] + "\n" + good[0], good[0], "\x00\x01"])
    scores = {r["doc_id"]: r["score"] for r in module.score(odd, model).collect()}
    assert len(scores) == 9 and all(0 <= s <= 1 for s in scores.values())
    assert scores[3] == scores[7] and scores[0] == scores[1]
    assert (scores[3] > 0.5 > scores[4]) if target == "quality" else (scores[4] > 0.5 > scores[3])
    kept = getattr(module, keep)(odd, model)
    assert kept.schema == odd.schema
    limit = module.THRESHOLD
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if (s >= limit if target == "quality" else s < limit)}
    assert module.score(odd.limit(0), model).count() == 0 and getattr(module, keep)(odd.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.where("doc_id < 30")):
        model = module.train(train, few, target)
        assert {r["score"] for r in module.score(odd, model).collect()} == {model.prior}


@pytest.mark.parametrize("module, target", [(quality, "quality"), (toxicity, "toxic")])
def test_labels_without_a_usable_document_do_not_use_up_the_bound(spark, module, target):
    table = docs(spark, ["The quick fox runs over a hill." if i % 2 else "idiot scum trash idiot" for i in range(60)] + ["x" * 50] * 60)
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], f"doc_id long, {target} int")
    rows = common.training_rows(table.where("doc_id < 60"), labels, target, 20).collect()
    assert len(rows) == 20 and {r["label"] for r in rows} == {0, 1} and all(len(r["text"]) <= 40 for r in rows)
    got = {r["doc_id"]: r["score"] for r in module.score(table, module.train(table.where("doc_id < 60"), labels, target, 20)).collect()}
    assert got[1] > 0.5 > got[0]


# ----- toxicity -----


def test_grams_are_exact_at_piece_borders(monkeypatch):
    text = "Some words, and Ümläute and more words".encode()
    want = np.sort(np.concatenate(list(toxicity.grams(text))))
    monkeypatch.setattr(toxicity, "_PIECE", 7)
    assert np.array_equal(want, np.sort(np.concatenate(list(toxicity.grams(text)))))
    padded = b" some words, and " + "ümläute".encode() + b" and more words "
    assert len(want) == sum(len(padded) - n + 1 for n in toxicity.ORDERS)


def test_grams_of_words_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(toxicity, "_PIECE", 8)
    monkeypatch.setattr(toxicity, "PART_BYTES", 20)
    for text in ("日本語の長い文" * 9, "a" * 100 + " " + "É" * 33 + "  \n" + "b" * 16 + " x", " " * 40 + "ab" + " " * 40 + "cd" + " " * 17, "z" * 16 + " " * 16 + "z" * 15):
        padded = f" {' '.join(text.lower().split())} ".encode()
        want = Counter(int.from_bytes(padded[i : i + n], "little") | n << 56 for n in toxicity.ORDERS for i in range(len(padded) - n + 1))
        assert Counter(np.concatenate(list(toxicity.grams(text.encode()))).tolist()) == want
        found = np.concatenate(list(toxicity.levels(text.encode()))).tolist()
        assert sorted(found) == sorted(g | k << 60 for g, n in want.items() for k, least in enumerate(toxicity.TIMES) if n >= least)


def test_features_are_counted_as_by_brute_force(spark):
    rows = [("aaa aaa", 1), ("aaa", 0), (None, 1), ("", 0), ("aaa aaa", 1)]
    df = spark.createDataFrame(rows, "text string, label int").select("label", "text")
    got = defaultdict(lambda: [0, 0])
    for r in df.mapInArrow(toxicity._count, "gram long, n0 long, n1 long").collect():
        got[r["gram"]][0] += r["n0"]
        got[r["gram"]][1] += r["n1"]
    want = defaultdict(lambda: [0, 0])
    for text, label in rows:
        if text:
            padded = f" {' '.join(text.lower().split())} ".encode()
            counts = Counter(padded[i : i + n] for n in toxicity.ORDERS for i in range(len(padded) - n + 1))
            for g, c in counts.items():
                for k, least in enumerate(toxicity.TIMES):
                    if c >= least:
                        want[int.from_bytes(g, "little") | len(g) << 56 | k << 60][label] += 1
    assert dict(got) == dict(want)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    held = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    model = toxicity.train(held, spark.read.parquet(f"{sf}/labels.parquet"))
    got = toxicity.score(held.where(toxicity.held_out("doc_id")), model).join(held.select("doc_id", "toxic"), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == r["toxic"] for r in got]) > 0.96


# ----- language-model scores -----


def test_cross_entropy_difference_by_brute_force(spark):
    texts = [None, "", "  ", "a b a c", "a b a b a b", "Zz zz q", "a b a c"]
    weight = 0.75
    table = docs(spark, texts)
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(table, table.where("doc_id = 4"), weight).collect()}
    tokens = [(t or "").lower().split() for t in texts]
    vocabulary = {w for t in tokens for w in t}

    def losses(corpus):
        bi = Counter()
        for t in corpus:
            ids = [w if w in vocabulary else "<unk>" for w in t]
            bi.update(zip(["<s>", *ids], ids))
        before, single = Counter(), Counter()
        for (a, b), n in bi.items():
            before[a] += n
            single[b] += n
        total, words = sum(single.values()), len(vocabulary) + 2

        def loss(a, b):
            p1 = (single[b] + 1) / (total + words - 1)
            w = weight if before[a] else 0
            return -math.log((w * bi[a, b] / before[a] if before[a] else 0) + (1 - w) * p1)

        return lambda t: sum(loss(a, b) for a, b in zip(["<s>", *t], t)) / len(t)

    near, far = losses([tokens[4]]), losses(tokens)
    for i, t in enumerate(tokens):
        ids = [w if w in vocabulary else "<unk>" for w in t]
        assert got[i]["n_tokens"] == len(t)
        if t:
            assert got[i]["target_loss"] == pytest.approx(near(ids), rel=1e-5) and got[i]["background_loss"] == pytest.approx(far(ids), rel=1e-5)
            assert got[i]["score"] == pytest.approx(near(ids) - far(ids), abs=1e-5)
        else:
            assert got[i]["score"] is None and got[i]["target_loss"] is None
    assert lm_score.cross_entropy_difference(table.limit(0), table.limit(0)).count() == 0
    assert {r["n_tokens"] for r in lm_score.cross_entropy_difference(table, table.limit(0)).collect()} == {0, 3, 4, 6}


def test_every_word_of_the_corpus_is_modelled(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK", 1000)
    rng = np.random.default_rng(3)
    common_words = " ".join(f"w{i}" for i in range(2100)) + " "
    texts = [common_words * 2, "rare gold word", "rare lead word", None, " ", *(" ".join(f"w{i}" for i in rng.integers(0, 300, 50)) for _ in range(40)), "rare gold word"]
    table, chosen = docs(spark, texts), [0, 1, 7]
    good = spark.createDataFrame([(i,) for i in [*chosen, 7, 999, None]], "doc_id long")
    tokens = [(t or "").lower().split() for t in texts]

    def losses(corpus):
        bi = Counter(p for t in corpus for p in zip(["<s>", *t], t))
        before, single = Counter(), Counter()
        for (a, b), n in bi.items():
            before[a] += n
            single[b] += n
        total, words = sum(single.values()), len({w for t in tokens for w in t}) + 2

        def loss(a, b):
            w = 0.75 if before[a] else 0
            return -math.log((w * bi[a, b] / before[a] if w else 0) + (1 - w) * (single[b] + 1) / (total + words - 1))

        return lambda t: sum(loss(a, b) for a, b in zip(["<s>", *t], t)) / len(t)

    near, far = losses([tokens[i] for i in chosen]), losses(tokens)
    for found in (lm_score.cross_entropy_difference(table, table.where("doc_id IN (0, 1, 7)")), lm_score.labelled_difference(table, good)):
        got = {r["doc_id"]: r for r in found.collect()}
        assert len(got) == len(texts) and got[1]["score"] < got[2]["score"]
        for i, t in enumerate(tokens):
            assert got[i]["n_tokens"] == len(t)
            if t:
                assert got[i]["target_loss"] == pytest.approx(near(t)) and got[i]["background_loss"] == pytest.approx(far(t))
            else:
                assert got[i]["score"] is None and got[i]["target_loss"] is None
    assert lm_score.labelled_difference(table.limit(0), good).count() == 0
    assert {r["n_tokens"] for r in lm_score.labelled_difference(table.where("doc_id < 5"), good.limit(0)).collect()} == {4200, 3, 0}


# ----- licences -----

MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in it.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""


def test_licences(spark):
    table = docs(spark, [
        None, "", "No such thing.", MIT, "Text without a stop\nReleased under the MIT License.\nMore", "# SPDX-License-Identifier: GPL-2.0-or-later\nx = 1",
        "Licensed under the Apache License,\nVersion 2.0 (the \"License\"). Licensed under CC BY-NC 4.0.", "It is licensed under unheard-of terms.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", MIT, "word " * 50000 + "licensed under the MIT License",
    ])
    got = {r["doc_id"]: r for r in licenses.license_scan(table).collect()}
    assert [got[i]["licenses"] for i in range(11)] == [
        [], [], [], ["MIT"], ["MIT"], ["GPL-2.0+"], ["Apache-2.0", "CC-BY-NC-4.0"], [], ["GPL-3.0+"], ["MIT"], ["MIT"]]
    assert got[7]["n_unknown"] == 1 and got[3]["sentence_ids"] == ["copyright", "mit:permission", "mit:notice", "mit:warranty"]
    assert licenses.license_scan(table.limit(0)).count() == 0


def test_every_phrase_has_a_needed_word():
    joined = lambda words: " ".join(words)
    for words, kind in licenses._GRANT_TABLE.entries.items():
        assert kind == "uses" or licenses.NEEDED.search(joined(words)), words  # "uses" needs a name with "license" or a version
    for name, template in licenses.SENTENCES:
        for words in licenses.expanded(template.replace("*", " ")):
            assert licenses.NEEDED.search(joined(words)), name


TEXTS_OF_LICENCES = {
    "MIT": MIT,
    "BSD-2-Clause": """Copyright (c) 2021, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "Apache-2.0": """Copyright 2022 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
""",
    "GPL-3.0+": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.
""",
}
TEXTS_OF_LICENCES["BSD-3-Clause"] = TEXTS_OF_LICENCES["BSD-2-Clause"].replace("THIS SOFTWARE IS", """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS""")


@pytest.mark.parametrize("name", TEXTS_OF_LICENCES)
def test_texts_of_licences(name):
    text = TEXTS_OF_LICENCES[name]
    for form in (text, "Some words before\n\n" + text.upper() + "\n\nand after.", "\r\n".join("// " + x for x in text.splitlines())):
        assert licenses.scan(form)[0] == [name]


@pytest.mark.parametrize("text, want", [
    ("Foo is licensed under the MIT License.", ["MIT"]), ("This project uses the MIT license.", ["MIT"]), ("Released under the GPL.", ["GPL"]),
    ("GNU General Public License v3.0", ["GPL-3.0"]), ("Licensed under GPLv3+", ["GPL-3.0+"]), ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]),
    ("Licensed under CC BY-SA 4.0 International", ["CC-BY-SA-4.0"]), ("Licensed under the MIT license (see LICENSE).", ["MIT"]),
    ("License: BSD-3-Clause", ["BSD-3-Clause"]), ("It uses the license of its users.", []), ("Er ist mit dem Rad unterwegs und under mit.", []),
    ("Released under the Boost Software License, Version 1.0.", ["BSL-1.0"]), ("You may not distribute it; it was never released under the GPL.", []),
    ("licensed under " + "very " * 9000 + "MIT", []), ("very " * 9000 + "licensed under the LGPL-2.1-or-later", ["LGPL-2.1+"]),
    *((("x " * n) + "licensed under the terms of the GNU Lesser General Public License, version 3 or later", ["LGPL-3.0+"]) for n in range(licenses.RUN - 20, licenses.RUN + 130, 13)),
])
def test_grants_anywhere(text, want):
    assert licenses.scan(text)[0] == want


def brute_phrases(words):
    """Every place, every phrase of the table, the longest first: identifiers of grants in front of names."""
    out, i = [], 0
    while i < len(words):
        grant = max((p for p, k in licenses._GRANT_TABLE.entries.items() if k == "grant" and tuple(words[i : i + len(p)]) == p), key=len, default=())
        after = words[i + len(grant) :]
        name = max((n for n in licenses.NAMES if grant and tuple(after[: len(n)]) == n), key=len, default=())
        if name and not (after[len(name) :] or [""])[0][:1].isdigit():
            out.append("grant:" + licenses.NAMES[name])
        i += len(grant) + len(name) or 1
    return out


def test_grants_by_brute_force():
    rng = np.random.default_rng(12)
    grants = [" ".join(p) for p, k in licenses._GRANT_TABLE.entries.items() if k == "grant"]
    names = [" ".join(n) for n in licenses.NAMES]
    for _ in range(60):
        words = []
        for _ in range(4):
            words += ["so"] * int(rng.integers(1, 4)) + rng.choice(grants).split() + rng.choice(names).split() + ["x"]
        words = licenses.normalise(" ".join(words))
        assert licenses.identifiers(" ".join(words)) == brute_phrases(words), words


@pytest.mark.parametrize("text, want", [
    ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', ["Apache-2.0"]),
    ("The tables, which we made in 2019, are released under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", ["CC-BY-NC-SA-3.0"]),
    ("Photos are available under CC BY-SA 2.0 and CC-BY-ND-2.5.", ["CC-BY-SA-2.0", "CC-BY-ND-2.5"]),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]), ("# SPDX-License-Identifier: CC-BY-SA-3.0", ["CC-BY-SA-3.0"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\n"
     "file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["MPL-2.0"]),
    ("It is free and licensed under the\nGNU GPL version 2 or later, so use it.", ["GPL-2.0+"]),
    ("                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/", ["Apache-2.0"]),
    ("2. Grant of Copyright License. Subject to the terms and conditions of\nthis License, each Contributor hereby grants to You a perpetual,\nworldwide copyright license to "
     "reproduce the Work.\n\n3. Grant of Patent License. Subject to the terms and conditions of\nthis License, each Contributor hereby grants to You a perpetual,\n"
     "worldwide patent license to make the Work.", ["Apache-2.0"]),
    ("Mozilla Public License Version 2.0", ["MPL-2.0"]), ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", ["LGPL-2.1"]),
    ("Creative Commons Attribution-NoDerivatives 4.0 International Public License", ["CC-BY-ND-4.0"]),
    ("Copyright 2020 Somebody, licensed under the ISC license.", ["ISC"]), ("It is not licensed under the MIT License.", []), ("Licensed under an MIT-style license.", []),
    ("He shared under the table.", []), ("Licensed under CC BY 4.1.", []),
])
def test_licences_as_they_are_written(text, want):
    assert licenses.scan(text)[0] == want


def test_triggers_find_sentences_however_they_are_wrapped():
    verbs = ("licensed under", "released under", "distributed to you under", "available under", "provided under", "published under", "shared under", "offered under",
             "covered by", "governed by", "redistributed under", "used under", "reused under", "is subject to", "bound by")
    names = ("GPL, version 3", "ISC", "MPL 2.0", "CC BY 4.0", "CC0", "MIT", "Apache 2.0", "Zlib")
    said = [f"This program is {v} the {n}." for v in verbs for n in names] + [
        "All rights reserved.", "Attribution 4.0 International", "Creative Commons Attribution-ShareAlike 3.0 Unported", "CC0 1.0 Universal",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This is free and unencumbered software released into the public domain.", "GNU General Public License, version 2, June 1991",
        "This program is distributed in the hope that it will be useful, but without any warranty."]
    for text in said:
        assert licenses.identifiers(text), text
        for gap in (" ", "  ", "\n", "\n# ", "\t"):
            licences, known, _ = licenses.scan(text.replace(" ", gap))
            assert known == licenses.identifiers(text), (text, gap)
    assert licenses.scan("This program is released\nunder the GPL, version 3.")[0] == ["GPL-3.0"]
    assert licenses.scan("All rights reserved.") == ([], ["reserved"], 0)


def test_license_lines_of_the_documents(spark):
    lines = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
             "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "MIT": "Released under the MIT License."}
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: set(r["licenses"]) for r in licenses.license_scan(table).collect()}
    for r in table.collect():
        assert got[r["doc_id"]] == {k for k, v in lines.items() if v in (r["text"] or "")}


# ----- HTML -----

PAGES = [
    (None, ""), ("", ""), ("   ", ""), ("plain text only", "plain text only"), ("<p>Unclosed <b>bold<p>next &amp; &lt;last&gt;", "Unclosed bold\n\nnext & <last>"),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><main><h1>Head</h1><p>Body\n text&nbsp;here.</p><p>Ok.</p>"
     "<div class='comments'><p>Reader says so and so at length.</p></div></main><footer>&copy; me</footer></body></html>", "Head\n\nBody text here.\n\nOk."),
    ("<article><header><h1>Title</h1></header><p>First.</p><aside>Side</aside><form><input>Send</form><script>var p='</p>';</script><ul><li>One<li>Two</ul></article>",
     "Title\n\nFirst.\n\nOne\n\nTwo"),
    ("<body><div class=menu><a href=1>A</a><a href=2>B</a></div><div id=content><p>" + "Long paragraph of text. " * 20 + "</p><p>Short.</p><p>" + "More text here. " * 20
     + "</p></div><div class='cookie-notice'>We use cookies to follow you around everywhere you go on the web.</div></body>",
     ("Long paragraph of text. " * 20).strip() + "\n\nShort.\n\n" + ("More text here. " * 20).strip()),
    ("<article><p>A<br>B</p><p>cut of", "A B\n\ncut of"), ("<article><p>x</p><![CDATA[ y ]]><!-- z --><?php q ?></article>", "x"),
    ("<article>" + "<div>" * 500 + "deep" + "</div>" * 500 + "</article>", "deep"),
]


def test_html(spark):
    table = spark.createDataFrame([(i, None if i == 3 else f"u{i}", h, "clash", 5) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r for r in html_text.main_text(table.union(table.where("page_id = 5"))).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i]["text"] == want, i
        assert got[i]["n_chars"] == len(want)
    assert html_text.main_text(table.limit(0)).count() == 0


def test_html_regions_without_article_are_whole():
    long = [f"Paragraph {i}. " + "A sentence of the text. " * 12 for i in range(10)]
    start, end = ["By A. Writer", "12 May"], [f"Closing item number {i}" for i in range(6)]
    links = [f"Reference number {i} of the list" for i in range(3)]
    page = ("<body><nav><a href=/>Home</a></nav><div id=content><h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in start + long) + "<ul>"
            + "".join(f"<li>{x}</li>" for x in end) + "</ul><ol>" + "".join(f"<li><a href=x>{x}</a></li>" for x in links) + "</ol></div></body>")
    assert html_text.extract(page).split("\n\n") == ["Title", *start, *(x.strip() for x in long), *end, *links]
    page = f"<body><div><h1>Title</h1><p>Short.</p><p>{'One paragraph with nearly all of the text. ' * 30}</p><p>End.</p></div></body>"
    assert html_text.extract(page).split("\n\n") == ["Title", "Short.", ("One paragraph with nearly all of the text. " * 30).strip(), "End."]


def test_html_names_do_not_hide_the_article():
    text = "A sentence of the text that goes on for a while. " * 8
    want = ["Title", text.strip(), "Related work", "Short.", "Cookies", "Effects on people."]
    article = (f"<h1>Title</h1><p>{text}</p><h2 id='related-work'>Related work</h2><p>Short.</p><h3 id='cookies'>Cookies</h3>"
               "<section id='social-effects'><p>Effects on people.</p></section><div class='share-buttons'>Share this</div>")
    tail = "<div class='sidebar'><p>Side text</p></div><section class='comments'><article><p>A reader says so.</p></article></section>"
    for inner in (f"<article>{article}</article>", f"<main>{article}</main>", f"<div id=content>{article}</div>"):
        for page in (
            f"<div class='site has-sidebar'><div class='content-sidebar-wrap'>{inner}{tail}</div></div>", f"<form method=post action=x.aspx>{inner}{tail}</form>",
            f"<app-root class='nav-open'>{inner}{tail}</app-root>", f"<div id=page>{inner}{tail}</div>",
            f"<div class='header'><h1>Site</h1></div><div class='page comments-open'>{inner}</div><form><p>Send me the newsletter</p></form>",
        ):
            assert html_text.extract(f"<body><nav>Home</nav>{page}</body>").split("\n\n") == want, page
    assert html_text.extract(f"<article>{article}<p class=ad>Buy it</p><section class=comments><p>{text * 3}</p></section></article>").split("\n\n") == want
    notice = "<div class='cookie-consent'><p>" + "We use cookies. " * 90 + "</p></div>"
    assert html_text.extract(f"<body><div><p>Short page.</p><p>{text}</p></div>{notice}</body>").split("\n\n") == ["Short page.", text.strip()]
    assert html_text.extract("<p>one <span class=ad>buy</span>two</p>") == "one two"


def test_html_smoothing_is_a_gaussian_mean():
    x = np.array([1.0, 5.0, 2.0, 8.0, 0.0, 3.0])
    for i, got in enumerate(html_text.smoothed(x)):
        near = [(math.exp(-0.5 * (i - j) ** 2), x[j]) for j in range(6) if abs(i - j) <= 2]
        assert got == pytest.approx(sum(w * v for w, v in near) / sum(w for w, _ in near))


def test_html_ratios_choose_the_region(monkeypatch):
    text = "A sentence of the text that goes on for a while. " * 6
    links = "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(12))
    pages = {
        f"<body><nav><ul>{links}</ul></nav><article><h1>Title</h1><p>{text}</p></article></body>": ["Title", text.strip()],
        f"<body><div><ul>{links}</ul></div><div><h1>Title</h1><p>{text}</p><p>{text}</p><p>Short.</p></div></body>": ["Title", text.strip(), text.strip(), "Short."],
        f"<body><article><p>Teaser.</p></article><article><p>{text}</p><p>End.</p></article></body>": [text.strip(), "End."],
    }
    for page, want in pages.items():
        assert html_text.extract(page).split("\n\n") == want
    for made in (lambda lines: np.ones(len(lines)), lambda lines: np.linspace(3, 0, len(lines)) ** 2):
        monkeypatch.setattr(html_text, "line_ratios", made)
        assert all(html_text.extract(page).split("\n\n") != want for page, want in list(pages.items())[:2])


def test_html_threshold_parts_two_clusters():
    assert html_text.threshold(np.array([0.1, 5.0, 0.3, 4.0, 4.5, 0.2])) == 4.0
    assert html_text.threshold(np.array([2.0, 2.0])) == 2.0 and html_text.threshold(np.array([7.0])) == 7.0


def test_html_of_deeply_nested_and_long_pages():
    import time

    n = 50_000
    for part in ("<div>some words", "<b>x<h1>y", "<article>ab cd", "<div class=sidebar>some words", "<table><tr><td>x"):
        began = time.perf_counter()
        html_text.extract(part * n)
        assert time.perf_counter() - began < 20, part
    long = "word " * 400_000
    assert html_text.extract(f"<article><p>{long}</p></article>") == long.strip()


# ----- long texts -----


def test_long_texts_are_read_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [" ".join(ITEMS[i][1] or "\t" for i in rng.integers(0, len(ITEMS), n)).encode() for n in (0, 1, 3, 40)] + [b"", None, b" \n ", "é\nü ".encode() * 50]
    searcher = decontam.WuManber([(str(i), decontam.split_words((t or "").encode())) for i, t in ITEMS])
    encoder = packing.Encoder.of(packing.default_tokenizer())

    def everything():
        return (
            [searcher.scan(t) for t in texts], [simhash.fingerprint(t) for t in texts], encoder.encode([t and t.decode() for t in texts]),
            [sum(lm_score.word_runs(t), []) for t in texts],
            [sorted(np.concatenate([*toxicity.grams(t), np.zeros(0, np.uint64)]).tolist()) for t in texts])

    want = everything()
    monkeypatch.setattr(common, "PIECE", 9)
    monkeypatch.setattr(packing, "LONG_TEXT", 20)
    monkeypatch.setattr(toxicity, "_PIECE", 11)
    assert everything() == want


def test_line_scores_are_features_times_weights():
    texts = [b"", None, b"One line.", b"A\n\nB!! C!!\n", b"same\nsame\n" * 3]
    features, length, per_text = quality.line_features(texts)
    weights = np.random.default_rng(8).normal(size=features.shape[1])
    got = quality.line_scores(texts, weights)
    assert np.allclose(got[0], features @ weights) and np.array_equal(got[1], length) and np.array_equal(got[2], per_text)


# ----- the two classifiers, whole queries by brute force -----


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    """A folder with documents and labels, and their rows."""
    rng = np.random.default_rng(41)
    words = "the a house tree river runs sees idiot scum vanish quick 12 345 ABC Ümlaut # | !! http://x.y/z thisisaverylongwordwithoutanymeaning".split()
    texts = []
    for i in range(150):
        lines = [" ".join(rng.choice(words[(0 if i % 3 else 8) : (14 if i % 2 else 21)], int(rng.integers(0, 14)))) for _ in range(int(rng.integers(1, 7)))]
        texts.append("\n".join(lines + lines[:1] * int(rng.integers(0, 2))))
    rows = [*enumerate(texts), (150, None), (151, ""), (152, "\n\n"), (153, texts[3]), (154, "ü" * 400), (None, texts[4]), (155, " \tx  y\r\n##\n")]
    labels = [(i, int(i % 3 != 0), int(i % 2 == 0)) for i in range(0, 150) if i % 7] + [(9, 1, 1), (700, 1, 1), (None, 0, 1), (20, None, None)]
    folder = tmp_path_factory.mktemp("small")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), rows, labels


def brute_training(spark, rows, labels, column, bound):
    """(text, label) of the rows learnt from, in the order that training takes them."""
    import zlib

    known = defaultdict(list)
    for r in labels:
        if r[0] is not None and r[column] is not None and zlib.crc32(str(r[0]).encode()) % 5:
            known[r[0]].append(r[column])
    texts = {i: t for i, t in rows if i in known}
    ranks = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in texts], "id long").selectExpr("id", "xxhash64(id)").collect()}
    return [(texts[i], max(known[i])) for i in sorted(texts, key=lambda i: (ranks[i], i))[:bound]]


def brute_line(line: bytes, twice: bool) -> list[float]:
    """Features of one line, byte by byte."""
    kinds = ["lower" if 97 <= b <= 122 else "upper" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else "space" if b in b" \t\r" else "punct" if b in b".,;:'\"()?-"
             else "control" if b < 32 or b == 127 else "high" if b >= 128 else "symbol" for b in line]
    count, words, n = Counter(kinds), line.replace(b"\t", b" ").replace(b"\r", b" ").split(b" "), max(len(line), 1)
    words = [w for w in words if w]
    symbol = lambda b: not (b >= 128 or b < 32 or b == 127 or chr(b).isalnum() or b in b" .,;:'\"()?-")
    per = max(len(words), 1)
    share = {k: count[k] / n for k in ("digit", "space", "punct", "symbol", "high", "control")}
    upper = count["upper"] / max(count["lower"] + count["upper"] + count["high"], 1)
    repeated = sum(a == b for a, b in zip(words, words[1:])) / per
    out = [math.log1p(len(line)) / 5, math.log1p(len(words)) / 3, min((len(line) - count["space"]) / per / 10, 3), share["digit"], share["space"], share["punct"],
           share["symbol"], share["high"], share["control"], upper, repeated, sum(len(w) > 24 for w in words) / per, sum(symbol(w[-1]) for w in words) / per,
           sum(len(w) == 1 and symbol(w[0]) for w in words) / per, not line, bool(line) and kinds[-1] == "punct", len(words) == 1]
    for x, steps in ((upper, (0.1, 0.3, 0.6)), (share["symbol"], (0.005, 0.02, 0.06)), (share["digit"], (0.02, 0.1)), (repeated, (0.02, 0.1, 0.4)), (share["punct"], (0.02, 0.05, 0.1))):
        out += [x > s for s in steps]
    return [float(x) for x in [*out, twice]]


def brute_features(text) -> tuple[list[list[float]], list[int]]:
    lines = (text or "").encode().split(b"\n")
    own = [brute_line(x, bool(x) and lines.count(x) > 1) for x in lines]
    none = [0.0] * len(own[0])
    full = [own[i] + (own[i - 1] if i else none) + (own[i + 1] if i + 1 < len(own) else none) + [float(i == 0), float(i + 1 == len(own)), 1.0] for i in range(len(own))]
    return full, [len(x) for x in lines]


def test_quality_query_by_brute_force(spark, small_corpus):
    import zlib

    sf, rows, labels = small_corpus
    chosen = [(*brute_features(t), y) for t, y in brute_training(spark, rows, labels, 1, quality.TRAIN_BOUND)]
    table = np.array([f for features, _, _ in chosen for f in features], np.float32).astype(float)  # as they travel
    sizes = np.array([len(f) for f, _, _ in chosen])
    model = quality.fit(table, np.array([n for _, lengths, _ in chosen for n in lengths], float), sizes, np.array([y for _, _, y in chosen]))
    got = {(r["doc_id"], r["held_out"]): (r["score"], r["predicted"]) for r in quality.op5_quality(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        features, lengths = brute_features(text)
        unary = [sum(a * w for a, w in zip(f, model.weights)) for f in features]
        (bb, bg), (gb, gg) = np.exp(model.move)
        ahead = [(1.0, math.exp(unary[0]))]
        for x in unary[1:]:
            b, g = ahead[-1]
            ahead.append((b * bb + g * gb, (b * bg + g * gg) * math.exp(x)))
        back = [(1.0, 1.0)]
        for x in reversed(unary[1:]):
            b, g = back[-1][0], back[-1][1] * math.exp(x)
            back.append((bb * b + bg * g, gb * b + gg * g))
        back.reverse()
        good = [a[1] * z[1] / (a[0] * z[0] + a[1] * z[1]) for a, z in zip(ahead, back)]
        mean = min(max(sum(p * (n + 1) for p, n in zip(good, lengths)) / sum(n + 1 for n in lengths), 1e-4), 1 - 1e-4)
        want = 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * mean + model.curve[2] * math.log(mean / (1 - mean)))))
        score, predicted = got[i, i is None or zlib.crc32(str(i).encode()) % 5 == 0]
        assert score == pytest.approx(want, abs=1e-5) and predicted == (score >= 0.3), i


def test_toxicity_query_by_brute_force(spark, small_corpus, monkeypatch):
    import zlib

    monkeypatch.setattr(toxicity, "FEATURES", 300)
    sf, rows, labels = small_corpus

    def present(text):
        words = (text or "").lower().split()
        padded = f" {' '.join(words)} ".encode() if words else b""
        counts = Counter(padded[i : i + n] for n in toxicity.ORDERS for i in range(len(padded) - n + 1))
        return {int.from_bytes(g, "little") | len(g) << 56 | k << 60 for g, c in counts.items() for k, least in enumerate(toxicity.TIMES) if c >= least}

    chosen = [(present(t), y) for t, y in brute_training(spark, rows, labels, 2, toxicity.TRAIN_BOUND)]
    n = Counter(y for _, y in chosen)
    seen = {y: Counter(f for fs, label in chosen if label == y for f in fs) for y in (0, 1)}
    says = {}
    for f in seen[0] | seen[1]:
        if seen[0][f] + seen[1][f] >= toxicity.MIN_DOCS:
            rates = [(seen[y][f] + 1) / (n[y] + 2) for y in (0, 1)]
            says[f] = ((rates[1] - rates[0]) * math.log(rates[1] / rates[0]), math.log(rates[1] / rates[0]))
    signed = lambda f: f - 2**64 if f >> 63 else f
    best = sorted(sorted(says, key=lambda f: (-says[f][0], signed(f)))[:300])
    at = {f: k for k, f in enumerate(best)}
    model = toxicity.fit(np.array(best, np.uint64), np.array([says[f][1] for f in best]), [np.array(sorted(at[f] for f in fs if f in at), np.int64) for fs, _ in chosen],
                         np.array([y for _, y in chosen]))
    weight = dict(zip(best, model.weights))
    got = {(r["doc_id"], r["held_out"]): (r["score"], r["predicted"]) for r in toxicity.op8_toxicity(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = 1 / (1 + math.exp(-model.constant - sum(weight[f] for f in present(text) if f in weight)))
        score, predicted = got[i, i is None or zlib.crc32(str(i).encode()) % 5 == 0]
        assert score == pytest.approx(want, abs=1e-6) and predicted == (score >= 0.5), i


LONG_P = "Here is a paragraph of some length that tells a part of the story in whole sentences. " * 4
PROBES = [
    (f"<body><article class='post comments-open'><p>{LONG_P}</p><p>{LONG_P}</p><p>{LONG_P}</p></article></body>", 3, []),
    (f"<body><article><div class='article-header'><h1>Title</h1></div><p>{LONG_P}</p></article></body>", 2, ["Title"]),
    (f"<body><div class='entry'><div class='post-header'><h1>Title</h1></div><p>{LONG_P}</p><p>{LONG_P}</p></div></body>", 3, ["Title"]),
    (f"<body><main><article><p>{LONG_P}</p></article><article><p>{LONG_P * 2}</p></article></main></body>", 2, []),
    (f"<body><div><article><p>{LONG_P}</p></article><article><p>{LONG_P * 2}</p></article></div></body>", 2, []),
    (f"<body><article><p>{LONG_P}</p><div class='related-work'><p>{LONG_P}</p></div></article></body>", 2, []),
    (f"<body><article><p>{LONG_P}</p><div class='related'><a href=x>One more</a> <a href=y>Another one</a></div></article></body>", 1, []),
    ("<body><div>" + "".join(f"<li><a href={i}>Menu item {i}</a></li>" for i in range(20)) + f"</div><div><p>{LONG_P}</p><p>{LONG_P}</p><p>{LONG_P}</p><p>{LONG_P}</p></div><div>Copyright 2020 Site</div></body>", 4, []),
    (f"<body><main><p>{LONG_P}</p><div class='user-opinions'><p>{LONG_P}</p></div></main></body>", 1, []),
    (f"<body><article><p>{LONG_P}</p></article><article class='comment'><p>{LONG_P}</p></article><article id='comment-7'><p>{LONG_P}</p></article></body>", 1, []),
]


@pytest.mark.parametrize("page, count, first", PROBES)
def test_html_of_blogs_and_plain_pages(page, count, first):
    """State names, headers of articles, sibling articles, sections named like link lists, menus and notes beside the text."""
    blocks = html_text.extract(page).split("\n\n")
    assert len(blocks) == count and blocks[: len(first)] == first, blocks
    assert all(b.startswith("Here is a paragraph") for b in blocks[len(first):])


@pytest.mark.parametrize("text, want", [
    ("Apache 2.0", ["Apache-2.0"]), ("Apache 2.0\n\nCome under the tree.", ["Apache-2.0"]), ("CC BY 4.0", ["CC-BY-4.0"]), ("MPL 2", ["MPL-2.0"]),
    ("This code is MIT licensed.", ["MIT"]), ("Apache 2.0 licensed", ["Apache-2.0"]), ("It is MIT-licensed, take it.", ["MIT"]), ("This is not MIT licensed.", []),
    ("Under the MIT license, you may use it.", ["MIT"]), ("Use it under the terms of the GNU General Public License version 2 only.", ["GPL-2.0"]),
    ("See https://opensource.org/licenses/MIT for more.", ["MIT"]), ("https://www.gnu.org/licenses/gpl-3.0.html", ["GPL-3.0"]),
    ("https://creativecommons.org/licenses/by-nc/4.0/", ["CC-BY-NC-4.0"]), ("By 4 May 2020 all was done.", []), ("He came under the apache tree.", []), ("mit licht und Luft", []),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
     "1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.\n"
     "3. Neither the name of " + "one holder and " * 300 + "the last may be used to endorse or promote products.", ["BSD-3-Clause"]),
])
def test_license_wordings_and_long_stars(text, want):
    assert licenses.scan(text)[0] == want
