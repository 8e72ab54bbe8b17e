"""Phrase collocations and b-bit MinHash near-duplicates: definitions, odd rows, brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spacelab.llm import minhash, phrases
from spacelab.llm.bitmap import Bitmap

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, phrase string, f double, node int, n string, key long"


def docs(spark, rows):
    """Documents with columns that clash with what operators add."""
    return spark.createDataFrame([(i, t, lang, "p", 0.5, 7, None, 1) for i, t, lang in rows], DOCS)


# ----- phrases -----


def brute_phrases(rows, support, best=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = {}
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        hidden = {q for p, a in candidates.items() for size in range(2, len(p)) for i in range(len(p) - size + 1)
                  for q in [p[i : i + size]] if 100 * a >= 100 * counts[q]}
        lines = []
        for p, a in candidates.items():
            if p not in hidden:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                lines.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(lines)[:best], 1):
            out[lang, rank] = (phrase.decode(), -a, l, r, n[lang], -score)
    return out


def found_phrases(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


def prose(seed, lines, words):
    pick = random.Random(seed)
    return " ".join(pick.choice(["alpha beta", "gamma", "delta epsilon zeta eta theta", "Beta", "iota."]) + pick.choice([" ", "\t ", ", ", "\x0b", " kappa "]) + f"w{pick.randrange(words)}" for _ in range(lines))


@pytest.mark.parametrize("rows", [
    [],
    [(None, None, None), (1, "", "en"), (2, " \t.,;", "en"), (2, None, "en")],
    [(i, prose(i, 40, 30), ["en", "de", None][i % 3]) for i in range(60)],
    [(1, "a a a a a a a a", "en")] * 30 + [(2, "xé É\x1cy xé É\x1cy! xé", None)] * 40,  # overlaps, bytes beyond ASCII, repeated rows
])
def test_phrases_by_brute_force(spark, rows):
    got = found_phrases(phrases.collocations(docs(spark, rows).repartition(5), support=8))
    assert got == brute_phrases(rows, 8)


def test_phrases_of_long_texts_and_short_runs(spark, monkeypatch):
    """Runs and sends far below a text's size change nothing; one text of a megabyte, one without blanks."""
    rows = [(1, prose(1, 60_000, 50), "en"), (2, "z." * 200_000 + "tail end", "en"), (3, "tail end " * 30, "en")]
    want = brute_phrases(rows, 20, 50)
    assert found_phrases(phrases.collocations(docs(spark, rows), support=20, best=50)) == want
    got = []
    for text in (r[1] for r in rows):
        monkeypatch.setattr(phrases, "RUN", 100)
        got.append([t for run in phrases.token_runs(text.encode()) for t in run])
        monkeypatch.setattr(phrases, "RUN", 1 << 30)
        assert [t for run in phrases.token_runs(text.encode()) for t in run] == got[-1]


def test_phrase_scores_pass_64_bits(spark):
    table = spark.createDataFrame([("en", "a b", 2, 10**15), ("en", "a", 1, 10**15 + 7), ("en", "b", 1, 3 * 10**15)], "lang string, phrase string, words int, f long")
    sizes = spark.createDataFrame([("en", 9 * 10**17)], "lang string, n long")
    row = phrases.scored(table, sizes).first()
    assert row["score"] == 1000 * 10**15 * 9 * 10**17 // ((10**15 + 7) * 3 * 10**15)


def test_equal_scores_rank_by_occurrences_then_bytes(spark):
    rows = [("en", p, a, 1, 1, 9, 5) for p, a in (("b", 3), ("é", 3), ("a", 3), ("z", 4))]
    table = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    assert [r["phrase"] for r in phrases.ranked(table, 3).orderBy("rank").collect()] == ["z", "a", "b"]


def test_bitmap_misses_nothing_and_stays_bounded(spark):
    values = np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64)
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "h long")
    for most in (29, 12):
        told = Bitmap.of(table, "h", most)
        assert told.holds(values).all() and told.bits <= most
    few = Bitmap.of(table.limit(0), "h")
    assert not few.holds(values).any()
    others = np.random.default_rng(2).integers(0, 1 << 64, 5000, dtype=np.uint64)
    assert Bitmap.of(table, "h").holds(others).mean() < 0.1


# ----- MinHash -----


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def brute_components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return Counter((r[0], len(sets[i]), ids[find(i)], r[0] is not None and r[0] == ids[find(i)]) for i, r in enumerate(rows))


def varied(seed, count, words, changes, base=None):
    """Near copies of one text."""
    pick = random.Random(seed)
    base = base or [f"t{pick.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(count):
        mine = list(base)
        for _ in range(pick.randrange(changes + 1)):
            mine[pick.randrange(len(mine))] = f"v{pick.randrange(10**6)}"
        out.append(" ".join(mine))
    return out


def found_components(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_minhash_by_brute_force(spark):
    texts = [t for s in range(6) for t in varied(s, 12, 40 + 30 * s, 3)]
    texts += ["One two", "one TWO", "one two three four", "one two three four five", "", " \t", None, "x", "\x1cx y", "x y"]
    rows = [(i * 3 % 1000, t, "en") for i, t in enumerate(texts)] + [(None, texts[0], None), (None, None, None), (None, "alone and without id", None), (5000, texts[3], None), (5000, texts[3], None)]
    assert found_components(minhash.near_duplicates(docs(spark, rows).repartition(4))) == brute_components(rows)


@pytest.mark.parametrize("group", [minhash.GROUP, 8])
def test_minhash_of_crowded_buckets(spark, group):
    """Long chains of near copies around one text, and texts that share a half without linking; small groups are dealt again."""
    pick = random.Random(9)
    half = [f"h{i}" for i in range(60)]
    apart = [" ".join(half + [f"u{pick.randrange(10**7)}" for _ in range(25)]) for _ in range(40)]
    rows = [(i, t, "en") for i, t in enumerate(varied(3, 120, 60, 4) + apart)]
    assert found_components(minhash.near_duplicates(docs(spark, rows), group=group)) == brute_components(rows)


def test_minhash_empty_table_and_long_text(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    pick = random.Random(4)
    words = [f"w{pick.randrange(3000)}" for _ in range(400_000)]  # over two megabytes: several runs
    close = words[:399_000] + ["other"] * 10
    rows = [(1, " ".join(words), "en"), (2, "\n".join(close).upper(), "en"), (3, "blankless" * 200_000, "en")]
    assert found_components(minhash.near_duplicates(docs(spark, rows))) == brute_components(rows)


def test_minhash_estimate_and_set(spark):
    text = " ".join(f"w{i % 90}" for i in range(500))
    assert len(minhash.shingle_set(text.encode())) == len(shingles(text)) == 90
    pool = np.random.default_rng(7).integers(0, 1 << 64, 4000, dtype=np.uint64)
    a, b = np.sort(pool[:3600]), np.sort(pool[400:])  # 3200 of 4000 in common
    x, y = minhash.minima(a), minhash.minima(b)
    signatures = np.frombuffer(minhash.packed(x) + minhash.packed(y), np.uint64).reshape(2, -1)
    equal = int(minhash.matches(signatures, np.array([0]), np.array([1]))[0, 0])
    assert abs(minhash.similarity(equal) - 0.8) < 0.15 and equal >= minhash.least_matches()
    assert abs((x == y).mean() - 0.8) < 0.15 and (minhash.band_keys(x) == minhash.band_keys(y)).sum() > 3
