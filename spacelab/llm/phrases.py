"""Phrase collocation mining by Apriori level-wise passes.

Pass k reads the whole texts and counts the k-grams whose two overlapping (k-1)-grams both occur at least ``SUPPORT``
times; pass 1 counts every word.  What was frequent one level down is broadcast as a bitmap of bounded size, 16 bits a
phrase: it never misses a frequent phrase, and the few others that it lets through are dropped by the exact counts, so
no phrase is lost or gained however full the bitmap is.  Counts are added up in each task, under the phrases themselves,
before they are shuffled.  Each level's table is written; joins with these tables give the two parts of every cut of a
candidate.

Counts, cuts and rankings are apart for each language.  Cutting a phrase of a occurrences among n words after its first
k words gives l and r occurrences of the parts and the score floor(1000 a n / (l r)), in 38-digit integers; a candidate
has its lowest score, at the smallest such k.  A candidate that a longer one of as many occurrences contains is dropped.

Defined results: a null text counts as empty, a null language as ``und``; a text without words adds nothing; repeated
rows count each; equal scores rank by occurrences, then by the phrase's bytes; a very long text is read in runs cut
where no word is, its runs overlapping by the words that a phrase may still need; an empty table gives an empty result;
extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import Bitmap
from .common import lean, portions, text_bytes, written

SUPPORT = 100
LONGEST = 5
BEST = 2000
SEED = 11
RUN = 1 << 20  # bytes of a text read at once
PORTION = 8 << 20  # bytes of texts that are counted together
TOKENS = 1 << 22

#: A-Z become lower case, tabs blanks, the nine separators full stops, which no word then holds.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 9 else 0x2E if chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D else b for b in range(256)
)
_CUT = re.compile(rb"[ .]")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def token_runs(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of a text and b"." between its pieces, in runs of bounded size."""
    folded, at = (text or b"").translate(_FOLD), 0
    while at < len(folded):
        found = _CUT.search(folded, at + RUN) if at + RUN < len(folded) else None
        end = found.end() if found else len(folded)
        yield folded[at:end].replace(b".", b" . ").split()
        at = end


def _grown(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    with np.errstate(over="ignore"):
        x = (hashes ^ (hashes >> np.uint64(31))) * _STEP + words
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def _start(lang: bytes) -> int:
    return xxhash.xxh64_intdigest(lang, SEED + 1)


def phrase_hash(lang: bytes, phrase: bytes) -> int:
    """The hash under which a phrase is known in the bitmaps."""
    state = np.array([_start(lang)], np.uint64)
    for word in phrase.split(b" "):
        state = _grown(state, np.array([xxhash.xxh64_intdigest(word, SEED)], np.uint64))
    return int(state[0])


class _Portion:
    """Tokens of some texts as numbers, 0 between pieces and texts."""

    def __init__(self):
        self.index: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.index[b"."]
        self.ids: list[np.ndarray] = []
        self.langs: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: list[bytes], lang: int) -> None:
        ids = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        self.ids += [ids, np.zeros(1, np.int64)]
        self.langs.append(np.full(len(ids) + 1, lang, np.int64))
        self.size += len(ids) + 1

    def grams(self, k: int, langs: list[bytes], frequent: Bitmap | None) -> pa.RecordBatch | None:
        """(lang, phrase, f): the k-grams that may be frequent, each once, with their occurrences here."""
        ids, lang = np.concatenate(self.ids), np.concatenate(self.langs)
        n = len(ids) - k + 1
        if n <= 0:
            return None
        whole = np.ones(n, bool)
        for i in range(k):
            whole &= ids[i : i + n] > 0
        names, at = list(self.index), np.flatnonzero(whole)
        if frequent is not None:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in names), np.uint64, len(names))[ids]
            state = np.array([_start(x) for x in langs], np.uint64)[lang]
            for i in range(k - 1):
                state = _grown(state[: len(ids) - i], hashes[i:])
            # state[i] now stands for the k-1 words from i on
            at = at[frequent.holds(state[at])]
            at = at[frequent.holds(state[at + 1])]
        if not len(at):
            return None
        code, size = lang[at], len(langs)
        for i in range(k):  # numbers of equal phrases, made small again before they pass 63 bits
            if size * len(names) >> 62:
                known, code = np.unique(code, return_inverse=True)
                size = len(known)
            code, size = code * len(names) + ids[at + i], size * len(names)
        _, first, many = np.unique(code, return_index=True, return_counts=True)
        at = at[first]
        words = pa.array(names, pa.binary())
        parts = [words.take(pa.array(ids[at + i])) for i in range(k)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if k > 1 else parts[0]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.binary()).take(pa.array(lang[at])), phrase, pa.array(many.astype(np.int64))], names=["lang", "phrase", "f"])

    def words(self, langs: list[bytes]) -> pa.RecordBatch:
        """(lang, null, words of the language here)."""
        many = np.bincount(np.concatenate(self.langs)[np.concatenate(self.ids) > 0], minlength=len(langs))
        some = np.flatnonzero(many)
        return pa.RecordBatch.from_arrays(
            [pa.array([langs[i] for i in some], pa.binary()), pa.nulls(len(some), pa.binary()), pa.array(many[some].astype(np.int64))], names=["lang", "phrase", "f"])


def _level(rows: DataFrame, k: int, frequent: Bitmap | None) -> DataFrame:
    """(lang, phrase, f) of the k-grams that may be frequent, in full counts; at level 1 also each language's words under a null phrase.

    A task counts a portion of texts at a time; its portions are added up before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, "text", PORTION):
                names = [x or b"" for x in text_bytes(batch.column("lang"))]
                langs = sorted(set(names))
                number = {x: i for i, x in enumerate(langs)}
                portion = _Portion()

                def counted() -> Iterator[pa.RecordBatch]:
                    if portion.size:
                        found = portion.grams(k, langs, frequent)
                        if found is not None:
                            yield found
                        if k == 1:
                            yield portion.words(langs)

                for name, text in zip(names, text_bytes(batch.column("text"))):
                    tail: list[bytes] = []
                    for tokens in token_runs(text):
                        if tail and k > 1:  # phrases that begin in the run before
                            portion.add(tail + tokens[: k - 1], number[name])
                        portion.add(tokens, number[name])
                        tail = (tail + tokens)[-(k - 1) :] if k > 1 else []
                        if portion.size > TOKENS:
                            yield from counted()
                            portion = _Portion()
                yield from counted()

    made = rows.mapInArrow(lean(run), "lang binary, phrase binary, f long")
    named = made.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "f")
    return named.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def levels(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of every phrase of ``support`` occurrences, (lang, n) words of each language)."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    frequent, found, sizes = None, None, None
    for k in range(1, longest + 1):
        table = written(_level(rows, k, frequent).where((F.col("f") >= support) | F.col("phrase").isNull()))
        if k == 1:
            sizes = table.where("phrase is null").select("lang", F.col("f").alias("n"))
        here = table.where("phrase is not null").select("lang", "phrase", F.lit(k).alias("words"), "f")
        found = here if found is None else found.unionByName(here)
        if k < longest:
            frequent = Bitmap.of(here.mapInArrow(_hashed, "h long"), "h")
    return found, sizes


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases -> the hashes of the bitmaps."""
    for batch in batches:
        made = [phrase_hash(a, b) for a, b in zip(text_bytes(batch.column("lang")), text_bytes(batch.column("phrase")))]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(made, np.uint64).view(np.int64))], names=["h"])


def _salted(rows: DataFrame, table: DataFrame, spread: str, salts: int = 8) -> DataFrame:
    """rows joined with the level tables by (lang, phrase); common words are parts of many candidates, so both sides are salted."""
    each = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(each.hint("merge"), ["lang", "phrase", "salt"]).drop("salt")


def scored(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate at its lowest cut, dropped ones left out."""
    candidates = found.where("words >= 2").select("lang", F.col("phrase").alias("whole"), "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "whole", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = cuts.select("lang", "whole", "a", "k", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("phrase")),
        F.struct(F.lit(1).alias("side"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("phrase")))).alias("part"))
    known = _salted(parts.select("lang", "whole", "a", "k", "part.side", "part.phrase"), found.select("lang", "phrase", "f"), "whole")
    both = known.groupBy("lang", "whole", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    # (lang, n) has a row a language; its size is checked before it is broadcast
    sized = both.join(F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes.hint("merge"), "lang")
    thousandfold = (wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)").alias("top")
    sized = sized.select("lang", "whole", "a", "k", "l", "r", "n", thousandfold, (wide("l") * wide("r")).cast("decimal(38,0)").alias("under"))
    sized = sized.select("lang", "whole", "a", "n", F.struct(F.expr("top DIV under").cast("long").alias("score"), "k", "l", "r").alias("cut"))
    lowest = sized.groupBy("lang", "whole", "a", "n").agg(F.min("cut").alias("cut"))
    inside = candidates.where("words >= 3").select(
        "lang", "a", "words", "w", F.explode(F.expr("sequence(2, words - 1)")).alias("size"))
    inside = inside.select("lang", "a", "w", "size", F.explode(F.expr("sequence(1, words - size + 1)")).alias("at"))
    inside = inside.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("whole"), "a")
    inside = inside.groupBy("lang", "whole").agg(F.max("a").alias("longer"))
    kept = lowest.join(inside.hint("merge"), ["lang", "whole"], "left").where("longer IS NULL OR longer < a")
    return kept.select("lang", F.col("whole").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(rows: DataFrame, best: int = BEST) -> DataFrame:
    """The first ``best`` of each language with their rank; the ranking runs in parts before it runs over their firsts."""
    from pyspark.sql import Window

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    firsts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best).drop("part", "rank")
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST, best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best-scored phrases of each language."""
    found, sizes = levels(docs, text_col, lang_col, support, longest)
    return ranked(written(scored(found, sizes)), best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS words, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p WHERE len(w) >= {k})"
        for k in range(1, LONGEST + 1))
    return f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
s AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM s),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, words, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {SUPPORT}),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words >= 2),
k AS (SELECT lang, phrase, words, a, w, unnest(range(1, words)) AS k FROM c),
x AS (SELECT k.*, l.f AS l, r.f AS r, n.n FROM k JOIN n USING (lang)
  JOIN f AS l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f AS r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
y AS (SELECT *, CAST((1000::HUGEINT * a * n) // (l::HUGEINT * r) AS BIGINT) AS score FROM x),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
e AS (SELECT lang, a, w, words, unnest(range(2, words)) AS size FROM c),
i AS (SELECT lang, array_to_string(w[j:j + size - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, words - size + 2)) AS j FROM e) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM z LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {BEST}"""


ORACLE = _sql()
