"""Toxicity by a character n-gram linear classifier on naive Bayes log-count ratios.

Features are n-grams of 3 to 6 UTF-8 code units of the lower-cased text between two spaces that occur at least once,
twice, three or five times.  Each has the log-ratio of its smoothed document counts in toxic and other texts, and a
logistic model is fitted to indicator times ratio.  An n-gram of up to seven bytes is a number, so grams are compared
exactly: a small hash table proposes a feature, equality of the number confirms it.

Training uses at most ``TRAIN_BOUND`` labelled rows outside the held-out fold (ranked by a hash of their id).  Executors count the grams, Spark adds the counts up and keeps the ``FEATURES``
strongest; the driver gets these and each text's feature numbers.  Scoring reads every document whole, once, without a shuffle.

Defined results: a null or empty text has no grams and gets the constant's score; a very long text is read in pieces, cut
at white space or, where there is none, between code points; bytes that are not UTF-8 read as replacement characters;
features that say equally much go by their numbers, training rows of equal hash by their label and features; with no labelled rows, or only one
label, every score is the share of label 1 (0 without rows); repeated rows score alike; an empty table gives an empty
result; extra columns, whatever their names, are not read (``keep_clean`` carries them along unchanged).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, id_type, keep_rows, keyed_text, lean, portions, text_bytes, training_rows, written

TRAIN_BOUND = 6000
ORDERS = (3, 4, 5, 6)
FEATURES = 20_000  # held out at sf0.1: area under the curve 0.975 with 1,000, 0.987 with 4,000, 0.994 with 40,000
MIN_DOCS = 4
SMOOTH = 1.0
THRESHOLD = 0.5
TIMES = (1, 2, 3, 5)  # a feature: the gram occurs so often at least
_SLOTS = 20
_GRAM = np.uint64((1 << 60) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 18
PART_BYTES = 1 << 21
_BLANK = re.compile(rb"[ \t-\r]")


def _runs(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """The lower-cased text in pieces of about ``_PIECE`` bytes, cut at white space, or where there is none between
    code points; and whether a piece ends inside a word."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        inside = False
        if end < len(text):
            blank = _BLANK.search(text, end, end + _PIECE)
            if blank:
                end = blank.end()
            else:
                end += _PIECE
                inside = end < len(text)
                while inside and end > at + 1 and end < len(text) and text[end] & 0xC0 == 0x80:
                    end -= 1
        yield text[at:end].decode("utf-8", "replace").lower().encode(), inside
        at = end


def grams(text: bytes | None) -> Iterator[np.ndarray]:
    """All n-grams of a text, with repeats, as numbers whose high byte holds the order; piece by piece."""
    longest, tail, any_word, inside = max(ORDERS), b" ", False, False
    for piece, goes_on in itertools.chain(_runs(text) if text else (), ((None, False),)):
        words = piece.split() if piece is not None else []
        if inside and (piece is None or not words or piece[:1].isspace()):
            tail, inside = tail + b" ", False
        if words:
            any_word, inside = True, goes_on and not piece[-1:].isspace()
            tail += b" ".join(words) + (b"" if inside else b" ")
        if len(tail) > longest and words or piece is None and any_word:
            last = piece is None
            whole = np.ndarray((len(tail),), "<u8", tail + bytes(8), strides=(1,))
            for n in ORDERS:  # a gram is yielded where it starts before the part that the next piece begins with
                count = len(tail) - n + 1 if last else len(tail) - longest + 1
                if count > 0:
                    yield (whole[:count] & np.uint64((1 << 8 * n) - 1)) | np.uint64(n << 56)
            tail = b"" if last else tail[len(tail) - longest + 1 :]


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * _MIX) >> np.uint64(64 - _SLOTS)


@dataclass
class Model:
    features: np.ndarray  # sorted; a gram's number with the place in TIMES above it
    weights: np.ndarray
    constant: float
    prior: float

    def __post_init__(self):
        self.base, self._of = np.unique(self.features & _GRAM, return_inverse=True)
        self._least = np.array(TIMES)[(self.features >> np.uint64(60)).astype(int)]
        self._used = np.zeros(1 << _SLOTS, bool)
        self._used[_slot(self.base)] = True

    def present(self, text: bytes | None) -> np.ndarray:
        """Positions of the features that hold for a text."""
        counts = np.zeros(len(self.base) + 1, np.int64)
        for g in grams(text):
            g = g[self._used[_slot(g)]]
            at = np.searchsorted(self.base, g)
            g, at = g[at < len(self.base)], at[at < len(self.base)]
            counts += np.bincount(at[self.base[at] == g], minlength=len(counts))
        return np.flatnonzero(counts[self._of] >= self._least)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not len(self.features):
            return np.full(len(texts), self.prior)
        x = np.array([self.weights[self.present(t)].sum() + self.constant for t in texts], np.float64)
        return 0.5 * (1 + np.tanh(0.5 * x))


def levels(text: bytes | None) -> Iterator[np.ndarray]:
    """All features that hold for a text, each once, in parts: a long text is read once for each part of the grams, so
    that their number in one part is bounded."""
    parts = max(1, len(text or b"") // PART_BYTES)
    for part in range(parts):
        mine = (g if parts == 1 else g[(g * _MIX >> np.uint64(32)) % np.uint64(parts) == np.uint64(part)] for g in grams(text))
        g, n = _added_up(mine)
        if len(g):
            yield np.concatenate([g[n >= least] | np.uint64(k << 60) for k, least in enumerate(TIMES)])


def _added_up(runs: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of all runs, sorted, with their counts; repeats are added up as soon as a few runs are there."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, most = 0, 1 << 21

    def merged() -> tuple[np.ndarray, np.ndarray]:
        numbers = np.concatenate([g for g, _ in held]) if held else np.zeros(0, np.uint64)
        if all(len(c) == 0 for _, c in held):
            return np.unique(numbers, return_counts=True)
        counts = np.concatenate([c if len(c) else np.ones(len(g), np.int64) for g, c in held])
        order = np.argsort(numbers)
        numbers, counts = numbers[order], counts[order]
        first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
        return numbers[first], np.add.reduceat(counts, first)

    for g in runs:
        held.append((g, g[:0].astype(np.int64)))
        size += len(g)
        if size > most:
            held = [merged()]
            size, most = len(held[0][0]), max(most, 2 * len(held[0][0]))
    return held[0] if len(held) == 1 and len(held[0][1]) else merged()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) rows -> (feature, documents of label 0 and 1 that have it), added up within each portion."""

    def rows(label: int, found: list[np.ndarray]) -> pa.RecordBatch:
        g, n = np.unique(np.concatenate(found), return_counts=True) if len(found) > 1 else (found[0], np.ones(len(found[0]), np.int64))
        counts = [np.zeros(len(g), np.int64), n.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(counts[1 - label]), pa.array(counts[label])], names=["gram", "n0", "n1"])

    for batch in batches:
        for part in portions(batch, "text", 1 << 20):
            for label in (0, 1):
                held = []
                for text, y in zip(text_bytes(part.column("text")), part.column("label").to_pylist()):
                    if (y > 0) == label and text and len(text) < PART_BYTES:
                        held += levels(text)
                    elif (y > 0) == label:
                        for found in levels(text):
                            yield rows(label, [found])
                if held:
                    yield rows(label, held)


def fit(features: np.ndarray, ratio: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, ridge: float = 0.02, steps: int = 400) -> Model:
    """Logistic model on indicator times ratio; rows: the positions of each text's features."""
    prior = float(labels.mean()) if len(labels) else 0.0
    if not len(features) or prior in (0.0, 1.0):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, prior)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows) if len(doc) else np.zeros(0, np.int64)
    value = ratio[feature]
    norm = max(float(np.sqrt((np.bincount(doc, value**2, minlength=len(rows))).mean())), 1e-9)
    value = value / norm
    weight = np.where(labels == 1, 0.5 / prior, 0.5 / (1 - prior))  # both classes weigh alike; the constant undoes it
    weight = weight / len(labels)
    w, c = np.zeros(len(features)), 0.0
    v, vc = np.zeros_like(w), 0.0
    # the matrix by rows and by columns, so that both products are sums of runs
    sizes = np.array([len(r) for r in rows])
    full, begins = np.flatnonzero(sizes), (np.cumsum(sizes) - sizes)[sizes > 0]
    by = np.argsort(feature, kind="stable")
    used, first = np.unique(feature[by], return_index=True)
    value, feature = value.astype(np.float32), feature.astype(np.int32)
    value_by, doc_by = value[by], doc[by].astype(np.int32)
    sums, slope = np.zeros(len(rows)), np.zeros(len(w))
    for n in range(steps):  # gradient steps with momentum
        if len(value):
            sums[full] = np.add.reduceat(value * w.astype(np.float32)[feature], begins)
        p = 0.5 * (1 + np.tanh(0.5 * (sums + c)))
        d = weight * (labels - p)
        if len(value):
            slope[used] = np.add.reduceat(value_by * d.astype(np.float32)[doc_by], first)
        v = 0.9 * v + slope - ridge * 1e-2 * w
        vc = 0.9 * vc + d.sum()
        w, c = w + 2.0 * v, c + 2.0 * vc
    order = np.argsort(features)
    return Model(features[order], (w * ratio / norm)[order], c, prior)


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", bound: int = TRAIN_BOUND) -> Model:
    """Fit on at most ``bound`` labelled rows; the driver gets ``FEATURES`` grams and each row's feature positions."""
    rows = written(training_rows(docs, labels, target, bound).select("label", "text", F.xxhash64("id").alias("rank")))
    totals = {r["y"]: r["n"] for r in rows.groupBy((F.col("label") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(False, 0), totals.get(True, 0)
    counted = (
        rows.select("label", "text").mapInArrow(lean(_count), "gram long, n0 long, n1 long")
        .groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= MIN_DOCS)
    )
    rate1, rate0 = (F.col("n1") + SMOOTH) / (n1 + 2 * SMOOTH), (F.col("n0") + SMOOTH) / (n0 + 2 * SMOOTH)
    ratio = F.log(rate1 / rate0)
    # how much a feature says about the label: the difference of the classes' rates times their log-ratio
    chosen = counted.select("gram", ratio.alias("ratio"), ((rate1 - rate0) * ratio).alias("says")).orderBy(F.desc("says"), "gram").limit(FEATURES).collect()
    table = np.array([r["gram"] for r in chosen], np.int64).view(np.uint64)
    ratios = np.array([r["ratio"] for r in chosen], np.float64)
    order = np.argsort(table)
    table, ratios = table[order], ratios[order]
    finder = Model(table, np.zeros(len(table)), 0.0, 0.0)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [finder.present(t).astype("<i4").tobytes() if len(table) else b"" for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("rank"), pa.array(found, pa.binary())], names=["label", "rank", "found"])

    got = rows.select("label", "rank", "text").mapInArrow(lean(positions), "label int, rank long, found binary").collect()  # bound rows
    got.sort(key=lambda r: (r["rank"], r["label"], bytes(r["found"])))
    return fit(table, ratios, [np.frombuffer(r["found"], "<i4").astype(np.int64) for r in got], np.array([int(r["label"] > 0) for r in got]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, score from 0 to 1 (higher: toxic likelier)."""
    schema = T.StructType([T.StructField("id", id_type(docs, id_col)), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.scores(text_bytes(batch.column("text"))))], names=["id", "score"])

    return keyed_text(docs, id_col, text_col).mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns unchanged."""
    return keep_rows(docs, text_col, lambda part: (model.scores(text_bytes(part.column("text"))) < threshold).tolist())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
