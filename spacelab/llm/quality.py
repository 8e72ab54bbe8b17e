"""Document quality from a linear-chain conditional random field over lines.

Every line of a text gets surface features of its own and of the lines before and after it.  A two-state chain labels
lines good or bad; forward-backward gives each line's marginal, and the marginals, weighted by line length, add up to
the document's evidence, which a logistic curve turns into a score.

Training: only documents carry labels.  Lines of good documents are good; lines of bad documents start as bad and are
relabelled once by a line-wise logistic model, so that ordinary lines of a bad document count as good.  The chain is
then fitted to these lines and the curve to the documents.  At most ``TRAIN_BOUND`` labelled rows outside the held-out
fold are used (ranked by a hash of their id); of a text with more than ``TRAIN_LINES`` lines, evenly spaced runs of so
many lines in all.  Features are computed on the executors, and only features come to the driver.  Scoring reads every
document whole, once, without a shuffle, and holds the features of one chunk of lines at a time; a line longer than a
chunk is read in pieces.

Defined results: a null or empty text is one empty line and is scored like any other; a very long text takes about 120
bytes a line and one chunk; training rows of equal hash go by their label and features; with no labelled rows, or only
one label, every score is the share of label 1 (0.5 without rows); repeated rows score alike; an empty table gives an
empty result; extra columns, whatever their names, are not read (``keep_good`` carries them along unchanged).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, id_type, keep_rows, keyed_text, lean, portions, text_bytes, training_rows

TRAIN_BOUND = 4000
TRAIN_LINES = 1024  # of one text
THRESHOLD = 0.3
CHUNK = 1 << 20
CHUNK_LINES = 1 << 14
LONG_CHAIN = 2000  # lines from which a text is walked alone

_LOWER, _UPPER, _DIGIT, _SPACE, _PUNCT, _SYMBOL, _HIGH, _CONTROL = range(8)
_CLASS = np.array([
    _LOWER if 97 <= b <= 122 else _UPPER if 65 <= b <= 90 else _DIGIT if 48 <= b <= 57 else _SPACE if b in b" \t\r"
    else _PUNCT if b in b".,;:'\"()?-" else _CONTROL if b < 32 or b == 127 else _HIGH if b >= 128 else _SYMBOL
    for b in range(256)
], np.int64)
_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, for prefix hashes."""
    if not _powers or len(_powers[0]) < size:
        size = max(size, CHUNK)
        inverse = pow(_ODD, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)], dtype=np.uint64) for x in (_ODD, inverse)]
    return _powers[0][:size], _powers[1][:size]


#: What is counted of a line besides its bytes by kind.
_WORDS, _REPEATED, _WIDE, _ODD_END, _ALONE = range(8, 13)


def _own_features(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, byte lengths and hashes of the lines in ``buf``, each with its line feed."""
    if len(buf) > CHUNK and not (buf[:-1] == 10).any():
        counts, length, whole, last = _long_line(buf[:-1])
    else:
        counts, length, whole, last = _line_counts(buf)
    return _features(counts, length, last), length, whole


def _words_of(kind: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, its hash, and the prefix hashes of the buffer."""
    blank = kind == _SPACE
    first = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    after = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    power, inverse = _power_tables(len(buf) + 1)
    with np.errstate(over="ignore"):
        prefix = np.r_[np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], dtype=np.uint64)]
        return first, after, (prefix[after] - prefix[first]) * inverse[first], prefix


def _line_counts(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, byte length, hash and kind of the last byte of each line."""
    ends = np.flatnonzero(buf == 10)
    starts = np.r_[0, ends[:-1] + 1]
    lines = len(starts)
    line_of = np.zeros(len(buf) + 1, np.int32)
    line_of[ends + 1] = 1
    line_of = np.cumsum(line_of[:-1], dtype=np.int32)
    kind = _CLASS[buf]
    kind[ends] = _SPACE
    counts = np.zeros((lines, 13))
    counts[:, :8] = np.bincount(line_of * 8 + kind, minlength=lines * 8).reshape(lines, 8)
    counts[:, _SPACE] -= 1
    first, after, word, prefix = _words_of(kind, buf)
    _, inverse = _power_tables(len(buf) + 1)
    with np.errstate(over="ignore"):
        whole = (prefix[ends] - prefix[starts]) * inverse[starts]
    of = line_of[first]
    for column, lines_of in (
        (_WORDS, of), (_REPEATED, of[1:][(word[1:] == word[:-1]) & (of[1:] == of[:-1])]), (_WIDE, of[(after - first) > 24]),
        (_ODD_END, of[kind[after - 1] == _SYMBOL]), (_ALONE, of[(after - first == 1) & (kind[first] == _SYMBOL)]),
    ):
        counts[:, column] = np.bincount(lines_of, minlength=lines)
    length = (ends - starts).astype(np.float64)
    return counts, length, whole, np.where(length > 0, kind[np.maximum(ends - 1, 0)], _CONTROL)


def _long_line(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_line_counts`` of one long line, in pieces; a word that is cut is put together again from its parts' hashes."""
    counts, whole, done = np.zeros(13), 0, 0
    open_hash = open_size = 0  # the word that may go on in the next piece
    open_symbol = before = None  # whether that word ends in a symbol; the hash of the word before it

    def closed(hashes, sizes, symbols):
        nonlocal before
        counts[_WORDS] += len(hashes)
        counts[_REPEATED] += (hashes[1:] == hashes[:-1]).sum() + (before is not None and len(hashes) and int(hashes[0]) == before)
        counts[_WIDE] += (sizes > 24).sum()
        counts[_ODD_END] += symbols.sum()
        counts[_ALONE] += (symbols & (sizes == 1)).sum()
        before = int(hashes[-1]) if len(hashes) else before

    for at in range(0, len(buf), CHUNK):
        piece = buf[at : at + CHUNK]
        kind = _CLASS[piece]
        counts[:8] += np.bincount(kind, minlength=8)
        first, after, word, prefix = _words_of(kind, piece)
        whole = (whole + pow(_ODD, done, 1 << 64) * int(prefix[-1])) % (1 << 64)
        sizes, symbols = after - first, kind[after - 1] == _SYMBOL if len(after) else np.zeros(0, bool)
        if open_size and (not len(first) or first[0]):
            closed(np.array([open_hash], np.uint64), np.array([open_size]), np.array([open_symbol]))
        elif open_size:
            word, sizes = word.copy(), sizes.copy()
            word[0] = np.uint64((open_hash + pow(_ODD, open_size, 1 << 64) * int(word[0])) % (1 << 64))
            sizes[0] += open_size
        open_size = 0
        if len(after) and after[-1] == len(piece):
            open_hash, open_size, open_symbol = int(word[-1]), int(sizes[-1]), bool(symbols[-1])
            word, sizes, symbols = word[:-1], sizes[:-1], symbols[:-1]
        closed(word, sizes, symbols)
        done += len(piece)
    if open_size:
        closed(np.array([open_hash], np.uint64), np.array([open_size]), np.array([open_symbol]))
    return counts[None, :], np.array([float(len(buf))]), np.array([whole], np.uint64), _CLASS[buf[-1:]]


def _features(counts: np.ndarray, length: np.ndarray, last: np.ndarray) -> np.ndarray:
    words = counts[:, _WORDS]
    safe, per_word = np.maximum(length, 1), np.maximum(words, 1)
    share = counts[:, :8] / safe[:, None]
    letters = np.maximum(counts[:, _LOWER] + counts[:, _UPPER] + counts[:, _HIGH], 1)
    upper = counts[:, _UPPER] / letters
    repeated = counts[:, _REPEATED] / per_word
    parts = [
        np.log1p(length) / 5, np.log1p(words) / 3, np.minimum((length - counts[:, _SPACE]) / per_word / 10, 3),
        share[:, _DIGIT], share[:, _SPACE], share[:, _PUNCT], share[:, _SYMBOL], share[:, _HIGH], share[:, _CONTROL], upper,
        repeated, counts[:, _WIDE] / per_word, counts[:, _ODD_END] / per_word, counts[:, _ALONE] / per_word,
        length == 0, last == _PUNCT, words == 1,
    ]
    for x, steps in ((upper, (0.1, 0.3, 0.6)), (share[:, _SYMBOL], (0.005, 0.02, 0.06)), (share[:, _DIGIT], (0.02, 0.1)),
                     (repeated, (0.02, 0.1, 0.4)), (share[:, _PUNCT], (0.02, 0.05, 0.1))):
        parts += [x > s for s in steps]
    out = np.empty((len(length), len(parts)))
    for k, p in enumerate(parts):
        out[:, k] = p
    return out


def _line_chunks(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The texts' lines, each with its line feed: at most CHUNK bytes and CHUNK_LINES lines at once, or one longer line."""
    held, size = [], 0
    for text in (*texts, None):
        if text is None or len(text) >= CHUNK or size + len(text) >= CHUNK:
            if held:
                yield from _few_lines(b"\n".join(held) + b"\n")
                held, size = [], 0
        if text is not None and len(text) >= CHUNK:
            yield from _long_text(text)
        elif text is not None:
            held.append(text)
            size += len(text) + 1


def _few_lines(data: bytes | memoryview) -> Iterator[np.ndarray]:
    buf = np.frombuffer(data, np.uint8)
    feeds = np.flatnonzero(buf == 10)
    cuts = [0, *(feeds[CHUNK_LINES - 1 :: CHUNK_LINES] + 1).tolist()]
    for a, b in zip(cuts, [*cuts[1:], len(buf)]):
        if a < b:
            yield buf[a:b]


def _long_text(text: bytes) -> Iterator[np.ndarray]:
    view, at = memoryview(text), 0
    while at + CHUNK < len(text):
        feed = text.rfind(b"\n", at, at + CHUNK)
        if feed < 0:
            feed = text.find(b"\n", at + CHUNK)
            if feed < 0:
                break
            yield np.frombuffer(view[at : feed + 1], np.uint8)
        else:
            yield from _few_lines(view[at : feed + 1])
        at = feed + 1
    if len(text) - at <= CHUNK:
        yield from _few_lines(text[at:] + b"\n")
    else:
        yield np.frombuffer(text[at:] + b"\n", np.uint8)


def sampled(text: bytes) -> bytes:
    """A text to learn from: the whole of it, or evenly spaced runs of ``TRAIN_LINES`` lines in all."""
    if text.count(b"\n") < TRAIN_LINES:
        return text
    feeds = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    starts, runs = np.r_[0, feeds + 1], 16
    size = TRAIN_LINES // runs
    firsts = np.linspace(0, len(starts) - size, runs).astype(int)
    ends = np.r_[feeds, len(text)]
    return b"\n".join(text[starts[a] : ends[a + size - 1]] for a in firsts)


def _twice(whole: np.ndarray, length: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """1 for every line that is not empty and stands in its text more than once."""
    doc = np.repeat(np.arange(len(per_text)), per_text)
    order = np.lexsort((whole, doc))
    same = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(whole))
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    return twice * (length > 0)


def _prepared(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    texts = [t or b"" for t in texts]
    return texts, np.array([t.count(b"\n") + 1 for t in texts], np.int64)


def line_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line with its neighbours', line lengths, lines of each text)."""
    texts, per_text = _prepared(texts)
    own, length, whole = (np.concatenate(x) for x in zip(*map(_own_features, _line_chunks(texts))))
    own = np.c_[own, _twice(whole, length, per_text)]
    first = np.cumsum(per_text) - per_text
    last = first + per_text - 1
    width = own.shape[1]
    full = np.zeros((len(own), 3 * width + 3))
    full[:, :width] = own
    full[1:, width : 2 * width] = own[:-1]
    full[:-1, 2 * width : 3 * width] = own[1:]
    full[first, width : 2 * width] = 0
    full[last, 2 * width : 3 * width] = 0
    full[first, 3 * width] = full[last, 3 * width + 1] = full[:, 3 * width + 2] = 1
    return full, length, per_text


def line_scores(texts: list[bytes | None], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` times ``weights``, without holding the features of more than a chunk of lines."""
    texts, per_text = _prepared(texts)
    width = (len(weights) - 3) // 3
    table = weights[: 3 * width].reshape(3, width).T  # own, as neighbour after, as neighbour before
    parts = []
    for chunk in _line_chunks(texts):
        own, length, whole = _own_features(chunk)
        parts.append((own @ table[:-1], length, whole))
    shares, length, whole = (np.concatenate(x) for x in zip(*parts))
    shares += _twice(whole, length, per_text)[:, None] * table[-1]
    first = np.cumsum(per_text) - per_text
    last = first + per_text - 1
    before, after = np.r_[0.0, shares[:-1, 1]], np.r_[shares[1:, 2], 0.0]
    before[first] = weights[3 * width]
    after[last] = weights[3 * width + 1]
    total = shares[:, 0] + before + after + weights[3 * width + 2]
    return total, length, per_text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward_backward(unary: np.ndarray, per_text: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds (good against bad) of the forward and backward messages at each line.

    unary: log-odds of each line alone; move[i, j]: log-potential of state j after state i (0 bad, 1 good).  All texts
    advance together, one line position at a time.
    """
    ahead, back = np.empty(len(unary)), np.zeros(len(unary))
    alone = np.flatnonzero(per_text > LONG_CHAIN)
    if len(alone):
        first = np.cumsum(per_text) - per_text
        for k in alone.tolist():
            part = slice(first[k], first[k] + per_text[k])
            _one_chain(unary[part], move.tolist(), ahead[part], back[part])
        rest = np.repeat(per_text <= LONG_CHAIN, per_text)
        ahead[rest], back[rest] = forward_backward(unary[rest], per_text[per_text <= LONG_CHAIN], move)
        return ahead, back
    order = np.argsort(-per_text, kind="stable")
    sizes = per_text[order]
    starts = (np.cumsum(per_text) - per_text)[order]
    live = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    to_good = lambda a: np.logaddexp(move[1, 1] + a, move[0, 1]) - np.logaddexp(move[1, 0] + a, move[0, 0])
    from_good = lambda b: np.logaddexp(move[1, 1] + b, move[1, 0]) - np.logaddexp(move[0, 1] + b, move[0, 0])
    for t, n in enumerate(live.tolist()):
        at = starts[:n] + t
        ahead[at] = unary[at] + (to_good(ahead[at - 1]) if t else 0)
    for t in range(len(live) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        back[at] = from_good(unary[at + 1] + back[at + 1])
    return ahead, back


def _one_chain(unary: np.ndarray, move: list[list[float]], ahead: np.ndarray, back: np.ndarray, block: int = 1 << 16) -> None:
    """``forward_backward`` of one text, line by line, into ``ahead`` and ``back``."""
    log1p, exp = math.log1p, math.exp
    (bad_bad, bad_good), (good_bad, good_good) = move

    def added(a: float, b: float) -> float:
        return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))

    a = None
    for at in range(0, len(unary), block):
        out = []
        for x in unary[at : at + block].tolist():
            a = x if a is None else x + added(good_good + a, bad_good) - added(good_bad + a, bad_bad)
            out.append(a)
        ahead[at : at + block] = out
    b = 0.0
    for at in reversed(range(0, len(unary), block)):
        out = []
        for x in reversed(unary[at : at + block].tolist()):
            out.append(b)
            x += b
            b = added(good_good + x, good_bad) - added(bad_good + x, bad_bad)
        out.reverse()
        back[at : at + block] = out


@dataclass
class Model:
    weights: np.ndarray | None
    move: np.ndarray
    curve: np.ndarray  # logistic: constant, weighted mean marginal, its log-odds
    prior: float

    def marginals(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chance that the line is good, length, lines of each text)."""
        unary, length, per_text = line_scores(texts, self.weights)
        ahead, back = forward_backward(unary, per_text, self.move)
        return _sigmoid(ahead + back), length, per_text

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        return _sigmoid(evidence(*self.marginals(texts)) @ self.curve)


def evidence(good: np.ndarray, length: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each text, as inputs of the curve."""
    starts = np.cumsum(per_text) - per_text
    weight = length + 1
    mean = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.c_[np.ones(len(mean)), mean, np.log(mean / (1 - mean))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        slope = x.T @ (weight * (y - p)) - ridge * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(features: np.ndarray, length: np.ndarray, per_text: np.ndarray, labels: np.ndarray, rounds: int = 120) -> Model:
    """Fit line labels, chain and curve; ``labels`` has one entry for each text."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if len(labels) == 0 or prior in (0.0, 1.0):
        return Model(None, np.zeros((2, 2)), np.zeros(3), prior)
    doc = np.repeat(np.arange(len(labels)), per_text)
    share = (1 / per_text)[doc]  # documents weigh alike
    first = _logistic(features, labels[doc].astype(float), share, 1.0)
    usual = _sigmoid(features @ first)
    state = np.where(labels[doc] == 1, 1.0, (usual > 0.5).astype(float))
    starts = np.cumsum(per_text) - per_text
    none_bad = np.flatnonzero((labels == 0) & (np.add.reduceat(1 - state, starts) == 0))
    for k in none_bad:  # a bad document has a bad line at least
        state[starts[k] + np.argmin(usual[starts[k] : starts[k] + per_text[k]])] = 0

    pair = np.ones(len(doc), bool)
    pair[starts + per_text - 1] = False
    i = np.flatnonzero(pair)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[i].astype(int), state[i + 1].astype(int)), share[i])
    w, move = first.copy(), np.zeros((2, 2))
    speed, mean, var = 0.05, np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for n in range(1, rounds + 1):
        unary = features @ w
        ahead, back = forward_backward(unary, per_text, move)
        good = _sigmoid(ahead + back)
        terms = np.stack([np.full(len(i), move[0, 0]), move[0, 1] + unary[i + 1] + back[i + 1], move[1, 0] + ahead[i],
                          move[1, 1] + ahead[i] + unary[i + 1] + back[i + 1]])
        terms = np.exp(terms - terms.max(axis=0, initial=-np.inf))
        expected = ((terms / terms.sum(axis=0)) @ share[i]).reshape(2, 2)
        slope = np.r_[features.T @ (share * (state - good)) - 0.5 * w, (seen - expected - 0.5 * move).ravel()]
        mean, var = 0.9 * mean + 0.1 * slope, 0.99 * var + 0.01 * slope**2
        step = speed * min(1.0, 2 * (1 - n / (rounds + 1))) * (mean / (1 - 0.9**n)) / (np.sqrt(var / (1 - 0.99**n)) + 1e-8)
        w, move = w + step[:-4], move + step[-4:].reshape(2, 2)
    ahead, back = forward_backward(features @ w, per_text, move)
    inputs = evidence(_sigmoid(ahead + back), length, per_text)
    return Model(w, move, _logistic(inputs, labels.astype(float), np.ones(len(labels)), 0.1), prior)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = TRAIN_BOUND) -> Model:
    """Fit on at most ``bound`` labelled rows; executors compute the features, the driver gets features only."""
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("lines", T.LongType()), T.StructField("rank", T.LongType()), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                features, length, per_text = line_features([sampled(t or b"") for t in text_bytes(part.column("text"))])
                table = np.c_[features, length].astype(np.float32)
                cuts = np.cumsum(per_text)
                data = [table[a:b].tobytes() for a, b in zip(cuts - per_text, cuts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array(per_text), part.column("rank"), pa.array(data, pa.binary())], names=["label", "lines", "rank", "data"])

    chosen = training_rows(docs, labels, target, bound)
    rows = chosen.withColumn("rank", F.xxhash64("id")).select("label", "text", "rank").mapInArrow(lean(run), schema)
    got = sorted(rows.collect(), key=lambda r: (r["rank"], r["label"], r["data"]))  # bound rows of features at most
    if not got:
        return fit(np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    per_text = np.array([r["lines"] for r in got], np.int64)
    table = np.frombuffer(b"".join(bytes(r["data"]) for r in got), np.float32).reshape(int(per_text.sum()), -1).astype(np.float64)
    return fit(table[:, :-1], table[:, -1], per_text, np.array([r["label"] for r in got]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, score from 0 to 1 (higher: good likelier)."""
    schema = T.StructType([T.StructField("id", id_type(docs, id_col)), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.scores(text_bytes(part.column("text"))))], names=["id", "score"])

    return keyed_text(docs, id_col, text_col).mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, columns unchanged."""
    return keep_rows(docs, text_col, lambda part: (model.scores(text_bytes(part.column("text"))) >= threshold).tolist())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
