"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive benchmark words.  Patterns of one length share a shift table over blocks of
words, which says how far the search may jump when the block under its end is in no pattern or only further left.
Where the shift is zero, a hash of the suffix selects a bucket of patterns, and direct comparison confirms an occurrence.
The search reads each document once, needs no shuffle, and keeps one portion of rows in memory.

The benchmark is the fixed side.  Its words are numbers in one array, a pattern is a place in it, the shift table is an
array of bytes over hashes, and the buckets are patterns sorted by their suffix hash, so a word of the benchmark takes
some forty bytes besides its spelling.  The benchmark is read in blocks of at most ``block_bytes`` of text, one broadcast
and one pass for each, so a benchmark of any size works; usually there is one block.

Defined results: a null or word-less text has no words and no hits; an item without words has no window; items with
the same id count once; a null item id marks words like any other and is listed as the empty string; repeated document
rows each get their own row; a very long text is searched run by run, its runs overlapping by a pattern less a word; an
empty table gives an empty result; extra columns, whatever their names, are not read (``decontaminated`` carries them
along unchanged).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_type, keep_rows, keyed_text, lean, pieces, portions, text_bytes, written

WINDOW = 10
BLOCK_BYTES = 16 << 20

#: A-Z become lower case, a-z, 0-9 and all bytes of non-ASCII characters stay, everything else separates words.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def word_runs(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in runs of bounded size."""
    for piece in pieces(text.translate(_FOLD)) if text else ():
        yield piece.split()


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All windows of ``size`` words; a shorter, non-empty item is one window."""
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


LONG = 1 << 18  # bytes from which a text is searched alone
SUFFIX = 6  # words of a pattern's end that choose its bucket
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(SUFFIX)], np.uint64)


def _suffix_hashes(words: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words before each end."""
    out = np.zeros(len(ends), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out += (words[ends - 1 - k].astype(np.uint64) + np.uint64(1)) * _FACTORS[k]
        return (out ^ (out >> np.uint64(31))) * _FACTORS[0]


class _Plan:
    """The patterns of one length."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, items: np.ndarray, length: int):
        self.length, self.block, self.width = length, min(2, length), min(SUFFIX, length)
        self.bits = min(26, max(12, int(8 * len(starts)).bit_length()))
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.uint8 if length < 256 else np.int64)
        places = self.places(words)
        for end in range(self.block, length + 1):  # the smaller shifts come later and stay
            self.shift[places[starts + end - 1]] = length - end
        keys = _suffix_hashes(words, starts + length, self.width)
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.items = keys[order], starts[order], items[order]

    def places(self, words: np.ndarray) -> np.ndarray:
        """Place in the shift table of the block that ends at each word; places before the first whole block mean nothing."""
        with np.errstate(over="ignore"):
            h = (words.astype(np.uint64) + np.uint64(1)) * _FACTORS[0]
            if self.block == 2 and len(words):
                h[1:] += (words[:-1].astype(np.uint64) + np.uint64(1)) * _FACTORS[1]
            return ((h ^ (h >> np.uint64(29))) * _FACTORS[2]) >> np.uint64(64 - self.bits)


class WuManber:
    """Finds all occurrences of the windows of items, which are (id, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int = WINDOW):
        self.names = [name for name, _ in items]
        self.numbers: dict[bytes, int] = {}  # from 1; 0 is a word of no item
        counts = np.array([len(words) for _, words in items], np.int64)
        number = self.numbers
        self.words = np.fromiter((number.setdefault(w, len(number) + 1) for _, words in items for w in words), np.int32, int(counts.sum()))
        firsts = np.cumsum(counts) - counts
        lengths = np.minimum(counts, size)
        self.plans = []
        for length in np.unique(lengths[lengths > 0]).tolist():
            mine = np.flatnonzero(lengths == length)
            windows = counts[mine] - length + 1
            starts = np.repeat(firsts[mine], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            self.plans.append(_Plan(self.words, starts, np.repeat(mine, windows), length))

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(words of the text, spans, items), run by run; a run starts with the words that a pattern may still need."""
        longest = max((plan.length for plan in self.plans), default=1)
        count, spans, found, tail = 0, [], set(), []
        for run in word_runs(text):
            words = tail + run
            here, items = self.search(words)
            first = count - len(tail)
            spans += [(a + first, b + first) for a, b in here]
            found |= items
            count += len(run)
            tail = words[-(longest - 1) :] if longest > 1 else []
        return count, merged(spans), found

    def scan_all(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """``scan`` of each text; short texts are searched in one go, with a word of no item after each."""
        out: list = [None] * len(texts)
        words: list[bytes] = []
        short, starts = [], []
        for i, text in enumerate(texts):
            if text and len(text) > LONG:
                out[i] = self.scan(text)
                continue
            short.append(i)
            starts.append(len(words))
            words += split_words(text)
            words.append(b"")
        ends = [*starts[1:], len(words)]
        for i, a, b in zip(short, starts, ends):
            out[i] = (b - a - 1, [], set())
        first = np.array(starts, np.int64)
        for start, end, items in self.occurrences(words):
            k = int(np.searchsorted(first, start, "right")) - 1
            _, spans, found = out[short[k]]
            spans.append((start - starts[k], end - starts[k]))
            found |= items
        return [(n, merged(spans) if spans else spans, found) for n, spans, found in out]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged (start, end) word spans that occurrences cover, and the ids of the items found."""
        spans, found = [], set()
        for start, end, items in self.occurrences(words):
            spans.append((start, end))
            found |= items
        return merged(spans), found

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(start, end, ids of the items) of every occurrence of a pattern."""
        count, get = len(words), self.numbers.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, count)
        for plan in self.plans:
            length = plan.length
            if count < length:
                continue
            steps = plan.shift[plan.places(ids)]
            ends = np.flatnonzero(steps == 0) + 1
            ends = ends[ends >= length]
            keys = _suffix_hashes(ids, ends, plan.width)
            low, high = (np.searchsorted(plan.keys, keys, side) for side in ("left", "right"))
            steps[ends[low == high] - 1] = 1  # their buckets are empty
            buckets = dict(zip(ends[low < high].tolist(), zip(low[low < high].tolist(), high[low < high].tolist())))
            steps = steps.tobytes() if steps.dtype == np.uint8 else steps.tolist()
            at = length - 1
            while at < count:
                step = steps[at]
                if step:
                    at += step
                    continue
                at += 1  # now the end
                mine = slice(*buckets[at])
                equal = np.ones(mine.stop - mine.start, bool)
                for k in range(length):  # compare with every pattern of the bucket
                    equal &= self.words[plan.starts[mine] + k] == ids[at - length + k]
                if equal.any():
                    yield at - length, at, {self.names[i] for i in np.unique(plan.items[mine][equal]).tolist()}


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """(item id, text) in blocks of bounded size, streamed from one partition after the other."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").cast("binary").alias("text"))
    block: list[tuple[str, bytes]] = []
    size = 0
    for row in rows.toLocalIterator():
        text = bytes(row["text"] or b"")
        block.append((row["item"] or "", text))
        size += len(text) + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


_tables: dict[tuple[str, int], WuManber] = {}


def _searcher(shared, window: int) -> WuManber:
    """The tables of a broadcast block, built once in each Python worker."""
    key = (shared.id, window)
    if key not in _tables:
        _tables.clear()
        _tables[key] = WuManber([(item, split_words(text)) for item, text in shared.value], window)
    return _tables[key]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class _Block:
    """What a worker needs of one benchmark block: the broadcast handle and its id."""

    def __init__(self, spark: SparkSession, rows: list[tuple[str, bytes]]):
        self.shared = spark.sparkContext.broadcast(rows)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.shared.value


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items (sorted), spans (merged word ranges), contaminated."""
    spark = docs.sparkSession
    key = T.StructField(id_col, id_type(docs, id_col))
    inner = T.StructType([
        T.StructField("id", key.dataType), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPANS),
    ])

    def one_pass(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = _searcher(block, window).scan_all
            for batch in batches:
                for part in portions(batch, "text", 2 << 20):
                    before = zip(part.column("items").to_pylist(), part.column("spans").to_pylist()) if "items" in part.schema.names else None
                    counts, all_items, all_spans = [], [], []
                    for n_words, spans, items in scan(text_bytes(part.column("text"))):
                        if before is not None:
                            old_items, old_spans = next(before)
                            items = items | set(old_items)
                            spans = merged([*spans, *((s["start"], s["end"]) for s in old_spans)])
                        counts.append(n_words)
                        all_items.append(sorted(items))
                        all_spans.append([{"start": a, "end": b} for a, b in spans])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("text") if more else pa.nulls(part.num_rows, pa.string()),
                         pa.array(counts, pa.int64()), pa.array(all_items, pa.list_(pa.string())), pa.array(all_spans, _SPANS_ARROW)],
                        names=["id", "text", "n_words", "items", "spans"])

        more = block is not last
        return run

    blocks = [_Block(spark, rows) for rows in benchmark_blocks(benchmark, block_bytes)] or [_Block(spark, [])]
    last = blocks[-1]
    out = keyed_text(docs, id_col, text_col)
    for n, block in enumerate(blocks):
        out = out.mapInArrow(lean(one_pass(block)), inner)
        if n % 3 == 2 and block is not last:
            out = written(out)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return out.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans",
        (hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, columns unchanged."""
    spark = docs.sparkSession
    for n, rows in enumerate(benchmark_blocks(benchmark, block_bytes)):
        block = _Block(spark, rows)

        def clean(part: pa.RecordBatch, block=block) -> list[bool]:
            return [not spans for _, spans, _ in _searcher(block, window).scan_all(text_bytes(part.column("text")))]

        docs = keep_rows(docs, text_col, clean)
        if n % 3 == 2:
            docs = written(docs)
    return docs


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query, from what ``contamination`` returns."""
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


#: Every word sequence of each window length in each document is compared with all windows.
ORACLE = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
gram AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, size WHERE len(w) >= n)),
occ AS (SELECT gram.doc_id, gram.n, gram.i, win.item_id FROM gram JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
