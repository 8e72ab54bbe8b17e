"""SimHash near-duplicate detection with pivot distance tables.

Fingerprint: 64 majority bits over the XXH64 hashes (seed 42) of a text's three-word shingles.  Two fingerprints link
at ``DISTANCE`` or fewer differing bits; documents of a connected component are near-duplicates of each other.

Linking works on distinct fingerprints.  A table holds each one's Hamming distances to ``PIVOTS`` fixed reference
fingerprints; it is computed once and stored, and its rows travel with the fingerprints.  Hamming distance is a metric,
so a pair with a distance to any pivot that differs by more than ``DISTANCE`` cannot link.  A table alone would still
meet every pair of the corpus, so pairs are dealt first, without losing any: of five bit ranges, three differing bits
leave two untouched, so linked fingerprints agree in both ranges of at least one of ten range pairs and meet in that
group.  Inside a group fingerprints are sorted by the pivot distance that spreads most, each meets only the window
within ``DISTANCE`` of its own, the largest difference over all pivots discards, and survivors are verified bit by bit.

A group above ``GROUP`` fingerprints is dealt again: the bits in which its members may differ are parted in four, and as
linked fingerprints agree in one of the four, each goes to four smaller groups, again and again until none is crowded;
few groups take part, and the bits run out before a group can be crowded without end.
A group yields a spanning star of each local component, not pairs.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; repeated rows share a
component; a null id never names a component unless all its ids are null; of equal least ids ``dedup`` keeps the first;
a very long text is hashed piece by piece; an empty table gives an empty result; extra columns, whatever their names,
are not read (``dedup`` carries them along unchanged).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_type, keyed_text, lean, pieces, portions, text_bytes, written
from .components import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 3
PIVOTS = 32
GROUP = 2048
FEW_BITS = 11
#: A fingerprint of more than this share of the rows is joined by broadcast; there are fewer than its inverse.
HOT_SHARE = 1 / 1000
#: (first bit, bits) of the five ranges.
RANGES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    ones, count, tail = np.zeros(64, np.int64), 0, []
    for piece in pieces(text.lower()) if text else ():
        words = tail + piece.split()
        if len(words) >= width:
            ones += _bit_counts(words, width)
            count += len(words) - width + 1
        tail = words[-(width - 1) :] if width > 1 else []
    if not count and tail:  # fewer words than a shingle: the whole sequence
        ones, count = _bit_counts(tail, len(tail)), 1
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


def _bit_counts(words: list[bytes], width: int) -> np.ndarray:
    """How many shingles of ``width`` words have each bit of their hash set."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    count = len(words) - width + 1
    starts, ends = (ends - lengths)[:count], ends[width - 1 :]
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, count, 1 << 15):
        cut = slice(at, at + (1 << 15))
        hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[cut].tolist(), ends[cut].tolist())], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def _column(batch: pa.RecordBatch) -> pa.Array:
    values = np.array([fingerprint(x) for part in portions(batch, "text") for x in text_bytes(part.column("text"))], np.uint64)
    return pa.array(values.view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): a row for each document row; fp holds the unsigned fingerprint's bits."""
    schema = T.StructType([T.StructField("id", id_type(docs, id_col)), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), _column(batch)], names=["id", "fp"])

    return keyed_text(docs, id_col, text_col).mapInArrow(lean(run), schema)


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of each fingerprint to the fixed reference fingerprints, one column for each."""
    refs = [xxhash.xxh64_intdigest(b"pivot %d" % k, SEED) for k in range(pivots)]
    return np.stack([np.bitwise_count(fps ^ np.uint64(r)) for r in refs], axis=1).astype(np.int8)


def pivoted(distinct: DataFrame) -> DataFrame:
    """``distinct`` (column fp) with the column pivots: the bytes of the fingerprint's row of the pivot table."""
    schema = T.StructType([*distinct.schema.fields, T.StructField("pivots", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pivot_table(batch.column("fp").to_numpy().view(np.uint64))
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(table.shape[1]), len(table), [None, pa.py_buffer(table.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, rows.cast(pa.binary())], names=[*batch.schema.names, "pivots"])

    return distinct.mapInArrow(lean(run), schema)


def _rows_of(column: pa.Array) -> np.ndarray:
    """The pivot table that a binary column holds."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1)


def _survivors(table: np.ndarray, fps: np.ndarray, i, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) link: pivot coordinates discard, bits verify.  i: an index or an array like j."""
    left = np.arange(len(j))
    for k in range(table.shape[1]):
        ours = table[i, k] if np.isscalar(i) else table[i[left], k]
        left = left[np.abs(table[j[left], k] - ours) <= DISTANCE]
        if not len(left):
            return left
    ours = fps[i] if np.isscalar(i) else fps[i[left]]
    return left[np.bitwise_count(fps[j[left]] ^ ours) <= DISTANCE]


def _star(fps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the components among some fingerprints, by windows along one pivot distance."""
    along = int(table.astype(np.float32).std(axis=0).argmax())
    order = np.argsort(table[:, along], kind="stable")
    fps, table = fps[order], table[order]
    ends = np.searchsorted(table[:, along], table[:, along] + np.int8(DISTANCE), side="right").tolist()
    label = np.arange(len(fps))
    for i, end in enumerate(ends):
        others = i + 1 + np.flatnonzero(label[i + 1 : end] != label[i])
        near = others[_survivors(table, fps, i, others)]
        if len(near):
            joined = np.unique(np.r_[label[near], label[i]])
            label[np.isin(label, joined)] = joined[0]
    off = np.flatnonzero(label != np.arange(len(fps)))
    return fps[off], fps[label[off]]


def _links(keys: np.ndarray, fps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges among fingerprints of equal key; ``keys`` is sorted, fingerprints of a key are distinct."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    inside = np.repeat(sizes > 1, sizes)
    if not inside.any():
        return fps[:0], fps[:0]
    fps, table = fps[inside], table[inside]
    sizes = sizes[sizes > 1]
    starts = np.cumsum(sizes) - sizes
    left, right = [], []
    small = sizes <= 8
    last = np.repeat(np.where(small, starts + sizes, 0), sizes)
    for lag in range(1, int(sizes[small].max(initial=1))):  # all small groups at once
        i = np.flatnonzero(np.arange(len(fps)) + lag < last)
        kept = _survivors(table, fps, i, i + lag)
        left.append(fps[i[kept]])
        right.append(fps[i[kept] + lag])
    for start, size in zip(starts[~small].tolist(), sizes[~small].tolist()):
        u, v = _star(fps[start : start + size], table[start : start + size])
        left.append(u)
        right.append(v)
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def _link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream of (key, fp, pivots) sorted by key -> edges (u, v); holds one batch and the key that runs across its end."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows of one key that may go on

    def edges(keys, fps, table):
        u, v = _links(keys, fps, table)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps, table = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), _rows_of(batch.column("pivots"))
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or held[-1][0][0] != keys[0]):
            yield edges(*(np.concatenate(x) for x in zip(*held, (keys[:cut], fps[:cut], table[:cut]))))
            held = []
        elif cut:
            yield edges(keys[:cut], fps[:cut], table[:cut])
        held.append((keys[cut:], fps[cut:], table[cut:]))
    if held:
        yield edges(*(np.concatenate(x) for x in zip(*held)))


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _parts(rest: int) -> list[int]:
    """The bits of ``rest`` as four runs of about equal length; three differing bits leave one of them untouched."""
    bits = [b for b in range(64) if rest >> b & 1]
    cuts = [len(bits) * k // (DISTANCE + 1) for k in range(DISTANCE + 2)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:])]


def _dealt_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, pivots, rest) of crowded groups -> a copy for each part of the bits that the group may still differ in,
    with the part's bits in its key and out of ``rest``."""
    for batch in batches:
        keys, fps, rests = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "fp", "rest"))
        for rest in np.unique(rests).tolist():
            rows = np.flatnonzero(rests == rest)
            for k, part in enumerate(_parts(rest)):
                with np.errstate(over="ignore"):  # groups may meet by chance; that only adds pairs to discard
                    key = (keys[rows] ^ (keys[rows] >> np.uint64(29))) * _MIX[0] + np.uint64(k + 1)
                    key = (key ^ (key >> np.uint64(31))) * _MIX[1] + ((fps[rows] & np.uint64(part)) * _MIX[0] >> np.uint64(1)) * _MIX[1]
                at = pa.array(rows)
                left = np.full(len(rows), rest & ~part, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column("fp").take(at), batch.column("pivots").take(at), pa.array(left.view(np.int64))],
                    names=["key", "fp", "pivots", "rest"])


def _groups(rows: DataFrame, group: int) -> DataFrame:
    """(key, fp, pivots) in groups of at most ``group``: crowded groups of ``rows`` (with rest) are dealt again until none is.

    Groups that may differ in ``FEW_BITS`` bits have 2^``FEW_BITS`` members at most, so this ends.
    """
    done, salts = None, 16  # a group may hold a third of all rows; the join has to spread it
    while True:
        counted = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.bit_count("rest")).alias("bits"))
        crowded = written(counted.where((F.col("n") > group) & (F.col("bits") > FEW_BITS)).select("key"))
        if crowded.isEmpty():
            small = rows.select("key", "fp", "pivots")
            return small if done is None else done.unionByName(small)
        spread = crowded.select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("crowded"))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int")).join(spread.hint("merge"), ["key", "salt"], "left")
        salted = written(salted.select("key", "fp", "pivots", "rest", "crowded"))
        small = salted.where("crowded IS NULL").select("key", "fp", "pivots")
        done = small if done is None else done.unionByName(small)
        again = salted.where("crowded").select("key", "fp", "pivots", "rest")
        rows = written(again.mapInArrow(lean(_dealt_again), "key long, fp long, pivots binary, rest long"))


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect all that link; not every pair is listed."""
    bits = [F.shiftrightunsigned("fp", at).bitwiseAND((1 << n) - 1) for at, n in RANGES]
    keys = [
        F.lit(k << 26).bitwiseOR(F.shiftleft(bits[a], 13)).bitwiseOR(bits[b])
        for k, (a, b) in enumerate(combinations(range(len(RANGES)), 2))
    ]
    masks = [((1 << n) - 1) << at for at, n in RANGES]
    rests = [~(masks[a] | masks[b]) & ((1 << 64) - 1) for a, b in combinations(range(len(RANGES)), 2)]
    each = F.explode(F.array(*(F.struct(k.alias("key"), F.lit(r - (1 << 64) if r >> 63 else r).cast("long").alias("rest")) for k, r in zip(keys, rests)))).alias("x")
    table = distinct if "pivots" in distinct.columns else written(pivoted(distinct.select("fp")))
    rows = table.select(each, "fp", "pivots").select("x.key", "fp", "pivots", "x.rest")
    return _groups(rows, group).repartition("key").sortWithinPartitions("key").mapInArrow(lean(_link_sorted), "u long, v long")


def classes(fps: DataFrame) -> DataFrame:
    """(fp, n, root) of every fingerprint that several rows have or that links to another; fps has a column fp."""
    distinct = written(pivoted(fps.groupBy("fp").agg(F.count("*").alias("n"))))
    found = connected_components(links(distinct))
    return (
        distinct.select("fp", "n").join(found.withColumnRenamed("node", "fp"), "fp", "left")
        .where("n > 1 or root is not null").select("fp", "n", F.coalesce("root", "fp").alias("root"))
    )


def _with_classes(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """``rows`` joined by fp with ``table`` (fp, n and more).  The few fingerprints that a great share of the rows has,
    such as that of empty texts, are joined by broadcast, so that no task gets all rows of one."""
    total = rows.count()
    hot = table.where(F.col("n") > max(HOT_SHARE * total, 1000))
    once = hot.select("fp")
    return rows.join(F.broadcast(hot), "fp").unionByName(
        rows.join(F.broadcast(once), "fp", "left_anti").join(table.join(F.broadcast(once), "fp", "left_anti"), "fp", how))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, fingerprint (16 hex digits), component_id (least id of its component)."""
    fps = written(fingerprints(docs, id_col, text_col))
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    member = written(classes(fps).join(least, "fp"))
    least_of = written(member.groupBy("root").agg(F.min("least").alias("component")))
    named = written(member.join(least_of, "root").select("fp", "n", "component"))
    return _with_classes(fps, named, "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component", "id").alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the least id, nulls last, the first of equal ones."""
    uid, fp = fresh(docs, "uid"), fresh(docs, "fp")
    marked = docs.withColumn(uid, F.monotonically_increasing_id())
    schema = T.StructType([*marked.schema.fields, T.StructField(fp, T.LongType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            yield pa.RecordBatch.from_arrays([*batch.columns, _column(text)], schema=batch.schema.append(pa.field(fp, pa.int64())))

    whole = written(marked.mapInArrow(lean(run), schema))
    rows = whole.select(F.col(fp).alias("fp"), F.struct(F.col(id_col).isNull().alias("a"), F.col(id_col).alias("b"), F.col(uid).alias("c")).alias("rank"))
    member = written(_with_classes(rows, written(classes(rows)), "inner"))
    best = member.groupBy("root").agg(F.min("rank").alias("best")).select(F.col("best.c").alias(uid))
    gone = member.select(F.col("rank.c").alias(uid)).join(best, uid, "left_anti")
    return whole.join(gone.hint("merge"), uid, "left_anti").select(*docs.columns)  # gone grows with the input: no side to broadcast


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
