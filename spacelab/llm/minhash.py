"""MinHash near-duplicate detection with b-bit signatures.

A document is the set of its distinct ``SHINGLE``-word shingles, told apart by 64-bit hashes; a text of fewer words is
one shingle, a text without words an empty set, which links with nothing.  Two sets link when their intersection is at
least ``SIMILARITY`` percent of their union.

Equal sets are one class from the start, so copies never meet.  Each class keeps ``HASHES`` minima.  ``BANDS`` bands of
``ROWS`` minima each make candidates: classes that agree in a whole band meet in that band's bucket.  Of the minima only
the low ``BITS`` bits travel there, packed into bit planes; the share of equal positions, less what chance
makes equal, estimates the similarity by bit counts.  Candidates whose estimate is ``SIGMAS`` deviations under the
bound are left out; all others are confirmed or refused on full sets.

Banding is a random method.  At the similarity of 0.8 itself a pair misses all 20 bands of 3 with probability
(1 - 0.8^3)^20 < 6e-7, and the estimate leaves it out with probability of about 3e-7; both fall steeply above.

A bucket may hold any number of classes.  Only connected components are asked for, so a bucket first names one link a
class, to a leader that looks like it; what the confirmed links join is not compared again.  The classes of a bucket
that are still apart name their likeliest links to other components, a growing number a class and round, until no pair
is left.  Buckets above ``GROUP`` classes are dealt again by a second band and by size, since sets whose sizes
differ by more than a fifth cannot link; there a pair at 0.8 must agree in two bands (missed with probability below 2e-5).

Full sets are made again only of classes that have candidates; a bitmap of bounded size tells them.  Classes that still
have candidates after two rounds get signatures of ``FINE`` further minima, which leave out nearly all that do not link.

Defined results: a null, empty or blank text has no shingles and its own id as component; repeated rows share a
component; a null id never names a component unless all its ids are null, and is never kept; rows with the same id and
different texts are different documents; a very long text is read piece by piece; an empty table gives an empty result;
extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmap import Bitmap
from .common import id_type, keyed_text, lean, pieces, portions, text_bytes, written
from .components import connected_components

SHINGLE = 4
SIMILARITY = 80
HASHES = 128
BANDS = 20
ROWS = 3
BITS = 4
FINE = 1024
SIGMAS = 5
GROUP = 4096
QUOTAS = (2, 1024)  # of the second and third round; sixteen times as many in each that follows
SEED = 12
#: A class of more than this share of the rows is joined by broadcast; there are fewer than its inverse.
HOT_SHARE = 1 / 1000

_random = np.random.default_rng(SEED)
#: A hash function is x -> (x ^ XOR) * ODD; the first ``HASHES`` make bands and signatures, the others fine signatures.
_ODD = _random.integers(0, 1 << 63, HASHES + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _random.integers(0, 1 << 63, HASHES + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(8)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` word hashes."""
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total += words[k : k + n] * np.uint64(_PLACE[k])
    return _mixed(total)


class _Words(defaultdict):
    """Words -> numbers from 0, with the hash of each number; forgets all when it holds ``most``."""

    def __init__(self, most: int = 1 << 18):
        super().__init__()
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.default_factory = count().__next__
        self.hashes = np.zeros(1 << 12, np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.reset()
        before = len(self)
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        new = len(self) - before
        if len(self) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(len(self), np.uint64)])
        for at, word in zip(range(len(self) - 1, before - 1, -1), islice(reversed(self), new)):
            self.hashes[at] = xxhash.xxh64_intdigest(word, SEED)
        return self.hashes[numbers]


def shingle_set(text: bytes | None, known: _Words | None = None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    known = _Words() if known is None else known
    found, tail = [], np.zeros(0, np.uint64)
    for piece in pieces(text.lower()) if text else ():
        words = np.concatenate([tail, known.of(piece.split())])
        if len(words) >= width:
            found.append(np.unique(_shingle_hashes(words, width)))
            tail = words[-(width - 1) :] if width > 1 else tail
        else:
            tail = words
    if not found and len(tail):
        return _shingle_hashes(tail, len(tail))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def minima(hashes: np.ndarray, functions: slice = slice(0, HASHES)) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    odd, xor = _ODD[functions, None], _XOR[functions, None]
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 17) // len(odd))
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), step):
            part = hashes[at : at + step]
            np.minimum(least, ((part[None, :] ^ xor) * odd).min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> bytes:
    """Low ``BITS`` bits of each minimum, one bit plane after the other."""
    low = _mixed(least)
    return b"".join(np.packbits((low >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little").tobytes() for b in range(BITS))


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            total = _mixed(total + rows[:, k] * np.uint64(_PLACE[k]))
    return total


def matches(signatures: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal positions of the packed signatures i (column) against j (row); rows of ``signatures`` are uint64 words."""
    words = signatures.shape[1] // BITS
    differ = np.zeros((len(i), len(j)), np.int64)
    for w in range(words):
        apart = np.zeros((len(i), len(j)), np.uint64)
        for b in range(BITS):
            plane = signatures[:, b * words + w]
            apart |= plane[i][:, None] ^ plane[j][None, :]
        differ += np.bitwise_count(apart)
    return 64 * words - differ


def similarity(equal: np.ndarray | int, hashes: int = HASHES) -> np.ndarray | float:
    """Similarity that a number of equal positions stands for, corrected for positions that are equal by chance."""
    chance = 2.0**-BITS
    return (equal / hashes - chance) / (1 - chance)


def least_matches(hashes: int = HASHES, sigmas: float = SIGMAS) -> int:
    """Equal positions under which a pair at the similarity bound hardly ever falls: the mean less some deviations."""
    share = 2.0**-BITS + (1 - 2.0**-BITS) * SIMILARITY / 100
    return int(hashes * share - sigmas * (hashes * share * (1 - share)) ** 0.5)


# ----- classes of equal sets -----


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rkey, n, digest, sig, bands): a row for each document row; empty sets have neither digest nor signature."""
    keyed = keyed_text(docs, id_col, text_col)
    keyed = keyed.select("id", F.xxhash64("text", "id").alias("rkey"), "text")
    schema = T.StructType([
        T.StructField("id", id_type(docs, id_col)), T.StructField("rkey", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for whole in batches:
            for batch in portions(whole, "text"):
                n, digests, signatures, bands = [], [], [], []
                for text in text_bytes(batch.column("text")):
                    found = shingle_set(text, known)
                    n.append(len(found))
                    if len(found):
                        least = minima(found)
                        digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                        signatures.append(packed(least))
                        bands.append(band_keys(least).view(np.int64))
                    else:
                        digests.append(None)
                        signatures.append(None)
                        bands.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("rkey"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return keyed.mapInArrow(lean(run), schema)


def _classes(rows: DataFrame) -> DataFrame:
    """(node, digest, n, copies, least, rkey, sig, bands): one row a set; rkey is that of one of its rows."""
    some = F.first(F.struct("n", "rkey", "sig", "bands")).alias("some")
    found = rows.where("n > 0").groupBy("digest").agg(some, F.min("id").alias("least"), F.count("*").alias("copies"))
    return written(found.select(F.monotonically_increasing_id().alias("node"), "digest", "copies", "least", "some.*"))


# ----- candidates -----


def _size_cell() -> F.Column:
    """Classes whose sizes allow a link lie in the same or in neighbouring cells."""
    return F.floor(F.log("n") / F.log(F.lit(100 / SIMILARITY)) + F.lit(1e-9)).cast("long")


def _salted(rows: DataFrame, keys: DataFrame, by: str, spread: str, salts: int = 16) -> DataFrame:
    """rows joined with keys (one row a key) where a key may have a large share of the rows."""
    each = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(each.hint("merge"), [by, "salt"]).drop("salt")


def _buckets(classes: DataFrame, group: int) -> DataFrame:
    """(key, node, sig, bands): the members of every bucket of two classes or more; crowded buckets are dealt again."""
    each = classes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    counted = written(each.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    members = written(_salted(each, counted, "key", "node"))
    dealt = members.where(F.col("m") <= group).select("key", "node")
    if (counted.agg(F.max("m")).first()[0] or 0) > group:
        again = (
            members.where(F.col("m") > group).join(classes.select("node", "bands").hint("merge"), "node")
            .select("node", "n", "key", "band", F.posexplode("bands").alias("other", "second")).where("other > band")
        )
        cell = _size_cell()
        again = again.select("node", F.explode(F.array(cell, cell + 1)).alias("cell"), "key", "second")
        dealt = dealt.unionByName(again.select(F.xxhash64("key", "second", "cell").alias("key"), "node"))
    return written(dealt.join(classes.select("node", "sig", "bands").hint("merge"), "node").select("key", "node", "sig", "bands"))


def _stream_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key -> one table a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            part = batch.slice(a, b - a)
            if held and held[-1].column("key")[0] != part.column("key")[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _firsts(node: np.ndarray, signatures: np.ndarray, bound: int, most: int = 16) -> Iterator[tuple[int, int, int, bool]]:
    """Links to leaders: the first class leads those that look alike enough, the first of the others those of them, and so on."""
    rest, alike = np.arange(len(node)), least_matches(sigmas=0)
    for _ in range(most):
        lead, rest = rest[0], rest[1:]
        if not len(rest):
            return
        equal = np.concatenate([matches(signatures, np.array([lead]), rest[i : i + (1 << 14)])[0] for i in range(0, len(rest), 1 << 14)])
        joins = equal >= max(alike, bound)
        for k, e in zip(rest[joins].tolist(), equal[joins].tolist()):
            yield int(node[lead]), int(node[k]), e, True
        rest = rest[~joins]
        if not len(rest):
            return


def _likeliest(
    key: int, label: np.ndarray, node: np.ndarray, signatures: np.ndarray, bands: np.ndarray, bound: int, quota: int
) -> Iterator[tuple[int, int, int, bool]]:
    """For each class outside the largest component its ``quota`` likeliest links to other components.

    A pair of two components, neither the largest, is looked at once, from the later one, and a pair that meets in
    several buckets only in that of its first band.  The last column tells whether the class has more.
    """
    own = np.flatnonzero((bands == key).all(axis=0))  # the bucket's band, none for one that was dealt again
    names, size = np.unique(label, return_counts=True)
    largest = names[size.argmax()]
    rows = np.flatnonzero(label != largest)
    for at in range(0, len(rows), 64):
        i = rows[at : at + 64]
        equal = np.concatenate([matches(signatures, i, np.arange(to, min(to + (1 << 14), len(node)))) for to in range(0, len(node), 1 << 14)], axis=1)
        ours, theirs = label[i][:, None], label[None, :]
        equal[(ours == theirs) | ((theirs != largest) & (theirs > ours)) | (equal < bound)] = -1
        for a in np.flatnonzero((equal >= 0).any(axis=1)).tolist():
            found = np.flatnonzero(equal[a] >= 0)
            if len(own):
                found = found[~(bands[found, : own[0]] == bands[i[a], : own[0]]).any(axis=1)]
            count = len(found)
            if count > quota:
                found = found[np.lexsort((node[found], -equal[a, found]))[:quota]]
            u = int(node[i[a]])
            for k in found.tolist():
                v = int(node[k])
                yield min(u, v), max(u, v), int(equal[a, k]), count > quota


def _apart(quota: int | None, bound: int):
    """Pairs of a bucket's classes in different components that may link; quota None: one link a class, to a leader."""
    kinds = pa.schema([("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("equal", pa.int32()), ("more", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int, bool]] = []
        best: dict[int, tuple[int, int, int, int, bool]] = {}

        def sent() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(kinds), kinds)], schema=kinds)
            out.clear()
            return made

        for table in _stream_of_keys(batches):
            label, node = table.column("label").to_numpy(), table.column("node").to_numpy()
            if len(node) < 2 or (label == label[0]).all():
                continue
            signatures = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(len(node), -1)
            bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            order = np.lexsort((node, label))
            label, node, signatures, bands = label[order], node[order], signatures[order], bands[order]
            key = table.column("key")[0].as_py()
            if quota is None:  # the best first link of each class goes on
                for u, v, equal, more in _firsts(node, signatures, bound):
                    if v not in best or best[v][3] < equal:
                        best[v] = (key, u, v, equal, more)
                if len(best) >= 1 << 16:
                    out += best.values()
                    best.clear()
                    yield sent()
                continue
            for pair in _likeliest(key, label, node, signatures, bands, bound, quota):
                out.append((key, *pair))
                if len(out) >= 1 << 16:
                    yield sent()
        out += best.values()
        yield sent()

    return run


# ----- confirming on full sets -----


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes): the full sets of ``nodes``, each from one row of the documents."""
    wanted = written(classes.join(nodes.hint("merge"), "node", "left_semi").select("node", "rkey"))
    told = Bitmap.of(wanted.select("rkey"), "rkey")
    keyed = keyed_text(docs, id_col, text_col).select(F.xxhash64("text", "id").alias("rkey"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for whole in batches:
            asked = whole.filter(pa.array(told.holds(whole.column("rkey").to_numpy().view(np.uint64)), pa.bool_()))
            for batch in portions(asked, "text"):
                found = [shingle_set(t, known).tobytes() for t in text_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("rkey"), pa.array(found, pa.binary())], names=["rkey", "hashes"])

    made = keyed.mapInArrow(lean(run), "rkey long, hashes binary")
    return written(made.dropDuplicates(["rkey"]).join(wanted.hint("merge"), "rkey").select("node", "hashes"))


def _confirmed(pairs: DataFrame, sets: DataFrame, salts: int = 8) -> DataFrame:
    """(u, v, linked) of pairs u < v, by full sets.  A class may be the first of many pairs, so that side is salted."""
    salt = F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int").alias("salt")
    rows = pairs.join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("theirs")).hint("merge"), "v").select("u", "v", salt, "theirs")
    firsts = sets.join(pairs.select(F.col("u").alias("node")).hint("merge"), "node", "left_semi")
    left = firsts.select(F.col("node").alias("u"), F.col("hashes").alias("ours"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    both = rows.join(left.hint("merge"), ["u", "salt"]).select("u", "v", "ours", "theirs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("ours"), batch.column("theirs")):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                common = len(a) + len(b) - len(np.union1d(a, b))
                linked.append(100 * common >= SIMILARITY * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_())], names=["u", "v", "linked"])

    return both.mapInArrow(lean(run), "u long, v long, linked boolean")


def _fine(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """``buckets`` with fine signatures, made from the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [packed(minima(np.frombuffer(x.as_buffer(), np.uint64), slice(HASHES, None))) for x in batch.column("hashes")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], names=["node", "sig"])

    asked = sets.join(buckets.select("node").distinct().hint("merge"), "node", "left_semi")
    made = written(asked.mapInArrow(lean(run), "node long, sig binary"))
    return written(buckets.select("key", "node", "bands").join(made.hint("merge"), "node").select("key", "node", "sig", "bands"))


def _components(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, group: int) -> DataFrame:
    """(node, root) of every class that links to another."""
    buckets, bound = _buckets(classes, group), least_matches()
    sets = _sets(docs, classes, buckets.select("node").distinct(), id_col, text_col)
    roots = tested = quota = None
    rounds = 0
    while True:
        # first links: a class meets its like in many buckets, so a quarter of them is enough to start with
        named = buckets if quota else buckets.where(F.col("key").bitwiseAND(3) == 0)
        label = F.col("node").alias("label") if roots is None else F.coalesce("root", "node").alias("label")
        named = (named if roots is None else named.join(roots.hint("merge"), "node", "left")).select("key", "node", "sig", "bands", label)
        found = named.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_apart(quota, bound)), "key long, u long, v long, equal int, more boolean")
        found = written(found)
        if quota is None:  # a class's likeliest link first: most classes are joined by it
            fresh = found.groupBy("v").agg(F.max_by("u", F.struct("equal", -F.col("u"))).alias("u")).select("u", "v")
        else:
            fresh = found.select("u", "v").distinct()
        if tested is not None:
            fresh = fresh.join(tested.hint("merge"), ["u", "v"], "left_anti")
        now = written(_confirmed(written(fresh), sets))
        if rounds > 1:
            tested = now.select("u", "v") if tested is None else tested.unionByName(now.select("u", "v"))
        links = now.where("linked").select("u", "v")
        if not links.isEmpty():  # components so far as stars, with the new links
            roots = written(connected_components(links if roots is None else links.union(roots.select("node", "root"))))
        if quota is not None:  # only buckets that have more to say go on
            open_keys = written(found.where("more").select("key").distinct())
            if open_keys.isEmpty():
                break
            buckets = buckets.join(open_keys.hint("merge"), "key")
            if rounds == 1:  # what is still open looks much alike; longer signatures tell it apart
                buckets, bound = _fine(written(buckets), sets), least_matches(FINE)
        quota = QUOTAS[rounds] if rounds < len(QUOTAS) else 16 * quota
        rounds += 1
    return roots if roots is not None else classes.select("node", F.col("node").alias("root")).limit(0)


def _with_hot(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows left-joined by digest with table (digest, copies, component); the few sets of a great share of the rows by broadcast."""
    total = rows.count()
    hot = table.where(F.col("copies") > max(HOT_SHARE * total, 1000))
    once = hot.select("digest")
    return rows.join(F.broadcast(hot), "digest").unionByName(
        rows.join(F.broadcast(once), "digest", "left_anti").join(table.join(F.broadcast(once), "digest", "left_anti").hint("merge"), "digest"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Per document row: id, n_shingles, component_id (least id of its component) and kept (its id is that)."""
    rows = written(_rows(docs, id_col, text_col))
    classes = _classes(rows)
    roots = _components(classes, docs, id_col, text_col, group)
    member = written(
        classes.select("node", "digest", "copies", "least").join(roots.hint("merge"), "node", "left")
        .select("digest", "copies", "least", F.coalesce("root", "node").alias("root")))
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    table = written(member.join(least.hint("merge"), "root").select("digest", "copies", "component"))
    slim = rows.select("id", "n", "digest")
    found = _with_hot(slim.where("n > 0"), table).select("id", "n", F.coalesce("component", "id").alias("component"))
    every = found.unionByName(slim.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return every.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
