"""Cost-balanced sequence packing.

A document is its token ids and an end id.  It is cut at every ``length`` tokens; whole pieces fill a sequence alone.
The rest are packed by estimated cost: a piece of n tokens costs ``LINEAR * n + n^2`` (its matrices and its attention).
Longest first, each goes to the cheapest sequence that has room.  A group opens just enough sequences for its tokens;
where no sequence has room, the piece is cut to fill the cheapest one, so a group pads less than one sequence.

Groups are runs of about ``GROUP_TOKENS`` tokens within a partition of the input.  Packing therefore needs no shuffle,
a task holds one group, and a lost task is recomputed alone; only the last group of a partition can be small.

Tokenizing: a text is cut into words by the tokenizer's own pattern, and each distinct word is encoded once per worker
(a bounded cache), many in one call.  This holds for texts of plain Latin code points, where the tokenizer's normalisation is lower-casing
alone; other texts, and those that contain a special token's name, go through the tokenizer as a whole.

Defined results: a null or empty text is the end id alone; a very long text is encoded piece by piece, cut at white space
where no token can span, and its ids are held at once; repeated rows are packed each, pieces of equal size in the order
of their rows, costs that tie by the earlier sequence; bytes that are not UTF-8 read as replacement characters; an empty
table gives an empty result; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import decoded, id_type, keyed_text, lean, pieces, portions

LENGTH = 2048
END_ID = 1
LINEAR = 4096
GROUP_TOKENS = 1 << 20
CACHED_WORDS = 800_000
LONG_TEXT = 2 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters(kind: str) -> str:
    """Code points below U+0300 of a general category, lower case as the tokenizer sees them."""
    return "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == kind and chr(c).lower() == chr(c))


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters, digits = _letters("L"), _letters("N")
        # fixed values: the pre-tokenizer's pattern; letters may stand first, since no other part starts with one
        self.words = re.compile(f"[{letters}]+|[{digits}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{letters}{digits}]+").findall
        names = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.whole = re.compile(f"[^\t\n\r\x20-\x7e\xa0-˿]{'|' + names if names else ''}").search
        self.cache: dict[str, bytes] = {}
        self.plain = self._alike()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _alike(self) -> bool:
        """Whether this tokenizer is of the kind that the short way is made for."""
        sample = "It's AÄß 12,\n  don't\t½ x-Y_z!? İ (we'll) 's ... end"
        self.ends = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        return not self.whole(sample) and self._by_words([sample]) == [self._full(sample)]

    def _full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> bool:
        """Encode new words in one call; the token that ends a word says so in its name."""
        for a in range(0, len(words), 2000):
            some = words[a : a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                return False
            raw, start = ids.tobytes(), 0
            for word, end in zip(some, (4 * cuts).tolist()):
                self.cache[word] = raw[start:end]
                start = end
        return True

    def _by_words(self, texts: list[str]) -> list[bytes | None]:
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        known, held, new = self.cache.get, [], set()
        for text in texts:
            words = self.words(text.lower())
            ids = list(map(known, words))
            gaps = [(i, words[i]) for i, x in enumerate(ids) if x is None]
            new.update(word for _, word in gaps)
            held.append((ids, gaps))
        if not self._learn(list(new)):
            return [None] * len(texts)
        for ids, gaps in held:
            for i, word in gaps:
                ids[i] = self.cache[word]
        return [b"".join(ids) for ids, _ in held]

    def _some(self, texts: list[str | None]) -> list[bytes]:
        short = [i for i, t in enumerate(texts) if t and self.plain and not self.whole(t)]
        found = dict(zip(short, self._by_words([texts[i] for i in short])))
        out = []
        for i, t in enumerate(texts):
            ids = found.get(i)
            out.append(ids if ids is not None else self._full(t) if t else b"")
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, little-endian.  White space separates tokens, so a long text is encoded piece by piece."""
        if not self.plain or not any(t and len(t) > LONG_TEXT for t in texts):
            return self._some(texts)
        out = []
        for t in texts:
            parts = pieces(t.encode()) if t and len(t) > LONG_TEXT else ()
            out.append(b"".join(self._some([p.decode()])[0] for p in parts) if parts else self._some([t])[0])
        return out


def cost(tokens, linear: int = LINEAR):
    return linear * tokens + tokens * tokens


def pack(sizes: list[int], length: int = LENGTH, linear: int = LINEAR) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, tokens, sequence, offset) of documents with these token counts."""
    pieces, rest, sequence = [], [], 0
    for doc, size in enumerate(sizes):
        whole = size // length
        for k in range(whole):
            pieces.append((doc, k * length, length, sequence, 0))
            sequence += 1
        if size % length:
            rest.append((size % length, doc, whole * length))
    total = sum(r[0] for r in rest)
    count = -(-total // length)
    room = np.full(count, length, np.int64)
    spent = np.zeros(count, np.float64)
    rest.sort(key=lambda r: (-r[0], r[1]))
    for size, doc, start in rest:
        while size:
            fits = np.where(room >= size, spent, np.inf)
            at = int(fits.argmin())
            if fits[at] == np.inf:  # no room for all of it: fill the cheapest sequence with the first part
                at = int(np.where(room > 0, spent, np.inf).argmin())
            part = min(size, int(room[at]))
            pieces.append((doc, start, part, sequence + at, length - int(room[at])))
            room[at] -= part
            spent[at] += cost(part, linear)
            size, start = size - part, start + part
    return pieces


def packed(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS,
           linear: int = LINEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start, length, ids (little-endian unsigned 32-bit, binary), doc_tokens, sequence_id, offset, cost."""
    path = tokenizer or default_tokenizer()
    kind = id_type(docs, id_col)
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
        T.StructField("cost", T.DoubleType())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(path).encode
        first = TaskContext.get().partitionId() << 36
        held: list[tuple[pa.Scalar, bytes]] = []
        tokens = 0

        def flush(rows):
            nonlocal first
            sizes = [len(ids) // 4 for _, ids in rows]
            pieces = pack(sizes, length, linear)
            top = max((p[3] for p in pieces), default=-1) + 1
            for at in range(0, len(pieces), 4096):
                some = pieces[at : at + 4096]
                doc, start, part, sequence, offset = (np.array(x, np.int64) for x in zip(*some))
                yield pa.RecordBatch.from_arrays([
                    pa.array([rows[d][0] for d in doc], pa_kind), pa.array(start), pa.array(part),
                    pa.array([rows[d][1][4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, part)], pa.binary()),
                    pa.array(np.array(sizes, np.int64)[doc]), pa.array(sequence + first), pa.array(offset), pa.array(cost(part, linear).astype(np.float64)),
                ], names=[f.name for f in schema.fields])
            first += top

        pa_kind = None
        for batch in batches:
            pa_kind = batch.schema.field("id").type
            for part in portions(batch, "text", 1 << 20):
                for key, ids in zip(part.column("id").to_pylist(), encode(decoded(part.column("text")))):
                    ids += end
                    held.append((key, ids))
                    tokens += len(ids) // 4
                    if tokens >= 2 * group_tokens:  # a small remainder joins the last whole group
                        half = count = 0
                        while half < group_tokens:
                            half += len(held[count][1]) // 4
                            count += 1
                        yield from flush(held[:count])
                        held, tokens = held[count:], tokens - half
        if held:
            yield from flush(held)

    return keyed_text(docs, id_col, text_col).mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(packed(spark.read.parquet(f"{sf_dir}/documents.parquet")))
