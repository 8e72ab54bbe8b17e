"""Sharding, packing, top-k search, near-duplicates and the pipeline: definitions, odd rows, brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from spacelab.llm import components, packing, quality, sharding, simhash, topk, toxicity
from spacelab.llm.common import written
from spacelab.llm.decontam import split_words, windows

DOCS = "doc_id long, text string, shard string, fp double, bucket int, uid string"


def docs(spark, rows):
    """Documents with columns that clash with what operators add."""
    return spark.createDataFrame([(i, t, "s", 0.5, 7, None) for i, t in rows], DOCS)


# ----- sharding -----


def check_shards(rows, shards, count):
    """Counts at most one apart, slots gapless."""
    slots = defaultdict(list)
    for r in rows:
        slots[r[0]].append(r[1])
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == count and max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("rows", [
    [], [(1, "only")], [(i, f"text {i}" * (i % 7)) for i in range(500)], [(None, None)] * 40 + [(5, "same")] * 300 + [(i, "") for i in range(100)],
    [(None, "hot " * 300)] * 900 + [(i, "x") for i in range(50)],
])
def test_shards(spark, rows):
    table = docs(spark, rows)
    got = sharding.shuffled(table, bucket_bytes=1 << 14)
    assert got.columns[:6] == table.columns and len(set(c.lower() for c in got.columns)) == len(got.columns)
    lying = [tuple(r) for r in got.collect()]
    check_shards([r[-2:] for r in lying], 24, len(rows))
    assert Counter((r[0], r[1]) for r in lying) == Counter(rows)


def test_shards_are_stable_and_seeded(spark):
    table = docs(spark, [(i, f"text {i}") for i in range(400)]).select("doc_id", "text")
    place = lambda df: {r["doc_id"]: (r["shard"], r["slot"]) for r in df.collect()}
    first = place(sharding.shuffled(table))
    assert first == place(sharding.shuffled(table.repartition(7))) != place(sharding.shuffled(table, seed=3))
    row = sharding.digest(sharding.shuffled(table)).where("doc_id = 17").first()
    assert (row["size"], row["text_crc32"], row["law"], row["grown_shard"]) == (15, zlib.crc32(b"text 17"), "rows", None)


@pytest.mark.parametrize("most", [sharding.MOST_TASKS, 5])
def test_shards_by_brute_force(spark, monkeypatch, most):
    """The order of all rows, made from ids and seeds alone."""
    monkeypatch.setattr(sharding, "MOST_TASKS", most)
    rows = [(i, f"text {i} " * (i % 9)) for i in range(600)] + [(None, None), (3, "again"), (3, None)]
    table = docs(spark, rows)
    keyed = table.select("doc_id", "text", F.xxhash64(F.lit(20), "doc_id").alias("h"), F.xxhash64(F.lit(22), "doc_id").alias("tie")).collect()
    size = lambda t: len((t or "").encode()) + 64
    buckets = max(64, -(-sum(size(r["text"]) for r in keyed) // 4096))
    lying = defaultdict(list)
    for r in keyed:
        lying[((r["h"] % 2**64) >> 12) % buckets].append((r["tie"], r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32(r["text"].encode()) if r["text"] is not None else -1, r["text"]))
    order = []
    for b in sorted(lying):
        mine = sorted(lying[b], key=lambda x: x[:4])
        place = list(range(len(mine)))
        picks = np.random.default_rng([20, b]).integers(np.arange(len(mine)), len(mine)).tolist()
        for i, j in enumerate(picks):
            place[i], place[j] = place[j], place[i]
        order += [mine[i] for i in place]
    base, extra = divmod(len(order), 24)
    want, at = [], 0
    for shard in range(24):
        for slot in range(base + (shard < extra)):
            _, known, i, _, text = order[at]
            want.append((i if known else None, text, shard, slot))
            at += 1
    got = [(r[0], r[1], r[-2], r[-1]) for r in sharding.shuffled(table, bucket_bytes=4096).collect()]
    assert sorted(got, key=lambda x: x[2:]) == want


def test_shard_files(spark, tmp_path):
    table = docs(spark, [(i, f"text {i}") for i in range(100)]).select("doc_id", "text")
    sharding.write_shards(table, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    check_shards([(r["shard"], r["slot"]) for r in back.collect()], 4, 100)


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(4, np.random.default_rng(i))) for i in range(6000))
    assert len(seen) == 24 and 180 < min(seen.values()) and max(seen.values()) < 330


# ----- packing -----

TEXTS = [None, "", "one two", "It's “quoted” – ÄÖ ß", "日本語のテキスト Σίσυφος", "<|endoftext|> literal", "long text, " * 3000, "one two", "a\x1fb\x85c", "x" * 5000]


def check_pieces(rows, docs_ids, length=2048):
    """Every id lies in one piece, in order; sequences are filled without gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["length"] == len(r["ids"]) // 4 > 0
    for i, want in docs_ids.items():
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == want and all(p["doc_tokens"] == len(want) // 4 for p in pieces)
        assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p["length"] for p in pieces) <= length
    return by_sequence


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in enumerate(TEXTS)}
    table = docs(spark, list(enumerate(TEXTS)))
    rows = packing.packed(table.repartition(1)).collect()
    sequences = check_pieces(rows, ids)
    assert len(sequences) == -(-sum(len(x) // 4 for x in ids.values()) // 2048)
    row = next(r for r in packing.digest(packing.packed(table)).collect() if r["doc_id"] == 2)
    assert row["ids_crc32"] == zlib.crc32(ids[2])
    assert packing.packed(table.limit(0)).count() == 0
    twice = packing.packed(docs(spark, [(3, "a b"), (3, "a b"), (None, "c")])).collect()
    assert sorted(r["length"] for r in twice) == [2, 3, 3]


def test_packing_in_small_groups(spark):
    table = docs(spark, [(i, "word " * (i * 37 % 400)) for i in range(300)])
    rows = packing.packed(table.repartition(2), length=128, group_tokens=1024).collect()
    sequences = check_pieces(rows, {}, 128)
    total = sum(r["length"] for r in rows)
    assert total == sum(i * 37 % 400 + 1 for i in range(300)) and len(sequences) <= total / 128 + 2 * (total / 1024)


def test_packing_balances_cost():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 700, 900).tolist()
    pieces = packing.pack(sizes, 2048)
    cost = defaultdict(float)
    for _, _, n, s, _ in pieces:
        cost[s] += packing.cost(n)
    assert max(cost.values()) < 1.1 * np.mean(list(cost.values()))
    assert len(cost) == -(-sum(sizes) // 2048)
    first = sorted(range(900), key=lambda i: (-sizes[i], i))[: len(cost)]
    assert {p[3] for p in pieces if p[0] in set(first) and p[1] == 0} == set(cost)  # the longest open one sequence each


# ----- top-k search -----


def brute_top(rows, k=20, every=20):
    fine = [(i, np.floor(64 * np.array(v, np.float64)).astype(object)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, (i, v) in enumerate(fine):
        if i % every == 0:
            scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), j) for c, (j, w) in enumerate(fine) if c != q and len(w) == len(v))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)}
    return out


@pytest.mark.parametrize("rows", [
    [], [(0, [1.0, 2.0])], [(0, None), (20, [float("nan"), 1.0]), (40, [None, 1.0]), (None, [1.0, 1.0]), (60, [1.0, 1.0]), (1, [float("inf"), 1.0])],
    [(i, [1.0, -0.5]) for i in range(100)], [(i, [float(i % 3), 0.25]) for i in range(-30, 40)] + [(20, [2.0, 0.25]), (7, [1.0, 0.25])] * 3,
    [(i, [float(i)] * (i % 4)) for i in range(80)], [(i, [5e5 * i, -3e5]) for i in range(45)],
])
def test_top_k(spark, rows):
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    got = topk.top_k(table.repartition(3), table.where("vec_id % 20 = 0"), block=3, bins=4)
    assert {tuple(r) for r in got.collect()} == brute_top(rows)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]


def test_top_k_of_random_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    single = [(i, np.array(v, np.float32).astype(np.float64).tolist()) for i, v in rows]
    assert {tuple(r) for r in topk.top_k(table, table.where("vec_id % 20 = 0")).collect()} == brute_top(single)


def test_top_k_of_long_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=20_000).round(1).tolist()) for i in range(0, 60, 4)]
    table = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, id int, size int, vec string, part int")
    assert {tuple(r) for r in topk.top_k(table, table.where("vec_id % 20 = 0"), block=2).collect()} == brute_top(rows)


def test_blocks_of_queries_do_not_lengthen_the_plan(spark):
    table = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    plans = [topk.top_k(table, table, k=2, block=b)._jdf.queryExecution().optimizedPlan().toString().count("\n") for b in (25, 500)]
    assert plans[0] == plans[1]


def test_scores_beyond_64_bits_are_clamped(spark):
    table = spark.createDataFrame([(i, [1e200 * (1 if i % 2 else -1)]) for i in range(6)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(table, table.where("vec_id = 0"), k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 2, topk._LIMIT), (0, 2, 4, topk._LIMIT), (0, 3, 1, -topk._LIMIT)]


# ----- near-duplicates -----


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    moving = True
    while moving:
        moving = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moving = True
    return label


@pytest.mark.parametrize("group", [simhash.GROUP, 4])
def test_links_connect_what_brute_force_connects(spark, group):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12)
    fps = {int(b) for b in base} | {0}
    for b in base[:6]:
        for _ in range(25):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps |= {1 << b for b in range(0, 64, 5)} | {7, 15, 2**64 - 1, 2**64 - 8}
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), group).collect()
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert all(((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() <= 64 for r in got)
    assert brute_components(signed, [tuple(r) for r in got]) == brute_components(signed, near)


def test_connected_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute_components({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if Counter(want.values())[r] > 1}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    near = text.replace("word0 ", "other ")
    rows = [(9, text), (4, near), (4, near), (7, text.upper()), (5, None), (6, ""), (8, " \n"), (None, "alone in the world"), (1, "two words"), (2, "Two  WORDS"),
            (3, "a" * 200000), (None, text)]
    table = docs(spark, rows)
    got = [tuple(r) for r in simhash.near_duplicates(table).collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    want = [(rows[i][0], f"{fps[i]:016x}", min((rows[j][0] for j in label if label[j] == label[i] and rows[j][0] is not None), default=None)) for i in range(len(rows))]
    assert Counter(got) == Counter(want)
    kept = simhash.dedup(table)
    assert kept.schema.names == table.schema.names
    first = defaultdict(list)
    for i in label:
        first[label[i]].append((rows[i][0] is None, rows[i][0] or 0, rows[i]))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(min(v, key=lambda x: x[:2])[2] for v in first.values())
    assert simhash.near_duplicates(table.limit(0)).count() == 0 and simhash.dedup(table.limit(0)).count() == 0


def test_near_duplicates_of_the_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = table.select("doc_id", "text").collect()
    fps = np.array([brute_fingerprint(r["text"]) for r in rows], np.uint64)
    near = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3)]
    label = brute_components(range(len(rows)), near)
    least = defaultdict(lambda: 10**9)
    for i, r in enumerate(rows):
        least[label[i]] = min(least[label[i]], r["doc_id"])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table).collect()}
    assert got == {r["doc_id"]: (f"{int(fps[i]):016x}", least[label[i]]) for i, r in enumerate(rows)}


# ----- pipeline -----


def test_pipeline_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in table.collect()}

    def left(ids):
        return table.where(F.col("doc_id").isin(ids))

    model = quality.train(table, labels)
    ids = [i for i, t in rows.items() if model.scores([t.encode()])[0] >= 0.3]
    model = toxicity.train(left(ids), labels)
    ids = [i for i in ids if model.scores([rows[i].encode()])[0] < 0.5]
    fps = {i: brute_fingerprint(rows[i]) for i in ids}
    label = brute_components(ids, [(i, j) for i in ids for j in ids if i < j and (fps[i] ^ fps[j]).bit_count() <= 3])
    ids = [i for i in ids if label[i] == i]
    wins = [list(w) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in windows(split_words(r["text"].encode()))]
    joined = [b" " + b" ".join(w) + b" " for w in wins]
    ids = [i for i in ids if not any(w in b" " + b" ".join(split_words(rows[i].encode())) + b" " for w in joined)]
    encode = packing.Encoder.of(packing.default_tokenizer())
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in pieces} == set(ids) and 0 < len(ids) < len(rows)
    check_pieces(pieces, {i: encode._full(rows[i]) + np.array([1], "<u4").tobytes() for i in ids})


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing columns, a long text and a benchmark passage, against the operators one by one."""
    good = "The quick brown fox runs over a hill and sees the wide sea. It sleeps under a tree number {}."
    bad = "BUY!! NOW!! ### | $$$ | CLICK {}\n" + "### $$$ !!!\n" * 5
    toxic = "You are an idiot and a scum, number {}. Such scum and idiot trash should vanish, idiot."
    passage = "once upon a midnight dreary while i pondered weak and weary over many a quaint volume"
    texts = [f.format(f"{i} w{i * 7919 % 1000} v{i * 104729 % 997}") for i in range(60) for f in (good, bad, toxic)]
    labels = [(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(180)] + [(None, 1, 1), (99999, 1, 0), (5, None, None)]
    odd = [None, "", "\n", good.format("odd") + " " + passage, good.format("odd ") * 3000, good.format("same"), good.format("same"), "日本語のテキスト" * 20]
    rows = [(i, t) for i, t in enumerate([*texts, *odd])] + [(None, good.format("nobody")), (185, odd[5]), (185, odd[5])]
    table = spark.createDataFrame([(i, t, "x", "y", 1.0, 2, b"z", "t") for i, t in rows],
                                  "doc_id long, text string, lang string, source string, score double, fp int, uid binary, label string")
    table.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, now = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = [(r["doc_id"], r["text"]) for r in now.collect()]
    encoded = lambda rows: [None if t is None else t.encode() for _, t in rows]
    for name, stage in corpus_pipeline.STAGES[:4]:
        if name in ("quality", "toxicity"):
            module = quality if name == "quality" else toxicity
            model = module.train(now, spark.read.parquet(f"{sf}/labels.parquet"))
            scores = [model.scores([t])[0] for t in encoded(left)]
            left = [r for r, s in zip(left, scores) if (s >= 0.3 if name == "quality" else s < 0.5)]
        elif name == "simhash":
            fps = [brute_fingerprint(t) for _, t in left]
            label = brute_components(range(len(left)), [(i, j) for i in range(len(left)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
            first = {}
            for i, r in enumerate(left):
                key = (r[0] is None, r[0] or 0)
                if label[i] not in first or key < first[label[i]][0]:
                    first[label[i]] = (key, r)
            left = [r for _, r in first.values()]
        else:
            left = [r for r in left if not r[1] or passage not in r[1].lower()]
        now = stage(spark, now, sf)
        assert now.schema == table.schema
        now = written(now)
        assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == Counter(left), name
        assert {tuple(r)[2:] for r in now.collect()} == {("x", "y", 1.0, 2, b"z", "t")}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert Counter({r["doc_id"]: r["doc_tokens"] for r in pieces}.keys()) == Counter(i for i, _ in left) and (184 in {i for i, _ in left})
    assert 20 < len(left) < 150


def test_crowded_fingerprint_groups_are_dealt_again(spark):
    """Forty thousand fingerprints that share 26 bits: no group stays crowded, no link is lost."""
    rng = np.random.default_rng(5)
    own = np.unique(rng.integers(0, 1 << 38, 40_000, dtype=np.uint64) << np.uint64(26))
    planted = own[:200] ^ (np.uint64(1) << rng.integers(26, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(26, 64, 200).astype(np.uint64))
    fps = np.unique(np.concatenate([own, planted]))
    table = simhash.pivoted(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"))
    rows = table.select(F.lit(1).cast("long").alias("key"), "fp", "pivots", F.lit(-(1 << 26)).cast("long").alias("rest"))
    sizes = [r["count"] for r in simhash._groups(rows, simhash.GROUP).groupBy("key").count().collect()]
    assert max(sizes) <= simhash.GROUP and sum(sizes) == 4 * len(fps)
    edges = {tuple(sorted((r["u"], r["v"]))) for r in simhash.links(table.select("fp")).collect()}
    root = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        assert (u ^ v).bit_count() <= 3 if (u ^ v) >= 0 else ((u ^ v) & (2**64 - 1)).bit_count() <= 3
        root[find(u)] = find(v)
    for a, b in zip(own[:200].view(np.int64).tolist(), planted.view(np.int64).tolist()):
        assert find(a) == find(b)
