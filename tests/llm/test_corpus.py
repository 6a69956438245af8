"""Sharding, near-duplicates, tokens and the pipeline against brute force and the public libraries."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from tessera.llm import bpe, decontam, pii, quality, sharding, simhash, token_counts, token_files

SF = "/root/testdata/sf0.001"
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", " a ", "a  b", "a \n b", "\n\n x", "a\x1c b c\x1d", "a \x85b\xa0c", "don't WE'VE I'll 's", "İstanbul ΑΣ ΑΣ.", "é á ́b", "日本語 ①②½ 😀", "a" * 500, "x<|endoftext|>y <|startoftext|><|endoftext|>", "a\u0558b", "\0 a\0b", None]


def texts(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_sharding(spark):
    rows, docs = sharding.op2_slot_sharding(spark, SF).collect(), texts(spark)
    places, sizes = defaultdict(list), Counter()
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(docs[r.doc_id].encode()) + 8, zlib.crc32(docs[r.doc_id].encode()))
        places[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert len(rows) == len(docs) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * max(sizes.values())


def test_slot_maps(spark, tmp_path):
    random.seed(2)
    load = [random.randint(0, 1000) for _ in range(500)]
    first = sharding.SlotMap.initial(5, 500)
    even = first.rebalanced(load)
    assert max(even.loads(load)) - min(even.loads(load)) <= 0.001 * sum(load) / 5 + 1
    grown = even.rebalanced(load, 6)
    moved = [(a, b) for a, b in zip(even.shard_of, grown.shard_of, strict=True) if a != b]
    assert len(moved) < 150 and grown.version == 2
    for m in (first, even, grown):
        sharding.store(spark, m, str(tmp_path / "maps"))
    assert sharding.load(spark, str(tmp_path / "maps")) == grown and sharding.load(spark, str(tmp_path / "maps"), 1) == even
    heavy = [10_000] + [1] * 99
    assert sorted(sharding.SlotMap.initial(4, 100).rebalanced(heavy).loads(heavy))[:3] == [33, 33, 33] or max(sharding.SlotMap.initial(4, 100).rebalanced(heavy).loads(heavy)) == 10_000
    assert even.rebalanced(load) is even
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "é", 3)], "doc_id long, text string, shard int")
    out = sharding.placed(odd, 2, n_slots=16).collect()
    assert sorted(r["size"] for r in out) == [8, 8, 8, 10]
    assert sharding.assign(odd, first).columns == odd.columns
    assert sharding.placed(odd.limit(0), 2, n_slots=16).count() == 0


def test_a_stored_map_is_edited(spark, tmp_path):
    folder, docs = str(tmp_path / "maps"), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    first = {r.doc_id: (r.shard, r.virtual_slot, r.map_version) for r in sharding.placed(docs, 5, n_slots=512, folder=folder).collect()}
    again = {r.doc_id: (r.shard, r.virtual_slot, r.map_version) for r in sharding.placed(docs, 5, n_slots=512, folder=folder).collect()}
    assert again == first and {v for _, _, v in first.values()} == {1}
    # Edited texts stay in their slots, and the map moves no more slots than it must.
    edited = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.repeat("text", 3)).otherwise(F.col("text")))
    third = {r.doc_id: (r.shard, r.virtual_slot, r.map_version) for r in sharding.placed(edited, 5, n_slots=512, folder=folder).collect()}
    assert {i: s for i, (_, s, _) in third.items()} == {i: s for i, (_, s, _) in first.items()} and {v for _, _, v in third.values()} == {2}
    assert sum(third[i][0] != first[i][0] for i in first) < 0.3 * len(first)
    grown = sharding.placed(edited, 6, n_slots=512, folder=folder)
    rows = grown.collect()
    assert {r.shard for r in rows} == set(range(6)) and sharding.load(spark, folder).n_shards == 6 and {r.map_version for r in rows} == {3}
    brute = Counter()
    for r in rows:
        brute[r.shard] += r["size"]
    assert max(brute.values()) - min(brute.values()) < 0.1 * max(brute.values())
    assert sharding.load(spark, str(tmp_path / "none")) is None


def test_a_key_that_repeats_is_spread(spark, tmp_path):
    folder = str(tmp_path / "maps")
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("a text").alias("text"))
    for _ in range(2):
        rows = sharding.placed(df, 4, n_slots=64, folder=folder).collect()
        shards = Counter(r.shard for r in rows)
        assert len(rows) == 6000 and max(shards.values()) - min(shards.values()) < 100 and {r.map_version for r in rows} == {1}
        assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in shards.items())
        assert max(Counter(r.virtual_slot for r in rows).values()) < 300
    assert len(sharding.load(spark, folder).spread) == 2


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    up = {i: i for i in prints}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark):
    prints = {i: brute_fingerprint(t) for i, t in texts(spark).items()}
    classes = brute_components(prints)
    rows = simhash.op9_simhash_vptree(spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{p:016x}", classes[i]) for i, p in prints.items()}


def test_simhash_forests_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = set(rng.integers(0, 2**64, 900, np.uint64).tolist())
    for seed in list(points)[:30]:
        x = seed
        for _ in range(60):
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            points.add(x)
            if rng.random() < 0.3:
                x = seed
    points = sorted(points)
    expected = brute_components(dict(enumerate(points)))
    monkeypatch.setattr(simhash, "LEAF", 32)
    array = np.array(points, np.uint64)
    forest = simhash._Forest(len(points))
    for i, j in simhash.link_forest(array).tolist():
        assert (points[i] ^ points[j]).bit_count() <= 4
        forest.join(i, j)
    assert {i: forest.find(i) for i in range(len(points))} == expected
    prints = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(points)], "doc_id long, fp long")
    # Large shards are dealt again; at the smaller size some stay large and are linked by the points midway.
    for rows, dense in ((400, False), (20, True)):
        monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
        assert (simhash._shards(prints.select("fp"), 4)[1] is not None) == dense
        assert {r.doc_id: r.component_id for r in simhash.grouped(prints).collect()} == expected


def test_a_dense_group_is_linked_in_time():
    rng, points = np.random.default_rng(5), set()
    while len(points) < 20_000:
        points.add(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    array, began = np.array(sorted(points), np.uint64), time.time()
    forest = simhash._Forest(len(array))
    forest.join_all(*simhash.link_forest(array).T)
    assert time.time() - began < 10
    # All have three bits, so those that share one are linked, and all of them are.
    assert len(set(forest.roots(np.arange(len(array))).tolist())) == 1


def test_simhash_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([(5, None, 1), (3, "", 2), (9, "\n", 3), (7, "a b", 4), (None, "A B", 5), (7, "a b", 4), (1, long, 6), (None, "alone", 7)], "doc_id long, text string, fp int")
    found = {(r.doc_id, r.component_id) for r in simhash.grouped(simhash.fingerprints(df)).collect()}
    assert found == {(5, 3), (3, 3), (9, 3), (7, 7), (None, 7), (1, 1), (None, None)}
    assert simhash.grouped(simhash.fingerprints(df.limit(0))).count() == 0
    assert simhash.fingerprint(simhash.shingle_hashes(long, 4)) == brute_fingerprint(long)


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert roots == {**{i: 0 for i in range(1, 201)}, **{i: 1000 for i in range(1001, 1100)}}


def test_bpe_equals_library(spark):
    library = Tokenizer.from_file(WORD_BPE)
    rows = {r.doc_id: r for r in bpe.op6_pair_index_bpe(spark, SF).collect()}
    odd = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, ids int")
    rows |= {-1 - r.doc_id: r for r in bpe.digests(odd, WORD_BPE).collect()}
    for i, t in [*texts(spark).items(), *((-1 - i, t) for i, t in enumerate(ODD))]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = rows[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), t
    assert bpe.encoded(odd.limit(0), WORD_BPE).columns == ["doc_id", "ids", "decoded"]


def test_bpe_merges_equal_one_by_one():
    v = bpe.Vocabulary(WORD_BPE)
    random.seed(6)
    words = ["".join(random.choices("abethinrs", k=random.randint(1, 30))) for _ in range(300)]

    def alone(word):
        s = v.start(word)
        while True:
            ranked = [(v.merges[a << bpe._SHIFT | b], i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a << bpe._SHIFT | b in v.merges]
            if not ranked:
                return s
            rank, i = min(ranked)
            s[i : i + 2] = [v.rules[rank][2]]

    assert bpe.merge_all(words, v) == [alone(w) for w in words]


def test_memory_turns(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    encoder, library = bpe.Encoder(bpe.Vocabulary(WORD_BPE)), Tokenizer.from_file(WORD_BPE)
    for k in range(12):
        some = [f"word{k % 3} and others{j}" for j in range(k)] + ["and"]
        for t, (ids, _) in zip(some, encoder.encode(some), strict=True):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(t, add_special_tokens=False).ids


def test_unigram_counts_equal_library(spark):
    pieces = token_counts.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    for byte_fallback in (True, False):
        library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
        library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = token_counts.Counter(pieces, byte_fallback)
        for t in [*texts(spark).values(), *ODD, "▁x ▁ y", "<s> <unk>", "<0x41>"]:
            assert counter.text(t) == len(library.encode(t or "", add_special_tokens=False).ids), t
    tied = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁", -1.0)]
    library = Tokenizer(models.Unigram(tied, unk_id=0))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    for t in ("abab", "babab ab", "aabb", "abcab", "cc c"):
        assert token_counts.Counter(tied).text(t) == len(library.encode(t).ids)
    rows = token_counts.op5_viterbi_counts(spark, SF).collect()
    assert len(rows) == len(texts(spark)) and all(r.n_tokens > 0 for r in rows)


def test_token_files(spark, tmp_path):
    library, start, rows = Tokenizer.from_file(BYTE_BPE), 0, {r.doc_id: r for r in token_files.op10_token_files(spark, SF).collect()}
    for i, t in sorted(texts(spark).items()):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_token_file_lookup_and_edges(spark, tmp_path):
    library = Tokenizer.from_file(BYTE_BPE)
    df = spark.createDataFrame([(10 * i, t, "x") for i, t in enumerate(ODD)] + [(None, "no key", "x"), (10, "again", "x"), (-5, "below", "x")], "doc_id long, text string, key string")
    manifest = token_files.written(df, str(tmp_path / "files"), BYTE_BPE, 2, range_bytes=500, shard_bytes=60)
    shards = [token_files.Shard(r.path) for r in manifest.orderBy("range", "part").collect()]
    assert len(shards) > len({r.range for r in manifest.collect()}) > 1
    found = token_files.read_back(manifest).orderBy("start").collect()
    assert [r.key for r in found] == sorted((r.doc_id for r in df.collect()), key=lambda k: (k is not None, k))
    for s in shards:
        first = {}
        for key, _, ids in s.documents():
            if key is not None:
                first.setdefault(key, ids.tolist())
        for key, ids in first.items():
            assert s.lookup(key).tolist() == ids
        assert all(s.lookup(k) is None for k in range(1_000_000, 1_000_300))
        assert (s.rows_of(np.arange(1_000_000, 1_000_300)) == -1).all()
    texts_of = defaultdict(list)
    for r in df.collect():
        texts_of[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 2])
    for r in found:
        assert np.frombuffer(r.ids, "<u4").tolist() in texts_of[r.key] and r.ids_crc32 == zlib.crc32(r.ids)
    some = spark.createDataFrame([(10,), (10,), (None,), (-5,), (7,), (40,), (9999,)], "doc_id int")
    assert {tuple(r) for r in token_files.find(manifest, some).collect()} == {tuple(r) for r in found if r.key in (10, -5, 40)}
    assert token_files.read_back(token_files.written(df.limit(0), str(tmp_path / "none"), BYTE_BPE, 2)).count() == 0
    with pytest.raises(ValueError, match="whole numbers"):
        token_files.written(df, str(tmp_path / "names"), BYTE_BPE, 2, key="key")


def test_a_key_of_many_rows_is_dealt_over_ranges(spark, tmp_path):
    df = spark.range(900).select((F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id"))).alias("doc_id"), F.lit("some text").alias("text"))
    manifest = token_files.written(df, str(tmp_path / "files"), BYTE_BPE, 2, range_bytes=5000)
    rows = manifest.collect()
    assert sum(r.n_docs for r in rows) == 900 and max(r.n_docs for r in rows) < 250
    found = token_files.read_back(manifest).orderBy("start").collect()
    assert [r.key for r in found] == sorted((r.doc_id for r in df.collect()), key=lambda k: (k is not None, k))
    assert len({r.start for r in found}) == 900
    assert token_files.find(manifest, spark.createDataFrame([(7,)], "doc_id int")).count() == 300


def test_an_index_that_leads_astray_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    path = token_files.written(df, str(tmp_path / "files"), BYTE_BPE, 2).first().path
    shard = token_files.Shard(path)
    name = path.removeprefix("file://")
    raw = bytearray(open(name, "rb").read())
    raw[shard.rows_at : shard.rows_at + 16] = raw[shard.rows_at + 8 : shard.rows_at + 16] + raw[shard.rows_at : shard.rows_at + 8]
    open(name, "wb").write(raw)
    with pytest.raises(ValueError, match="does not lead"):
        list(token_files.Shard(path).documents())


def test_perfect_hash():
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(-(2**62), 2**62, 50_000))
    hashed = token_files.PerfectHash.build(keys)
    assert sorted(hashed.places(keys).tolist()) == list(range(len(keys)))
    assert np.array_equal(token_files.places_in(hashed.packed(), keys), hashed.places(keys))
    assert token_files.PerfectHash.build(keys[:0]).packed() == b""


def five_word_classes(texts):
    """For each text, the first that is reached over pairs which share four fifths of their five-word shingles."""
    sets, up = [], list(range(len(texts)))
    for t in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", words)
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [find(i) for i in range(len(texts))]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = quality.assess(docs).filter("kept").collect()
    left = {r.doc_id: r.text for r in judged}
    ids = sorted(left)
    classes = dict(zip(ids, five_word_classes([left[i] for i in ids]), strict=True))
    left = {i: t for n, (i, t) in enumerate(sorted(left.items())) if classes[i] == n}
    items = [decontam.reduced(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(x in decontam.reduced(t) for x in items)}
    new = {r.doc_id: r.text for r in pii.pseudonymised(spark.createDataFrame(list(left.items()), "doc_id long, text string"), pii.DEMO_KEY).collect()}
    library = Tokenizer.from_file(WORD_BPE)
    expected = {}
    for i, t in new.items():
        ids = library.encode(t, add_special_tokens=False).ids
        expected[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == expected


def test_pipeline_stages_keep_the_columns(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 60, "en", "s", 300)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0), docs.withColumn("_rank", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("fp", F.lit(1))):
            out = stage(spark, table, SF)
            assert out.columns == table.columns, name
            out.collect()
