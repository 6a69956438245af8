"""The pipeline's near-duplicate stage against brute-force similarity of five-word shingles."""

import random

import numpy as np

import corpus_pipeline
from tessera.llm import simhash

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def classes(texts):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

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


def families():
    """Texts and copies of them with a stretch of words changed, at similarities from about 0.6 to 1."""
    random.seed(9)
    texts = []
    for _ in range(25):
        words = [f"w{random.randrange(3000)}" for _ in range(random.randint(60, 500))]
        texts.append(" ".join(words))
        for _ in range(6):
            copy, n = list(words), int(len(words) * random.choice([0.02, 0.06, 0.08, 0.1, 0.12, 0.2]))
            at = random.randrange(len(words) - n)
            copy[at : at + n] = [f"x{random.randrange(3000)}" for _ in range(n)]
            texts.append(" ".join(copy))
    return texts


def test_stage_keeps_one_of_each_class(spark):
    texts = families()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = {i for i, c in enumerate(classes(texts)) if c == i}
    assert len(expected) < len(texts)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()} == expected


def test_forest_of_sets_equals_brute_force():
    texts = families()
    forest = simhash.similar_forest([simhash.shingle_set(t) for t in texts])
    assert [forest.find(i) for i in range(len(texts))] == classes(texts)


def test_repeated_and_null_ids(spark):
    random.seed(10)
    a, b, c = (" ".join(f"w{random.randrange(3000)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a, 1), (2, b, 2), (2, a, 3), (None, b, 4), (None, c, 5), (None, c, 6), (7, None, 7), (7, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int")
    kept = {r.at for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()}
    assert {1, 2} <= kept and len(kept & {5, 6}) == 1 and len(kept & {7, 8}) == 1 and len(kept) == 4
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), SF).count() == 0


def test_candidates_are_links_of_fingerprints(spark, monkeypatch):
    random.seed(11)
    reach, rows = simhash.REACH, []
    for cell in range(40):
        at = random.getrandbits(64)
        for _ in range(random.choice([1, 2, 2, 3, 8, 30])):
            at = random.choice([at, random.getrandbits(64)])
            for bit in random.sample(range(64), random.choice([0, 5, 20, 26, 27])):
                at ^= 1 << bit
            rows.append((cell, len(rows), at - (1 << 64) if at >> 63 else at))
    df = spark.createDataFrame(rows, "cell long, node long, fp long")

    def linked(links):
        up = list(range(len(rows)))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for u, v in links:
            x, y = sorted((find(u), find(v)))
            up[y] = x
        return [find(i) for i in range(len(rows))]

    near = [(a, b) for c, a, x in rows for d, b, y in rows if c == d and a < b and bin((x ^ y) % 2**64).count("1") <= reach]
    expected = linked(near)
    assert len(set(expected)) < len(rows) and any(rows[a][0] == rows[b][0] and expected[a] != expected[b] for a in range(len(rows)) for b in range(a))
    assert linked((r.u, r.v) for r in simhash.candidates(df, reach).collect()) == expected
    # A cell too large for a task is one candidate component, whatever its fingerprints are.
    monkeypatch.setattr(simhash, "SHARD_ROWS", 7)
    size = {c: sum(r[0] == c for r in rows) for c in range(40)}
    expected = linked(near + [(a, b) for c, a, _ in rows for d, b, _ in rows if c == d and size[c] > 7])
    assert linked((r.u, r.v) for r in simhash.candidates(df, reach).collect()) == expected


def test_forest_at_the_stage_radius_equals_brute_force():
    rng, points = random.Random(12), set()
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(60):
            points.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(14))))
    points = np.array(sorted(points), np.uint64)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 19
    forest, brute = simhash._Forest(len(points)), simhash._Forest(len(points))
    found = simhash.link_forest(points, 19)
    forest.join_all(found[:, 0], found[:, 1])
    brute.join_all(*np.nonzero(near))
    assert len(points) > simhash.LEAF and forest.roots(np.arange(len(points))).tolist() == brute.roots(np.arange(len(points))).tolist()
