import random
import re
from itertools import combinations

import corpus_pipeline as c
from mnemos.llm import minhash, similar


def brute_set(text, n):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_least(rows, n=5):
    """key -> smallest key reachable; rows: (key, text), keys distinct."""
    sets = {k: brute_set(t, n) for k, t in rows}
    least = {k: k for k in sets}

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            least[max(a, b)] = min(a, b)
    return {k: root(k) for k in sets}


def copies(seed, n, words=60):
    """Texts, copies of them with some words changed, and of the copies again: similarities on both sides of the threshold."""
    random.seed(seed)
    texts = []
    for _ in range(n):
        own = [f"w{random.randrange(10_000)}" for _ in range(random.randint(5, words))]
        for _ in range(random.randint(1, 5)):
            texts.append(" ".join(own))
            for _ in range(random.randint(0, 3)):
                own[random.randrange(len(own))] = f"w{random.randrange(10_000)}"
    random.shuffle(texts)
    return list(enumerate(texts))


def test_groups_against_brute_force(spark, monkeypatch):
    rows = copies(1, 60) + [(1000, None), (1001, " \n"), (1002, "One two"), (1003, "one TWO"), (1004, "w1")]
    want = brute_least(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar.near_groups(df).collect()} == want
    assert len(set(want.values())) < len(rows) - 20
    # one group of candidates, cut into pairs of blocks
    rows = [(k, " ".join(f"w{i}" for i in range(40)) + " " + t) for k, t in copies(2, 12, 30)]
    monkeypatch.setattr(minhash, "GROUP", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar.near_groups(df).collect()} == brute_least(rows)


def test_stage_goes_by_similarity(spark):
    """Pairs that a fingerprint radius of 6 bits missed (145 and 177) or linked at a similarity of 0.76 (192)."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    least = brute_least([(r.doc_id, r.text) for r in docs.collect()])
    got = c.near(spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {k for k, m in least.items() if k == m}
    assert least[145] < 145 and least[177] < 177 and least[192] == 192


def test_odd_tables(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(5, None), (4, " \n"), (3, "One two"), (9, "one TWO"), (9, "one TWO"), (None, "one two"), (None, "zz"), (1, long), (2, long.upper() + " more")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, node long")
    found = similar.near_groups(df).collect()
    assert sorted((repr(r.doc_id), repr(r.component_id)) for r in found) == sorted([("5", "4"), ("4", "4"), ("3", "3"), ("9", "3"), ("9", "3"), ("None", "3"), ("None", "None"), ("1", "1"), ("2", "1")])
    assert similar.near_groups(df.limit(0)).count() == 0


def test_fingerprints_give_candidates(spark):
    """Operator 4's links are edges between first rows; only the whole sets decide on them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = minhash.sketched(docs, "doc_id", "text", 5, 4, 5, {"f": similar.simhash.fingerprints(similar.F.col("text"), 5)})
    edges = similar.by_fingerprint(rows).collect()
    prints = {r.row: r.f & (1 << 64) - 1 for r in rows.collect()}
    assert edges and all(r.u < r.v and (prints[r.u] ^ prints[r.v]).bit_count() <= similar.DISTANCE for r in edges)


def test_shared_boilerplate(spark):
    """5,000 texts that share a long passage: none is near another, and no group is larger than its verified links make it."""
    rng = random.Random(4)
    shared = " ".join(f"b{i}" for i in range(60))
    rows = [(k, shared + " " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(30))) for k in range(5000)]
    rows += [(10_000 + k, rows[k][1] + " tail") for k in range(0, 5000, 100)]
    found = {r.doc_id: r.component_id for r in similar.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: k - 10_000 if k >= 10_000 else k for k, _ in rows}
