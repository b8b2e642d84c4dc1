import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from mnemos.llm import minhash
from mnemos.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text, n=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(A_Z)) if w]
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, num=17, den=20):
    """rows: (key, text), keys distinct."""
    sets, least = {k: brute_set(t) for k, t in rows}, {k: k for k, _ in rows}

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            least[max(a, b)] = min(a, b)
    return {k: (len(s), root(k), root(k) == k) for k, s in sets.items()}


def mine(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute([(r.doc_id, r.text) for r in docs])
    assert mine(QUERIES["op13_minhash_near_dedup"](spark, SF)) == want
    assert sum(not kept for _, _, kept in want.values()) > 3


def chained(seed, n, words):
    """Texts and copies of copies, each with a few other words: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        own = [f"w{rng.randrange(10_000)}" for _ in range(rng.randint(5, words))]
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(own))
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10_000)}"
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 3)  # buckets in pairs of blocks
    rows = chained(1, 60, 160) + [(1000, "One two"), (1001, "one TWO"), (1002, "w1")]
    want = brute(rows)
    assert mine(minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert 20 < sum(not kept for _, _, kept in want.values()) < len(rows) - 60
    # one text with 60 copies that differ from each other more than from it, then the copies without it
    rng = random.Random(2)
    text = [f"x{i}" for i in range(300)]
    rows = [(500, " ".join(text))] + [(k, " ".join(w if rng.random() > 0.012 else f"y{rng.random()}" for w in text)) for k in range(60)]
    for part in (rows, rows[1:]):
        assert mine(minhash.groups(spark.createDataFrame(part, "doc_id long, text string"))) == brute(part)


def test_boilerplate_is_no_link(spark):
    """Texts that share a long passage and fall into common buckets, none similar enough; no candidate edge a pair."""
    rng = random.Random(3)
    shared = " ".join(f"b{i}" for i in range(220))
    rows = [(k, shared + " " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(30))) for k in range(400)]
    assert all(c == k for k, (_, c, _) in mine(minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"))).items())
    sketched = minhash.sketched(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5, 17, 20)
    cells = sketched.select(F.col("row").alias("node"), "n", F.explode("cells").alias("cell"))
    shared = cells.join(cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1"), "cell")
    assert shared.groupBy("cell").count().agg(F.max("count")).first()[0] > 50
    assert minhash.stars(shared, 17, 20)[0].count() <= len(rows) * minhash.BANDS


def test_buckets_move_once_to_be_counted(spark, tmp_path):
    rows = [(k, 5, k // 3 if k < 30 else k) for k in range(90)]
    spark.createDataFrame(rows, "node long, n long, cell long").write.parquet(f"{tmp_path}/cells")
    df = minhash.in_several(spark.read.parquet(f"{tmp_path}/cells"))
    assert sorted((r.node, r.n, r.cell, r.size) for r in df.collect()) == [(*r, 3) for r in rows[:30]]
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_bins_agree_as_often_as_sets_do():
    rng, agree = np.random.default_rng(1), {}
    for size in (20, 60, 1000):
        for _ in range(300):
            both = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            a, b = (np.sort(np.concatenate([both, rng.integers(0, 1 << 64, size // 10, dtype=np.uint64)])) for _ in "ab")
            agree.setdefault(size, []).append((minhash.minima(a) == minhash.minima(b)).mean())
        assert abs(np.mean(agree[size]) - 10 / 12) < 0.01
    assert len(set(minhash.minima(np.array([5], np.uint64)).tolist())) == 1


def test_odd_tables(spark):
    """Null keys and texts, blanks, repeated keys, an upper-case copy, a very long text, columns of the helpers' names."""
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(5, None), (4, " \n"), (3, "One two"), (9, "one TWO"), (9, "one TWO"), (None, "one two"), (None, "zz"), (1, long), (2, long.upper() + " more")]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, node long, cells string")
    got = sorted(repr((r.doc_id, r.component_id, r.kept)) for r in minhash.groups(df).collect())
    want = [(5, 5, True), (4, 4, True), (3, 3, True), (9, 3, False), (9, 3, False), (None, 3, False), (None, None, True), (1, 1, True), (2, 1, False)]
    assert got == sorted(map(repr, want))
    assert minhash.groups(df.limit(0)).count() == 0


def test_pieces_of_a_text(monkeypatch):
    text = " ".join(f"Wört{i % 700}" for i in range(3000)) + " \t"
    whole = minhash.shingles(text, 5)
    monkeypatch.setattr(minhash, "PIECE", 50)
    assert (minhash.shingles(text, 5) == whole).all() and len(whole) == len(brute_set(text))
