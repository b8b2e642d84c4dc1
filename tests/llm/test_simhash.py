import random

import numpy as np
import xxhash

from mnemos.llm import simhash


def brute_print(text, n):
    words = text.encode().translate(simhash.LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum((1 << b) for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, distance):
    """prints: (key, fingerprint); the smallest key reachable of each fingerprint."""
    keys = {}
    for k, f in prints:
        keys[f] = min(k, keys.get(f, k))
    left, out = set(keys), {}
    while left:
        group, queue = set(), [left.pop()]
        while queue:
            f = queue.pop()
            group.add(f)
            near = {x for x in left if (x ^ f).bit_count() <= distance}
            left -= near
            queue += near
        out |= dict.fromkeys(group, min(keys[f] for f in group))
    return out


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, brute_print(r.text or "", 4)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_groups(rows, 4)
    assert sorted(map(tuple, simhash.op4_simhash_near_dedup(spark, sf).collect())) == sorted((k, f"{f:016x}", want[f]) for k, f in rows)


def links_of(spark, prints, distance, groups):
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in prints], "f long")
    found = simhash.components(simhash.links(df, distance, groups)).collect()
    return {(r.node & (1 << 64) - 1): r.root for r in found}


def test_links_are_all_found(spark, monkeypatch):
    random.seed(5)
    prints = {0}
    for _ in range(40):
        f = random.getrandbits(64)
        for _ in range(random.randint(1, 30)):
            prints.add(f)
            for b in random.sample(range(64), random.randint(1, 5)):
                f ^= 1 << b
    for distance, groups, cell in ((4, None, 8192), (4, 6, 5), (6, 9, 8192), (1, 3, 20)):
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "FEW", 3 if cell < 100 else 16)
        want = brute_groups([(f, f) for f in prints], distance)
        found = links_of(spark, prints, distance, groups)
        parts = {}
        for f in prints:
            parts.setdefault(found.get(f, ("alone", f)), set()).add(f)
        whole = {}
        for f in prints:
            whole.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, whole.values()))


def test_odd_tables(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(5, None), (4, " \n"), (3, "One two"), (9, "one TWO"), (9, "one TWO"), (None, "one two"), (None, "zz"), (1, long), (2, long.upper())]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, f long")
    found = simhash.near_groups(df, shingle=4).collect()
    assert sorted(repr((repr(r.doc_id), r.component_id)) for r in found) == sorted(map(repr, [("5", 4), ("4", 4), ("3", 3), ("9", 3), ("9", 3), ("None", 3), ("None", None), ("1", 1), ("2", 1)]))
    assert {r.f & (1 << 64) - 1 for r in found if r.doc_id == 1} == {brute_print(long, 4)}
    assert simhash.near_groups(df.limit(0)).count() == 0


def test_manhattan_distance_of_embeddings_is_a_lower_bound():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    b[:2500] = a[:2500] ^ (np.uint64(1) << rng.integers(0, 64, 2500).astype(np.uint64))
    counts = lambda f: np.stack([np.bitwise_count((f >> np.uint64(2 * i)) & np.uint64(3)) for i in range(32)], axis=1).astype(int)
    want = np.abs(counts(a) - counts(b)).sum(1)
    got = simhash.manhattan(simhash.embedded(a), simhash.embedded(b))
    assert (got == want).all() and (got <= np.bitwise_count(a ^ b)).all()


def test_groups_grow_with_the_fingerprints():
    found = [simhash.groups_for(n, 4) for n in (0, 10**6, 10**8, 10**9, 10**10)]
    assert found == sorted(found) and found[0] == found[1] == 7 < found[2] < found[4]
