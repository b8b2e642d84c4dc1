"""The seeded generator, shuffles and drawn exams against plain loops."""

import pytest
from pyspark.sql import functions as F

from mnemos.operators import sampling


class Loop:
    """The generator as a loop with a state, in 32-bit arithmetic."""

    def __init__(self, seed):
        self.n = 2166136261
        for c in seed:
            unit = int.from_bytes(c.encode("utf-16-be")[:2], "big")
            self.n = (self.n ^ unit) * 16777619 & 0xFFFFFFFF

    def draw(self):
        self.n = (self.n + 0x6D2B79F5) & 0xFFFFFFFF
        t = (self.n ^ self.n >> 15) * (1 | self.n) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (61 | t) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return t ^ t >> 14

    def shuffled(self, items):
        items = [*items]
        for i in range(len(items) - 1, 0, -1):
            j = self.draw() * (i + 1) >> 32
            items[i], items[j] = items[j], items[i]
        return items


def exam(seed, mode, sources, pool):
    """pool: (exam, kind, place, question_id) of one module."""
    exams = sorted({p[0] for p in pool})
    if not exams or sources is not None and (not sources or set(sources) - set(exams)):
        return None, "sources"
    if mode not in sampling.SIZES:
        return None, "mode"
    exams, rng, chosen = [e for e in exams if sources is None or e in sources], Loop(seed), []
    for kind, amount in sampling.SIZES[mode].items():
        sets = [rng.shuffled(sorted((place, e, q) for e, k, place, q in pool if (e, k) == (own, kind))) for own in exams]
        sets = rng.shuffled([g for g in sets if g])
        if sum(map(len, sets)) < amount:
            return None, "too_few"
        own = []
        while len(own) < amount:
            for g in sets:
                if g and len(own) < amount:
                    own.append(g.pop(0))
        chosen += own
    chosen = rng.shuffled(chosen)
    return (None, "one_exam") if len(exams) > 1 and len({e for _, e, _ in chosen}) < 2 else ([q for _, _, q in chosen], None)


SEEDS = ["", "seed", "same", "ß€", "😀 astral", "\x00", "x" * 300, "1", "2"]


def test_draws_and_skips(spark):
    df = spark.createDataFrame([(s,) for s in SEEDS], "seed string").select("seed", sampling.seeded(F.col("seed")).alias("state"), F.explode(F.sequence(F.lit(1), F.lit(300))).alias("i"))
    got = {(r.seed, r.i): r.d for r in df.select("seed", "i", sampling.draw(F.col("state"), F.col("i")).alias("d")).collect()}
    for s in SEEDS:
        loop = Loop(s)
        assert [got[s, i] for i in range(1, 301)] == [loop.draw() for _ in range(300)]
    assert spark.createDataFrame([(None,)], "seed string").select(sampling.seeded(F.col("seed")).alias("s")).first().s is None


@pytest.mark.parametrize("n", [0, 1, 2, 36, 200])
def test_shuffles(spark, n):
    df = spark.createDataFrame([(s, [*range(n)]) for s in SEEDS], "seed string, items array<int>")
    rows = df.select("seed", *[sampling.shuffled(F.col("items"), sampling.seeded(F.col("seed")), F.lit(skip)).alias(f"s{skip}") for skip in (0, 5)]).collect()
    for r in rows:
        later = Loop(r.seed)
        for _ in range(5):
            later.draw()
        assert r.s0 == Loop(r.seed).shuffled(range(n)) and r.s5 == later.shuffled(range(n))


def test_exams(spark):
    """Papers of 28 and 8 questions, an exam with one kind only, a module with a single exam, repeats in the sources, every refusal."""
    pools = [(e, "plan", kind, i, e * 100 + i + 50 * (kind == "multi_part")) for e, mc, parts in ((1, 28, 8), (2, 28, 8), (3, 5, 0), (4, 0, 3)) for kind, n in (("multiple_choice", mc), ("multi_part", parts)) for i in range(n)]
    pools += [(e, "short", "multiple_choice", i, 1000 + e * 20 + i) for e in (1, 2) for i in range(5 + 7 * e)] + [(1, "short", "multi_part", i, 2000 + i) for i in range(4)]
    pools += [(7, "wide", "multiple_choice", i, 3000 + i) for i in range(12)] + [(7, "wide", "multi_part", i, 3100 + i) for i in range(4)] + [(8, "wide", "other", 0, 3200)]
    asked = [(m, mode, src) for m in ("plan", "short", "wide", "absent") for mode in ("kurz", "standard", "x") for src in (None, [], [1], [2, 1, 2], [3], [3, 4], [7], [7, 8], [1, 9])]
    asked = [(i, SEEDS[i % len(SEEDS)], *a) for i, a in enumerate(asked)]
    requests = spark.createDataFrame(asked, "session_id long, seed string, module string, mode string, sources array<long>")
    got = {r.session_id: (r.question_ids, r.refused) for r in sampling.draw_exams(requests, spark.createDataFrame(pools, "exam long, module string, kind string, place int, question_id long")).collect()}
    want = {i: exam(seed, mode, src, [(e, k, place, q) for e, own, k, place, q in pools if own == m]) for i, seed, m, mode, src in asked}
    assert got == want
    assert {r for _, r in want.values()} == {None, "sources", "mode", "too_few", "one_exam"}
    full = [len(q) for q, _ in want.values() if q]
    assert {8, 16} == set(full)


def test_reruns_agree_and_empty(spark):
    requests = spark.createDataFrame([], "session_id long, seed string, module string, mode string, sources array<long>")
    assert sampling.draw_exams(requests, spark.createDataFrame([], "exam long, module string, kind string, place int, question_id long")).count() == 0
