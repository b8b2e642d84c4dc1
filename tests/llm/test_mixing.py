from collections import defaultdict

import pandas as pd

from mnemos.llm import mixing
from tests.llm.util import spark_rows, sql_rows


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(mixing.op8_mix_sources(spark, sf)) == sql_rows(mixing.OP8_SQL, sf)


def test_fine_ranges_change_nothing(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(mixing, "RANGE_WORDS", 50)
    assert spark_rows(mixing.op8_mix_sources(spark, sf)) == sql_rows(mixing.OP8_SQL, sf)


def level(sizes, share=150):
    """Water-filling by the letter: reshare the excess until no target is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    stopped = {}
    while True:
        rest = share / 100 * sum(sizes.values()) - sum(stopped.values())
        free = [s for s in names if s not in stopped]
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return target | stopped
        stopped |= {s: 2.0 * sizes[s] for s in over}


def test_odd_tables(spark):
    rows = [(i, "w " * (i % 7), None if i % 5 == 0 else f"s{i % 5}", 0) for i in range(60)] + [(3, "a b c", "s3", 0)] * 2 + [(99, None, "empty", 0), (98, "x", "tiny", 0), (97, "word " * 5000, "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    found = mixing.mix(df).collect()
    assert len(found) == len(rows)
    sizes, of = defaultdict(int), {}
    for k, t, s, _ in rows:
        sizes[s] += len((t or "").split())
        of[k] = s
    want = level(sizes)
    taken = defaultdict(int)
    for r in found:
        assert abs(r.target - want[of[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[of[r.doc_id]] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    assert mixing.mix(df.limit(0)).count() == 0
    docs = pd.DataFrame([r for r in rows if r[0] != 3], columns=["doc_id", "text", "source", "size"])
    same = spark.createDataFrame([r for r in rows if r[0] != 3], df.schema)
    assert spark_rows(mixing.mix(same).drop("row")) == sql_rows(mixing.OP8_SQL, documents=docs)
