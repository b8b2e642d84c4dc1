import hashlib
import re

import numpy as np

from mnemos.llm import exact_dedup as x
from tests.llm.util import spark_rows, sql_rows


def test_filters_merge_losslessly():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 20, 3000).astype(np.uint64) << np.uint64(30) for _ in range(3)]
    merged = x.CountingQuotientFilter.merge([x.CountingQuotientFilter.load(x.CountingQuotientFilter.build(p, 60).dump()) for p in parts], 60)
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged.values(60) == values).all() and (merged.counts == counts).all()


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(x.op10_exact_dedup(spark, sf)) == sql_rows(x.OP10_SQL, sf)


def test_odd_tables(spark):
    rows = [(7, "a  b", 1), (3, "a\t\nb", 2), (3, "a b", 3), (9, None, 4), (8, "", 5), (None, "a b", 6), (1, "\x1ca b", 7), (2, "z" * 200_000, 8), (4, "z" * 200_000, 9)]
    df = spark.createDataFrame([(k, t, "n", i) for k, t, i in rows], "doc_id long, text string, norm string, row long")
    found = x.groups(df).collect()
    assert len(found) == len(rows) and all(r.text_sha256 in {hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t, _ in rows} for r in found)
    got = sorted((repr(r.doc_id), r.keep_id, r.group_size, r.kept) for r in found)
    three = sorted(k for d, *k in got if d == "3")
    assert three == [[3, 4, False], [3, 4, True]]
    assert [k for d, *k in got if d != "3"] == [[1, 1, True], [2, 2, True], [2, 2, False], [3, 4, False], [8, 2, True], [8, 2, False], [3, 4, False]]
    assert x.groups(df.limit(0)).count() == 0


def test_filters_of_a_partition(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(-(1 << 62), 1 << 62, 4000), np.repeat(rng.integers(-(1 << 62), 1 << 62, 5), [2, 3, 500, 2, 7])])
    rng.shuffle(values)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    df = spark.createDataFrame([(int(v),) for v in values], "f long").repartition(3)
    got = {r.fingerprint: r.n for r in x.repeated(df, "f", 16).collect()}
    own, counts = np.unique(values, return_counts=True)
    assert got == {int(v): int(n) for v, n in zip(own, counts) if n > 1}
    assert x.repeated(df.limit(0), "f", 16).count() == 0
