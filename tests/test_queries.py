"""Every query of the library equals its SQL on the smallest tables."""

import math

import duckdb
import pytest

from mnemos.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations pages benchmark embeddings".split()


def plain(v):
    return ("%.6f" % v) if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.sql(SQL[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    want = sorted([plain(r[i]) for i in order] for r in found.fetchall())
    assert len(got) == len(want)
    assert got == want
