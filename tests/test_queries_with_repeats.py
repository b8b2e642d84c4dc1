"""The queries again on larger tables, where keys, times and rectangles repeat."""

import duckdb
import pytest

from mnemos.plans import queries
from mnemos.plans.registry import QUERIES, SQL
from tests.test_queries import TABLES, plain

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(n for n, f in QUERIES.items() if f.__module__ == queries.__name__))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(SQL[name])
    order = {x[0]: i for i, x in enumerate(found.description)}
    assert got == sorted([plain(r[order[c]]) for c in columns] for r in found.fetchall())
