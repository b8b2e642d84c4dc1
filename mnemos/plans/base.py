"""Where queries register, and tables that several of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.adapters import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, prelude: str = ""):
    """Registers a query under its name; ``sql`` goes behind the prelude's common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = prelude + sql
        return f

    return add


#: Sessions made of orders: every status, missing times, repeated and empty lists.
SESSIONS = """WITH sessions AS (SELECT o_orderkey AS session_id, o_custkey AS user_id, CASE o_orderkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' WHEN 2 THEN 'completed' WHEN 3 THEN 'abandoned' ELSE 'discarded' END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS discarded_at, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS deleted_at, CASE o_orderkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'completed' WHEN 2 THEN 'paused' END AS previous_status,
  CASE WHEN o_orderkey % 4 = 0 THEN 'original' ELSE 'module' END AS test_type, (o_custkey % 6)::VARCHAR AS exam, o_custkey % 4 AS module, o_orderdate AS started_at, o_orderkey % 9 AS revision,
  CASE WHEN o_orderkey % 3 = 0 THEN []::VARCHAR[] ELSE [(o_custkey % 6)::VARCHAR, (o_orderkey % 6)::VARCHAR, (o_custkey % 6)::VARCHAR] END AS source_exams FROM orders)
"""


def cases(value, *pairs, otherwise=None):
    """A CASE over equal values."""
    out = F.lit(otherwise)
    for a, b in reversed(pairs):
        out = F.when(value == a, b).otherwise(out)
    return out


def sessions(s, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    return table(s, d, "orders").select(
        k.alias("session_id"), c.alias("user_id"), cases(k % 5, (0, "active"), (1, "paused"), (2, "completed"), (3, "abandoned"), otherwise="discarded").alias("status"), F.when(k % 7 == 0, F.col("o_orderdate")).alias("discarded_at"),
        F.when(k % 11 == 0, F.col("o_orderdate")).alias("deleted_at"), cases(k % 4, (0, "active"), (1, "completed"), (2, "paused")).alias("previous_status"), F.when(k % 4 == 0, "original").otherwise("module").alias("test_type"),
        text(c % 6).alias("exam"), (c % 4).alias("module"), F.col("o_orderdate").alias("started_at"), (k % 9).alias("revision"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(text(c % 6), text(k % 6), text(c % 6))).alias("source_exams"),
    )
