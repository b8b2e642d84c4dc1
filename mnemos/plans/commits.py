"""Queries of leases, commits and keyed stores: they write the given tables to a work folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemos.adapters import table
from mnemos.plans.base import query
from mnemos.sources import commits

COLUMNS = "o_orderkey long, o_custkey long, o_orderstatus string, part long"


def _parts(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_custkey") % 40).alias("part"))


@query(
    """WITH o AS (SELECT *, o_custkey % 40 AS part FROM orders)
SELECT part::VARCHAR AS part, CASE WHEN part = 7 THEN 'removed' WHEN part = 3 AND bool_or(o_orderkey % 2 = 0) OR part % 10 = 1 AND bool_or(o_orderstatus <> 'F') THEN 'written' ELSE 'kept' END AS change FROM o GROUP BY part"""
)
def s09_changed_parts(s, d):
    """All orders as a first version, then one with a part gone, rows of one repeated and states of some changed: what was written again."""
    at, rows = commits.work_folder(s, "orders"), _parts(s, d)
    commits.commit(rows, at, "part")
    p = F.col("part")
    changed = rows.where(p != 7).withColumn("o_orderstatus", F.when(p % 10 == 1, "F").otherwise(F.col("o_orderstatus")))
    changed = changed.unionByName(changed.where((p == 3) & (F.col("o_orderkey") % 2 == 0)))
    return commits.commit(changed, at, "part")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_custkey % 40 AS part FROM orders WHERE o_custkey % 40 <> 7")
def s07_after_a_crash(s, d):
    """What readers see after a version, two commits that end before their manifest and before their version file, and one that follows."""
    at, rows = commits.work_folder(s, "crash"), _parts(s, d)
    commits.commit(rows, at, "part")
    broken = rows.withColumn("o_orderstatus", F.lit("?"))
    commits.commit(broken, at, "part", stop_before="manifest")
    commits.commit(broken, at, "part", stop_before="version")
    commits.commit(rows.where("part <> 7"), at, "part")
    return commits.read_version(s, at, COLUMNS)


@query(
    """WITH w AS (SELECT o_custkey % 6 AS scope, count(*) AS rows FROM orders GROUP BY ALL)
SELECT scope, writer, CASE WHEN writer = 'a' AND scope % 3 = 0 OR writer = 'b' AND scope % 3 > 0 THEN CASE WHEN writer = 'a' THEN 'fenced' ELSE 'refused' END ELSE 'committed' END AS outcome, rows FROM w, (VALUES ('a'), ('b')) t(writer)"""
)
def s13_fenced_writers(s, d):
    """Two writers of each scope: one takes over the scopes that the other has held too long, and is refused for the others; who was taken over can't commit."""
    at, rows = commits.work_folder(s, "leases"), table(s, d, "orders").withColumn("scope", F.col("o_custkey") % 6)
    counts = {r.scope: r.n for r in rows.groupBy("scope").agg(F.count("*").alias("n")).collect()}  # six rows
    told = []
    for scope, n in counts.items():
        own = rows.where(F.col("scope") == scope).select("o_orderkey", "scope")
        a = commits.acquire(s, f"{at}/leases", f"s{scope}", "a", 1000, now_ms=0)
        b = commits.acquire(s, f"{at}/leases", f"s{scope}", "b", 1000, now_ms=2000 if scope % 3 == 0 else 500)
        for writer, lease in (("b", b), ("a", a)):
            try:
                outcome = "refused"
                if lease:
                    commits.commit(own, f"{at}/tables/{scope}", "scope", lease)
                    outcome = "committed"
            except commits.Fenced:
                outcome = "fenced"
            told.append((scope, writer, outcome, n))
    return s.createDataFrame(told, "scope long, writer string, outcome string, rows long")


#: Orders as stored by three versions of the schema: letters, names, names with a rank.
STORED = """stored AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'partly' END AS status, CASE WHEN o_orderkey % 3 = 2 THEN substr(o_orderpriority, 1, 1)::INT ELSE 9 END AS rank FROM orders)"""


def _store(s, d):
    o = table(s, d, "orders")
    k, letter = F.col("o_orderkey"), F.col("o_orderstatus")
    name = F.when(letter == "O", "open").when(letter == "F", "closed").otherwise("partly")
    base = o.select(k.alias("id"), F.col("o_custkey").alias("user_id"), F.when(k % 3 == 0, letter).otherwise(name).alias("status"), F.when(k % 3 == 2, F.substring("o_orderpriority", 1, 1).cast("int")).alias("rank"), (k % 3).cast("int").alias("schema_version"))
    names = lambda df: df.withColumn("status", F.when(F.col("status") == "O", "open").when(F.col("status") == "F", "closed").otherwise("partly"))
    ranks = lambda df: df.withColumn("rank", F.coalesce("rank", F.lit(9)))
    return commits.migrated(base, [names, ranks])


@query(f"WITH {STORED} SELECT id, user_id, status, rank, 2 AS schema_version FROM stored")
def s19_migrated_store(s, d):
    """Rows of all versions as the newest."""
    return _store(s, d)


@query(f"WITH {STORED} SELECT user_id, status, count(*) AS n FROM stored GROUP BY ALL HAVING count(*) > 1")
def s19_repeated_keys(s, d):
    """Compound keys that aren't unique."""
    return commits.repeated_keys(_store(s, d), "user_id", "status")


@query(f"WITH {STORED} SELECT id, user_id, status FROM stored WHERE user_id = (SELECT min(o_custkey) FROM orders)")
def s19_indexed_lookup(s, d):
    """One user's rows by way of the index on the second key: one bucket of its files is read."""
    rows = _store(s, d)
    user = table(s, d, "orders").agg(F.min("o_custkey")).first()[0]
    found = commits.index(rows, "user_id", ["id"], commits.work_folder(s, "index")).where(F.col("user_id") == user)
    return found.select("id").join(rows, "id").select("id", "user_id", "status")
