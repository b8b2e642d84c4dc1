"""Queries of the seeded generator: draws, shuffles, and exams drawn from several sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemos.adapters import SQL, inventory, table
from mnemos.operators import sampling
from mnemos.plans.base import query


def _hash(seed: str) -> str:
    """SQL of the seed's hash."""
    return f"list_reduce([2166136261::HUGEINT] || list_transform(string_split({seed}, ''), lambda c: ascii(c)::HUGEINT), lambda n, c: (xor(n, c) * 16777619) % 4294967296)"


def _draws(source: str, state: str, i: str) -> str:
    """Common table expressions that put ``r``, an unsigned 32-bit draw, beside the rows of ``source``."""
    return f"""d1 AS (SELECT *, ({state} + {i}::HUGEINT * 1831565813) % 4294967296 AS n FROM {source}),
d2 AS (SELECT *, (xor(n, n >> 15) * (n | 1)) % 4294967296 AS t FROM d1), d3 AS (SELECT *, xor(t, (t + (xor(t, t >> 7) * (t | 61)) % 4294967296) % 4294967296) AS u FROM d2),
draws AS (SELECT *, xor(u, u >> 14) AS r FROM d3)"""


#: Of a list of places (i, j) from the last one on: the list with each pair exchanged.
SWAPS = "list_reduce([{items}] || {pairs}, lambda a, p: list_transform(range(1, len(a) + 1), lambda k: CASE WHEN k = p[1] THEN a[p[2]] WHEN k = p[2] THEN a[p[1]] ELSE a[k] END))"


@query(
    f"""WITH s AS (SELECT c_custkey, {_hash("c_name || CASE c_custkey % 3 WHEN 0 THEN 'ß' WHEN 1 THEN '€' ELSE '' END")} AS state, unnest(range(1, 9)) AS i FROM customer), {_draws("s", "state", "i")}
SELECT c_custkey, i::INT AS i, r::BIGINT AS draw, (r * 36 // 4294967296)::BIGINT AS below_36 FROM draws"""
)
def o15_draws(s, d):
    """Eight draws for each customer, seeded by the name and letters beyond ASCII."""
    seed = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "ß").when(F.col("c_custkey") % 3 == 1, "€").otherwise(""))
    rows = table(s, d, "customer").select("c_custkey", sampling.seeded(seed).alias("state"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("i"))
    return rows.select("c_custkey", "i", sampling.draw(F.col("state"), F.col("i")).alias("draw"), sampling.below(F.col("state"), F.col("i"), F.lit(36)).alias("below_36"))


@query(
    f"""WITH g AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS items, {_hash("'seed ' || o_custkey")} AS state FROM orders GROUP BY o_custkey),
s AS (SELECT *, unnest(range(1, len(items))) AS step FROM g), {_draws("s", "state", "step")},
p AS (SELECT o_custkey, list([len(items) - step + 1, (r * (len(items) - step + 1) // 4294967296)::BIGINT + 1] ORDER BY step) AS pairs FROM draws GROUP BY o_custkey),
f AS (SELECT o_custkey, {SWAPS.format(items="items", pairs="coalesce(pairs, [])")} AS mixed FROM g LEFT JOIN p USING (o_custkey))
SELECT o_custkey, unnest(mixed) AS o_orderkey, unnest(range(1, len(mixed) + 1))::INT AS place FROM f"""
)
def o16_shuffled(s, d):
    """Each customer's orders in the order that the customer's seed gives."""
    own = table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("items"))
    state = sampling.seeded(F.concat(F.lit("seed "), F.col("o_custkey").cast("string")))
    mixed = own.select("o_custkey", sampling.shuffled(F.col("items"), state, F.lit(0)).alias("mixed"))
    return mixed.select("o_custkey", F.posexplode("mixed").alias("place", "o_orderkey")).withColumn("place", F.col("place") + 1)


#: Requests of the customers: every module, mode, lists of exams (one, two, an unknown one, none) and all exams.
REQUESTS = """requests AS (SELECT c_custkey AS session_id, c_name AS seed, c_custkey % 3 AS module, CASE WHEN c_custkey % 13 = 0 THEN 'lang' WHEN c_custkey % 2 = 0 THEN 'kurz' ELSE 'standard' END AS mode,
  CASE c_custkey % 7 WHEN 0 THEN [c_custkey % 5] WHEN 1 THEN [c_custkey % 5, (c_custkey + 1) % 5] WHEN 2 THEN [c_custkey % 5, 9] WHEN 3 THEN []::BIGINT[] WHEN 4 THEN [4, 1, 2, 4] END AS sources FROM customer)"""


def _requests(s, d):
    k = F.col("c_custkey")
    lists = {0: [k % 5], 1: [k % 5, (k + 1) % 5], 2: [k % 5, F.lit(9).cast("long")], 3: [], 4: [F.lit(x).cast("long") for x in (4, 1, 2, 4)]}
    sources = F.lit(None).cast("array<long>")
    for r, own in lists.items():
        sources = F.when(k % 7 == r, F.array(*own).cast("array<long>")).otherwise(sources)
    mode = F.when(k % 13 == 0, "lang").when(k % 2 == 0, "kurz").otherwise("standard")
    return table(s, d, "customer").select(k.alias("session_id"), F.col("c_name").alias("seed"), (k % 3).alias("module"), mode.alias("mode"), sources.alias("sources"))


@query(
    f""", {REQUESTS},
sizes(mode, kind, turn, amount) AS (VALUES ('kurz', 'multiple_choice', 0, 6), ('kurz', 'multi_part', 1, 2), ('standard', 'multiple_choice', 0, 12), ('standard', 'multi_part', 1, 4)),
bank AS (SELECT module, list(DISTINCT exam) AS exams FROM inventory GROUP BY module),
asked AS (SELECT r.*, {_hash("seed")} AS state, exams, CASE WHEN sources IS NULL THEN exams ELSE list_intersect(exams, sources) END AS used,
  sources IS NOT NULL AND (len(sources) = 0 OR len(list_filter(sources, lambda x: NOT list_contains(exams, x))) > 0) AS lacking FROM requests r JOIN bank USING (module)),
sets AS (SELECT session_id, state, turn, amount, q.exam, list(question_id ORDER BY question_id) AS items FROM asked JOIN inventory q USING (module) JOIN sizes USING (mode, kind) WHERE NOT lacking AND list_contains(used, q.exam) GROUP BY ALL),
counted AS (SELECT *, len(items) AS many, count(*) OVER (PARTITION BY session_id, turn) AS members, row_number() OVER (PARTITION BY session_id, turn ORDER BY exam) AS pos, sum(len(items)) OVER (PARTITION BY session_id, turn) AS there FROM sets),
-- every shuffle of an exam's paper as one row: turn, step (1: an exam's questions, 2: the exams), exam
shuffles AS (SELECT session_id, state, turn, 1 AS step, exam, many FROM counted UNION ALL SELECT session_id, state, turn, 2, -1, members FROM counted WHERE pos = 1
  UNION ALL SELECT session_id, any_value(state), 2, 1, -1, sum(least(amount, there)) FROM counted WHERE pos = 1 GROUP BY session_id),
offsets AS (SELECT *, coalesce(sum(many - 1) OVER (PARTITION BY session_id ORDER BY turn, step, exam ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skip FROM shuffles),
s AS (SELECT *, unnest(range(1, many::BIGINT)) AS i FROM offsets), {_draws("s", "state", "(skip + i)")},
pairs AS (SELECT session_id, turn, step, exam, list([many::BIGINT - i + 1, (r * (many - i + 1) // 4294967296)::BIGINT + 1] ORDER BY i) AS pairs FROM draws GROUP BY ALL),
inside AS (SELECT c.*, {SWAPS.format(items="items", pairs="coalesce(pairs, [])")} AS mixed FROM counted c LEFT JOIN pairs p ON (p.session_id, p.turn, p.step, p.exam) = (c.session_id, c.turn, 1, c.exam)),
exams AS (SELECT i.session_id, i.turn, list(i.exam ORDER BY i.exam) AS items FROM inside i GROUP BY ALL),
ordered AS (SELECT e.session_id, e.turn, {SWAPS.format(items="items", pairs="coalesce(pairs, [])")} AS exams FROM exams e LEFT JOIN pairs p ON (p.session_id, p.turn, p.step) = (e.session_id, e.turn, 2)),
dealt AS (SELECT session_id, turn, amount, i.exam, unnest(mixed) AS id, unnest(range(len(mixed))) AS round, list_position(o.exams, i.exam) AS g FROM inside i JOIN ordered o USING (session_id, turn)),
chosen AS (SELECT * FROM dealt QUALIFY row_number() OVER (PARTITION BY session_id, turn ORDER BY round, g) <= amount),
papers AS (SELECT session_id, list(id ORDER BY turn, round, g) AS items, count(DISTINCT exam) AS from_exams FROM chosen GROUP BY session_id),
enough AS (SELECT session_id, count(*) FILTER (there >= amount) AS kinds FROM counted WHERE pos = 1 GROUP BY session_id),
final AS (SELECT p.session_id, {SWAPS.format(items="items", pairs="coalesce(pairs, [])")} AS ids, from_exams FROM papers p LEFT JOIN pairs x ON (x.session_id, x.turn) = (p.session_id, 2)),
told AS (SELECT a.session_id, ids, CASE WHEN lacking THEN 'sources' WHEN mode NOT IN ('kurz', 'standard') THEN 'mode' WHEN coalesce(kinds, 0) < 2 THEN 'too_few' WHEN len(used) > 1 AND from_exams < 2 THEN 'one_exam' END AS refused
  FROM asked a LEFT JOIN final f USING (session_id) LEFT JOIN enough e USING (session_id))
SELECT session_id, CASE WHEN refused IS NULL THEN array_to_string(ids, ',') END AS questions, refused FROM told""",
    SQL,
)
def o17_stratified_sample(s, d):
    """An exam for each customer, drawn by the customer's seed from the sources that it names."""
    pools = inventory(s, d).select("exam", "module", "kind", F.col("question_id").alias("place"), "question_id").withColumns({"exam": F.col("exam").cast("long"), "module": F.col("module").cast("long")})
    drawn = sampling.draw_exams(_requests(s, d), pools)
    return drawn.select("session_id", F.array_join(F.transform("question_ids", lambda x: x.cast("string")), ",").alias("questions"), "refused")
