"""Queries of the page detector: every order as half a page, its lines as what is printed on it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemos.adapters import table
from mnemos.functions.dealing import tasks
from mnemos.operators import layout
from mnemos.plans.base import query

HEADING_X, BODY_X = (40.0, 230.0), (30.0, 220.0, 410.0)
#: Lines that a task prints and reads: lines and half pages move once, dealt out by page, and lie together from then on.
LINES = 250_000


def _printed(s, d):
    """Headings near their anchors, too small or unreadable ones, notes that name the first line's number, and other text."""
    k = F.col("l_partkey")
    parts = tasks(table(s, d, "lineitem"), LINES)
    x = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").where("l_orderkey is not null").repartition(parts, "l_orderkey")
    x = x.withColumn("first", F.min_by(k % 28 + 1, F.struct("l_linenumber", "l_partkey", "l_suppkey")).over(W.partitionBy("l_orderkey")))
    kind, row, col, offset = F.floor(k / 6) % 8, F.floor(k % 6 / 2), k % 2, F.col("l_orderkey") % 2 * 421
    top = 100 + 100 * row + F.col("l_orderkey") % 3
    text = F.when((kind <= 3) | (kind == 6), (k % 28 + 1).cast("string")).when(kind == 4, "I ").when(kind == 5, F.concat(F.lit("Nebenrechnung Aufgabe "), F.col("first").cast("string"), F.lit(":"))).otherwise(F.col("l_returnflag"))
    x0 = offset + F.when(col == 0, 40).otherwise(230) + F.when(kind == 5, 20).otherwise(k % 5 - 2)
    y0 = top + F.when(kind == 5, 40).when(kind == 7, 60).otherwise(2 + k % 7)
    tall = F.when(kind == 6, 10).when(kind == 4, 18).otherwise(16 + k % 3)
    num = lambda c: c.cast("double")
    lines = x.select(F.col("l_orderkey").alias("page"), text.alias("text"), num(x0).alias("x0"), num(y0).alias("y0"), num(x0 + 20).alias("x1"), num(y0 + tall).alias("y1"))
    o = F.col("o_orderkey")
    ys = F.array(*[num(100 + 100 * i + o % 3) for i in range(4)])
    halves = table(s, d, "orders").select("o_orderkey", "o_custkey").where("o_orderkey is not null").repartition(parts, "o_orderkey").select(o.alias("page"), (o % 2).alias("side"), num(o % 2 * 421).alias("offset"), ys.alias("ys"), (F.col("o_custkey") % 3).alias("supported"))
    return lines, halves


PAGES = """WITH RECURSIVE src AS (SELECT *, first_value(l_partkey % 28 + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS first, (l_partkey // 6) % 8 AS kind, (l_partkey % 6) // 2 AS r, l_partkey % 2 AS c FROM lineitem),
boxes AS (SELECT l_orderkey AS page, kind, CASE WHEN kind <= 3 OR kind = 6 THEN (l_partkey % 28 + 1)::VARCHAR WHEN kind = 4 THEN 'I' WHEN kind = 5 THEN first::VARCHAR END AS word, r, c, l_orderkey % 2 * 421 + CASE c WHEN 0 THEN 40 ELSE 230 END + CASE WHEN kind = 5 THEN 20 ELSE l_partkey % 5 - 2 END AS x0,
  100 + 100 * r + l_orderkey % 3 + CASE kind WHEN 5 THEN 40 WHEN 7 THEN 60 ELSE 2 + l_partkey % 7 END AS y0, CASE kind WHEN 6 THEN 10 WHEN 4 THEN 18 ELSE 16 + l_partkey % 3 END AS tall FROM src),
halves AS (SELECT o_orderkey AS page, o_orderkey % 2 AS side, o_orderkey % 2 * 421 AS shift, o_custkey % 3 AS supported, o_orderkey % 3 AS low FROM orders),
spots AS (SELECT h.*, r, c, shift + CASE c WHEN 0 THEN 40 ELSE 230 END AS ax, 102 + 100 * r + low AS ay FROM halves h, range(3) a(r), range(2) b(c)),
marks AS (SELECT s.page, side, s.r, s.c, shift, low, supported, count(*) FILTER (kind IN (0, 1, 2, 3) AND tall >= 16) = 1 AS readable,
   CASE WHEN count(*) FILTER (kind IN (0, 1, 2, 3) AND tall >= 16) = 1 THEN max(word) FILTER (kind IN (0, 1, 2, 3)) ELSE 'UNRESOLVED-' || side || '-' || s.r || '-' || s.c END AS number,
   CASE WHEN count(*) FILTER (kind IN (0, 1, 2, 3) AND tall >= 16) = 1 THEN max(y0) FILTER (kind IN (0, 1, 2, 3)) ELSE any_value(ay) + 6 END AS y
  FROM spots s JOIN boxes b ON b.page = s.page AND abs(b.x0 - ax) < 14 AND b.y0 BETWEEN ay - 8 AND ay + 24 GROUP BY s.page, side, s.r, s.c, shift, low, supported
  HAVING count(*) FILTER (kind IN (0, 1, 2, 3) AND tall >= 16) = 1 OR count(*) FILTER (tall >= 18 AND (kind <= 4)) > 0),
edges AS (SELECT h.page, side, shift, supported, low, e AS band, coalesce((SELECT min(y) - 5 FROM marks m WHERE m.page = h.page AND m.r = e AND e BETWEEN 1 AND 2), 100 + 100 * e + low) AS y FROM halves h, range(4) t(e)),
notes AS (SELECT b.page, e.band AS r, CASE WHEN x0 < e.shift + 220 THEN 0 ELSE 1 END AS c, arg_max(word, (b.y0, b.x0, word)) AS owner FROM boxes b JOIN edges e ON e.page = b.page AND b.y0 >= e.y JOIN edges n ON n.page = b.page AND n.band = e.band + 1 AND b.y0 < n.y
  WHERE kind = 5 AND x0 >= e.shift + 30 AND x0 < e.shift + 410 AND EXISTS (SELECT 1 FROM marks m WHERE m.page = b.page AND m.number = word) GROUP BY ALL),
grid AS (SELECT p.page, r, max(m.number) FILTER (m.c = 0) AS n0, max(m.number) FILTER (m.c = 1) AS n1, max(w.owner) FILTER (w.c = 0) AS w0, max(w.owner) FILTER (w.c = 1) AS w1
  FROM (SELECT DISTINCT page, t.r FROM marks, range(3) t(r)) p LEFT JOIN marks m USING (page, r) LEFT JOIN notes w USING (page, r) GROUP BY ALL),
held AS (SELECT page, -1::BIGINT AS r, NULL::VARCHAR AS l, NULL::VARCHAR AS rt FROM grid GROUP BY page
  UNION ALL SELECT h.page, g.r, coalesce(w0, CASE WHEN n0 IS NOT NULL THEN n0 ELSE l END), coalesce(w1, CASE WHEN n0 IS NOT NULL THEN coalesce(n1, n0) WHEN n1 IS NOT NULL THEN n1 ELSE rt END) FROM held h JOIN grid g ON g.page = h.page AND g.r = h.r + 1),
cells AS (SELECT h.page, h.r, l AS number, e.shift + 30 AS x0, e.shift + 410 AS x1, e.y AS y0, n.y AS y1, e.side, e.supported FROM held h JOIN edges e ON e.page = h.page AND e.band = h.r JOIN edges n ON n.page = h.page AND n.band = h.r + 1 WHERE l = rt
  UNION ALL SELECT h.page, h.r, o, e.shift + CASE k WHEN 0 THEN 30 ELSE 220 END, e.shift + CASE k WHEN 0 THEN 220 ELSE 410 END, e.y, n.y, e.side, e.supported
   FROM (SELECT page, r, l AS o, 0 AS k FROM held WHERE l IS DISTINCT FROM rt UNION ALL SELECT page, r, rt, 1 FROM held WHERE l IS DISTINCT FROM rt) h JOIN edges e ON e.page = h.page AND e.band = h.r JOIN edges n ON n.page = h.page AND n.band = h.r + 1 WHERE o IS NOT NULL),
runs AS (SELECT *, sum(b) OVER (PARTITION BY page, number ORDER BY r, x0) AS seq FROM (SELECT *, (NOT coalesce(lag(x0) OVER w = x0 AND lag(x1) OVER w = x1 AND lag(y1) OVER w = y0, FALSE))::INT AS b FROM cells WINDOW w AS (PARTITION BY page, number ORDER BY r, x0))),
regions AS (SELECT page, side, supported, number, seq, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1, count(*) OVER (PARTITION BY page, number) > 1 AS many FROM runs GROUP BY page, side, supported, number, seq)
"""


@query(
    """SELECT g.page, g.side, number, seq, x0, y0, x1, y1, least(0.96, CASE WHEN many THEN 0.84 END, CASE WHEN g.supported < 2 THEN 0.93 END)::DOUBLE AS confidence, CASE WHEN many THEN 'non_rectangular_layout' ELSE '' END AS reasons, 'h' || g.side || '-r' || m.r || '-c' || m.c AS anchor
FROM regions g JOIN marks m USING (page, number) WHERE readable""",
    PAGES,
)
def g13_page_regions(s, d):
    """The questions' regions on every page."""
    found = layout.detected(*_printed(s, d), HEADING_X, BODY_X)[0]
    return found.withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT page, side, 'h' || side || '-r' || r || '-c' || c AS anchor, 'unreadable_heading' AS reason FROM marks WHERE NOT readable", PAGES)
def g13_unread_headings(s, d):
    return layout.detected(*_printed(s, d), HEADING_X, BODY_X)[1]


@query('SELECT page, e.side, r AS "row", l AS "left", rt AS "right" FROM held JOIN (SELECT DISTINCT page, side FROM edges) e USING (page) WHERE r >= 0', PAGES)
def g28_cell_owners(s, d):
    """Who owns the two cells of each band."""
    lines, halves = _printed(s, d)
    sheets = layout.marked(lines, halves, HEADING_X, 28)
    return layout.held(sheets, lines, BODY_X, 3).select("page", "side", "row", "left", "right")
