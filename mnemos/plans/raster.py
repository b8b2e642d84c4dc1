"""Queries over pixels: pages drawn from the bytes of the suppliers' rows, with rings, dots and lines that vary by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemos.adapters import table
from mnemos.functions.dealing import dealt
from mnemos.operators import raster
from mnemos.operators.raster import ADAPTIVE, FIXED, TWOFOLD, Rule
from mnemos.plans.base import query

#: Of a drawn page, and how many a task draws.
WIDE, HIGH = 40, 120
PAGES = 200


def _suppliers(s, d):
    return dealt(table(s, d, "supplier"), "s_suppkey", rows=PAGES)


def _page(s, d, lo: float, hi: float, dot: float):
    """A page for each supplier: five dots below each other, a ring around one or two or half of one, some faint, some dots missing."""
    k = F.col("s_suppkey")
    x = _suppliers(s, d).select(k, "s_name", F.explode(F.sequence(F.lit(0), F.lit(HIGH - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(WIDE - 1))).alias("x"))
    noise = F.ascii(F.substring(F.col("s_name"), (F.pmod(F.col("x") + F.col("y") * WIDE + k, F.length("s_name")) + 1).cast("int"), F.lit(1)))
    row = F.least(F.lit(5), F.greatest(F.lit(1), F.floor((F.col("y") - 9) / 20) + 1))
    x = x.withColumns({"noise": noise, "row": row}).withColumn("dy", F.col("y") - 19 - 20 * (F.col("row") - 1))
    r2 = (F.col("x") - 20) * (F.col("x") - 20) + F.col("dy") * F.col("dy")
    drawn = ((F.col("row") == k % 6) | ((k % 7 == 0) & (F.col("row") == F.floor(k / 7) % 5 + 1))) & ((k % 11 > 0) | (F.col("x") >= 20))
    ring, spot = r2.between(lo, hi) & drawn, (r2 <= dot) & ~((k % 13 == 0) & (F.col("row") == 3))
    v = F.when(ring & (k % 5 == 0), 195 + F.col("noise") % 15).when(ring, 40 + F.col("noise") % 50).when(spot, 60 + F.col("noise") % 30).otherwise(225 + F.col("noise") % 30)
    return x.select(k.alias("page"), "y", "x", v.cast("int").alias("v"))


def _sql_page(lo: float, hi: float, dot: float) -> str:
    return f"""k AS (SELECT s_suppkey AS page, s_name, y::INT AS y, x::INT AS x, least(5, greatest(1, (y - 9 + 20) // 20)) AS r FROM supplier, range({HIGH}) a(y), range({WIDE}) b(x)),
n AS (SELECT *, ascii(substr(s_name, 1 + ((x + y * {WIDE} + page) % length(s_name))::INT, 1)) AS noise, (x - 20) ** 2 + (y - 19 - 20 * (r - 1)) ** 2 AS r2 FROM k),
px AS (SELECT page, y, x, CASE WHEN r2 BETWEEN {lo} AND {hi} AND (r = page % 6 OR page % 7 = 0 AND r = (page // 7) % 5 + 1) AND (page % 11 > 0 OR x >= 20) THEN CASE WHEN page % 5 = 0 THEN 195 + noise % 15 ELSE 40 + noise % 50 END
  WHEN r2 <= {dot} AND NOT (page % 13 = 0 AND r = 3) THEN 60 + noise % 30 ELSE 225 + noise % 30 END AS v FROM n)"""


def _centres(s, d, shaken: bool = False):
    k = F.col("s_suppkey")
    x = table(s, d, "supplier").select(k.alias("page"), F.lit("c").alias("item"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("row"))
    far = (F.col("page") % 3 - 1, F.col("page") % 2) if shaken else (F.lit(0), F.lit(0))
    return x.select("page", "item", "row", (20 + far[0]).cast("double").alias("cx"), (19 + 20 * (F.col("row") - 1) + far[1]).cast("double").alias("cy"))


def _columns(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("page"), F.lit("c").alias("item"), (F.col("s_suppkey") % 17 > 0).alias("numbered"))


#: The box mean's ink at some offsets, by frames of 31 pixels each way.
MEANS = """rows31 AS (SELECT *, sum(v) OVER w AS rs, count(*) OVER w AS rn FROM px WINDOW w AS (PARTITION BY page, y ORDER BY x ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
boxes AS (SELECT *, sum(rs) OVER w AS total, sum(rn) OVER w AS cells FROM rows31 WINDOW w AS (PARTITION BY page, x ORDER BY y ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING))"""
CENTRES = """centres AS (SELECT s_suppkey AS page, r AS row, 20::DOUBLE AS cx, (19 + 20 * (r - 1))::DOUBLE AS cy FROM supplier, range(1, 6) t(r))"""
SHAKEN = """loose AS (SELECT s_suppkey AS page, r AS row, 20 + s_suppkey % 3 - 1 AS cx, 19 + 20 * (r - 1) + s_suppkey % 2 AS cy FROM supplier, range(1, 6) t(r)),
moved AS (SELECT page, row, cx + ox AS cx, cy + oy AS cy, oy, ox FROM loose, range(-3, 4) a(oy), range(-3, 4) b(ox)),
dark AS (SELECT m.page, m.row, m.cx, m.cy, oy, ox, avg(v) AS grey FROM moved m JOIN px ON px.page = m.page AND px.x BETWEEN m.cx - 2 AND m.cx + 2 AND px.y BETWEEN m.cy - 2 AND m.cy + 2 GROUP BY ALL),
centres AS (SELECT page, row, cx::DOUBLE AS cx, cy::DOUBLE AS cy FROM dark QUALIFY row_number() OVER (PARTITION BY page, row ORDER BY grey, oy, ox) = 1)"""


def _sql_measured(rule: Rule) -> str:
    """The rings' figures of ``ink`` around ``centres``."""
    op = ">" if rule.strict else ">="
    return f"""polar AS (SELECT c.page, c.row, threshold, ink, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r, floor((atan2(y - cy, x - cx) + pi()) / (2 * pi()) * 12)::INT % 12 AS sector
  FROM centres c JOIN ink i ON i.page = c.page AND i.x BETWEEN c.cx - {rule.reach} AND c.cx + {rule.reach} AND i.y BETWEEN c.cy - {rule.reach} AND c.cy + {rule.reach}),
sectors AS (SELECT page, row, threshold, sector, avg(ink::INT) AS share FROM polar WHERE r BETWEEN {rule.ring[0]} AND {rule.ring[1]} GROUP BY ALL),
support AS (SELECT page, row, threshold, round(count(*) FILTER (share {op} {rule.sector}) / 12, 4) AS support FROM sectors GROUP BY ALL),
measured AS (SELECT page, row, threshold, round(avg(ink::INT) FILTER (r BETWEEN {rule.ring[0]} AND {rule.ring[1]}), 4) AS ring, round(avg(ink::INT) FILTER (r <= {rule.dot}), 4) AS dot, any_value(support) AS support
  FROM polar JOIN support USING (page, row, threshold) GROUP BY ALL HAVING count(*) = {(2 * rule.reach + 1) ** 2})"""


def _sql_decided(rule: Rule) -> str:
    near = "FALSE" if rule.margin is None else f"strong = 1 AND coalesce(nxt, 0) > round(top - {rule.margin}, 6)"
    last = f"CASE WHEN found <> {rule.thresholds} OR answers <> 1 THEN '{rule.names[3]}' END" if rule.thresholds > 1 else "NULL"
    return f"""per AS (SELECT page, threshold, count(*) AS n, min(dot) AS dot, count(*) FILTER (s) AS strong, count(*) FILTER (ring >= {rule.possible[0]} AND support >= {rule.possible[1]}) AS possible, max(row) FILTER (s) AS row, max(ring) FILTER (s) AS top, max(ring) FILTER (NOT s) AS nxt
  FROM (SELECT *, ring >= {rule.strong[0]} AND support >= {rule.strong[1]} AS s FROM measured) GROUP BY ALL),
alls AS (SELECT page, count(*) AS seen, count(*) FILTER (n <> 5 OR dot < {rule.least_dot}) AS dots, count(*) FILTER (strong <> 1 OR possible <> 1) AS unclear, count(*) FILTER ({near}) AS near, count(*) FILTER (strong = 1) AS found, count(DISTINCT CASE WHEN strong = 1 THEN row END) AS answers, max(row) FILTER (strong = 1) AS answer FROM per GROUP BY page),
told AS (SELECT s_suppkey AS page, answer, answers, concat_ws(',', CASE WHEN dots > 0 OR seen < {rule.thresholds} THEN '{rule.names[0]}' END, CASE WHEN unclear > 0 THEN '{rule.names[1]}' END, CASE WHEN near > 0 THEN '{rule.names[2]}' END, {last},
  CASE WHEN s_suppkey % 17 = 0 THEN 'question_number_uncertain' END) AS reasons FROM supplier JOIN alls ON page = s_suppkey),
decided AS (SELECT page, CASE WHEN reasons = '' AND answers = 1 THEN answer END AS answer, reasons FROM told)"""


def _told(found):
    return found.select("page", "answer", F.array_join("reasons", ",").alias("reasons"))


G01 = f"WITH {_sql_page(64, 139, 9)}, {MEANS}, ink AS (SELECT page, 9 AS threshold, y, x, v * cells <= total - 9 * cells AS ink FROM boxes), {CENTRES}, {_sql_measured(ADAPTIVE)}, {_sql_decided(ADAPTIVE)}"
G02 = f"WITH {_sql_page(64, 139, 9)}, {MEANS}, ink AS (SELECT page, t AS threshold, y, x, v * cells <= total - t * cells AS ink FROM boxes, (VALUES (3), (5)) o(t)), {SHAKEN}, {_sql_measured(TWOFOLD)}, {_sql_decided(TWOFOLD)}"
G03 = f"WITH {_sql_page(23, 42, 2.9)}, ink AS (SELECT page, t AS threshold, y, x, v < t AS ink FROM px, (VALUES (190), (215)) o(t)), {CENTRES}, {_sql_measured(FIXED)}, {_sql_decided(FIXED)}"


@query("SELECT * FROM decided", G01)
def g01_adaptive_marks(s, d):
    """The marked row of each page's column, by the mean around each pixel."""
    ink = raster.adaptive_ink(_page(s, d, 64, 139, 9), [9])
    return _told(raster.decided(raster.rings(ink, _centres(s, d), ADAPTIVE), _columns(s, d), ADAPTIVE))


def _twofold(s, d):
    page = _page(s, d, 64, 139, 9)
    centres = raster.snapped(page, _centres(s, d, shaken=True))
    return raster.decided(raster.rings(raster.adaptive_ink(page, [3, 5]), centres, TWOFOLD), _columns(s, d), TWOFOLD), centres


@query("SELECT * FROM decided", G02)
def g02_twofold_marks(s, d):
    """As G01 under two offsets, with centres that first move to the dots."""
    return _told(_twofold(s, d)[0])


@query("SELECT page, row, threshold, ring AS ring_ink, support AS angular_support, dot AS center_ink FROM measured", G03)
def g03_ring_figures(s, d):
    """What each row measures under two fixed greys."""
    ink = raster.fixed_ink(_page(s, d, 23, 42, 2.9), [190, 215])
    return raster.rings(ink, _centres(s, d), FIXED).drop("item")


@query("SELECT * FROM decided", G03)
def a35_marks_from_pixels(s, d):
    """The decision on G03's figures."""
    ink = raster.fixed_ink(_page(s, d, 23, 42, 2.9), [190, 215])
    return _told(raster.decided(raster.rings(ink, _centres(s, d), FIXED), _columns(s, d), FIXED))


@query(
    """SELECT page, d.answer, reasons, min(cx) - 24 AS x0, max(cy) + 14 AS y1, max(cx - 12) FILTER (row = answer) AS ring_x0, max(cy + 12) FILTER (row = answer) AS ring_y1 FROM decided d JOIN centres USING (page) GROUP BY ALL""",
    G02,
)
def g24_choices(s, d):
    """Answers with the boxes of their columns and rings."""
    x = raster.choices(*_twofold(s, d))
    return x.select("page", "answer", F.array_join("reasons", ",").alias("reasons"), F.col("crop")[0].alias("x0"), F.col("crop")[3].alias("y1"), F.get("circle", F.lit(0)).alias("ring_x0"), F.get("circle", F.lit(3)).alias("ring_y1"))


# --- seams ---------------------------------------------------------------------------------------------------------

#: A page of 60 x 50 with two lines that tilt and have gaps by key, over a band of text bytes.
LINES = """k AS (SELECT s_suppkey AS page, s_name, y::INT AS y, x::INT AS x FROM supplier, range(50) a(y), range(60) b(x)),
px AS (SELECT page, y, x, CASE WHEN y >= 15 + page % 4 + (x * (page % 3)) // 60 AND y < 17 + page % 4 + (x * (page % 3)) // 60 AND NOT (page % 5 = 0 AND x % 20 < 9) THEN 30 WHEN y >= 34 AND y < 36 AND x BETWEEN 4 AND 25 + page % 30 THEN 20
  ELSE 200 + ascii(substr(s_name, 1 + ((x + y * 60 + page) % length(s_name))::INT, 1)) % 40 END AS v FROM k)"""


def _lined(s, d):
    k = F.col("s_suppkey")
    x = _suppliers(s, d).select(k.alias("page"), "s_name", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("x"))
    p, y, c = F.col("page"), F.col("y"), F.col("x")
    tilt = 15 + p % 4 + F.floor(c * (p % 3) / 60)
    noise = F.ascii(F.substring(F.col("s_name"), (F.pmod(c + y * 60 + p, F.length("s_name")) + 1).cast("int"), F.lit(1)))
    v = F.when((y >= tilt) & (y < tilt + 2) & ~((p % 5 == 0) & (c % 20 < 9)), 30).when((y >= 34) & (y < 36) & c.between(4, 25 + p % 30), 20).otherwise(200 + noise % 40)
    return x.select("page", "y", "x", v.cast("int").alias("v"))


SEGMENTS = f"""WITH {LINES}, e AS (SELECT page, y, x FROM (SELECT *, abs(v - lag(v) OVER (PARTITION BY page, x ORDER BY y)) AS step FROM px) WHERE step >= 100),
b AS (SELECT page, a AS angle, round(round(y * cos(radians(a / 10)) - x * sin(radians(a / 10)), 9))::INT AS "offset", x, y FROM e, range(-12, 13) t(a)),
p AS (SELECT * FROM b QUALIFY count(*) OVER (PARTITION BY page, angle, "offset") >= 12),
g AS (SELECT *, sum(cut) OVER (PARTITION BY page, angle, "offset" ORDER BY x, y) AS piece FROM (SELECT *, (coalesce(x - lag(x) OVER (PARTITION BY page, angle, "offset" ORDER BY x, y), 0) > 4)::INT AS cut FROM p)),
segments AS (SELECT page, angle, "offset", min(x) AS x0, max(x) AS x1, arg_min(y, (x, y)) AS y0, arg_max(y, (x, y)) AS y1 FROM g GROUP BY page, angle, "offset", piece HAVING max(x) - min(x) >= 10)"""


def _segments(s, d):
    return raster.segments(raster.edges(_lined(s, d), 100), 12, 10, 4)


@query("SELECT * FROM segments", SEGMENTS)
def g11_segments(s, d):
    """Level lines by votes of edge pixels."""
    return _segments(s, d)


@query(
    """, bands AS (SELECT s_suppkey AS page, band, nominal FROM supplier, (VALUES (1, 16), (2, 33)) t(band, nominal)),
near AS (SELECT b.*, x1 - x0 AS long, (y0 + y1) / 2 AS middle FROM bands b JOIN segments s ON s.page = b.page AND abs(y1 - y0) < 4 AND abs((y0 + y1) / 2 - nominal) < 6 AND x0 BETWEEN 0 AND 20 AND x1 <= 59 AND x1 - x0 > 18),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY page, band ORDER BY long DESC, middle) = 1)
SELECT page, band, round(coalesce(middle, nominal), 1)::DOUBLE AS seam, middle IS NOT NULL AS supported FROM bands LEFT JOIN best USING (page, band, nominal)""",
    SEGMENTS,
)
def g11_seams(s, d):
    """Two bands of each page, moved to the line near them."""
    band = F.struct(F.lit(1).alias("band"), F.lit(16).alias("nominal")), F.struct(F.lit(2).alias("band"), F.lit(33).alias("nominal"))
    bands = table(s, d, "supplier").select(F.col("s_suppkey").alias("page"), F.explode(F.array(*band)).alias("b")).select("page", "b.*", F.lit(0).alias("lo"), F.lit(20).alias("hi"), F.lit(59).alias("end"))
    return raster.seams(_segments(s, d), bands, 6, 18)


# --- composition ---------------------------------------------------------------------------------------------------


#: Parts of a task.
PARTS = 20_000


def _parts(s, d):
    return dealt(table(s, d, "part"), "p_partkey", rows=PARTS)


def _rows(s, d):
    """Each part's page: its name's bytes, sixteen to a row, four rows."""
    y = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("y")
    return _parts(s, d).select(F.col("p_partkey").alias("page"), F.rpad("p_name", 64, ".").alias("n"), y).select("page", "y", F.encode(F.substring(F.col("n"), F.col("y") * 16 + 1, F.lit(16)), "utf-8").alias("bytes"))


def _regions(s, d):
    """Two to three regions of one or two pages for each part, overlapping; some without owner, some of two owners."""
    k = F.col("p_partkey")
    last = table(s, d, "part").agg(F.max("p_partkey")).first()[0] or 0
    owner = F.when(k % 9 == 0, None).otherwise("q")
    boxes = [
        F.struct(owner.alias("owner"), F.lit(1).alias("seq"), k.alias("page"), (k % 5).cast("int").alias("x0"), F.lit(0).alias("y0"), (k % 5 + 6).cast("int").alias("x1"), F.lit(2).alias("y1")),
        F.struct(F.lit("q").alias("owner"), F.lit(2).alias("seq"), k.alias("page"), F.lit(2).alias("x0"), F.lit(1).alias("y0"), F.lit(9).alias("x1"), (k % 3 + 2).cast("int").alias("y1")),
        F.struct(F.when(k % 10 == 0, "r").otherwise("q").alias("owner"), F.lit(3).alias("seq"), F.when(k % 4 == 0, F.lit(last) + 1 - k).otherwise(k).alias("page"), F.lit(3).alias("x0"), F.lit(2).alias("y0"), (k % 13 + 6).cast("int").alias("x1"), F.lit(4).alias("y1")),
    ]
    return _parts(s, d).select(k.alias("question"), F.explode(F.array(*boxes)).alias("b")).select("question", "b.*")


#: Every pixel of every panel is the last region's that covers it, or white.
PICTURES = """WITH names AS (SELECT p_partkey AS page, rpad(p_name, 64, '.') AS n FROM part), last AS (SELECT max(p_partkey) AS last FROM part),
regions AS (SELECT p_partkey AS question, CASE WHEN p_partkey % 9 > 0 THEN 'q' END AS owner, 1 AS seq, p_partkey AS page, p_partkey % 5 AS x0, 0 AS y0, p_partkey % 5 + 6 AS x1, 2 AS y1 FROM part
  UNION ALL SELECT p_partkey, 'q', 2, p_partkey, 2, 1, 9, p_partkey % 3 + 2 FROM part
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'r' ELSE 'q' END, 3, CASE WHEN p_partkey % 4 = 0 THEN last + 1 - p_partkey ELSE p_partkey END, 3, 2, p_partkey % 13 + 6, 4 FROM part, last),
good AS (SELECT question FROM regions GROUP BY question HAVING count(*) = count(owner) AND count(DISTINCT owner) = 1),
panels AS (SELECT question, page, min(seq) AS first, min(x0) AS l, min(y0) AS t, max(x1) AS r, max(y1) AS b FROM regions JOIN good USING (question) GROUP BY ALL),
placed AS (SELECT *, coalesce(sum(b - t + 24) OVER (PARTITION BY question ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top, max(r - l) OVER (PARTITION BY question) AS wide, count(*) OVER (PARTITION BY question) AS n, row_number() OVER (PARTITION BY question ORDER BY first) AS pos FROM panels),
dots AS (SELECT question, page, wide, top + y - t AS oy, ox, l + ox AS x, y FROM placed, range(4) a(y), range(20) b(ox) WHERE y >= t AND y < b AND ox < wide),
seen AS (SELECT d.question, d.oy, d.ox, arg_max(CASE WHEN d.x < 16 THEN substr(hex(encode(n)), (1 + 2 * (d.y * 16 + d.x))::BIGINT, 2) END, seq) FILTER (seq IS NOT NULL AND d.x < 16) AS h FROM dots d LEFT JOIN regions g ON g.question = d.question AND g.page = d.page AND d.x >= g.x0 AND d.x < g.x1 AND d.y >= g.y0 AND d.y < g.y1 LEFT JOIN names p ON p.page = d.page GROUP BY ALL),
lines AS (SELECT question, oy AS y, string_agg(coalesce(h, 'FF'), '' ORDER BY ox) AS h FROM seen GROUP BY ALL UNION ALL SELECT question, top + b - t + g, repeat('FF', wide::INT) FROM placed, range(24) a(g) WHERE pos < n),
pictures AS (SELECT question, (any_value(length(h)) // 2)::INT AS width, count(*) AS height, string_agg(h, '' ORDER BY y) AS h FROM lines GROUP BY question)
"""


@query("SELECT question, width, height, sha256(encode(width || 'x' || height || ':') || unhex(h)) AS sha256 FROM pictures", PICTURES)
def g08_composed(s, d):
    """Size and hash of every part's picture."""
    return raster.picture_hashes(raster.composed(_rows(s, d), _regions(s, d)))


@query("SELECT question, CASE WHEN count(*) > count(owner) THEN 'unresolved' ELSE 'mixed' END AS problem FROM regions GROUP BY question HAVING count(*) > count(owner) OR count(DISTINCT owner) > 1", PICTURES)
def g08_refused(s, d):
    return raster.refused(_regions(s, d))


@query(
    """WITH p AS (SELECT p_partkey AS page, hex(encode(rpad(p_name, 64, '.'))) AS h FROM part)
SELECT page, y::INT AS y, string_agg(substr(h, (1 + 2 * (((y * 2) // 5) * 16 + (x * 2) // 5))::BIGINT, 2), '' ORDER BY x) AS bytes FROM p, range(10) a(y), range(40) b(x) GROUP BY ALL"""
)
def g07_scaled(s, d):
    """Every part's page at five halves of its size, as 180 dpi are of 72."""
    return raster.scaled_rows(_rows(s, d), 5, 2).select("page", "y", F.hex("bytes").alias("bytes"))
