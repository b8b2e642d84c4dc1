"""Lookups, orders and derived tables over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemos.adapters import SQL, attempts, inventory, table
from mnemos.operators import bank, lookups, progress, registry, results, topics
from mnemos.plans.base import SESSIONS, cases, query
from mnemos.plans.base import sessions as all_sessions
from mnemos.plans.queries import BANK, _classified, _latest, _nodes

MODULES = "WITH m AS (SELECT DISTINCT CASE o_orderkey % 5 WHEN 0 THEN 'wiso' WHEN 1 THEN 'arbeitsplanung' WHEN 2 THEN 'Funktionsanalyse' ELSE 'extra' || o_custkey % 3 END AS module, CASE WHEN o_orderkey % 11 = 0 THEN 'old' WHEN month(o_orderdate) < 7 THEN year(o_orderdate) || '-sommer' ELSE year(o_orderdate) || '-' || substr((year(o_orderdate) + 1)::VARCHAR, 3) || '-winter' END AS exam FROM orders) "


def _modules(s, d):
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    name = F.when(k % 5 == 0, "wiso").when(k % 5 == 1, "arbeitsplanung").when(k % 5 == 2, "Funktionsanalyse").otherwise(F.concat(F.lit("extra"), (F.col("o_custkey") % 3).cast("string")))
    winter = F.concat(y.cast("string"), F.lit("-"), F.substring((y + 1).cast("string"), 3, 2), F.lit("-winter"))
    exam = F.when(k % 11 == 0, "old").when(F.month("o_orderdate") < 7, F.concat(y.cast("string"), F.lit("-sommer"))).otherwise(winter)
    return table(s, d, "orders").select(name.alias("module"), exam.alias("exam")).distinct()


RANK = "CASE lower(module) WHEN 'arbeitsplanung' THEN 10 WHEN 'funktionsanalyse' THEN 20 WHEN 'wiso' THEN 30 ELSE 100 END"
EXAMS = ", e AS (SELECT exam, CASE WHEN exam LIKE '%-sommer' THEN 'Sommer ' || substr(exam, 1, 4) WHEN exam LIKE '%-winter' THEN 'Winter ' || replace(substr(exam, 1, 7), '-', '/') ELSE exam END AS label, row_number() OVER (ORDER BY try_cast(substr(exam, 1, 4) AS INT) NULLS FIRST, exam LIKE '%winter', exam)::INT AS place FROM (SELECT DISTINCT exam FROM m)) "


@query(f"SELECT module, row_number() OVER (ORDER BY {RANK}, module)::INT AS place FROM (SELECT DISTINCT module FROM m)", MODULES)
def o20_ranked_modules(s, d):
    return lookups.ranked_modules(_modules(s, d))


@query(f"SELECT exam, module, {RANK} AS rank FROM m", MODULES)
def o01_module_rank(s, d):
    return _modules(s, d).select("exam", "module", lookups.module_rank(F.col("module")).alias("rank"))


@query("SELECT * FROM e", MODULES + EXAMS)
def o05_exam_options(s, d):
    return lookups.exam_options(_modules(s, d))


@query("SELECT exam, module, any_value(label) AS label FROM m JOIN e USING (exam) GROUP BY ALL", MODULES + EXAMS)
def f52_exam_labels(s, d):
    return _modules(s, d).select("exam", "module", lookups.exam_label(F.col("exam")).alias("label"))


LISTED = MODULES + EXAMS + f", l AS (SELECT exam, module, row_number() OVER (ORDER BY place, {RANK}, module)::INT AS place FROM m JOIN e USING (exam)) "


def _listed(s, d):
    m = _modules(s, d)
    return lookups.module_list(m, lookups.exam_options(m))


@query("SELECT * FROM l", LISTED)
def o19_module_list(s, d):
    return _listed(s, d)


@query("SELECT module, arg_min(exam, place) AS exam FROM l GROUP BY module", LISTED)
def o18_first_per_module(s, d):
    return lookups.first_per_module(_listed(s, d))


@query("SELECT exam, module FROM l WHERE exam LIKE '%-sommer' AND module = 'wiso'", LISTED)
def f53_module_lookup(s, d):
    return _listed(s, d).where(F.col("exam").endswith("-sommer") & (F.col("module") == "wiso")).select("exam", "module")


@query(
    """, r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'wiso' WHEN 1 THEN 'none' ELSE 'extra1' END AS module, CASE WHEN o_orderkey % 3 = 0 THEN 'U1' ELSE (o_orderkey % 4)::VARCHAR END AS number, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE year(o_orderdate) || '-sommer' END AS exam FROM orders),
q AS (SELECT exam, module, unnest(['1', '2', 'U1']) AS number FROM l WHERE module <> 'extra1' UNION ALL SELECT exam, module, '9' FROM l WHERE module = 'extra1'),
f AS (SELECT exam, arg_min(module, place) AS first FROM l GROUP BY exam),
x AS (SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.exam = r.exam AND l.module = r.module) THEN r.module ELSE first END AS target FROM r LEFT JOIN f USING (exam))
SELECT id, exam, coalesce(target, module) AS module, CASE WHEN target IS NULL OR EXISTS (SELECT 1 FROM q WHERE q.exam = x.exam AND q.module = x.target AND q.number = x.number) THEN number WHEN target = 'extra1' THEN '9' ELSE '1' END AS number FROM x""",
    LISTED,
)
def f54_retargeted_routes(s, d):
    k = F.col("o_orderkey")
    routes = table(s, d, "orders").select(
        k.alias("id"), F.when(k % 4 == 0, "wiso").when(k % 4 == 1, "none").otherwise("extra1").alias("module"), F.when(k % 3 == 0, "U1").otherwise((k % 4).cast("string")).alias("number"),
        F.when(k % 7 == 0, "unknown").otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit("-sommer"))).alias("exam"),
    )
    listed = _listed(s, d)
    numbers = F.when(F.col("module") == "extra1", F.array(F.lit("9"))).otherwise(F.array(F.lit("1"), F.lit("2"), F.lit("U1")))
    return lookups.retargeted(routes, listed, listed.select("exam", "module", F.posexplode(numbers).alias("pos", "number")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber = ANY([1, 2, 5]) AS inside FROM lineitem")
def f51_part_lookup(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_contains(F.array(F.lit(1), F.lit(2), F.lit(5)), F.col("l_linenumber")).alias("inside"))


@query("SELECT session_id, CASE session_id % 4 WHEN 0 THEN 'Alle Jahre' WHEN 1 THEN 'Keine ausgewählt' WHEN 2 THEN CASE WHEN exam < '3' THEN 'E' || exam ELSE 'Nicht verfügbar' END ELSE '2 Jahrgänge ausgewählt' END AS label FROM sessions", SESSIONS)
def f55_selection_labels(s, d):
    k, e = F.col("session_id"), F.col("exam")
    chosen = F.when(k % 4 == 0, None).when(k % 4 == 1, F.array().cast("array<string>")).when(k % 4 == 2, F.array(e)).otherwise(F.array(e, F.lit("x")))
    return all_sessions(s, d).select("session_id", lookups.selection_label(chosen, F.when(e < "3", F.concat(F.lit("E"), e))).alias("label"))


@query("SELECT session_id, CASE WHEN session_id % 5 = 0 THEN '2 Reihen' ELSE 'E' || exam END AS label FROM sessions", SESSIONS)
def f56_source_labels(s, d):
    k, e = F.col("session_id"), F.col("exam")
    chosen = F.when(k % 5 == 0, F.array(e, F.lit("x"))).otherwise(F.array(e))
    return all_sessions(s, d).select("session_id", lookups.selection_label(chosen, F.concat(F.lit("E"), e), "Reihen").alias("label"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '3,5' WHEN 1 THEN '2' WHEN 2 THEN '1,2' ELSE '' END AS pages FROM part")
def f35_context_pages(s, d):
    k = F.col("p_partkey")
    ints = lambda *x: F.array(*map(F.lit, x))
    pages = lookups.context_pages(F.when(k % 4 == 0, ints(3, 5, 3)), F.when(k % 4 == 1, 0).otherwise(1), ints(2, 0, 2), k % 4 < 3)
    return table(s, d, "part").select("p_partkey", F.array_join(pages.cast("array<string>"), ",").alias("pages"))


LINES = """WITH lines AS (SELECT p_partkey AS id, p_partkey % 20 AS page, CASE p_partkey % 7 WHEN 0 THEN 'Aufgabe ' || p_size % 45 || '.' WHEN 1 THEN 'U' || p_size % 9 WHEN 2 THEN p_size || ')' WHEN 3 THEN ' ' || p_size || ' ' WHEN 4 THEN p_name ELSE p_size || ' mm' END AS text,
  (p_partkey * 37 % 600)::DOUBLE AS x0, (p_partkey * 91 % 842)::DOUBLE AS y0, (p_partkey * 91 % 842 + 6 + p_size)::DOUBLE AS y1 FROM part)
"""


def _lines(s, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    t = n.cast("string")
    text = F.when(k % 7 == 0, F.concat(F.lit("Aufgabe "), (n % 45).cast("string"), F.lit("."))).when(k % 7 == 1, F.concat(F.lit("U"), (n % 9).cast("string"))).when(k % 7 == 2, F.concat(t, F.lit(")"))).when(k % 7 == 3, F.concat(F.lit(" "), t, F.lit(" "))).when(k % 7 == 4, F.col("p_name")).otherwise(F.concat(t, F.lit(" mm")))
    return table(s, d, "part").select(k.alias("id"), (k % 20).alias("page"), text.alias("text"), (k * 37 % 600).cast("double").alias("x0"), (k * 91 % 842).cast("double").alias("y0"), (k * 91 % 842 + 6 + n).cast("double").alias("y1"))


def _pages(s, d):
    return _lines(s, d).select("page").distinct().withColumns({"width": F.lit(595.0), "height": F.lit(842.0)})


@query(
    """, x AS (SELECT page, y0 AS top, CASE WHEN id % 7 < 2 THEN regexp_extract(text, '(\\d+)', 1)::INT WHEN id % 7 IN (2, 3) AND x0 < 595 * 0.14 AND y0 < 842 * 0.9 THEN regexp_extract(text, '(\\d+)', 1)::INT END AS number FROM lines)
SELECT * FROM x WHERE number BETWEEN 1 AND 40""",
    LINES,
)
def f32_heading_candidates(s, d):
    return lookups.headings(_lines(s, d), _pages(s, d))


@query(
    """, slots AS (SELECT page, i AS slot, i * 60.0 AS x, i * 80.0 AS y FROM (SELECT DISTINCT page FROM lines), range(10) t(i))
SELECT DISTINCT slots.page, slot::INT AS slot FROM slots JOIN lines ON lines.page = slots.page AND length(trim(text, ' ')) <= 4 AND y1 - y0 >= 18 AND abs(x0 - x) < 14 AND y0 >= y - 8 AND y0 <= y + 24""",
    LINES,
)
def f45_suspected_labels(s, d):
    slots = _pages(s, d).select("page", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("slot")).select("page", "slot", (F.col("slot") * 60.0).alias("x"), (F.col("slot") * 80.0).alias("y"))
    return lookups.suspected(_lines(s, d), slots)


@query(
    """WITH q AS (SELECT c_custkey AS question_id, (c_custkey % 12)::VARCHAR AS number, c_mktsegment AS module FROM customer),
p AS (SELECT o_orderkey AS page, CASE o_orderkey % 3 WHEN 0 THEN 'furniture: Aufgabe  ' || o_custkey % 15 || ', U' || o_orderkey % 4 || ' und Aufgabe 3' WHEN 1 THEN 'MACHINERY u ' || o_custkey % 15 || '.' ELSE 'Aufgabe 1 alone' END AS text FROM orders),
n AS (SELECT DISTINCT page, lower(text) AS text, unnest(regexp_extract_all(text, '(?i)(?:Aufgabe|U)\\s*(\\d+)\\b', 1)) AS number FROM p)
SELECT question_id, page FROM q JOIN n USING (number) WHERE contains(text, lower(module))"""
)
def j10_solution_pages(s, d):
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 15).cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("furniture: Aufgabe  "), c, F.lit(", U"), (k % 4).cast("string"), F.lit(" und Aufgabe 3"))).when(k % 3 == 1, F.concat(F.lit("MACHINERY u "), c, F.lit("."))).otherwise("Aufgabe 1 alone")
    q = table(s, d, "customer").select(F.col("c_custkey").alias("question_id"), (F.col("c_custkey") % 12).cast("string").alias("number"), F.col("c_mktsegment").alias("module"))
    return lookups.solution_pages(q, table(s, d, "orders").select(k.alias("page"), text.alias("text")))


@query("SELECT question_id, attempt_id FROM inventory JOIN attempts USING (question_id) WHERE correctness = 'falsch'", SQL)
def j28_corrections(s, d):
    return lookups.corrections(inventory(s, d).select("question_id"), attempts(s, d).where("correctness = 'falsch'").select("question_id", "attempt_id"))


@query("SELECT topic, member FROM closure", BANK)
def j11_topic_closure(s, d):
    return bank.closure(_nodes(s, d))


@query("SELECT DISTINCT question_id FROM membership WHERE topic = 2", BANK)
def f09_topic_filter(s, d):
    return bank.select(inventory(s, d), _classified(s, d), _nodes(s, d), topics=[2]).select("question_id")


@query(
    """SELECT p_partkey AS card, p_partkey % 10 AS topic FROM part WHERE p_partkey % 10 <> 9 AND p_partkey % 10 % 4 <> 0 AND p_partkey % 3 = p_partkey % 10 % 3 AND p_partkey % 7 > 0 AND p_size % 4 > 0 AND p_size % 5 > 0 AND p_partkey % 6 NOT IN (4, 5)"""
)
def f23_eligible_cards(s, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    ids = F.when(k % 6 == 5, F.array().cast("array<int>")).when(k % 6 == 4, F.array(F.lit(1), F.lit(9))).otherwise(F.array(F.lit(1), F.lit(2)))
    cards = table(s, d, "part").select(k.alias("card"), (k % 10).alias("topic"), (k % 3).alias("version"), F.when(k % 7 > 0, F.lit("2024-01-01")).otherwise("2024-03-01").cast("date").alias("verified_at"), F.when(n % 4 > 0, "a").otherwise(" ").alias("answer"), (n % 5).alias("sources"), ids.alias("question_ids"))
    summaries = s.range(9).select(F.col("id").alias("topic"), (F.col("id") % 3).alias("version"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("question_ids"), (F.col("id") % 4 != 0).alias("valid"))
    return lookups.eligible_cards(cards, summaries, "2024-02-01")


VERSIONS = """WITH v AS (SELECT o_orderkey AS id, o_custkey AS topic_id, o_orderkey % 3 > 0 AS current, o_orderkey % 5 > 0 AS verified, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate::DATE END AS verified_at, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate::DATE END AS effective_from, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE + 500 END AS effective_until, DATE '1996-01-01' AS as_of FROM orders) """


def _versions(s, d):
    k, at = F.col("o_orderkey"), F.to_date("o_orderdate")
    return table(s, d, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("topic_id"), (k % 3 > 0).alias("current"), (k % 5 > 0).alias("verified"), F.when(k % 7 > 0, at).alias("verified_at"), F.when(k % 4 > 0, at).alias("effective_from"),
        F.when(k % 2 == 0, F.date_add(at, 500)).alias("effective_until"), F.lit("1996-01-01").cast("date").alias("as_of"),
    )


@query(
    """SELECT topic_id, id FROM v WHERE current AND verified AND verified_at <= DATE '1997-06-01' AND (effective_from IS NULL OR effective_from <= DATE '1997-06-01') AND (effective_until IS NULL OR DATE '1997-06-01' < effective_until)
 AND NOT EXISTS (SELECT 1 FROM (SELECT topic_id, max_by(id, (effective_from, id)) AS id, max(effective_from) AS began FROM v WHERE effective_from <= DATE '1997-06-01' GROUP BY topic_id) x WHERE x.topic_id = v.topic_id AND x.id <> v.id AND x.began > v.as_of)""",
    VERSIONS,
)
def f22_still_valid(s, d):
    return lookups.still_valid(_versions(s, d), "1997-06-01")


SOURCE = "WITH s AS (SELECT o_orderkey AS source_id, o_custkey AS exam, CASE o_orderkey % 3 WHEN 0 THEN 'blocked' WHEN 1 THEN 'production' END AS status, sha256(o_orderkey::VARCHAR) AS sha FROM orders WHERE o_orderkey % 8 > 0) "


@query("SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 8 = 0 THEN 'unregistered' WHEN o_orderkey % 3 = 0 THEN 'blocked' WHEN o_orderkey % 5 = 0 THEN 'hash' END AS problem FROM orders")
def f50_usable_sources(s, d):
    k = F.col("source_id")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("source_id"))
    sha = F.sha2(k.cast("string"), 256)
    known = o.where(k % 8 > 0).select("source_id", cases(k % 3, (0, "blocked"), (1, "production")).alias("status"), sha.alias("sha256"))
    return lookups.usable_source(o.select("source_id", F.when(k % 5 > 0, sha).alias("sha256")), known)


@query("SELECT a.c_custkey AS scope, a.c_custkey AS question_source_id, b.o_orderkey AS solution_source_id, coalesce(CASE WHEN b.o_orderkey % 2 = 0 THEN 'manual' END, b.o_orderpriority) AS official_answer_revision FROM customer a JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey) b ON b.o_custkey = a.c_custkey WHERE a.c_nationkey % 4 > 0")
def f49_provenance(s, d):
    c = table(s, d, "customer").where("c_nationkey % 4 > 0").select(F.col("c_custkey").alias("scope"), F.col("c_custkey").alias("source_id"), F.lit("h").alias("sha256"), F.lit("l").alias("layout_profile"))
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("scope")).agg(F.max("o_orderkey").alias("source_id"), F.max_by("o_orderpriority", "o_orderkey").alias("answer_profile"))
    o = o.select("scope", "source_id", F.lit("h").alias("sha256"), "answer_profile", F.when(F.col("source_id") % 2 == 0, "manual").alias("manual_revision"))
    return lookups.provenance(c, o, ["scope"]).select("scope", "question_source_id", "solution_source_id", "official_answer_revision")


@query("SELECT o_orderkey, o_custkey AS scope, CASE WHEN o_custkey % 3 > 0 THEN 'settings ' || o_custkey END AS settings, o_custkey % 3 = 0 AS missing FROM orders")
def f44_review_scopes(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("scope"))
    known = o.where("scope % 3 > 0").select("scope").distinct().withColumn("settings", F.concat(F.lit("settings "), F.col("scope").cast("string")))
    return lookups.scopes(o, known)


@query("SELECT topic, count(DISTINCT question_id) AS needed FROM membership JOIN (SELECT question_id FROM latest WHERE correctness = 'falsch' UNION SELECT question_id FROM attempts WHERE question_id % 4 = 1) USING (question_id) GROUP BY topic", BANK)
def u02_needed_questions(s, d):
    return lookups.need_work(topics.members(_classified(s, d), _nodes(s, d)), _latest(s, d).where("correctness = 'falsch'"), attempts(s, d).where("question_id % 4 = 1"))


@query("SELECT exam FROM (SELECT DISTINCT exam FROM sessions UNION SELECT DISTINCT (o_orderkey % 9)::VARCHAR FROM orders)", SESSIONS)
def u04_all_years(s, d):
    listed = table(s, d, "orders").select((F.col("o_orderkey") % 9).cast("string").alias("exam"))
    return lookups.exam_options(all_sessions(s, d).select("exam").unionByName(listed)).select("exam")


@query(
    """, l AS (SELECT question_id, correctness FROM latest WHERE user_id = (SELECT min(user_id) FROM latest))
SELECT (SELECT count(*) FROM inventory) AS questions, count(DISTINCT question_id) AS classified, (SELECT count(*) FROM inventory) - count(DISTINCT question_id) AS unclassified, round(100.0::DOUBLE * count(DISTINCT question_id) / (SELECT count(*) FROM inventory), 6) AS coverage,
 (SELECT count(*) FROM l) AS answered, CASE WHEN (SELECT count(*) FROM l) >= 3 THEN (SELECT round(100.0::DOUBLE * count(*) FILTER (correctness = 'richtig') / count(*), 6) FROM l) END AS accuracy FROM membership""",
    BANK,
)
def a39_overall(s, d):
    latest = _latest(s, d)
    own = latest.join(latest.agg(F.min("user_id").alias("user_id")), "user_id")
    return lookups.overall(inventory(s, d), topics.members(_classified(s, d), _nodes(s, d)), own)


SEASONED = (
    BANK
    + """, q AS (SELECT *, (2015 + exam) || CASE WHEN question_id % 2 = 0 THEN '-sommer' ELSE '-winter' END AS season FROM inventory),
rs AS (SELECT season FROM (SELECT DISTINCT season FROM q) ORDER BY substr(season, 1, 4)::INT DESC, CASE WHEN contains(season, 'sommer') THEN 0 ELSE 1 END DESC LIMIT 4),
st AS (SELECT topic, count(DISTINCT question_id) AS questions, count(DISTINCT season) AS seasons, count(DISTINCT CASE WHEN season IN (SELECT season FROM rs) THEN season END) AS recent_seasons FROM membership JOIN q USING (question_id) GROUP BY topic),
an AS (SELECT topic, count(DISTINCT question_id) AS aq, count(*) AS answers, count(*) FILTER (correctness = 'richtig') AS correct, max(ts) AS last FROM membership JOIN latest USING (question_id) GROUP BY topic),
rel AS (SELECT st.*, round(0.4::DOUBLE * questions / (SELECT count(*) FROM q) + 0.4::DOUBLE * seasons / (SELECT count(DISTINCT season) FROM q) + 0.2::DOUBLE * recent_seasons / 4, 6) AS relevance FROM st)
"""
)


def _relevant(s, d):
    i = F.col("question_id")
    q = inventory(s, d).withColumn("season", F.concat((F.col("exam") + 2015).cast("string"), F.when(i % 2 == 0, "-sommer").otherwise("-winter")))
    recent = topics.recent(q, 4)
    stats = topics.statistics(topics.members(_classified(s, d), _nodes(s, d)), q, _latest(s, d), recent)
    size = q.agg(F.count_distinct("question_id"), F.count_distinct("season")).first()  # two numbers of the taxonomy's size
    return topics.relevance(stats, size[0], size[1], 4)


@query("SELECT topic, relevance, CASE WHEN relevance >= 0.7 THEN 'very_high' WHEN relevance >= 0.5 THEN 'high' WHEN relevance >= 0.25 THEN 'medium' ELSE 'low' END AS relevance_label FROM rel", SEASONED)
def a09_relevance(s, d):
    return _relevant(s, d).select("topic", "relevance", "relevance_label")


@query(
    """, nd AS (SELECT topic, count(DISTINCT question_id) AS needed FROM membership JOIN latest USING (question_id) WHERE correctness = 'falsch' GROUP BY topic),
p AS (SELECT topic, round(relevance + 2 * coalesce(needed / questions, 0) + CASE WHEN aq >= 3 AND round(100.0::DOUBLE * correct / answers, 6) < 60 THEN 1 - round(100.0::DOUBLE * correct / answers, 6) / 100 ELSE 0 END + CASE WHEN coalesce(answers, 0) = 0 THEN 0.25 ELSE 0 END, 6) AS priority FROM rel LEFT JOIN an USING (topic) LEFT JOIN nd USING (topic))
SELECT topic, priority, CASE WHEN priority >= 0.9 THEN 'now' WHEN priority >= 0.5 THEN 'soon' ELSE 'later' END AS priority_label FROM p""",
    SEASONED,
)
def a10_priority(s, d):
    members = topics.members(_classified(s, d), _nodes(s, d))
    needs = lookups.need_work(members, _latest(s, d).where("correctness = 'falsch'"), _latest(s, d).where("false"))
    return topics.priority(_relevant(s, d), needs).select("topic", "priority", "priority_label")


@query("SELECT topic, last AS last_practiced FROM st LEFT JOIN an USING (topic)", SEASONED)
def a11_last_practiced(s, d):
    return _relevant(s, d).select("topic", "last_practiced")


@query("SELECT topic, arg_min(season, substr(season, 1, 4) || CASE WHEN contains(season, 'sommer') THEN 0 ELSE 1 END) AS first_season, arg_max(season, substr(season, 1, 4) || CASE WHEN contains(season, 'sommer') THEN 0 ELSE 1 END) AS last_season FROM membership JOIN q USING (question_id) GROUP BY topic", SEASONED)
def w15_first_last_season(s, d):
    return _relevant(s, d).select("topic", "first_season", "last_season")


@query("SELECT topic, relevance, row_number() OVER (ORDER BY relevance DESC, topic)::INT AS place FROM rel", SEASONED)
def o13_memory_topics(s, d):
    from pyspark.sql import Window as W

    return _relevant(s, d).select("topic", "relevance", F.row_number().over(W.orderBy(F.desc("relevance"), "topic")).alias("place"))


@query("SELECT question_id, correctness FROM (SELECT * FROM formal WHERE question_id IN (SELECT question_id FROM inventory WHERE exam = 2))", SQL)
def j01_results_of_inventory(s, d):
    every = results.formal(attempts(s, d))
    return results.bounded(every, inventory(s, d).where("exam = 2"), "2024-01-31 00:00:00").select("question_id", "correctness")


@query("SELECT question_id, arg_max(module, attempt_id) AS module, max(attempt_id) AS n FROM attempts JOIN inventory USING (question_id) GROUP BY question_id", SQL)
def a03_distinct_questions(s, d):
    x = attempts(s, d).join(inventory(s, d).select("question_id", "module"), "question_id").select("question_id", "module", F.col("attempt_id").alias("n"))
    return results.last_wins(x, ["question_id"], "n")


@query("SELECT session_id, started_at, row_number() OVER (ORDER BY started_at DESC, session_id)::INT AS place FROM sessions", SESSIONS)
def o06_history_order(s, d):
    from pyspark.sql import Window as W

    return all_sessions(s, d).select("session_id", "started_at", F.row_number().over(W.orderBy(F.desc("started_at"), "session_id")).alias("place"))


@query(
    """WITH q AS (SELECT l_orderkey AS id, l_partkey, l_suppkey, l_linenumber, l_extendedprice, CASE WHEN l_suppkey % 3 = 0 THEN 'U' || l_partkey % 20 ELSE (l_partkey % 30)::VARCHAR END AS number FROM lineitem)
SELECT number, row_number() OVER (ORDER BY CASE WHEN number LIKE 'U%' THEN 1 ELSE 0 END, replace(number, 'U', '')::INT)::INT AS place FROM (SELECT DISTINCT number FROM q)"""
)
def o14_question_order(s, d):
    from pyspark.sql import Window as W

    p = F.col("l_partkey")
    q = table(s, d, "lineitem").select(F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("U"), (p % 20).cast("string"))).otherwise((p % 30).cast("string")).alias("number")).distinct()
    return q.select("number", F.row_number().over(W.orderBy(*progress.natural_order(F.col("number")))).alias("place"))


@query("SELECT DISTINCT o_custkey AS alias FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_custkey) WHERE n > 1")
def s17_alias_index(s, d):
    return progress.alias_conflicts(table(s, d, "orders").select(F.col("o_custkey").alias("alias"), F.col("o_orderstatus").alias("sha"))).select("alias")


@query("SELECT o_orderkey, substr(sha256('note|' || o_orderkey), 1, 24) AS key FROM orders")
def t48_scalar_keys(s, d):
    return table(s, d, "orders").select("o_orderkey", registry.short_id(F.lit("note"), F.col("o_orderkey").cast("string")).alias("key"))


@query("SELECT document, page, number, text FROM (SELECT o_custkey AS document, o_orderkey AS page, l_linenumber AS number, l_returnflag AS text FROM orders JOIN lineitem ON l_orderkey = o_orderkey)")
def s15_flattened_documents(s, d):
    li = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("text"))).alias("proposals"))
    pages = table(s, d, "orders").join(li, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("document")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("page"), "proposals")).alias("pages"))
    return lookups.examined(pages)


@query("SELECT o_custkey AS document, count(*) AS questions FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def a37_questions_per_document(s, d):
    return s15_flattened_documents(s, d).groupBy("document").agg(F.count("*").alias("questions"))


@query("SELECT count(*) AS pages, count(*) FILTER (n_chars < 200) AS image_only, count(DISTINCT source) AS sources, count(*) FILTER (lang IS NULL OR n_chars < 50) AS review_items FROM documents")
def a33_ingestion_totals(s, d):
    x = table(s, d, "documents")
    return x.agg(F.count("*").alias("pages"), F.count_if(F.col("n_chars") < 200).alias("image_only"), F.count_distinct("source").alias("sources"), F.count_if(F.col("lang").isNull() | (F.col("n_chars") < 50)).alias("review_items"))


@query("SELECT l_orderkey AS image, round(avg(l_discount), 3) AS confidence FROM lineitem WHERE l_discount > 0 GROUP BY l_orderkey")
def a31_mean_confidence(s, d):
    return table(s, d, "lineitem").where("l_discount > 0").groupBy(F.col("l_orderkey").alias("image")).agg(F.round(F.avg("l_discount"), 3).alias("confidence"))


@query(
    """WITH m AS (SELECT l_orderkey AS item, l_suppkey % 3 AS threshold, l_linenumber AS row, l_discount AS ring FROM lineitem),
p AS (SELECT item, threshold, count(*) FILTER (ring >= 0.08) AS strong, count(*) FILTER (ring >= 0.05) AS possible, max(ring) AS top, arg_max(row, (ring, row)) AS row, list_reverse_sort(list(ring)) AS a, count(*) AS rows FROM m GROUP BY ALL),
x AS (SELECT item, bool_and(strong = 1 AND possible = 1) AS u, bool_and(strong <> 1 OR top - coalesce(a[2], 0) >= 0.01) AS c, bool_and(rows = 5) AS f, count(DISTINCT CASE WHEN strong = 1 THEN row END) AS answers, count(*) FILTER (strong = 1) AS decided, max(row) AS answer FROM p GROUP BY item),
y AS (SELECT *, concat_ws(',', CASE WHEN NOT f THEN 'five_dot_positions_not_clear' END, CASE WHEN NOT c THEN 'insufficient_margin' END, CASE WHEN NOT u THEN 'no_unique_circle' END, CASE WHEN answers <> 1 OR decided <> 3 THEN 'threshold_disagreement' END) AS reasons FROM x)
SELECT item, CASE WHEN reasons = '' THEN answer END AS answer, reasons FROM y"""
)
def a35_mark_decisions(s, d):
    m = table(s, d, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_suppkey") % 3).alias("threshold"), F.col("l_linenumber").alias("row"), F.col("l_discount").alias("ring"))
    return lookups.unclear_marks(m, (0.08, 0.05), 0.01, 3).withColumn("reasons", F.array_join("reasons", ","))


@query(
    """SELECT o_custkey AS module, l_linenumber AS number, o_orderkey * 10 + l_linenumber AS question_id, CASE WHEN o_custkey % 3 > 0 THEN 'sha' || o_custkey END AS source_sha FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""
)
def s34_inventory(s, d):
    x = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.groupBy(F.col("o_custkey").alias("module")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("question_id"), F.col("l_returnflag").alias("text"))).alias("questions"))
    known = x.where("module % 3 > 0").select("module", F.concat(F.lit("sha"), F.col("module").cast("string")).alias("source_sha"))
    return lookups.inventory(x, known)[0].where(F.length("revision") == 64).select("module", "number", "question_id", "source_sha")


@query("SELECT question_id FROM (SELECT o_orderkey * 10 + l_linenumber AS question_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY question_id HAVING count(*) > 1")
def s34_repeated_ids(s, d):
    x = table(s, d, "lineitem").groupBy((F.col("l_orderkey") % 7).alias("module")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("question_id"), F.col("l_returnflag").alias("text"))).alias("questions"))
    return lookups.inventory(x, x.select("module", F.lit("s").alias("source_sha")))[1].select("question_id")
