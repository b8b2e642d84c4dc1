"""The library's operators over whole tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemos.adapters import NOW, SQL, attempts, inventory, table
from mnemos.functions import text as fn
from mnemos.operators import bank, geometry, progress, registry, replay, results, review, sessions, topics, validators
from mnemos.plans import base
from mnemos.plans.base import ORACLE
from mnemos.sources import tables
from mnemos.streaming import replication



def query(sql: str | None = None, prelude: str = SQL):
    """Behind the adapters' common table expressions, unless told otherwise."""
    return base.query(sql, prelude)


def _formal(s, d) -> DataFrame:
    return results.bounded(results.formal(attempts(s, d)), inventory(s, d), NOW)


def _latest(s, d) -> DataFrame:
    return results.last_wins(_formal(s, d), ["user_id", "question_id"], "ts", "attempt_id")


@query("SELECT attempt_id, user_id, question_id, ts, correctness FROM formal")
def f04_formal_results(s, d):
    return _formal(s, d).select("attempt_id", "user_id", "question_id", "ts", "correctness")


@query("SELECT attempt_id, user_id, question_id, ts, correctness FROM latest")
def a02_latest_results(s, d):
    return _latest(s, d).select("attempt_id", "user_id", "question_id", "ts", "correctness")


@query(
    """, q AS (SELECT module, count(*) AS total FROM inventory GROUP BY module)
SELECT u.user_id, module, count(correctness) AS answered, count(*) FILTER (correctness = 'richtig') AS correct, count(*) FILTER (correctness = 'teilweise') AS partial,
 round(100.0::DOUBLE * count(*) FILTER (correctness = 'richtig') / nullif(count(correctness), 0), 6) AS accuracy, any_value(total) AS total, round(100.0::DOUBLE * count(correctness) / any_value(total), 6) AS coverage
FROM (SELECT DISTINCT user_id FROM latest) u CROSS JOIN inventory i JOIN q USING (module) LEFT JOIN latest l ON l.user_id = u.user_id AND l.question_id = i.question_id GROUP BY u.user_id, module"""
)
def a05_module_progress(s, d):
    return results.by_module(_latest(s, d), inventory(s, d))


@query("SELECT user_id, count(*) AS answered, (SELECT count(*) FROM inventory) - count(*) AS open, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM inventory), 6) AS coverage FROM latest GROUP BY user_id")
def a04_coverage(s, d):
    return results.coverage(_latest(s, d), inventory(s, d))


@query(
    """SELECT user_id, count(correctness) AS answered, count(*) FILTER (correctness = 'richtig') AS correct, count(*) FILTER (correctness = 'teilweise') AS partial,
 round(100.0::DOUBLE * count(*) FILTER (correctness = 'richtig') / nullif(count(correctness), 0), 6) AS accuracy FROM latest GROUP BY user_id"""
)
def a01_summary(s, d):
    return _latest(s, d).groupBy("user_id").agg(*results.measures(F.col("correctness")))


@query(
    """, f AS (SELECT user_id, question_id, min(ts) AS first FROM formal GROUP BY ALL)
SELECT user_id, count(*) FILTER (first >= TIMESTAMP '2024-01-24') AS new_questions, count(*) AS seen FROM f GROUP BY user_id"""
)
def a07_first_seen(s, d):
    return results.first_seen(_formal(s, d), "2024-01-24")


@query(
    """, w AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-24' THEN 'this' WHEN ts >= TIMESTAMP '2024-01-17' THEN 'previous' END AS w FROM formal),
l AS (SELECT * FROM w WHERE w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, question_id, w ORDER BY ts DESC, attempt_id DESC) = 1),
g AS (SELECT user_id, count(*) FILTER (w = 'this') AS ta, count(*) FILTER (w = 'previous') AS pa, count(*) FILTER (w = 'this' AND correctness = 'richtig') AS tc, count(*) FILTER (w = 'previous' AND correctness = 'richtig') AS pc FROM l GROUP BY user_id)
SELECT user_id, ta AS this_answered, pa AS previous_answered, round(100.0::DOUBLE * tc / nullif(ta, 0), 6) AS this_accuracy, round(100.0::DOUBLE * pc / nullif(pa, 0), 6) AS previous_accuracy,
 CASE WHEN ta >= 5 AND pa >= 5 THEN round(100.0::DOUBLE * tc / ta - 100.0::DOUBLE * pc / pa, 6) END AS change FROM g"""
)
def w01_weeks(s, d):
    return results.weeks(_formal(s, d), NOW)


@query(
    """, days AS (SELECT DISTINCT user_id, ts::DATE AS day FROM formal WHERE ts::DATE <= DATE '2024-01-31'),
i AS (SELECT *, day + row_number() OVER (PARTITION BY user_id ORDER BY day DESC)::INT AS island, max(day) OVER (PARTITION BY user_id) AS newest FROM days)
SELECT user_id, count(*) FILTER (island = newest + 1 AND newest >= DATE '2024-01-30') AS streak, count(*) FILTER (day >= DATE '2024-01-29') AS week_days, count(*) AS active_days FROM i GROUP BY user_id"""
)
def w03_streaks(s, d):
    return results.streaks(_formal(s, d), NOW)


@query(
    """, a AS (SELECT user_id, count(*)::INT AS answered FROM latest GROUP BY user_id), n AS (SELECT count(*)::INT AS n FROM inventory)
SELECT user_id, answered, (SELECT min(m) FROM (SELECT unnest([10, 25, 50, 75, 100]) AS m UNION SELECT n FROM n) t WHERE m <= n.n AND m > answered)::INT AS next_milestone FROM a, n"""
)
def a38_milestones(s, d):
    return results.milestones(_latest(s, d), inventory(s, d).count())


@query(
    """, q AS (SELECT module, count(*) AS total FROM inventory GROUP BY module), u AS (SELECT DISTINCT user_id FROM latest),
o AS (SELECT user_id, module, count(*) AS n FROM latest JOIN inventory USING (question_id) GROUP BY ALL),
g AS (SELECT u.user_id, q.module, round(100.0::DOUBLE * coalesce(n, 0) / total, 6) AS coverage FROM u CROSS JOIN q LEFT JOIN o ON o.user_id = u.user_id AND o.module = q.module)
SELECT user_id, module, coverage FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY coverage, module) = 1"""
)
def o02_lowest_module(s, d):
    return results.lowest_module(_latest(s, d), inventory(s, d))


#: The replay over ten questions, so that every stage occurs: wrong results before the last look are dismissed, those before the tenth are a legacy.
REPLAY = (
    SQL
    + """, marks AS (SELECT user_id, max(ts) AS until FROM attempts WHERE viewed GROUP BY user_id),
r AS (SELECT f.user_id, f.question_id % 10 AS question_id, f.attempt_id, f.ts, f.correctness, f.ts < TIMESTAMP '2024-01-10' AS legacy, f.correctness = 'richtig' AS ok,
  coalesce(f.correctness <> 'richtig' AND f.ts < m.until - INTERVAL 3 DAY, FALSE) AS dismissed FROM formal f LEFT JOIN marks m USING (user_id)),
o AS (SELECT *, NOT ok AND NOT dismissed AS back, row_number() OVER (PARTITION BY user_id, question_id ORDER BY legacy DESC, ts, attempt_id) AS n FROM r),
b AS (SELECT *, max(CASE WHEN back THEN n END) OVER w AS lastb FROM o WINDOW w AS (PARTITION BY user_id, question_id ORDER BY n)),
lv AS (SELECT user_id, question_id, lastb, min(ts) FILTER (n = lastb) AS since, least(least(1 + count(*) FILTER (ok AND legacy), 3) + count(*) FILTER (ok AND NOT legacy), 4) AS level FROM b WHERE lastb IS NOT NULL GROUP BY ALL),
ent AS (SELECT *, lag(level) OVER (PARTITION BY user_id, question_id ORDER BY lastb) AS prev FROM lv),
st AS (SELECT user_id, question_id, arg_max(level, lastb)::INT AS stage, arg_max(since, lastb) FILTER (prev IS NULL OR prev = 4) AS entered_at FROM ent GROUP BY ALL),
wr AS (SELECT user_id, question_id, max(ts) FILTER (NOT ok) AS last_wrong_at, count(*) FILTER (NOT ok) AS wrong_count, max(n) FILTER (NOT ok) AS lastw FROM o GROUP BY ALL HAVING count(*) FILTER (NOT ok) > 0),
stages AS (SELECT wr.user_id, wr.question_id, stage, entered_at, last_wrong_at, wrong_count, (SELECT count(*) FROM o WHERE o.user_id = wr.user_id AND o.question_id = wr.question_id AND o.ok AND o.n > wr.lastw) AS streak
  FROM wr LEFT JOIN st ON st.user_id = wr.user_id AND st.question_id = wr.question_id)
"""
)


def _stages(s, d) -> DataFrame:
    marks = attempts(s, d).where("viewed").groupBy("user_id").agg((F.max("ts") - F.expr("interval 3 days")).alias("until"))
    ten = _formal(s, d).withColumn("question_id", F.col("question_id") % 10)
    return replay.replay(replay.dismissed(ten, marks), "2024-01-10")


@query("SELECT * FROM stages", REPLAY)
def a20_replay(s, d):
    return _stages(s, d)


@query("SELECT user_id, count(*) FILTER (stage = 1) AS stage_1, count(*) FILTER (stage = 2) AS stage_2, count(*) FILTER (stage = 3) AS stage_3, count(*) FILTER (stage = 4) AS stage_mastered FROM stages GROUP BY user_id", REPLAY)
def a06_stage_counts(s, d):
    return replay.stage_counts(_stages(s, d))


UNSURE = ", looked AS (SELECT user_id, question_id % 10 AS question_id, arg_max(viewed, (ts, attempt_id)) AS v FROM attempts GROUP BY ALL), doubts AS (SELECT l.user_id, l.question_id FROM looked l ANTI JOIN (SELECT * FROM stages WHERE stage < 4) s ON s.user_id = l.user_id AND s.question_id = l.question_id WHERE v) "


def _unsure(s, d) -> DataFrame:
    return replay.unsure(attempts(s, d).withColumn("question_id", F.col("question_id") % 10), _stages(s, d))


@query("SELECT * FROM doubts", REPLAY + UNSURE)
def j07_unsure_questions(s, d):
    return _unsure(s, d)


@query(
    """, q AS (SELECT module, count(*) AS total FROM inventory GROUP BY module), u AS (SELECT DISTINCT user_id FROM latest),
o2 AS (SELECT user_id, module, count(*) AS n FROM latest JOIN inventory USING (question_id) GROUP BY ALL),
g AS (SELECT u.user_id, q.module, round(100.0::DOUBLE * coalesce(n, 0) / total, 6) AS coverage FROM u CROSS JOIN q LEFT JOIN o2 ON o2.user_id = u.user_id AND o2.module = q.module),
low AS (SELECT user_id, module FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY coverage, module) = 1),
c AS (SELECT user_id, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM inventory) AS coverage FROM latest GROUP BY user_id)
SELECT c.user_id, CASE WHEN EXISTS (SELECT 1 FROM stages s WHERE s.user_id = c.user_id AND stage = 1) THEN 'wrong' WHEN EXISTS (SELECT 1 FROM doubts x WHERE x.user_id = c.user_id) THEN 'unsure'
 WHEN coverage >= 60 THEN 'test' ELSE 'module ' || module END AS action FROM c JOIN low ON low.user_id = c.user_id""",
    REPLAY + UNSURE,
)
def o03_next_action(s, d):
    latest, inv = _latest(s, d), inventory(s, d)
    return results.next_action(_stages(s, d).where("stage = 1"), _unsure(s, d), results.coverage(latest, inv), results.lowest_module(latest, inv))


# --- the bank: topics are k % 12 under parents k % 4 -------------------------------------------------------------

BANK = (
    SQL
    + """, nodes AS (SELECT DISTINCT question_id % 12 + 100 AS id, question_id % 4 AS parent_id FROM inventory UNION SELECT DISTINCT question_id % 4, NULL FROM inventory),
classified AS (SELECT question_id, CASE WHEN question_id % 7 = 0 THEN []::INT[] WHEN question_id % 5 = 0 THEN [question_id % 4] ELSE [question_id % 12 + 100, (question_id * 7) % 12 + 100] END AS topic_ids,
  (question_id % 10) / 10.0::DOUBLE AS confidence, CASE WHEN question_id % 9 = 0 THEN ['legal_change'] ELSE []::VARCHAR[] END AS reasons, question_id % 6 = 0 AS locked, question_id % 4 AS revision FROM inventory),
closure AS (SELECT id AS topic, id AS member FROM nodes UNION SELECT parent_id, id FROM nodes WHERE parent_id IS NOT NULL),
tagged AS (SELECT DISTINCT question_id, unnest(topic_ids) AS member FROM classified),
membership AS (SELECT DISTINCT topic, question_id FROM tagged JOIN closure USING (member))
"""
)


def _nodes(s, d) -> DataFrame:
    q = inventory(s, d)
    child = q.select((F.col("question_id") % 12 + 100).alias("id"), (F.col("question_id") % 4).alias("parent_id")).distinct()
    return child.unionByName(q.select((F.col("question_id") % 4).alias("id"), F.lit(None).cast("int").alias("parent_id")).distinct())


def _classified(s, d) -> DataFrame:
    k = F.col("question_id")
    topics_ = F.when(k % 7 == 0, F.array().cast("array<int>")).when(k % 5 == 0, F.array(k % 4)).otherwise(F.array(k % 12 + 100, (k * 7) % 12 + 100))
    reasons = F.when(k % 9 == 0, F.array(F.lit("legal_change"))).otherwise(F.array().cast("array<string>"))
    return inventory(s, d).select("question_id", topics_.alias("topic_ids"), ((k % 10) / F.lit(10.0)).alias("confidence"), reasons.alias("reasons"), (k % 6 == 0).alias("locked"), (k % 4).alias("revision"))


@query("SELECT question_id, module, exam, kind FROM inventory SEMI JOIN (SELECT question_id FROM membership WHERE topic IN (1, 104)) m USING (question_id) WHERE exam IN (1, 2, 3) AND kind = 'multiple_choice'", BANK)
def f07_faceted_filter(s, d):
    return bank.select(inventory(s, d), _classified(s, d), _nodes(s, d), exams=[1, 2, 3], kinds=["multiple_choice"], topics=[1, 104])


@query(
    """, n AS (SELECT question_id, CASE WHEN question_id % 8 = 1 THEN 9 ELSE question_id % 4 END AS r FROM inventory WHERE question_id % 11 <> 0),
p AS (SELECT * FROM classified WHERE question_id % 13 <> 0)
SELECT coalesce(n.question_id, p.question_id) AS question_id,
 CASE WHEN p.question_id IS NULL THEN 'new' WHEN n.question_id IS NULL THEN 'removed' WHEN r <> revision AND locked THEN 'locked_changed' WHEN r <> revision THEN 'changed' ELSE 'same' END AS status,
 CASE WHEN p.question_id IS NULL OR (r <> revision AND NOT locked) THEN '' ELSE array_to_string(topic_ids, ',') END AS topics,
 CASE WHEN p.question_id IS NULL THEN 'new_question' WHEN r <> revision AND locked THEN 'source_changed' ELSE '' END AS reasons,
 n.question_id IS NOT NULL AS active, coalesce(locked, FALSE) AS locked, coalesce(r, revision) AS revision
FROM n FULL JOIN p ON n.question_id = p.question_id""",
    BANK,
)
def j02_reconcile(s, d):
    new = inventory(s, d).where("question_id % 11 <> 0").select("question_id", F.when(F.col("question_id") % 8 == 1, 9).otherwise(F.col("question_id") % 4).alias("revision"))
    previous = _classified(s, d).where("question_id % 13 <> 0").select("question_id", "revision", "topic_ids", "locked", F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    out = bank.reconcile(new, previous, NOW)
    return out.select("question_id", "status", F.array_join(F.col("topic_ids").cast("array<string>"), ",").alias("topics"), F.array_join("reasons", ",").alias("reasons"), "active", "locked", "revision")


@query("SELECT c.question_id, CASE WHEN c.question_id % 5 = 1 THEN 1.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN c.question_id % 5 = 1 THEN TRUE ELSE locked END AS locked FROM classified c", BANK)
def j04_override(s, d):
    base = _classified(s, d).select("question_id", "confidence", "locked")
    return bank.override(base, base.where("question_id % 5 = 1").select("question_id", F.lit(1.0).alias("confidence"), F.lit(True).alias("locked")))


@query("SELECT question_id FROM classified WHERE question_id % 17 = 3", BANK)
def j05_edit_conflicts(s, d):
    now = _classified(s, d).select("question_id", "confidence")
    return bank.edit_conflicts(now, now.withColumn("confidence", F.when(F.col("question_id") % 17 == 3, -1.0).otherwise(F.col("confidence"))))


@query(
    """SELECT exam, module, count(*) AS questions, count(*) FILTER (len(topic_ids) > 0) AS classified, count(*) FILTER (len(topic_ids) = 0) AS unclassified, count(*) FILTER (locked) AS locked,
 count(*) FILTER (confidence < 0.8 OR len(reasons) > 0) AS review FROM inventory JOIN classified USING (question_id) GROUP BY exam, module""",
    BANK,
)
def a13_classification_counts(s, d):
    return bank.classification_counts(inventory(s, d), _classified(s, d), "exam", "module")


@query("SELECT count(*) AS questions, count(*) FILTER (len(topic_ids) > 0) AS classified, count(*) FILTER (len(topic_ids) = 0) AS unclassified, count(*) FILTER (locked) AS locked, count(*) FILTER (confidence < 0.8 OR len(reasons) > 0) AS review FROM inventory JOIN classified USING (question_id)", BANK)
def a12_classification_totals(s, d):
    return bank.classification_counts(inventory(s, d), _classified(s, d))


@query(", c AS (SELECT topic, count(*) AS questions FROM membership GROUP BY topic) SELECT topic, questions, (SELECT max(questions) FROM c) AS most FROM c", BANK)
def a18_facet_counts(s, d):
    return bank.facets(inventory(s, d), _classified(s, d), _nodes(s, d))


@query(
    """SELECT t.member AS topic, count(DISTINCT t.question_id) AS questions FROM tagged t JOIN nodes n ON n.id = t.member AND n.parent_id IS NULL
WHERE NOT EXISTS (SELECT 1 FROM tagged u JOIN nodes m ON m.id = u.member WHERE u.question_id = t.question_id AND m.parent_id = t.member) GROUP BY ALL""",
    BANK,
)
def u08_parent_only(s, d):
    return bank.parent_only(_classified(s, d), _nodes(s, d))


@query(
    """, a AS (SELECT question_id, question_id % 4 AS r FROM inventory WHERE question_id % 5 <> 0), b AS (SELECT question_id, question_id % 3 AS r FROM inventory WHERE question_id % 7 <> 0)
SELECT question_id, CASE WHEN b.r IS NULL THEN 'added' WHEN a.r IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (question_id) WHERE a.r IS DISTINCT FROM b.r"""
)
def u10_pool_changes(s, d):
    q = inventory(s, d)
    return bank.pool_changes(q.where("question_id % 5 <> 0").select("question_id", (F.col("question_id") % 4).alias("revision")), q.where("question_id % 7 <> 0").select("question_id", (F.col("question_id") % 3).alias("revision")))


@query("""SELECT user_id, '{"modules":[' || array_to_string(list_sort(list_distinct(list(question_id % 3))), ',') || '],"exams":[' || array_to_string(list_sort(list_distinct(list(question_id % 5))), ',') || ']}' AS definition FROM attempts GROUP BY user_id""")
def u03_canonical_definition(s, d):
    a = attempts(s, d).groupBy("user_id").agg(F.collect_set(F.col("question_id") % 3).alias("modules"), F.collect_set(F.col("question_id") % 5).alias("exams"))
    return a.select("user_id", bank.canonical("modules", "exams").alias("definition"))


# --- topics -----------------------------------------------------------------------------------------------------

SEASONS = (
    BANK
    + """, seasons AS (SELECT question_id, kind, (2018 + question_id % 5)::VARCHAR || CASE WHEN question_id % 2 = 0 THEN '-sommer' ELSE '-winter' END AS season FROM inventory),
newest AS (SELECT DISTINCT season FROM seasons QUALIFY dense_rank() OVER (ORDER BY season[1:4]::INT DESC, CASE WHEN contains(season, 'sommer') THEN 0 ELSE 1 END DESC) <= 3),
sz AS (SELECT topic, count(*) AS questions, count(DISTINCT season) AS seasons, count(DISTINCT season) FILTER (season IN (FROM newest)) AS recent_seasons, count(*) FILTER (kind = 'multi_part') AS multi_part,
  arg_min(season, season[1:4]::INT * 2 + CASE WHEN contains(season, 'sommer') THEN 0 ELSE 1 END) AS first_season, arg_max(season, season[1:4]::INT * 2 + CASE WHEN contains(season, 'sommer') THEN 0 ELSE 1 END) AS last_season FROM membership JOIN seasons USING (question_id) GROUP BY topic),
an AS (SELECT topic, count(DISTINCT question_id) AS aq, count(*) AS answers, count(*) FILTER (correctness = 'richtig') AS correct, max(ts) AS last_practiced FROM membership JOIN latest USING (question_id) GROUP BY topic),
stats AS (SELECT sz.*, coalesce(aq, 0) AS answered_questions, coalesce(answers, 0) AS answers, coalesce(correct, 0) AS correct, last_practiced, CASE WHEN aq >= 3 THEN round(100.0::DOUBLE * correct / answers, 6) END AS accuracy,
  round(0.4::DOUBLE * questions / (SELECT count(*) FROM inventory) + 0.4::DOUBLE * seasons / 10 + 0.2::DOUBLE * recent_seasons / 3, 6) AS relevance FROM sz LEFT JOIN an USING (topic)),
labelled AS (SELECT *, CASE WHEN relevance >= 0.7 THEN 'very_high' WHEN relevance >= 0.5 THEN 'high' WHEN relevance >= 0.25 THEN 'medium' ELSE 'low' END AS relevance_label FROM stats),
candidates AS (SELECT DISTINCT topic FROM membership m WHERE NOT EXISTS (SELECT 1 FROM membership c JOIN nodes n ON n.id = c.topic WHERE n.parent_id = m.topic AND c.question_id = m.question_id))
"""
)


def _stats(s, d) -> DataFrame:
    q = inventory(s, d)
    q = q.withColumn("season", F.concat((F.col("question_id") % 5 + 2018).cast("string"), F.when(F.col("question_id") % 2 == 0, "-sommer").otherwise("-winter")))
    out = topics.statistics(topics.members(_classified(s, d), _nodes(s, d)), q, _latest(s, d), topics.recent(q, 3))
    return topics.relevance(out, q.count(), 10, 3)


def _candidates(s, d) -> DataFrame:
    return topics.candidates(topics.members(_classified(s, d), _nodes(s, d)), _nodes(s, d))


@query("SELECT * FROM membership", BANK)
def j12_topic_membership(s, d):
    return topics.members(_classified(s, d), _nodes(s, d))


@query("SELECT * FROM labelled", SEASONS)
def a08_topic_statistics(s, d):
    return _stats(s, d)


@query("SELECT topic, relevance, questions FROM labelled SEMI JOIN candidates USING (topic) ORDER BY relevance DESC, questions DESC, topic LIMIT 8", SEASONS)
def o09_frequent_topics(s, d):
    return topics.frequent(_stats(s, d).join(_candidates(s, d), "topic", "left_semi")).select("topic", "relevance", "questions")


@query(
    """, need AS (SELECT topic, count(DISTINCT question_id) AS needed FROM membership JOIN latest USING (question_id) WHERE correctness = 'falsch' GROUP BY topic),
p AS (SELECT l.topic, last_practiced, round(relevance + 2 * coalesce(needed, 0)::DOUBLE / questions + CASE WHEN accuracy < 60 THEN 1 - accuracy / 100 ELSE 0 END + CASE WHEN answers = 0 THEN 0.25 ELSE 0 END, 6) AS priority FROM labelled l SEMI JOIN candidates c ON c.topic = l.topic LEFT JOIN need USING (topic))
SELECT topic, priority, CASE WHEN priority >= 0.9 THEN 'now' WHEN priority >= 0.5 THEN 'soon' ELSE 'later' END AS priority_label, row_number() OVER (ORDER BY priority DESC, coalesce(last_practiced, TIMESTAMP '1970-01-01'), topic) AS rank FROM p""",
    SEASONS,
)
def o10_ranked_topics(s, d):
    needs = topics.members(_classified(s, d), _nodes(s, d)).join(_latest(s, d).where("correctness = 'falsch'"), "question_id").groupBy("topic").agg(F.count_distinct("question_id").alias("needed"))
    return topics.ranked(topics.priority(_stats(s, d).join(_candidates(s, d), "topic", "left_semi"), needs)).select("topic", "priority", "priority_label", "rank")


CUES = {"contract": r"of the [aeiou]", "law": r"uber|fur [bdf]", "tax": r"que .{0,3}est", "pay": r"les [aeiou]", "rent": r"\$\$\$"}
TEXTS = (
    """WITH st AS (SELECT doc_id, source, lang, text, replace(replace(replace(regexp_replace(strip_accents(replace(lower(substr(split_part(text, '?', 1), 1, 700)), 'ß', 'ss')), '[^\x00-\x7F]', '', 'g'), '-' || chr(10), ''), chr(10), ''), ' ', '') AS stem FROM documents),
hits AS (SELECT doc_id, source, list_filter(["""
    + ", ".join(f"CASE WHEN regexp_matches(stem, '{p.replace(" ", "")}') THEN '{t}' END" for t, p in CUES.items())
    + """], lambda x: x IS NOT NULL) AS topics, text FROM st)
"""
)


def _hits(s, d) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "source", "text")
    return topics.cue_hits(docs, CUES)


@query("SELECT doc_id, array_to_string(topics, ',') AS topics, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 60 AND len(regexp_extract_all(text, '[A-Za-zÄÖÜäöüß]{3,}')) >= 4 AND len(regexp_extract_all(text, '[A-Za-zÄÖÜäöüß]')) >= 45 AND len(regexp_extract_all(text, chr(65533))) < 3 AS usable FROM hits", TEXTS)
def c05_text_topics(s, d):
    return _hits(s, d).select("doc_id", F.array_join("topics", ",").alias("topics"), topics.usable(F.col("text")).alias("usable"))


@query(
    """SELECT topic, count(DISTINCT source) AS seasons, count(*) AS questions FROM (SELECT source, unnest(topics) AS topic FROM hits WHERE doc_id % 3 > 0 AND doc_id % 5 <> 1 AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 60 AND len(regexp_extract_all(text, '[A-Za-zÄÖÜäöüß]{3,}')) >= 4
  AND len(regexp_extract_all(text, '[A-Za-zÄÖÜäöüß]')) >= 45 AND len(regexp_extract_all(text, chr(65533))) < 3) GROUP BY topic HAVING count(DISTINCT source) >= 3""",
    TEXTS,
)
def a27_topic_proposals(s, d):
    """Of unclassified and certain texts."""
    k = F.col("doc_id")
    return topics.proposals(_hits(s, d).withColumns({"classified": k % 3 == 0, "confidence": F.when(k % 5 == 1, 0.8).otherwise(0.85)}), "source")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'locked' WHEN doc_id % 5 = 0 OR score IS NULL OR score < 0.8 THEN 'classification_needs_review' WHEN score < 0.95 THEN 'machine_suggested' ELSE 'machine_accepted_high_confidence' END AS status
FROM (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN (n_chars % 100) / 100::DOUBLE END AS score FROM documents)""",
    "",
)
def c08_policy(s, d):
    """Scores of every hundredth and null, locked rows, rows without topics."""
    k = F.col("doc_id")
    score = F.when(k % 7 > 0, F.col("n_chars") % 100 / F.lit(100.0))
    topic = F.when(k % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return table(s, d, "documents").select("doc_id", topics.policy(score, topic, F.when(k % 9 == 0, True)).alias("status"))


# --- sessions: conversations as sessions, events as their actions -----------------------------------------------

ITEMS = """WITH items AS (SELECT conv_id AS session_id, turn AS question_id, length(text) % 7 <> 0 AS answered, CASE length(text) % 7 WHEN 1 THEN 'richtig' WHEN 2 THEN 'richtig' WHEN 3 THEN 'falsch' WHEN 4 THEN 'teilweise' END AS correctness FROM conversations)
"""


def _items(s, d) -> DataFrame:
    n = F.length("text") % 7
    grade = F.when(n.isin(1, 2), "richtig").when(n == 3, "falsch").when(n == 4, "teilweise")
    return table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("question_id"), F.coalesce(n != 0, F.lit(False)).alias("answered"), grade.alias("correctness"))


@query(
    """SELECT session_id, count(*) AS total, count(*) FILTER (answered) AS answered, count(*) FILTER (correctness = 'richtig') AS correct, count(*) FILTER (correctness = 'falsch') AS wrong, count(*) FILTER (correctness = 'teilweise') AS partial,
 count(*) FILTER (NOT answered) AS unanswered, count(*) FILTER (answered AND correctness IS NULL) AS pending FROM items GROUP BY session_id""",
    ITEMS,
)
def a14_session_score(s, d):
    return sessions.score(_items(s, d))


@query("SELECT session_id, CASE WHEN count(*) FILTER (correctness IS NULL) > 0 THEN NULL WHEN bool_and(correctness = 'richtig') THEN 'richtig' WHEN bool_and(correctness = 'falsch') THEN 'falsch' ELSE 'teilweise' END AS assessment FROM items GROUP BY session_id", ITEMS)
def a15_combined_assessment(s, d):
    parts = F.collect_list(F.struct(F.coalesce("correctness", F.lit("")).alias("c")))
    x = _items(s, d).groupBy("session_id").agg(parts.alias("p"))
    return x.select("session_id", sessions.combined(F.transform("p", lambda a: F.nullif(a["c"], F.lit("")))).alias("assessment"))


def _actions(events: DataFrame) -> DataFrame:
    """Each event as one of nine actions on a question of its user's session, with values that fit and others."""
    e, k, kind = F.col("event_id"), F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    action = F.when(e % 13 == 0, "restore").when(e % 11 == 0, "discard").when(kind == "view", F.when(k % 3 == 0, "pause").otherwise("move")).when(kind == "click", "answer").when(kind == "signup", F.when(k % 4 == 0, "submit").otherwise("resume")).when(kind == "error", F.when(k % 6 == 0, "abandon").otherwise("resume")).otherwise("assess")
    part = F.when(k % 7 == 0, "9").otherwise((k % 2 + 1).cast("string"))
    text = F.when(k % 2 == 0, F.concat(F.lit('{"choice":"'), (k % 7).cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('{"'), part, F.lit('":"'), F.when(k % 5 == 0, " ").otherwise("text"), F.lit('"}')))
    grade = F.concat(F.lit('{"'), part, F.lit('":"'), F.when(k % 9 == 0, "gut").when(k % 3 == 0, "richtig").otherwise("falsch"), F.lit('"}'))
    return events.select(F.col("user_id").alias("session_id"), e.alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("at"), action.alias("action"), (k % 12).cast("long").alias("question_id"), F.when(action == "answer", text).when(action == "assess", grade).alias("value"))


def _models(events: DataFrame) -> DataFrame:
    """Ten questions of each session: even ones have a choice, odd ones two parts."""
    q = events.select(F.col("user_id").alias("session_id")).distinct().withColumn("question_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    even = F.col("question_id") % 2 == 0
    return q.select("session_id", "question_id", F.when(even, "multiple_choice").otherwise("multi_part").alias("kind"), F.when(even, F.array().cast("array<string>")).otherwise(F.array(F.lit("1"), F.lit("2"))).alias("parts"))


@query(
    """WITH RECURSIVE acts AS (SELECT user_id AS session_id, event_id AS seq, (epoch_us(ts) // 1000)::BIGINT AS ms, k % 12 AS q, k,
  CASE WHEN event_id % 13 = 0 THEN 'restore' WHEN event_id % 11 = 0 THEN 'discard' WHEN event_type = 'view' THEN CASE WHEN k % 3 = 0 THEN 'pause' ELSE 'move' END WHEN event_type = 'click' THEN 'answer' WHEN event_type = 'signup' THEN CASE WHEN k % 4 = 0 THEN 'submit' ELSE 'resume' END
   WHEN event_type = 'error' THEN CASE WHEN k % 6 = 0 THEN 'abandon' ELSE 'resume' END ELSE 'assess' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, min_by((epoch_us(ts) // 1000)::BIGINT, event_id) OVER (PARTITION BY user_id) AS first_ms
  FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events)),
-- k is even where q is: a choice for a choice question, a part for one in parts; choices 0 and 6 and part 9 don't exist
f AS (SELECT session_id, 0::BIGINT AS n, 'active' AS status, 0::BIGINT AS revision, 0::BIGINT AS elapsed, first_ms AS since, NULL::VARCHAR AS previous, NULL::BIGINT AS current, []::BIGINT[] AS filled, []::BIGINT[] AS assessed, 0::BIGINT AS refused FROM acts WHERE n = 1
 UNION ALL SELECT session_id, n, CASE WHEN NOT ok THEN status WHEN action = 'discard' THEN 'discarded' WHEN action = 'restore' THEN CASE previous WHEN 'active' THEN 'paused' ELSE previous END WHEN action = 'pause' THEN 'paused' WHEN action = 'resume' THEN 'active' WHEN action = 'submit' THEN 'completed' WHEN action = 'abandon' THEN 'abandoned' ELSE status END,
  revision + ok::BIGINT, elapsed + CASE WHEN ok AND action IN ('pause', 'submit', 'abandon', 'discard') AND status = 'active' THEN greatest(0, ms - since) ELSE 0 END, CASE WHEN NOT ok OR action IN ('answer', 'move', 'assess') THEN since WHEN action = 'resume' THEN ms END,
  CASE WHEN ok AND action = 'discard' THEN status WHEN ok AND action = 'restore' THEN NULL ELSE previous END, CASE WHEN ok AND action = 'move' THEN q ELSE current END,
  CASE WHEN ok AND action = 'answer' THEN CASE WHEN q % 2 = 0 OR k % 5 > 0 THEN list_distinct(list_append(filled, q)) ELSE list_filter(filled, lambda x: x <> q) END ELSE filled END, CASE WHEN ok AND action = 'assess' THEN list_distinct(list_append(assessed, q)) ELSE assessed END, refused + (NOT ok)::BIGINT
 FROM (SELECT f.*, a.n, a.ms, a.q, a.k, a.action, CASE a.action WHEN 'answer' THEN f.status = 'active' AND q < 10 AND CASE WHEN q % 2 = 0 THEN k % 7 BETWEEN 1 AND 5 ELSE k % 7 > 0 END WHEN 'move' THEN f.status NOT IN ('abandoned', 'discarded') AND q < 10
   WHEN 'assess' THEN f.status = 'completed' AND q < 10 AND q % 2 = 1 AND list_contains(filled, q) AND k % 7 > 0 AND k % 9 > 0 WHEN 'discard' THEN f.status <> 'discarded' WHEN 'restore' THEN f.status = 'discarded' AND f.previous IS NOT NULL WHEN 'pause' THEN f.status = 'active' WHEN 'resume' THEN f.status = 'paused' ELSE f.status IN ('active', 'paused') END AS ok
  FROM (SELECT * EXCLUDE (n), n AS before FROM f) f JOIN acts a ON a.session_id = f.session_id AND a.n = f.before + 1))
SELECT session_id, status, revision, elapsed, current AS current_question, len(filled) AS answered, len(assessed) AS assessed, refused FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC) = 1""",
    "",
)
def t14_session_machine_whole(s, d):
    """Over all events, by all nine actions."""
    e = table(s, d, "events")
    return sessions.fold(_actions(e), _models(e))


@query(
    """, g AS (SELECT u.user_id, i.question_id, i.question_id AS pos, l.correctness AS state FROM (SELECT DISTINCT user_id FROM latest) u CROSS JOIN inventory i LEFT JOIN latest l ON l.user_id = u.user_id AND l.question_id = i.question_id)
SELECT user_id, arg_min(question_id, (CASE WHEN state IS NULL THEN 0 WHEN state <> 'richtig' THEN 1 ELSE 2 END, pos)) AS next_question, count(state) AS answered, count(*) FILTER (state = 'richtig') AS correct,
 round(100.0::DOUBLE * count(*) FILTER (state = 'richtig') / nullif(count(state), 0)) AS rate FROM g GROUP BY user_id"""
)
def w09_next_question_whole(s, d):
    """Over all questions."""
    states = _latest(s, d).select("user_id", "question_id", F.col("correctness").alias("state"))
    return sessions.next_question(inventory(s, d).select("question_id", F.col("question_id").alias("pos")), states)


@query("SELECT c_custkey, count(*) AS open FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY c_custkey HAVING count(*) > 1", "")
def t15_open_twice(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("completed").alias("status"))
    return sessions.open_twice(o, "c_custkey")


# --- registry ---------------------------------------------------------------------------------------------------

SOURCES = """WITH sources AS (SELECT o_custkey AS scope, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderkey AS source_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous,
  o_orderstatus <> 'P' AS approved, (o_orderkey % 50)::VARCHAR AS sha256, o_orderdate AS stamp, o_orderpriority AS kind FROM orders)
"""


def _sources(s, d) -> DataFrame:
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(s, d, "orders")
    return o.select(
        F.col("o_custkey").alias("scope"), F.row_number().over(by).alias("version"), F.col("o_orderkey").alias("source_id"), F.lag("o_orderkey").over(by).alias("previous"), (F.col("o_orderstatus") != "P").alias("approved"),
        (F.col("o_orderkey") % 50).cast("string").alias("sha256"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("kind"),
    )


@query("SELECT scope, source_id, version::INT AS version FROM sources WHERE approved QUALIFY row_number() OVER (PARTITION BY scope ORDER BY version DESC) = 1", SOURCES)
def j19_latest_approved(s, d):
    return registry.latest_approved(_sources(s, d), "scope").select("scope", "source_id", "version")


@query(
    """, x AS (SELECT *, CASE WHEN source_id % 23 = 0 THEN -1 WHEN source_id % 7 = 0 THEN version - 2 ELSE previous END AS supersedes FROM sources WHERE previous IS NOT NULL)
SELECT x.source_id, CASE WHEN o.source_id IS NULL THEN 'missing' WHEN o.scope <> x.scope THEN 'scope' WHEN o.version + 1 <> x.version THEN 'version' WHEN o.sha256 = x.sha256 THEN 'same_content' END AS problem
FROM x LEFT JOIN sources o ON o.source_id = x.supersedes WHERE o.source_id IS NULL OR o.scope <> x.scope OR o.version + 1 <> x.version OR o.sha256 = x.sha256""",
    SOURCES,
)
def j21_supersedes_chain(s, d):
    x = _sources(s, d)
    old = F.when(F.col("source_id") % 23 == 0, -1).when(F.col("source_id") % 7 == 0, F.col("version") - 2).otherwise(F.col("previous"))
    return registry.chain_violations(x.withColumn("supersedes", F.when(F.col("previous").isNotNull(), old)))


@query(
    """, v AS (SELECT scope AS topic_id, source_id AS id, stamp::DATE AS a, CASE WHEN source_id % 3 = 0 THEN (stamp + INTERVAL 700 DAY)::DATE END AS b, source_id % 4 <> 0 AS verified, CASE WHEN source_id % 2 = 0 THEN previous END AS old FROM sources),
h AS (SELECT * FROM v WHERE a <= DATE '1997-06-01' AND (b IS NULL OR DATE '1997-06-01' < b)), k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.topic_id = h.topic_id AND g.old = h.id)),
g AS (SELECT topic_id, count(*) AS n, min(id) AS id, bool_and(verified) AS verified FROM k GROUP BY topic_id)
SELECT t.topic_id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 AND verified THEN 'current' ELSE 'needs_review' END AS status, CASE WHEN n = 1 AND verified THEN id END AS version FROM (SELECT DISTINCT topic_id FROM v) t LEFT JOIN g USING (topic_id)""",
    SOURCES,
)
def j22_knowledge_as_of(s, d):
    x = _sources(s, d)
    day = F.to_date("at")
    v = x.select(F.col("scope").alias("topic_id"), F.col("source_id").alias("id"), day.alias("effective_from"), F.when(F.col("source_id") % 3 == 0, F.date_add(day, 700)).alias("effective_until"), (F.col("source_id") % 4 != 0).alias("verified"),
                 F.when((F.col("source_id") % 2 == 0) & F.col("previous").isNotNull(), F.array("previous")).otherwise(F.array().cast("array<bigint>")).alias("supersedes"))
    return registry.resolve(v, "1997-06-01")


STAGE_SQL = "list_position(['registered', 'hash_verified', 'profile_matched', 'layout_validated', 'preview_ready', 'formal_segmented', 'answers_extracted', 'validated', 'production'], stage) - 1"


@query(
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem),
e AS (SELECT l_orderkey AS source_id, seq, CASE WHEN l_suppkey % 11 = 0 THEN 'blocked' ELSE ['registered', 'hash_verified', 'profile_matched', 'layout_validated', 'preview_ready', 'formal_segmented', 'answers_extracted', 'validated', 'production'][1 + ((seq + CASE WHEN l_partkey % 6 = 0 THEN 0 ELSE 8 END + 4 * (l_orderkey % 2)) % 9)::INT] END AS stage,
 CASE WHEN l_suppkey % 2 = 0 THEN 'why' END AS reason FROM n),
x AS (SELECT *, {STAGE_SQL} AS i, lag(stage) OVER w AS before, lag({STAGE_SQL}) OVER w AS last, row_number() OVER w = 1 AS first FROM e WINDOW w AS (PARTITION BY source_id ORDER BY seq))
SELECT source_id, seq::INT AS seq, stage, before FROM x WHERE NOT coalesce(CASE WHEN stage = 'blocked' THEN reason IS NOT NULL AND NOT first AND before <> 'production' AND before <> 'blocked' WHEN first THEN i = 0 ELSE before <> 'blocked' AND i = last + 1 END, FALSE)""",
    "",
)
def t25_stage_order(s, d):
    """Each order's lines as the events of a source, some of them blocks with and without a reason; half of the sources begin late."""
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), "l_partkey", "l_suppkey", n.alias("seq"))
    index = (F.col("seq") + F.when(F.col("l_partkey") % 6 == 0, 0).otherwise(8) + 4 * (F.col("source_id") % 2)) % 9
    stage = F.when(F.col("l_suppkey") % 11 == 0, registry.BLOCKED).otherwise(F.element_at(F.array(*[F.lit(x) for x in registry.STAGES]), (index + 1).cast("int")))
    return registry.stage_violations(li.select("source_id", "seq", F.col("seq").alias("at"), stage.alias("stage"), F.when(F.col("l_suppkey") % 2 == 0, "why").alias("reason")))


@query("SELECT o_orderkey, substr(sha256(concat_ws('|', o_custkey, o_orderpriority)), 1, 24) AS id FROM orders", "")
def c15_short_ids(s, d):
    return table(s, d, "orders").select("o_orderkey", registry.short_id(F.col("o_custkey").cast("string"), "o_orderpriority").alias("id"))


# --- geometry: rectangles made of parts -------------------------------------------------------------------------

RECTS = """WITH r AS (SELECT p_partkey AS id, p_partkey % 40 AS page, p_partkey % 7 AS owner, (p_partkey * 37 % 500)::DOUBLE AS x0, (p_partkey * 91 % 700)::DOUBLE AS y0, (p_partkey * 37 % 500 + p_size)::DOUBLE AS x1, (p_partkey * 91 % 700 + p_size * 2)::DOUBLE AS y1 FROM part)
"""


def _rects(s, d) -> DataFrame:
    k = F.col("p_partkey")
    x, y = k * 37 % 500, k * 91 % 700
    return table(s, d, "part").select(k.alias("id"), (k % 40).alias("page"), (k % 7).alias("owner"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.col("p_size")).cast("double").alias("x1"), (y + F.col("p_size") * 2).cast("double").alias("y1"))


@query(
    """SELECT a.page, a.id AS first, b.id AS second, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) AS area FROM r a JOIN r b ON a.page = b.page AND a.id < b.id AND a.owner <> b.owner
WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 1""",
    RECTS,
)
def j15_overlaps(s, d):
    return geometry.overlaps(_rects(s, d))


@query("SELECT page, owner, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS regions FROM r GROUP BY page, owner", RECTS)
def a26_hulls(s, d):
    return geometry.hulls(_rects(s, d), "page", "owner")


@query(", m AS (SELECT page, y0 AS top, min(id) AS id FROM r GROUP BY page, y0) SELECT page, id, top, coalesce(lead(top) OVER (PARTITION BY page ORDER BY top), 900) AS bottom FROM m", RECTS)
def w12_marker_bounds(s, d):
    m = _rects(s, d).groupBy("page", F.col("y0").alias("top")).agg(F.min("id").alias("id"))
    return geometry.bounds(m, 900.0).select("page", "id", "top", "bottom")


@query(
    """, o AS (SELECT page, y0, row_number() OVER (PARTITION BY page ORDER BY y0, id) AS n FROM r), m AS MATERIALIZED (SELECT * FROM o),
k(page, n, last, kept) AS (SELECT page, n, y0, TRUE FROM m WHERE n = 1 UNION ALL SELECT m.page, m.n, CASE WHEN m.y0 - k.last > 5 THEN m.y0 ELSE k.last END, m.y0 - k.last > 5 FROM k JOIN m ON m.page = k.page AND m.n = k.n + 1)
SELECT page, last AS top FROM k WHERE kept""",
    RECTS.replace("WITH r", "WITH RECURSIVE r"),
)
def w11_kept_markers(s, d):
    return geometry.kept_markers(_rects(s, d).select("page", F.col("y0").alias("top")))


@query(
    """, c AS (SELECT page, 0 AS col, row_number() OVER (PARTITION BY page ORDER BY id) AS row, CASE WHEN id % 3 = 0 THEN owner END AS owner FROM r),
f AS (SELECT page, row, last_value(owner IGNORE NULLS) OVER (PARTITION BY page ORDER BY row ROWS UNBOUNDED PRECEDING) AS owner FROM c),
b AS (SELECT *, row = 1 OR owner IS DISTINCT FROM lag(owner) OVER (PARTITION BY page ORDER BY row) AS begins FROM f), g AS (SELECT *, sum(begins::INT) OVER (PARTITION BY page ORDER BY row ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT page, 0 AS col, owner, min(row)::INT AS first_row, max(row)::INT AS last_row FROM g GROUP BY page, run, owner""",
    RECTS,
)
def w13_carried_owners(s, d):
    cells = _rects(s, d).select("page", F.lit(0).alias("col"), F.row_number().over(W.partitionBy("page").orderBy("id")).alias("row"), F.when(F.col("id") % 3 == 0, F.col("owner")).alias("owner"))
    return geometry.carried(cells)


def _coverage(lines: DataFrame, orders: DataFrame) -> DataFrame:
    f = lines.select((F.col("l_orderkey") % 200).alias("scope"), (F.col("l_linenumber") + F.col("l_partkey") % 2).cast("long").alias("number"))
    e = orders.select((F.col("o_orderkey") % 210).alias("scope")).distinct().withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))))
    return geometry.number_coverage(f, e)


@query(
    """WITH f AS (SELECT l_orderkey % 200 AS scope, l_linenumber + l_partkey % 2 AS number FROM lineitem), c AS (SELECT scope, number, count(*) AS n FROM f GROUP BY ALL), e AS (SELECT DISTINCT o_orderkey % 210 AS scope, unnest(range(1, 8)) AS number FROM orders)
SELECT scope, number, CASE WHEN c.n IS NULL THEN 'missing' WHEN e.scope IS NULL THEN 'unexpected' ELSE 'duplicate' END AS problem FROM c FULL JOIN e USING (scope, number) WHERE c.n IS NULL OR e.scope IS NULL OR c.n > 1""",
    "",
)
def a21_number_coverage_whole(s, d):
    """Over all lines."""
    return _coverage(table(s, d, "lineitem"), table(s, d, "orders"))


# --- change logs and validators ---------------------------------------------------------------------------------

@query(
    """WITH r AS (SELECT user_id, max(event_id) AS revision, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id), l AS (SELECT user_id, max(event_id) AS known FROM events WHERE event_id % 10 < 9 GROUP BY user_id)
SELECT r.user_id::VARCHAR AS id, revision, value, user_id % 3 = 0 AS conflict FROM r LEFT JOIN l USING (user_id) WHERE revision > coalesce(known, 0)""",
    "",
)
def t05_receive(s, d):
    e = table(s, d, "events").select(F.lit("attempt").alias("entity"), F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("revision"), F.col("event_type").alias("value"), F.lit(False).alias("deleted"))
    local = e.where("revision % 10 < 9").groupBy("entity", "id").agg(F.max("revision").alias("revision"))
    pending = e.select("entity", "id").distinct().where("cast(id as int) % 3 = 0")
    apply, conflicts = replication.receive(local, pending, e)
    return apply.withColumn("conflict", F.lit(False)).unionByName(conflicts.withColumn("conflict", F.lit(True))).select("id", "revision", "value", "conflict")


@query("""SELECT o_orderkey, r AS rule FROM (SELECT o_orderkey, unnest([CASE WHEN o_totalprice < 5000 THEN 'price' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'priority' END, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'date' END]) AS r FROM orders) WHERE r IS NOT NULL""", "")
def v01_violations(s, d):
    return validators.violations(table(s, d, "orders"), "o_orderkey", {"price": F.col("o_totalprice") >= 5000, "priority": F.col("o_orderpriority") != "5-LOW", "date": F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")})


@query("SELECT doc_id, quality FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d USING (doc_id)", "")
def j24_dangling(s, d):
    return validators.dangling(table(s, d, "labels"), table(s, d, "documents").where("doc_id % 3 <> 0"), "doc_id", "doc_id").select("doc_id", "quality")


@query("SELECT id, 'depth' AS rule FROM nodes n WHERE EXISTS (SELECT 1 FROM nodes p WHERE p.id = n.parent_id AND p.parent_id IS NOT NULL)", BANK)
def v02_taxonomy(s, d):
    return validators.taxonomy(_nodes(s, d).select("id", "parent_id", F.lit("knowledge").alias("kind"), F.lit(None).cast("int").alias("merged_into")))


@query("SELECT o_custkey, list_sort(list(o_orderkey))::VARCHAR AS items FROM orders GROUP BY o_custkey", "")
def s23_export(s, d):
    return tables.export(table(s, d, "orders"), "o_custkey", F.col("o_orderkey")).select("o_custkey", F.concat(F.lit("["), F.array_join(F.col("items").cast("array<string>"), ", "), F.lit("]")).alias("items"))


@query("SELECT event_id, user_id, TRUE AS more FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100", "")
def s25_cursor_page(s, d):
    return tables.page(table(s, d, "events").select(F.col("event_id").alias("cursor"), "user_id"), 500, 100).withColumnRenamed("cursor", "event_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 = 0", "")
def s24_import(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    new, conflicts = tables.merge_import(o.where("o_orderkey % 4 <> 0"), o, "o_orderkey")
    return new.join(conflicts, "o_orderkey", "left_anti")


@query("SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages WHERE regexp_matches(url, '[?&]page=')", "")
def c23_route(s, d):
    return table(s, d, "pages").select("page_id", fn.route(F.col("url"), "page").alias("page")).where("page is not null")


# --- progress, history, lookups ---------------------------------------------------------------------------------

RUNS = """WITH a AS (SELECT event_id AS attempt_id, user_id, CAST(props->>'$.k' AS INT) AS question_id, 1 + CAST(props->>'$.k' AS INT) % 3 AS generation, event_id % 17 AS progress_order, ts,
  CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'click' THEN 'partial' WHEN 'error' THEN 'incorrect' ELSE 'unanswered' END AS state, CASE WHEN event_id % 3 = 0 THEN event_type ELSE ' ' END AS note FROM events),
n AS (SELECT user_id, max(generation) AS generation FROM a GROUP BY user_id)
"""


def _runs(s, d) -> DataFrame:
    e = attempts(s, d)
    return e.select("attempt_id", "user_id", "question_id", (F.col("question_id") % 3 + 1).alias("generation"), (F.col("attempt_id") % 17).alias("progress_order"), "ts", "correctness")


@query("SELECT user_id, generation, question_id, attempt_id, state FROM a JOIN n USING (user_id, generation) QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY progress_order DESC, ts DESC, attempt_id DESC) = 1", RUNS)
def w05_latest_in_run(s, d):
    return progress.latest_in_run(_runs(s, d))


@query("SELECT user_id, generation, question_id, attempt_id, state FROM (SELECT * FROM a WHERE attempt_id % 4 <> 1) JOIN (SELECT user_id, max(generation) AS generation FROM a WHERE attempt_id % 4 <> 1 GROUP BY user_id) USING (user_id, generation) QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY progress_order DESC, ts DESC, attempt_id DESC) = 1", RUNS)
def t22_delete_falls_back(s, d):
    runs = _runs(s, d)
    return progress.latest_in_run(progress.without(runs, runs.where("attempt_id % 4 = 1")))


@query(
    """, l AS (SELECT user_id, question_id, arg_max(note, (ts, attempt_id)) AS note FROM a WHERE trim(note) <> '' GROUP BY ALL), dr AS (SELECT DISTINCT user_id, question_id, CASE WHEN question_id % 2 = 0 THEN 'draft' ELSE '' END AS draft FROM a WHERE question_id % 5 = 0)
SELECT user_id, question_id, coalesce(CASE WHEN draft <> '' THEN draft END, note) AS note FROM l FULL JOIN dr USING (user_id, question_id) WHERE coalesce(CASE WHEN draft <> '' THEN draft END, note) IS NOT NULL""",
    RUNS,
)
def w07_latest_notes(s, d):
    e = table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("int").alias("question_id")
    a = e.select("user_id", k, "ts", F.col("event_id").alias("attempt_id"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(" ").alias("note"))
    drafts = a.where("question_id % 5 = 0").select("user_id", "question_id", F.when(F.col("question_id") % 2 == 0, "draft").otherwise("").alias("draft")).distinct()
    return progress.latest_note(a, drafts)


@query(
    """WITH c AS (SELECT l_orderkey, l_suppkey AS candidate, l_discount AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_suppkey DESC) AS n FROM lineitem)
SELECT a.l_orderkey, CASE WHEN b.score IS NULL OR a.score - b.score > 0.015 THEN a.candidate END AS candidate FROM c a LEFT JOIN c b ON b.l_orderkey = a.l_orderkey AND b.n = 2 WHERE a.n = 1""",
    "",
)
def a34_strongest_candidate(s, d):
    c = table(s, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("candidate"), F.col("l_discount").alias("score"))
    return progress.strongest(c, "l_orderkey", 0.015)


@query(
    """WITH o AS (SELECT o_orderkey AS question_id, o_custkey % 40 AS alias, CASE WHEN o_orderkey % 5 = 0 THEN 'own' END AS sha FROM orders)
SELECT question_id, coalesce(sha, CASE WHEN alias < 20 THEN 'a' || alias END, CASE WHEN question_id % 2 = 0 THEN 'q' || question_id END) AS resolved FROM o""",
    "",
)
def f41_source_fallback(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("question_id"), (F.col("o_custkey") % 40).alias("alias"), F.when(F.col("o_orderkey") % 5 == 0, "own").alias("sha"))
    aliases = rows.where("alias < 20").select("alias", F.concat(F.lit("a"), F.col("alias").cast("string")).alias("sha")).distinct()
    index = rows.where("question_id % 2 = 0").select("question_id", F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("sha"))
    return progress.resolved(rows, aliases, index).select("question_id", "resolved")


@query("SELECT o_custkey AS alias, count(DISTINCT o_orderstatus) AS hashes FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1", "")
def s44_alias_conflicts(s, d):
    return progress.alias_conflicts(table(s, d, "orders").select(F.col("o_custkey").alias("alias"), F.col("o_orderstatus").alias("sha")))


@query("SELECT page, x0, y0, x1, y1, array_to_string(list_sort(list_distinct(list(owner))), ',') AS owners FROM (SELECT id % 4 AS page, floor(x0 / 50) AS x0, floor(y0 / 50) AS y0, 1.0::DOUBLE AS x1, 2.0::DOUBLE AS y1, owner FROM r) GROUP BY ALL HAVING count(DISTINCT owner) > 1", RECTS)
def j42_shared_regions(s, d):
    r = _rects(s, d).select((F.col("id") % 4).alias("page"), F.floor(F.col("x0") / 50).cast("double").alias("x0"), F.floor(F.col("y0") / 50).cast("double").alias("y0"), F.lit(1.0).alias("x1"), F.lit(2.0).alias("y1"), "owner")
    return progress.shared_regions(r).withColumn("owners", F.array_join(F.col("owners").cast("array<string>"), ","))


@query("SELECT user_id, arg_max(event_type, (ts, event_type, event_id)) AS kind, arg_max(event_id, (ts, event_type, event_id)) AS id FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY user_id", "")
def o12_resume_candidate(s, d):
    e = table(s, d, "events").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return progress.resume(*[e.where(F.col("kind") == k) for k in ("click", "view", "error")])


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'license')", "")
def f17_search(s, d):
    return table(s, d, "documents").where(bank.found(F.lit("LICENSE"), "source", "lang", "text")).select("doc_id")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 5", "")
def o08_dashboard_history(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("abandoned").alias("status"))
    return sessions.history(o).limit(5).select(F.col("session_id").alias("o_orderkey"), F.col("started_at").alias("o_orderdate"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS value FROM orders", "")
def t28_locked_write(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select("o_orderkey", registry.locked_write(F.col("o_orderstatus"), F.col("o_orderpriority"), k % 3 == 0, k % 2 == 0).alias("value"))


@query("""SELECT 'customer' AS store, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events""", "")
def a36_record_counts(s, d):
    out = None
    for t in ("customer", "orders", "events"):
        n = table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("store"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT lang, round(avg(n_chars), 3) AS mean_chars, count(*) AS documents FROM documents GROUP BY lang", "")
def a30_report_counters(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.round(F.avg("n_chars"), 3).alias("mean_chars"), F.count("*").alias("documents"))


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AND bool_or(o_orderstatus = 'F' AND o_orderpriority = '5-LOW')", "")
def f38_both_kinds(s, d):
    x = table(s, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_custkey", F.col("o_orderpriority").alias("kind"), (F.col("o_orderstatus") == "F").alias("approved"))
    return registry.both_kinds(x, "o_custkey")


# --- review and promotion ---------------------------------------------------------------------------------------


@query(
    """, m AS (SELECT module, unnest(list_reverse(list_sort(list(question_id)))) AS number, generate_subscripts(list(question_id), 1) - 1 AS pos FROM inventory GROUP BY module)
SELECT m.module, pos::INT AS pos, number, number + 1000 AS question_id FROM m WHERE number % 6 <> 0"""
)
def f39_parts_in_order(s, d):
    q = inventory(s, d)
    declared = q.groupBy("module").agg(F.sort_array(F.collect_list("question_id"), asc=False).alias("numbers"))
    return review.parts_in_order(declared, q.where("question_id % 6 <> 0").select("module", F.col("question_id").alias("number"), (F.col("question_id") + 1000).alias("question_id")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'm' || o_custkey ELSE o_orderpriority END AS answer, o_orderpriority AS machine, o_orderkey % 4 = 0 AS locked FROM orders", "")
def j27_merged_confirmations(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("answer"), "o_custkey")
    return review.merged(o.select("id", "answer"), o.where("id % 4 = 0").select("id", F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("answer")))


@query("SELECT o_orderkey AS id, o_orderstatus AS answer FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 5 <> 0", "")
def j26_bound_confirmations(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("hash"), F.col("o_orderpriority").alias("kind"), "o_orderstatus")
    answers = o.where("id % 3 = 0").select("id", F.when(F.col("hash") % 5 == 0, -1).otherwise(F.col("hash")).alias("hash"), "kind", F.col("o_orderstatus").alias("answer"))
    return review.confirmed(o.select("id", "hash", "kind"), answers, ["hash", "kind"])[0].select("id", "answer")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 10 = 1 THEN 'extra' ELSE 'differs' END AS problem FROM orders WHERE o_orderkey % 10 IN (0, 1, 2)", "")
def j30_release_differences(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    promoted = o.where("o_orderkey % 10 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 2, -1.0).otherwise(F.col("o_totalprice")))
    return review.differences(promoted, o.where("o_orderkey % 10 <> 1"), "o_orderkey")


@query("SELECT o_custkey AS key, min(o_orderpriority) AS decision FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) = 1 AND min(o_orderkey % 2) = 0", "")
def j39_unique_decision(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderstatus") == "F").alias("reviewed"), (F.col("o_orderkey") % 2).alias("evidence"), F.lit(0).cast("long").alias("current"), F.col("o_orderpriority").alias("decision"))
    return review.unique_decision(o)


@query(
    """WITH f AS (SELECT l_orderkey AS scope, list_distinct(list(l_linenumber)) AS have FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY ALL), e AS (SELECT o_orderkey AS scope, range(1, 1 + 3 + o_orderkey % 3) AS want FROM orders WHERE o_orderkey % 5 <> 0),
x AS (SELECT scope, coalesce(have, []) AS have, coalesce(want, []) AS want FROM f FULL JOIN e USING (scope)), y AS (SELECT scope, len(list_filter(want, lambda w: NOT list_contains(have, w))) AS missing, len(list_filter(have, lambda w: NOT list_contains(want, w))) AS extra FROM x)
SELECT scope, missing::INT AS missing, extra::INT AS extra, CASE WHEN missing = 0 AND extra = 0 THEN 'ok' ELSE 'needs_review' END AS status FROM y""",
    "",
)
def a24_coverage_downgrade(s, d):
    found = table(s, d, "lineitem").where("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("scope"), F.col("l_linenumber").cast("long").alias("number"))
    o = table(s, d, "orders").where("o_orderkey % 5 <> 0")
    return review.downgraded(found, o.select(F.col("o_orderkey").alias("scope"), F.explode(F.sequence(F.lit(1).cast("long"), 3 + F.col("o_orderkey") % 3)).alias("number")))


@query(
    """, p AS (SELECT DISTINCT topic, 'p' || question_id % 5 AS pattern FROM membership), q AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY pattern) AS n FROM p)
SELECT topic, count(DISTINCT question_id) AS questions, (SELECT string_agg(pattern, '|' ORDER BY pattern) FROM q WHERE q.topic = m.topic AND n <= 3) AS patterns FROM membership m GROUP BY topic""",
    BANK,
)
def a29_topic_summaries(s, d):
    m = topics.members(_classified(s, d), _nodes(s, d))
    return review.summaries(m, m.select("topic", F.concat(F.lit("p"), (F.col("question_id") % 5).cast("string")).alias("pattern")))


@query("SELECT question_id AS id, array_to_string(CASE WHEN locked THEN topic_ids ELSE [question_id % 3] END, ',') AS topics, array_to_string(CASE WHEN locked THEN reasons || ['again'] ELSE ['again'] END, ',') AS reasons, locked FROM classified", BANK)
def c10_locked_reconciliation(s, d):
    old = _classified(s, d).select(F.col("question_id").alias("id"), F.col("topic_ids").alias("topics"), "reasons", "locked")
    out = review.reconciled(old, old.select("id", F.array(F.col("id") % 3).alias("topics"), F.array(F.lit("again")).alias("reasons")))
    return out.select("id", F.array_join(F.col("topics").cast("array<string>"), ",").alias("topics"), F.array_join("reasons", ",").alias("reasons"), "locked")


@query("SELECT user_id::VARCHAR AS id, max(event_id)::VARCHAR AS mutation_id, CASE WHEN user_id % 3 = 0 THEN user_id % 9 ELSE 0 END::BIGINT AS base_revision FROM events WHERE user_id % 3 <> 1 GROUP BY user_id", "")
def t04_acknowledge(s, d):
    p = table(s, d, "events").groupBy("user_id").agg(F.max("event_id").alias("m"))
    pending = p.select(F.lit("note").alias("entity"), F.col("user_id").cast("string").alias("id"), F.col("m").cast("string").alias("mutation_id"), F.lit(0).cast("long").alias("base_revision"))
    acks = p.where("user_id % 3 <> 2").select(F.lit("note").alias("entity"), F.col("user_id").cast("string").alias("id"), F.when(F.col("user_id") % 3 == 1, F.col("m").cast("string")).otherwise("old").alias("mutation_id"), (F.col("user_id") % 9).alias("revision"))
    return review.acknowledged(pending, acks).select("id", "mutation_id", "base_revision")


@query("SELECT o_custkey AS id FROM orders GROUP BY o_custkey HAVING o_custkey % 7 = 0 OR o_custkey % 11 = 0", "")
def t27_append_only(s, d):
    old = table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("events"))
    new = old.where("id % 7 <> 0").withColumn("events", F.when(F.col("id") % 11 == 0, F.concat(F.array(F.lit("x")), F.col("events"))).otherwise(F.concat(F.col("events"), F.array(F.lit("new")))))
    return review.prefix_violations(old, new)


@query(
    """, l AS (SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY scope ORDER BY version DESC) = 1)
SELECT c_custkey AS scope, CASE WHEN version IS NULL THEN 'first' WHEN sha256 = (c_custkey % 50)::VARCHAR THEN 'same' ELSE 'replaces' END AS action,
 (coalesce(version, 0) + CASE WHEN sha256 = (c_custkey % 50)::VARCHAR THEN 0 ELSE 1 END)::INT AS version, CASE WHEN sha256 <> (c_custkey % 50)::VARCHAR THEN source_id END AS supersedes FROM customer LEFT JOIN l ON scope = c_custkey""",
    SOURCES,
)
def t29_register_source(s, d):
    latest = results.last_wins(_sources(s, d).select("scope", "source_id", "version", F.col("sha256").alias("sha")), ["scope"], "version")
    return review.registered(latest, table(s, d, "customer").select(F.col("c_custkey").alias("scope"), (F.col("c_custkey") % 50).cast("string").alias("sha")))


@query("SELECT user_id AS run_id, count(DISTINCT question_id) AS questions, count(DISTINCT question_id) FILTER (correctness IS NOT NULL) AS done, count(DISTINCT question_id) = count(DISTINCT question_id) FILTER (correctness IS NOT NULL) AS complete FROM attempts GROUP BY user_id")
def a19_training_completion(s, d):
    a = attempts(s, d)
    runs = a.groupBy(F.col("user_id").alias("run_id")).agg(F.collect_set("question_id").alias("question_ids"))
    return review.open_runs(runs, a.select(F.col("user_id").alias("run_id"), "question_id", "correctness"))


@query("SELECT question_id AS id FROM inventory WHERE question_id % 5 = 0 OR question_id % 8 = 1")
def u07_retired(s, d):
    q = inventory(s, d).select(F.col("question_id").alias("id"))
    return review.retired(q, q.where("id % 5 <> 0"), q.where("id % 8 = 1"))
