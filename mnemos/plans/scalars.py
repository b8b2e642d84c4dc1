"""Predicates and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemos.adapters import NOW, SQL, attempts, inventory, table
from mnemos.functions import text as fn
from mnemos.operators import bank, geometry, progress, registry, replay, results, sessions, topics
from mnemos.plans.base import SESSIONS, cases, query
from mnemos.plans.base import sessions as all_sessions
from mnemos.streaming import replication

FLAGS = "WITH a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS invalidated, CASE WHEN event_id % 7 = 0 THEN 'x' END AS deleted_at, CASE WHEN event_id % 9 = 0 THEN 'x' END AS discarded_at, CASE event_id % 4 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS valid FROM events) "


def _flags(s, d):
    k = F.col("event_id")
    return table(s, d, "events").select("event_id", cases(k % 5, (0, True), (1, False)).alias("invalidated"), F.when(k % 7 == 0, "x").alias("deleted_at"), F.when(k % 9 == 0, "x").alias("discarded_at"), cases(k % 4, (0, False), (1, True)).alias("valid"))


@query("SELECT event_id FROM a WHERE NOT coalesce(invalidated, FALSE) AND deleted_at IS NULL AND discarded_at IS NULL AND coalesce(valid, TRUE)", FLAGS)
def f01_eligible(s, d):
    return _flags(s, d).where(results.eligible()).select("event_id")


@query("SELECT session_id FROM sessions WHERE status = 'completed' AND discarded_at IS NULL AND deleted_at IS NULL", SESSIONS)
def f03_for_analysis(s, d):
    return all_sessions(s, d).where(sessions.for_analysis()).select("session_id")


@query("SELECT attempt_id, concat_ws(':', attempt_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), correctness) AS key FROM attempts", SQL)
def f05_result_keys(s, d):
    return attempts(s, d).select("attempt_id", replay.result_key(F.col("attempt_id"), F.col("ts"), F.col("correctness")).alias("key"))


@query("SELECT attempt_id FROM attempts WHERE ts <= TIMESTAMP '2024-01-15' AND question_id IN (SELECT question_id FROM inventory WHERE module = 1)", SQL)
def f06_bounded_results(s, d):
    return results.bounded(attempts(s, d), inventory(s, d).where("module = 1"), "2024-01-15 00:00:00").select("attempt_id")


@query(
    """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'human_confirmed' ELSE 'machine_suggested' END AS source,
 list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'candidate_requires_confirmation' END, CASE WHEN o_orderkey % 5 = 0 THEN 'knowledge_unclassified' END, CASE WHEN o_orderkey % 7 = 0 THEN 'source_changed' END], lambda x: x IS NOT NULL) AS reasons FROM orders)
SELECT id FROM c WHERE len(list_filter(reasons, lambda r: r <> 'candidate_requires_confirmation' AND (source = 'human_confirmed' OR r <> 'knowledge_unclassified'))) > 0"""
)
def f08_exceptions(s, d):
    k = F.col("o_orderkey")
    reasons = F.filter(F.array(F.when(k % 2 == 0, "candidate_requires_confirmation"), F.when(k % 5 == 0, "knowledge_unclassified"), F.when(k % 7 == 0, "source_changed")), lambda x: x.isNotNull())
    return table(s, d, "orders").where(F.size(bank.exceptional(reasons, F.when(k % 3 == 0, "human_confirmed").otherwise("machine_suggested"))) > 0).select(k.alias("id"))


@query(
    """, x AS (SELECT *, CASE WHEN len(source_exams) > 0 THEN source_exams ELSE [exam] END AS exams FROM sessions)
SELECT session_id, started_at FROM x WHERE deleted_at IS NULL AND status = 'completed' AND test_type = 'module' AND list_contains(exams, '3')""",
    SESSIONS,
)
def f10_history_filter(s, d):
    x = all_sessions(s, d).where("deleted_at is null and test_type = 'module'").withColumn("exams", sessions.exams_of(F.col("source_exams"), F.col("exam")))
    return sessions.history(x, status="completed", exam="3").select("session_id", "started_at")


@query("SELECT session_id, status IN ('abandoned', 'discarded') AS archived FROM sessions", SESSIONS)
def f11_archived(s, d):
    return all_sessions(s, d).select("session_id", sessions.archived(F.col("status")).alias("archived"))


@query("SELECT session_id, CASE WHEN len(source_exams) = 0 THEN exam WHEN source_exams[1] = source_exams[2] THEN source_exams[1] ELSE source_exams[1] || ',' || source_exams[2] END AS exams FROM sessions", SESSIONS)
def f12_session_exams(s, d):
    return all_sessions(s, d).select("session_id", F.array_join(sessions.exams_of(F.col("source_exams"), F.col("exam")), ",").alias("exams"))


@query("SELECT session_id FROM sessions WHERE session_id % 4 = 0 OR list_contains(source_exams, exam)", SESSIONS)
def f13_source_filter(s, d):
    chosen = F.when(F.col("session_id") % 4 != 0, F.col("source_exams"))
    return all_sessions(s, d).where(bank.includes_source(chosen, F.col("exam"))).select("session_id")


@query("SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS items FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [p_type, p_brand] ELSE [p_brand, p_type] END AS list_distinct_ordered FROM part)")
def f14_source_lists(s, d):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit(" , "), "p_type", F.lit(",  "), "p_brand", F.lit(" ,,"), "p_type")).otherwise(F.concat("p_brand", F.lit(","), "p_type", F.lit(", "), "p_brand"))
    return table(s, d, "part").select("p_partkey", F.array_join(bank.source_list(text), "|").alias("items"))


@query("SELECT session_id, array_to_string(CASE WHEN list_contains(source_exams, '2') THEN list_filter(source_exams, lambda x: x <> '2') ELSE list_append(source_exams, '2') END, ',') AS chosen FROM sessions", SESSIONS)
def f15_toggled(s, d):
    return all_sessions(s, d).select("session_id", F.array_join(bank.toggled(F.col("source_exams"), F.lit("2")), ",").alias("chosen"))


@query("SELECT session_id, len(list_filter(source_exams, lambda x: x NOT IN ('0', '1', '2', '3'))) = 0 AS available FROM sessions", SESSIONS)
def f16_all_available(s, d):
    return all_sessions(s, d).select("session_id", bank.all_available(F.col("source_exams"), F.array(*[F.lit(str(i)) for i in range(4)])).alias("available"))


REVIEW = """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN []::INT[] ELSE [o_orderkey::INT] END AS topics, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE (o_orderkey % 10) / 10.0::DOUBLE END AS confidence,
 CASE o_orderkey % 5 WHEN 0 THEN ['source_changed'] WHEN 1 THEN ['legal_change', 'other'] WHEN 2 THEN NULL ELSE []::VARCHAR[] END AS reasons FROM orders) """


def _review(s, d):
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    reasons = F.when(k % 5 == 0, F.array(F.lit("source_changed"))).when(k % 5 == 1, F.array(F.lit("legal_change"), F.lit("other"))).when(k % 5 == 2, None).otherwise(none)
    topics_ = F.when(k % 6 == 0, None).when(k % 6 == 1, F.array().cast("array<int>")).otherwise(F.array(k.cast("int")))
    return table(s, d, "orders").select(k.alias("id"), topics_.alias("topics"), F.when(k % 8 != 0, (k % 10) / F.lit(10.0)).alias("confidence"), reasons.alias("reasons"))


@query("SELECT id FROM c WHERE topics IS NULL OR len(topics) = 0 OR confidence IS NULL OR confidence < 0.8 OR coalesce(list_contains(reasons, 'source_changed'), FALSE)", REVIEW)
def f18_ordinary_review(s, d):
    return _review(s, d).where(topics.ordinary_review(F.col("topics"), F.col("confidence"), F.col("reasons"))).select("id")


@query("SELECT id FROM c WHERE coalesce(list_contains(reasons, 'legal_change'), FALSE)", REVIEW)
def f19_legal_review(s, d):
    return _review(s, d).where(topics.legal_review(F.col("reasons"))).select("id")


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat_ws(',', CASE WHEN o_orderkey % 4 <> 1 THEN 'validity' END, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 = 0 THEN 'begin_unknown' END, CASE WHEN o_orderkey % 7 > 4 THEN 'replacement' END) END AS reasons FROM orders"""
)
def f20_legal_reasons(s, d):
    k = F.col("o_orderkey")
    found = topics.legal_reasons(k % 3 != 0, cases(k % 4, (0, None), (1, True), otherwise=False), F.when(k % 5 != 0, F.col("o_orderdate")), F.when(k % 7 > 4, 1).otherwise(0))
    return table(s, d, "orders").select(k.alias("id"), F.array_join(found, ",").alias("reasons"))


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0 AND event_id % 4 <> 0")
def f24_free_attempts(s, d):
    k = F.col("event_id")
    x = table(s, d, "events").withColumns({"test_id": F.when(k % 3 == 0, k), "training_run_id": F.when(k % 4 == 0, F.lit("r"))})
    return x.where(progress.free()).select("event_id")


@query(
    """WITH a AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS auto, CASE event_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS own, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN [] WHEN 2 THEN ['richtig', NULL] ELSE ['richtig', 'falsch'] END AS parts FROM events)
SELECT event_id FROM a WHERE (coalesce(auto, FALSE) OR coalesce(own, FALSE)) AND (NOT coalesce(own, FALSE) OR (parts IS NOT NULL AND len(parts) > 0 AND event_id % 5 <> 2))"""
)
def f25_gradable_attempts(s, d):
    k = F.col("event_id")
    part = lambda *xs: F.array(*[F.struct(F.lit(x).cast("string").alias("correctness")) for x in xs])
    parts = F.when(k % 5 == 0, None).when(k % 5 == 1, F.slice(part("x"), 1, 0)).when(k % 5 == 2, part("richtig", None)).otherwise(part("richtig", "falsch"))
    x = table(s, d, "events").withColumns({"auto_scored": cases(k % 3, (0, True), (1, False)), "self_assessed": cases(k % 4, (0, True), (1, False)), "subparts": parts})
    return x.where(results.gradable(x.columns)).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS g, 1 + user_id % 2 AS r, event_id % 5 = 0 AS legacy FROM events) WHERE g = r OR (g IS NULL AND r = 1 AND legacy)")
def f26_in_run(s, d):
    k = F.col("event_id")
    return table(s, d, "events").where(progress.in_run(F.when(k % 3 > 0, k % 3), F.col("user_id") % 2 + 1, k % 5 == 0)).select("event_id")


@query("SELECT attempt_id, CASE WHEN attempt_id % 7 = 0 THEN 'partial' WHEN correctness IS NULL THEN 'unanswered' WHEN correctness = 'richtig' THEN 'correct' WHEN correctness = 'falsch' THEN 'incorrect' ELSE 'partial' END AS state FROM attempts", SQL)
def f27_states(s, d):
    """Every seventh attempt has a grade that no rule names."""
    grade = F.when(F.col("attempt_id") % 7 == 0, "fast richtig").otherwise(F.col("correctness"))
    return attempts(s, d).select("attempt_id", progress.state_of(grade).alias("state"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN l_linenumber BETWEEN 1 AND 5 ELSE l_suppkey % 3 = 1 END AS answered FROM lineitem")
def f30_answered(s, d):
    k, p = F.col("l_partkey"), F.col("l_suppkey")
    parts = F.when(p % 3 == 0, F.array(F.lit(" "), F.lit(None).cast("string"))).when(p % 3 == 1, F.array(F.lit(""), F.lit("x")))
    kind = F.when(k % 2 == 0, "multiple_choice").otherwise("multi_part")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sessions.question_answered(kind, F.col("l_linenumber").cast("string"), parts).alias("answered"))


@query("SELECT session_id, CASE WHEN status = 'discarded' AND deleted_at IS NULL THEN CASE previous_status WHEN 'active' THEN 'paused' ELSE previous_status END END AS target FROM sessions", SESSIONS)
def f31_restored(s, d):
    return all_sessions(s, d).select("session_id", sessions.restored().alias("target"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'WiSo' WHEN 1 THEN 'Arbeitsplanung' WHEN 2 THEN 'Solutions' WHEN 3 THEN 'Solutions' ELSE 'Unknown' END AS module FROM part")
def f33_modules_of_files(s, d):
    k = F.col("p_partkey")
    name = F.concat("p_name", cases(k % 5, (0, "_WISO_1.pdf"), (1, "ArbeitsPlanung wiso"), (2, "Lösungen"), (3, "LOSUNG"), otherwise=".pdf"))
    return table(s, d, "part").select("p_partkey", fn.module_of(name).alias("module"))


#: The rule on a text that is cut by key to every length, with replacement characters in some.
USABLE = """length(regexp_replace(cut, '^\\s+|\\s+$', '', 'g')) >= 60 AND len(regexp_extract_all(cut, '[A-Za-zÄÖÜäöüß]{3,}')) >= 4 AND len(regexp_extract_all(cut, '[A-Za-zÄÖÜäöüß]')) >= 45 AND len(regexp_extract_all(cut, chr(65533))) < 3"""
CUT = """WITH c AS (SELECT doc_id, left(text, (30 + doc_id % 90)::INT) || repeat(chr(65533), (doc_id % 5)::INT) || repeat(' ', (doc_id % 3)::INT) AS cut FROM documents) """


def _cut(s, d):
    text = F.concat(F.substring(F.col("text"), F.lit(1), (30 + F.col("doc_id") % 90).cast("int")), F.repeat(F.lit("\ufffd"), (F.col("doc_id") % 5).cast("int")), F.repeat(F.lit(" "), (F.col("doc_id") % 3).cast("int")))
    return table(s, d, "documents").select("doc_id", text.alias("text"))


@query(f"SELECT doc_id, {USABLE} AS usable FROM c", CUT)
def f34_usable_texts(s, d):
    return _cut(s, d).select("doc_id", topics.usable(F.col("text")).alias("usable"))


@query("SELECT session_id FROM sessions WHERE discarded_at IS DISTINCT FROM deleted_at", SESSIONS)
def f37_changed_evidence(s, d):
    from mnemos.operators import review

    return all_sessions(s, d).where(review.changed_evidence(F.col("discarded_at"), F.col("deleted_at"))).select("session_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 6 = 0 THEN NULL WHEN l_linenumber = l_suppkey % 6 THEN 'richtig' ELSE 'falsch' END AS grade FROM lineitem")
def f46_grades(s, d):
    key = F.nullif((F.col("l_suppkey") % 6).cast("string"), F.lit("0"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sessions.grade(F.col("l_linenumber").cast("string"), key).alias("grade"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'a' END AS knowledge, CASE WHEN o_orderkey % 3 > 0 THEN 't' || o_orderkey % 3 END AS primary_type,
 CASE o_orderkey % 3 WHEN 1 THEN 't2' WHEN 2 THEN 't1' ELSE 't1,t2' END AS secondary, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'knowledge_unclassified' END, CASE WHEN o_orderkey % 3 = 0 THEN 'question_type_unclassified' END) AS reasons FROM orders"""
)
def f47_confirmations(s, d):
    k = F.col("o_orderkey")
    knowledge = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("a")))
    x = bank.confirmation(knowledge, F.when(k % 3 > 0, F.concat(F.lit("t"), (k % 3).cast("string"))), F.array(F.lit("t1"), F.lit("t2"), F.lit("t1")))
    x = table(s, d, "orders").select(k.alias("id"), x.alias("c"))
    return x.select("id", F.array_join("c.knowledge", ",").alias("knowledge"), "c.primary_type", F.array_join("c.secondary", ",").alias("secondary"), F.array_join("c.reasons", ",").alias("reasons"))


# --- text, times, numbers ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS at FROM orders")
def c01_stamps(s, d):
    text = F.when(F.col("o_orderkey") % 4 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("o_orderkey") % 8 == 0, "soon")
    return table(s, d, "orders").select("o_orderkey", fn.stamp(text).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, ts::DATE AS day FROM events")
def c02_local_days(s, d):
    return table(s, d, "events").select("event_id", fn.local_day(F.col("ts")).alias("day"))


@query("SELECT doc_id, contains(lower(text), 'straße') OR contains(lower(text), 'über') AS hit FROM documents")
def c03_cues_in_text(s, d):
    return table(s, d, "documents").select("doc_id", (bank.found(F.lit("STRAßE"), "text") | bank.found(F.lit("Über"), "text")).alias("hit"))


@query("SELECT doc_id, md5(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\\x00-\\x7F]', '', 'g')) AS folded FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')")
def c04_folded(s, d):
    return table(s, d, "documents").where("lang in ('en', 'de', 'fr', 'es')").select("doc_id", F.md5(fn.fold(F.col("text"))).alias("folded"))


@query("SELECT doc_id, md5(substr(split_part(text, '?', 1), 1, 700)) AS stem FROM documents")
def c07_stems(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(topics.stem(F.col("text"))).alias("stem"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 10 >= 8 AND {USABLE} THEN length(cut) ELSE 0 END AS n FROM c", CUT)
def c09_trusted_texts(s, d):
    sure = F.when(F.col("doc_id") % 10 >= 8, 0.85).when(F.col("doc_id") % 10 < 7, 0.8)
    return _cut(s, d).select("doc_id", F.length(topics.trusted_text(F.col("text"), sure)).cast("long").alias("n"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN NULL ELSE abs((CASE p_partkey % 5 WHEN 0 THEN p_retailprice ELSE p_size + 0.5 END) - (p_size + 0.52)) <= 0.02 + 1e-9 AND p_partkey % 3 <> 0 END AS ok FROM part"""
)
def c11_numeric_answers(s, d):
    k = F.col("p_partkey")
    text = F.when(k % 5 == 4, "about five").when(k % 5 == 0, F.col("p_retailprice").cast("string")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(",5 ")))
    unit = F.when(k % 3 == 0, "V").otherwise(" A")
    return table(s, d, "part").select("p_partkey", sessions.unit_check(text, unit, F.col("p_size") + 0.52, F.lit("A"), F.lit(0.02)).alias("ok"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def c12_digests(s, d):
    return table(s, d, "documents").select("doc_id", fn.digest(F.col("text")).alias("digest"))


@query("""SELECT session_id, sha256('{"a":"' || status || '","b":' || coalesce('"' || previous_status || '"', 'null') || '}') AS digest FROM sessions""", SESSIONS)
def c13_object_digests(s, d):
    return all_sessions(s, d).select("session_id", fn.object_digest(F.struct(F.col("status").alias("a"), F.col("previous_status").alias("b"))).alias("digest"))


@query("""SELECT o_orderkey, '{"a":"' || o_orderstatus || '","b":"' || o_orderpriority || '"}' AS json FROM orders""")
def c14_canonical_maps(s, d):
    m = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("b"), "o_orderpriority", F.lit("a"), "o_orderstatus")).otherwise(F.create_map(F.lit("a"), "o_orderstatus", F.lit("b"), "o_orderpriority"))
    return table(s, d, "orders").withColumn("m", m).select("o_orderkey", registry.canonical_map("m").alias("json"))


@query("SELECT o_orderkey, substr(sha256(concat_ws('|', o_orderpriority, o_custkey)), 1, 24) AS key FROM orders")
def c16_cache_keys(s, d):
    return table(s, d, "orders").select("o_orderkey", registry.short_id("o_orderpriority", F.col("o_custkey").cast("string")).alias("key"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size WHEN 2 THEN 1 END::DOUBLE AS points FROM part")
def c17_points(s, d):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, F.concat("p_name", F.lit(" ("), n, F.lit(",5 Punkte)"))).when(k % 4 == 1, F.concat(n, F.lit(".0  Punkte"))).when(k % 4 == 2, "x 1 Punkt, 2 Punkte").otherwise(F.concat(n, F.lit(" Punktezahl")))
    return table(s, d, "part").select("p_partkey", fn.points(text).alias("points"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS minutes FROM part")
def c18_minutes(s, d):
    text = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("Dauer: "), F.col("p_size").cast("string"), F.lit(" Minuten, danach 5 Minuten"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" Min")))
    return table(s, d, "part").select("p_partkey", fn.minutes(text).alias("minutes"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_orderpriority WHEN month(o_orderdate) < 7 THEN 'Sommer ' || year(o_orderdate) ELSE 'Winter ' || year(o_orderdate) || '/' || lpad(((year(o_orderdate) + 1) % 100)::VARCHAR, 2, '0') END AS label FROM orders")
def c19_season_labels(s, d):
    """Winter terms name two years; what is no term stays as it is."""
    year = F.year("o_orderdate")
    winter = F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"), F.lit("-winter"))
    season = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderpriority")).when(F.month("o_orderdate") < 7, F.concat(year.cast("string"), F.lit("-sommer"))).otherwise(winter)
    return table(s, d, "orders").select("o_orderkey", fn.season_label(season).alias("label"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderdate::DATE <= DATE '1997-06-01' AND (o_orderkey % 2 = 0 OR DATE '1997-06-01' < o_orderdate::DATE + 30)")
def c20_holds_on(s, d):
    k, at = F.col("o_orderkey"), F.to_date("o_orderdate")
    begin = F.when(k % 6 == 0, "unknown").otherwise(at.cast("string"))
    end = F.when(k % 2 != 0, F.date_add(at, 30).cast("string"))
    return table(s, d, "orders").where(fn.holds_on(F.lit("1997-06-01"), begin, end)).select("o_orderkey")


@query("SELECT p_partkey, round_even(p_partkey / 2.0::DOUBLE, 0)::DOUBLE AS even, round(p_partkey / 2.0::DOUBLE)::DOUBLE AS up FROM part")
def c21_rounding(s, d):
    x = F.col("p_partkey") / 2
    return table(s, d, "part").select("p_partkey", fn.half_even(x).alias("even"), F.round(x).alias("up"))


@query("SELECT o_orderkey, format('{:02d}:{:02d}:{:02d}', o_orderkey * 37 // 3600, o_orderkey * 37 // 60 % 60, o_orderkey * 37 % 60) AS time FROM orders")
def c22_clock(s, d):
    return table(s, d, "orders").select("o_orderkey", sessions.hms(F.col("o_orderkey") * 37).alias("time"))


@query("SELECT p_partkey, 'https://x.org/' || CASE p_partkey % 3 WHEN 0 THEN '?view=' || p_type || '&q=a%26b+c' WHEN 1 THEN '?view=' || p_type ELSE '?q=a%26b+c' END AS url FROM part")
def c24_route_urls(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select("p_partkey", fn.route_url(F.lit("https://x.org/"), view=F.when(k % 3 < 2, F.col("p_type")), q=F.when(k % 3 != 1, "a&b c")).alias("url"))


@query("SELECT question_id, exam || '/' || module AS key FROM inventory", SQL)
def c25_owner_keys(s, d):
    return inventory(s, d).select("question_id", fn.owner_key(F.col("exam").cast("string"), F.col("module").cast("string")).alias("key"))


@query("SELECT o_custkey, count(DISTINCT o_orderkey % 50) AS questions FROM orders GROUP BY o_custkey")
def c26_initial_states(s, d):
    ids = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_list((F.col("o_orderkey") % 50).cast("string")).alias("ids"))
    states = fn.initial_states(F.col("ids"))
    return ids.select("o_custkey", F.size(F.map_filter(states, lambda k, v: v == "unanswered")).cast("long").alias("questions"))


@query("SELECT p_partkey, floor(p_retailprice * 2.5)::BIGINT AS x0, floor(p_size * 2.5)::BIGINT AS y0, ceil((p_retailprice + 1) * 2.5)::BIGINT AS x1, ceil((p_size + 3) * 2.5)::BIGINT AS y1 FROM part")
def c27_pixel_boxes(s, d):
    a, b = F.col("p_retailprice"), F.col("p_size")
    return table(s, d, "part").select("p_partkey", geometry.pixel_box(F.lit(2.5).cast("double"), a, b, a + 1, b + 3).alias("b")).select("p_partkey", "b.*")


@query("SELECT event_id FROM events WHERE event_id % 5 > 0 AND event_id % 7 > 0 AND length(props) <= 200000")
def t11_valid_mutations(s, d):
    k = F.col("event_id")
    x = table(s, d, "events").select("event_id", F.when(k % 5 > 0, k.cast("string")).alias("mutation_id"), F.lit("note").alias("entity"), F.col("user_id").cast("string").alias("id"), F.when(k % 7 > 0, 0).otherwise(-1).alias("base_revision"), F.col("props").alias("value"))
    return replication.valid(x).select("event_id")


@query("SELECT attempt_id, coalesce(correctness <> 'richtig' AND ts < CASE WHEN user_id % 3 > 0 THEN TIMESTAMP '2024-01-10' END, FALSE) AS dismissed FROM attempts WHERE correctness IS NOT NULL", SQL)
def t18_dismissed(s, d):
    a = attempts(s, d).where("correctness is not null")
    marks = a.where("user_id % 3 > 0").select("user_id").distinct().withColumn("until", F.lit("2024-01-10").cast("timestamp_ntz"))
    return replay.dismissed(a, marks).select("attempt_id", "dismissed")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def t17_changed_states(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = o.where("o_orderkey % 3 > 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")))
    return replay.changed(o, old, ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).select("o_orderkey")


@query("SELECT event_id, value::BIGINT + CASE WHEN event_id % 3 = 0 THEN greatest(0, event_id * 5 - event_id * event_id) ELSE 0 END AS elapsed FROM events")
def w10_elapsed(s, d):
    k = F.col("event_id")
    return table(s, d, "events").select("event_id", sessions.elapsed(F.bround("value").cast("long"), k * k, k * 5, k % 3 == 0).alias("elapsed"))


SEASONS = "WITH q AS (SELECT DISTINCT CASE WHEN o_orderkey % 9 = 0 THEN year(o_orderdate) || '-extra' WHEN month(o_orderdate) < 7 THEN year(o_orderdate) || '-sommer' ELSE year(o_orderdate) || '-winter' END AS season FROM orders), r AS (SELECT season, row_number() OVER (ORDER BY substr(season, 1, 4)::INT, CASE WHEN contains(season, 'sommer') THEN 0 ELSE 1 END, season) AS n FROM q) "


def _seasons(s, d):
    half = F.when(F.col("o_orderkey") % 9 == 0, "-extra").when(F.month("o_orderdate") < 7, "-sommer").otherwise("-winter")
    return table(s, d, "orders").select(F.concat(F.year("o_orderdate").cast("string"), half).alias("season"))


@query("SELECT season, n::INT AS place FROM r", SEASONS)
def o04_season_order(s, d):
    from pyspark.sql import Window as W

    return _seasons(s, d).distinct().select("season", F.row_number().over(W.orderBy(*topics.season_key(F.col("season")))).alias("place"))


@query("SELECT season FROM r ORDER BY n DESC LIMIT 4", SEASONS)
def w08_recent_seasons(s, d):
    return topics.recent(_seasons(s, d), 4)


@query("SELECT p_partkey, upper(p_name) COLLATE NOCASE = lower(p_name) AS same FROM part")
def c28_locale_order(s, d):
    return table(s, d, "part").select("p_partkey", (F.collate(F.upper("p_name"), "UNICODE_CI") == F.lower("p_name")).alias("same"))


#: Anchor of the bounded queries.
AT = NOW
