"""Guarded writes, runs and migrations over whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemos.adapters import SQL, attempts, inventory, table
from mnemos.functions.dealing import dealt
from mnemos.operators import guards, runs
from mnemos.plans.base import SESSIONS, query
from mnemos.plans.base import sessions as all_sessions

# --- marks and notes: states of a third of the questions, commands from all attempts ------------------------------

MARKS = (
    SQL
    + """, cur AS (SELECT DISTINCT user_id, question_id, question_id % 2 = 0 AS active, CASE WHEN question_id % 2 = 0 THEN TIMESTAMP '2024-01-01' END AS entered_at, 1 + question_id % 4 AS revision, CASE WHEN question_id % 5 > 0 THEN 'old' ELSE '' END AS text FROM attempts WHERE question_id % 3 = 0),
cmd AS (SELECT user_id, question_id, attempt_id AS seq, viewed AS active, ts AS stamp, CASE WHEN attempt_id % 11 = 0 THEN NULL WHEN question_id % 3 = 0 THEN 1 + (question_id + attempt_id % 2) % 4 ELSE attempt_id % 2 END AS expected,
  CASE attempt_id % 3 WHEN 0 THEN 'old' WHEN 1 THEN '' END AS expected_text, correctness AS text FROM attempts),
x AS (SELECT c.*, o.active AS old_active, o.entered_at AS old_entered_at, o.text AS old_text, coalesce(o.revision, 0) AS revision FROM cmd c LEFT JOIN cur o USING (user_id, question_id))
"""
)


def _marks(s, d):
    q = F.col("question_id")
    x = attempts(s, d).where(q % 3 == 0).select("user_id", "question_id").distinct()
    return x.select("user_id", "question_id", (q % 2 == 0).alias("active"), F.when(q % 2 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("entered_at"), (q % 4 + 1).alias("revision"), F.when(q % 5 > 0, "old").otherwise("").alias("text"))


def _commands(s, d):
    q, k = F.col("question_id"), F.col("attempt_id")
    expected = F.when(k % 11 == 0, None).when(q % 3 == 0, (q + k % 2) % 4 + 1).otherwise(k % 2)
    text = F.when(k % 3 == 0, "old").when(k % 3 == 1, "")
    return attempts(s, d).select("user_id", "question_id", k.alias("seq"), F.col("viewed").alias("active"), F.col("ts").alias("at"), expected.alias("expected"), text.alias("expected_text"), F.col("correctness").alias("text"))


@query(
    """, a AS (SELECT * FROM x WHERE coalesce(expected = revision, FALSE) QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY seq) = 1),
n AS (SELECT user_id, question_id, active, CASE WHEN active THEN CASE WHEN old_active THEN old_entered_at ELSE stamp END END AS entered_at, revision + 1 AS revision FROM a)
SELECT * FROM n UNION ALL SELECT user_id, question_id, active, entered_at, revision FROM cur ANTI JOIN n USING (user_id, question_id)""",
    MARKS,
)
def t33_toggled_marks(s, d):
    return guards.toggled_uncertainty(_marks(s, d), _commands(s, d))


@query(
    """, a AS (SELECT * FROM x WHERE coalesce(expected = revision, FALSE) AND coalesce(old_text, '') = coalesce(expected_text, '') QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY seq) = 1),
n AS (SELECT user_id, question_id, text, revision + 1 AS revision FROM a)
SELECT * FROM n UNION ALL SELECT user_id, question_id, text, revision FROM cur ANTI JOIN n USING (user_id, question_id)""",
    MARKS,
)
def t34_saved_notes(s, d):
    return guards.saved_notes(_marks(s, d), _commands(s, d))


SEEDS = MARKS + """, t AS (SELECT *, CASE WHEN attempt_id % 4 = 0 THEN attempt_id % 20 END AS test_id, attempt_id % 3 = 0 AS unsure FROM attempts),
l AS (SELECT * FROM t WHERE correctness IS NOT NULL AND (test_id IS NULL OR (test_id < 12 AND question_id % 2 = 0)) QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY ts DESC, attempt_id DESC) = 1),
seeds AS (SELECT user_id, question_id, unsure AS active, CASE WHEN unsure THEN ts END AS entered_at, 1 AS revision, attempt_id AS last_result_id FROM l ANTI JOIN cur USING (user_id, question_id))
"""


def _seeds(s, d):
    k = F.col("attempt_id")
    a = attempts(s, d).withColumns({"test_id": F.when(k % 4 == 0, k % 20), "unsure": k % 3 == 0})
    tests = a.where("test_id < 12 and question_id % 2 = 0").select("user_id", "test_id", "question_id")
    return guards.migrated_uncertainty(a, tests, _marks(s, d).select("user_id", "question_id"))


@query("SELECT * FROM seeds", SEEDS)
def w06_seeded_marks(s, d):
    return _seeds(s, d)


@query("SELECT user_id, question_id, active, revision FROM seeds UNION ALL SELECT user_id, question_id, active, revision FROM cur", SEEDS)
def t35_migrated_marks(s, d):
    columns = ["user_id", "question_id", "active", "revision"]
    return _seeds(s, d).select(columns).unionByName(_marks(s, d).select(columns))


@query(
    MARKS.removeprefix(SQL).split("cmd AS")[0].rstrip().rstrip(",")
    + """, n AS (SELECT user_id, question_id, arg_max(correctness, (ts, attempt_id)) AS note FROM attempts WHERE correctness IS NOT NULL GROUP BY ALL)
SELECT user_id, question_id, note, 1 AS revision FROM n WHERE user_id % 4 <> 1 AND question_id % 7 <> 2 AND NOT EXISTS (SELECT 1 FROM cur WHERE cur.user_id = n.user_id AND cur.question_id = n.question_id)""",
    SQL,
)
def t36_migrated_notes(s, d):
    a = attempts(s, d)
    notes = a.where("correctness is not null").groupBy("user_id", "question_id").agg(F.max_by("correctness", F.struct("ts", "attempt_id")).alias("note"))
    return guards.migrated_notes(notes, _marks(s, d), a.where("question_id % 7 = 2").select("user_id", "question_id").distinct(), a.where("user_id % 4 = 1").select("user_id").distinct())


@query(
    """WITH c AS (SELECT event_id // 2 AS attempt_id, event_id AS seq, user_id, event_id % 50 AS question_id, CASE WHEN event_id % 3 > 0 THEN user_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END END AS session_user, event_id % 50 + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS session_question FROM events)
SELECT attempt_id, seq, CASE WHEN session_user IS NOT NULL AND (session_user <> user_id OR session_question <> question_id) THEN 'foreign' WHEN attempt_id % 5 = 0 OR row_number() OVER (PARTITION BY attempt_id ORDER BY seq) > 1 THEN 'exists' ELSE 'added' END AS outcome FROM c"""
)
def t37_inserted_attempts(s, d):
    k, u = F.col("event_id"), F.col("user_id")
    x = table(s, d, "events").select(F.floor(k / 2).alias("attempt_id"), k.alias("seq"), u, (k % 50).alias("question_id"), F.when(k % 3 > 0, u + (k % 7 == 0).cast("int")).alias("session_user"), (k % 50 + (k % 13 == 0).cast("int")).alias("session_question"))
    return guards.inserted_attempts(x.where("attempt_id % 5 = 0"), x)


@query(
    """, n AS (SELECT attempt_id // 3 AS attempt_id, arg_max({'note': correctness, 'reason': 'r' || attempt_id % 4}, attempt_id) AS n FROM attempts GROUP BY ALL)
SELECT attempt_id, CASE WHEN n IS NOT NULL THEN n.note ELSE 'as it was' END AS note, n.reason AS error_reason, question_id FROM attempts LEFT JOIN n USING (attempt_id)""",
    SQL,
)
def t38_annotated(s, d):
    a = attempts(s, d).select("attempt_id", F.lit("as it was").alias("note"), F.lit(None).cast("string").alias("error_reason"), "question_id", "correctness")
    k = F.col("attempt_id")
    notes = a.select(F.floor(k / 3).alias("attempt_id"), k.alias("seq"), F.col("correctness").alias("note"), F.concat(F.lit("r"), (k % 4).cast("string")).alias("error_reason"))
    return guards.annotated(a, notes).drop("correctness")


#: Order lines of a task.
LINES = 250_000

# --- sessions: actions from all order lines -----------------------------------------------------------------------

ACTS = SESSIONS + """, acts AS (SELECT l_orderkey AS session_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, CASE l_partkey % 5 WHEN 0 THEN 'pause' WHEN 1 THEN 'resume' WHEN 2 THEN 'restore' WHEN 3 THEN 'discard' ELSE 'submit' END AS action,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN l_orderkey % 9 ELSE l_suppkey % 9 END AS expected FROM lineitem),
kept AS (SELECT * FROM sessions WHERE session_id % 13 > 0)
"""


def _dealt_lines(s, d):
    """The order lines by order, so many to a task: what numbers, joins or groups them by order then neither moves them again nor sorts more in a task when the table grows."""
    return dealt(table(s, d, "lineitem"), "l_orderkey", rows=LINES)


def _acts(s, d):
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    p, u, k = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    action = F.element_at(F.array(*[F.lit(x) for x in ("pause", "resume", "restore", "discard", "submit")]), (p % 5 + 1).cast("int"))
    return _dealt_lines(s, d).select(k.alias("session_id"), n.alias("seq"), action.alias("action"), F.when(u % 7 == 0, None).when(u % 2 == 0, k % 9).otherwise(u % 9).alias("expected"))


@query(
    """, o AS (SELECT *, CASE WHEN test_type = 'module' THEN '' ELSE exam END AS own_exam FROM kept), oc AS (SELECT user_id, test_type, module, own_exam, count(*) AS n FROM o WHERE status IN ('active', 'paused') GROUP BY ALL),
x AS (SELECT a.*, o.status, coalesce(a.expected = o.revision, FALSE) AS fits, coalesce(oc.n, 0) - (o.status IN ('active', 'paused'))::INT AS others,
 CASE WHEN action = 'restore' THEN CASE WHEN o.status = 'discarded' THEN CASE WHEN o.previous_status = 'active' THEN 'paused' ELSE o.previous_status END END WHEN action = 'discard' THEN CASE WHEN o.status <> 'discarded' THEN 'discarded' END
  WHEN o.status = 'active' AND action = 'pause' THEN 'paused' WHEN o.status = 'paused' AND action = 'resume' THEN 'active' WHEN o.status IN ('active', 'paused') AND action = 'submit' THEN 'completed' END AS target
 FROM acts a LEFT JOIN o USING (session_id) LEFT JOIN oc USING (user_id, test_type, module, own_exam)),
y AS (SELECT *, coalesce(action IN ('resume', 'restore') AND target IN ('active', 'paused') AND others > 0, FALSE) AS competing FROM x),
z AS (SELECT *, target IS NOT NULL AND NOT competing AS allowed, row_number() OVER (PARTITION BY session_id, fits AND target IS NOT NULL AND NOT competing ORDER BY seq) AS place FROM y),
r AS (SELECT *, CASE WHEN status IS NULL THEN 'missing' WHEN NOT fits THEN 'changed' WHEN NOT allowed THEN CASE WHEN competing THEN 'competing' ELSE 'refused' END WHEN place > 1 THEN 'changed' ELSE 'applied' END AS outcome FROM z)
SELECT session_id, seq::INT AS seq, outcome, CASE WHEN outcome = 'applied' THEN target ELSE status END AS status FROM r""",
    ACTS,
)
def t16_updated_sessions(s, d):
    return guards.updated_sessions(all_sessions(s, d).where("session_id % 13 > 0"), _acts(s, d))


@query(
    """, x AS (SELECT a.*, o.status, coalesce(a.expected = o.revision, FALSE) AS fits FROM (SELECT * FROM acts WHERE action = 'discard') a LEFT JOIN kept o USING (session_id)),
y AS (SELECT *, row_number() OVER (PARTITION BY session_id, fits AND status <> 'discarded' ORDER BY seq) AS place FROM x)
SELECT session_id, seq::INT AS seq, CASE WHEN status IS NULL THEN 'missing' WHEN NOT fits THEN 'changed' WHEN status = 'discarded' THEN 'refused' WHEN place > 1 THEN 'changed' ELSE 'applied' END AS outcome FROM y""",
    ACTS,
)
def t39_discarded_sessions(s, d):
    return guards.updated_sessions(all_sessions(s, d).where("session_id % 13 > 0"), _acts(s, d).where("action = 'discard'")).select("session_id", "seq", "outcome")


@query("SELECT session_id, status FROM kept WHERE session_id NOT IN (SELECT session_id FROM acts JOIN sessions USING (session_id) WHERE action = 'discard' AND expected = revision)", ACTS)
def t40_deleted_sessions(s, d):
    return guards.deleted_sessions(all_sessions(s, d).where("session_id % 13 > 0"), _acts(s, d).where("action = 'discard'"))[0].select("session_id", "status")


# --- replication ---------------------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 > 0 AND o_orderkey % 5 = 0 THEN 'older' WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 > 0 AND o_orderkey % 7 = 0 AND o_orderstatus <> 'F' THEN 'history' WHEN o_orderkey % 4 = 0 THEN 'deleted' ELSE 'put' END AS outcome FROM orders"""
)
def t07_applied_remote(s, d):
    k = F.col("o_orderkey")
    o = table(s, d, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("exam"), F.lit(2).alias("generation"))
    i = F.col("id")
    remote = o.select("id", F.when(i % 7 == 0, "F").otherwise(F.col("exam")).alias("exam"), F.when(i % 5 == 0, 1).otherwise(3).alias("generation"), (i % 4 == 0).alias("deleted"))
    return guards.applied_remote(o.where("id % 3 = 0"), remote, ["exam"], "generation")


CONFLICTS = """WITH c AS (SELECT o_orderkey AS id, 'm' || o_orderkey AS mutation_id, o_custkey % 10 AS revision FROM orders WHERE o_orderkey % 3 > 0),
ch AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'local' ELSE 'remote' END AS choice, CASE WHEN o_orderkey % 5 > 0 THEN 'm' || o_orderkey END AS expected_mutation, CASE WHEN o_orderkey % 7 = 0 THEN 99 WHEN o_orderkey % 7 < 5 THEN o_custkey % 10 END AS expected_revision FROM orders),
p AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'new' ELSE mutation_id END AS pending FROM c WHERE id % 17 > 0),
x AS (SELECT ch.*, mutation_id, revision, pending, CASE WHEN mutation_id IS NULL THEN 'missing' WHEN (expected_mutation IS NOT NULL AND expected_mutation <> mutation_id) OR (expected_revision IS NOT NULL AND expected_revision <> revision) THEN 'changed' WHEN choice = 'remote' AND pending IS DISTINCT FROM mutation_id THEN 'local_changed' WHEN choice = 'remote' THEN 'replaced' ELSE 'sent_again' END AS outcome FROM ch LEFT JOIN c USING (id) LEFT JOIN p USING (id))
"""


def _resolved(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(s, d, "orders").select(F.lit("note").alias("entity"), k.alias("id"), F.concat(F.lit("m"), k.cast("string")).alias("mutation_id"), (c % 10).alias("revision"))
    i = F.col("id")
    conflicts = o.where("id % 3 > 0")
    choices = o.select("entity", "id", F.when(i % 2 == 0, "local").otherwise("remote").alias("choice"), F.when(i % 5 > 0, F.col("mutation_id")).alias("expected_mutation"), F.when(i % 7 == 0, 99).when(i % 7 < 5, F.col("revision")).alias("expected_revision"))
    pending = conflicts.where("id % 17 > 0").select("entity", "id", F.when(i % 11 == 0, "new").otherwise(F.col("mutation_id")).alias("mutation_id"))
    return guards.resolved_conflicts(conflicts, choices, pending)


@query("SELECT id, outcome, CASE WHEN outcome IN ('replaced', 'sent_again') THEN revision END AS base_revision FROM x", CONFLICTS)
def t08_resolved_conflicts(s, d):
    return _resolved(s, d).drop("entity")


@query("SELECT id, revision AS base_revision FROM x WHERE outcome = 'sent_again'", CONFLICTS)
def t47_resolved_then_sent(s, d):
    return _resolved(s, d).where("outcome = 'sent_again'").select("id", "base_revision")


@query("SELECT p_partkey AS source_id, CASE WHEN p_partkey % 9 = 0 THEN 'missing' WHEN p_partkey % 3 = 2 THEN 'late' WHEN p_partkey % 4 = 0 THEN 'incomplete' ELSE 'bound' END AS outcome FROM part")
def t30_bound_profiles(s, d):
    k = F.col("p_partkey")
    p = table(s, d, "part").select(k.alias("source_id"), F.element_at(F.array(F.lit("registered"), F.lit("hash_verified"), F.lit("validated")), (k % 3 + 1).cast("int")).alias("status"))
    commands = p.select("source_id", F.lit("a").alias("layout_profile"), F.when(F.col("source_id") % 4 > 0, "b").alias("answer_profile"))
    return guards.bound_profiles(p.where("source_id % 9 > 0"), commands)


@query(
    """WITH x AS (SELECT p_partkey AS source_id, p_partkey % 4 AS now_at, p_size % 4 AS target, p_partkey % 9 = 0 AS gone, p_partkey % 5 > 0 AS evidence FROM part)
SELECT source_id, CASE WHEN gone THEN 'missing' WHEN target = 3 OR now_at = 3 THEN 'unknown' WHEN now_at >= target THEN 'past' WHEN target <> now_at + 1 THEN 'skips' WHEN NOT evidence THEN 'no_evidence' ELSE 'advanced' END AS outcome FROM x"""
)
def t31_advanced(s, d):
    k = F.col("p_partkey")
    names = F.array(*[F.lit(x) for x in ("registered", "hash_verified", "profile_matched", "blocked")])
    p = table(s, d, "part").select(k.alias("source_id"), F.element_at(names, (k % 4 + 1).cast("int")).alias("status"), F.element_at(names, F.col("p_size") % 4 + 1).alias("target"), F.when(k % 5 > 0, True).alias("evidence"))
    return guards.advanced(p.where("source_id % 9 > 0"), p.select("source_id", "target", "evidence"), ["registered", "hash_verified", "profile_matched"])


# --- runs: one of each order, with the order's lines as questions ---------------------------------------------------

RUNS = """WITH q AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_partkey % 50 AS question_id, l_suppkey, l_linenumber FROM lineitem),
runs AS (SELECT run_id, list(DISTINCT question_id) FILTER (question_id % 3 > 0) AS question_ids, run_id % 3 AS revision, min(question_id) AS current_question FROM q GROUP BY run_id),
drafts AS (SELECT DISTINCT run_id, question_id, 'old' AS text, CASE WHEN question_id % 2 = 0 THEN run_id * 100 + question_id END AS attempt_id FROM q WHERE question_id % 3 = 1),
atts AS (SELECT DISTINCT run_id, question_id, run_id * 100 + question_id AS attempt_id FROM q WHERE question_id % 4 > 0),
cmd AS (SELECT run_id, seq, question_id, l_suppkey % 3 AS expected, 'new' AS text, CASE WHEN l_suppkey % 2 = 0 THEN run_id * 100 + question_id END AS attempt_id, l_suppkey FROM q),
ok AS (SELECT cmd.* FROM cmd JOIN runs USING (run_id) WHERE expected = revision AND question_ids IS NOT NULL AND list_contains(question_ids, question_id) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq) = 1)
"""


def _q(s, d):
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return _dealt_lines(s, d).select(F.col("l_orderkey").alias("run_id"), n.alias("seq"), (F.col("l_partkey") % 50).alias("question_id"), "l_suppkey")


def _training(s, d):
    q = _q(s, d)
    r, i = F.col("run_id"), F.col("question_id")
    all_runs = q.groupBy("run_id").agg(F.collect_set(F.when(i % 3 > 0, i)).alias("question_ids"), F.min("question_id").alias("current_question")).withColumn("revision", r % 3)
    drafts = q.where(i % 3 == 1).select("run_id", "question_id").distinct().select("run_id", "question_id", F.lit("old").alias("text"), F.when(i % 2 == 0, r * 100 + i).alias("attempt_id"))
    made = q.where(i % 4 > 0).select("run_id", "question_id").distinct().withColumn("attempt_id", r * 100 + i)
    u = F.col("l_suppkey")
    commands = q.select("run_id", "seq", "question_id", (u % 3).alias("expected"), F.lit("new").alias("text"), F.when(u % 2 == 0, r * 100 + i).alias("attempt_id"), F.when(u % 5 > 0, "richtig").alias("correctness"))
    return all_runs, drafts, made, commands


@query("SELECT r.run_id, coalesce(ok.question_id, r.current_question) AS current_question, r.revision + (ok.run_id IS NOT NULL)::INT AS revision FROM runs r LEFT JOIN ok USING (run_id)", RUNS)
def t43_moved_cursors(s, d):
    all_runs, _, _, commands = _training(s, d)
    return runs.moved(all_runs, commands).select("run_id", "current_question", "revision")


@query(
    """, n AS (SELECT run_id, question_id, text, attempt_id FROM ok WHERE attempt_id IS NULL OR attempt_id IN (SELECT attempt_id FROM atts))
SELECT * FROM n UNION ALL SELECT run_id, question_id, text, attempt_id FROM drafts ANTI JOIN n USING (run_id, question_id)""",
    RUNS,
)
def t42_saved_drafts(s, d):
    all_runs, drafts, made, commands = _training(s, d)
    return runs.drafted(drafts, all_runs, commands, made)


@query("SELECT run_id AS training_run_id, question_id, attempt_id, CASE WHEN l_suppkey % 5 > 0 THEN 'richtig' END AS correctness, CASE WHEN question_id % 5 > 0 THEN 'm' || question_id % 4 END AS module FROM ok", RUNS)
def t24_training_attempts(s, d):
    all_runs, _, _, commands = _training(s, d)
    i = F.col("question_id")
    kept = _q(s, d).where(i % 5 > 0).select("run_id", "question_id").distinct().withColumn("module", F.concat(F.lit("m"), (i % 4).cast("string")))
    return runs.attempted(all_runs, kept, commands)


@query("SELECT run_id, question_id, CASE WHEN EXISTS (SELECT 1 FROM ok JOIN atts a USING (run_id, question_id, attempt_id) WHERE ok.run_id = dr.run_id AND ok.attempt_id = dr.attempt_id) THEN '' ELSE text END AS text FROM drafts dr", RUNS)
def t44_removed_attempts(s, d):
    all_runs, drafts, made, commands = _training(s, d)
    return runs.attempt_removed(made, drafts, all_runs, commands)[1].drop("attempt_id")


@query("SELECT DISTINCT run_id FROM (SELECT run_id, unnest(question_ids) AS question_id FROM runs) ANTI JOIN (SELECT run_id, question_id FROM drafts WHERE attempt_id IS NOT NULL) USING (run_id, question_id)", RUNS)
def f43_incomplete_runs(s, d):
    all_runs, drafts, _, _ = _training(s, d)
    return runs.incomplete(all_runs, drafts)


@query(
    """WITH rq AS (SELECT o_orderkey AS seq, o_custkey AS user_id, 'd' || o_orderkey % 7 AS definition_key, CASE WHEN o_orderkey % 6 = 0 THEN 1 + o_orderkey % 3 END AS stage, o_orderkey % 10 = 0 AS uncertainty, o_orderkey % 4 = 0 AS restart, CASE o_orderkey % 8 WHEN 0 THEN [] WHEN 1 THEN [1, 1] WHEN 2 THEN NULL ELSE [1, 2] END AS ids FROM orders),
x AS (SELECT rq.*, p.user_id IS NOT NULL AS saved, rq.user_id % 5 > 0 AS there FROM rq LEFT JOIN (SELECT DISTINCT user_id, definition_key FROM rq WHERE user_id % 3 = 0 AND definition_key < 'd4') p USING (user_id, definition_key)),
y AS (SELECT *, CASE WHEN stage IS NULL AND NOT uncertainty AND NOT restart AND saved THEN CASE WHEN there THEN 'resumed' ELSE 'missing_run' END WHEN ids IS NULL OR len(ids) = 0 OR ids = [1, 1] OR (stage IS NOT NULL AND uncertainty) THEN 'refused' ELSE 'started' END AS action FROM x)
SELECT user_id, definition_key, action, CASE WHEN action = 'resumed' THEN user_id || definition_key END AS run_id, CASE WHEN action = 'started' THEN CASE WHEN uncertainty THEN 'uncertainty' WHEN stage IS NULL THEN 'bank' ELSE 'stage' END END AS kind FROM y"""
)
def t23_started_trainings(s, d):
    k = F.col("o_orderkey")
    pair = lambda a, b: F.array(F.lit(a).cast("long"), F.lit(b).cast("long"))
    ids = F.when(k % 8 == 0, F.array().cast("array<long>")).when(k % 8 == 1, pair(1, 1)).when(k % 8 == 2, None).otherwise(pair(1, 2))
    rq = table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("d"), (k % 7).cast("string")).alias("definition_key"), F.when(k % 6 == 0, k % 3 + 1).alias("stage"), (k % 10 == 0).alias("uncertainty"), (k % 4 == 0).alias("restart"), ids.alias("question_ids"))
    progress = rq.where("user_id % 3 = 0 and definition_key < 'd4'").select("user_id", "definition_key").distinct().withColumn("run_id", F.concat(F.col("user_id").cast("string"), "definition_key"))
    return runs.started(rq, progress, progress.where("user_id % 5 > 0").select("user_id", "run_id"))


@query(
    """, g AS (SELECT u.user_id, i.module, i.question_id, l.correctness FROM (SELECT DISTINCT user_id FROM latest) u CROSS JOIN inventory i LEFT JOIN latest l ON l.user_id = u.user_id AND l.question_id = i.question_id)
SELECT user_id, module, count(*) AS total, count(correctness) AS completed, count(*) FILTER (correctness = 'richtig') AS correct, round(100.0::DOUBLE * count(*) FILTER (correctness = 'richtig') / nullif(count(correctness), 0)) AS rate,
 coalesce(list_sort(list(question_id) FILTER (correctness IS NOT NULL)), [])::VARCHAR AS done, arg_min(question_id, (CASE WHEN correctness IS NULL THEN 0 WHEN correctness <> 'richtig' THEN 1 ELSE 2 END, question_id)) AS resume FROM g GROUP BY user_id, module""",
    SQL,
)
def a17_module_progress(s, d):
    from mnemos.operators import progress as pr
    from mnemos.plans.queries import _latest

    states = _latest(s, d).select("user_id", "question_id", pr.state_of(F.col("correctness")).alias("state"))
    x = runs.module_progress(inventory(s, d).withColumn("pos", F.col("question_id")), states)
    return x.withColumn("done", F.concat(F.lit("["), F.array_join(F.coalesce("done", F.array()).cast("array<string>"), ", "), F.lit("]")))


PROGRESS = """WITH p AS (SELECT o_custkey AS user_id, o_orderkey AS id, 'r' || o_orderkey % 5 AS run_id, 1 + o_orderkey % 3 AS generation, 2 + o_orderkey % 4 AS revision, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS reset_at, 'e' || o_custkey % 3 AS exam, 'm' || o_orderkey % 4 AS module FROM orders) """


def _progress(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return table(s, d, "orders").select(c.alias("user_id"), k.alias("id"), t("r", k % 5).alias("run_id"), (k % 3 + 1).alias("generation"), (k % 4 + 2).alias("revision"), F.when(k % 2 == 0, F.col("o_orderdate")).alias("reset_at"), t("e", c % 3).alias("exam"), t("m", k % 4).alias("module"))


@query("SELECT user_id, id, generation + (id % 3 = 0 AND id % 7 > 0)::INT AS generation, revision + (id % 3 = 0 AND id % 7 > 0)::INT AS revision, CASE WHEN id % 3 = 0 AND id % 7 > 0 THEN TIMESTAMP '2024-01-31' ELSE reset_at END AS reset_at FROM p", PROGRESS)
def t21_reset_progress(s, d):
    p = _progress(s, d)
    i = F.col("id")
    commands = p.select("user_id", "id", F.when(i % 7 > 0, F.col("run_id")).otherwise("other").alias("run_id"), F.when(i % 3 == 0, F.col("revision")).when(i % 3 == 1, F.lit(0)).alias("expected"), F.lit("2024-01-31").cast("timestamp_ntz").alias("at"), F.lit(1).alias("seq"))
    return runs.reset(p, commands)


@query("SELECT user_id, id, run_id, id % 10 AS question_id, exam, module, generation FROM p WHERE id % 6 > 0", PROGRESS)
def t45_stamped_sessions(s, d):
    p = _progress(s, d)
    i = F.col("id")
    return runs.stamped(p.select("user_id", "id", F.when(i % 6 > 0, F.col("run_id")).alias("run_id"), (i % 10).alias("question_id")), p)


@query(
    """, m AS (SELECT DISTINCT user_id, module AS id, question_id FROM (SELECT DISTINCT user_id FROM attempts), inventory WHERE (user_id + module) % 4 > 0)
SELECT user_id, id, question_id, CASE correctness WHEN 'richtig' THEN 'correct' WHEN 'teilweise' THEN 'partial' WHEN 'falsch' THEN 'incorrect' ELSE 'unanswered' END AS state, 1 AS generation, 1 AS revision FROM m LEFT JOIN latest USING (user_id, question_id)""",
    SQL,
)
def t19_ensured_progress(s, d):
    from mnemos.plans.queries import _latest

    lists = inventory(s, d).groupBy(F.col("module").alias("id")).agg(F.collect_list("question_id").alias("a")).select("id", F.concat("a", "a").alias("question_ids"))
    modules = attempts(s, d).select("user_id").distinct().join(lists)
    return runs.ensured(modules, modules.where("(user_id + id) % 4 = 0").select("user_id", "id"), _latest(s, d))


@query(
    """, st AS (SELECT DISTINCT user_id, question_id, 'unanswered' AS state, NULL::BIGINT AS attempt_id FROM attempts), l AS (SELECT user_id, question_id, arg_max(correctness, (attempt_id % 17, attempt_id)) AS c, arg_max(attempt_id, (attempt_id % 17, attempt_id)) AS a FROM attempts WHERE correctness IS NOT NULL GROUP BY ALL)
SELECT user_id, question_id, CASE c WHEN 'richtig' THEN 'correct' WHEN 'teilweise' THEN 'partial' WHEN 'falsch' THEN 'incorrect' ELSE 'unanswered' END AS state, a AS attempt_id FROM st LEFT JOIN l USING (user_id, question_id)""",
    SQL,
)
def t20_saved_states(s, d):
    a = attempts(s, d).withColumn("progress_order", F.col("attempt_id") % 17)
    states = a.select("user_id", "question_id").distinct().withColumns({"state": F.lit("unanswered"), "attempt_id": F.lit(None).cast("long")})
    return runs.saved_states(states, a)


@query(
    """SELECT question_id, module, CASE WHEN module < 2 THEN 'M' || module END AS title, CASE WHEN question_id % 4 = 1 THEN 'reviewed' WHEN question_id % 7 > 0 THEN 'text' END AS text,
 CASE WHEN kind = 'multiple_choice' AND question_id % 5 > 0 THEN question_id % 5 END AS answer, CASE WHEN kind = 'multi_part' AND question_id % 3 > 0 THEN 'solution' END AS solution,
 CASE WHEN question_id % 7 = 0 THEN FALSE WHEN kind = 'multiple_choice' THEN question_id % 5 > 0 ELSE question_id % 3 > 0 END AS valid FROM (SELECT question_id, module, CASE WHEN question_id % 7 > 0 THEN kind END AS kind FROM inventory)""",
    SQL,
)
def j23_snapshots(s, d):
    q = inventory(s, d)
    i = F.col("question_id")
    modules = q.where("module < 2").select("module").distinct().withColumn("title", F.concat(F.lit("M"), F.col("module").cast("string")))
    return runs.snapshots(q.select("question_id", "module"), modules, q.where(i % 7 > 0).select("question_id", "kind", F.lit("text").alias("text")), q.where(i % 4 == 1).select("question_id", F.lit("reviewed").alias("text")), q.where(i % 5 > 0).select("question_id", (i % 5).alias("answer")), q.where(i % 3 > 0).select("question_id", F.lit("solution").alias("solution")))
