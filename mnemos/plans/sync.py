"""Queries of the standing synchronisation: streams over the events, with their state in the state store."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.adapters import table
from mnemos.plans.base import query
from mnemos.sources.commits import work_folder
from mnemos.streaming import sync


#: Buckets of the state at least, and events that come to one.
BUCKETS, EVENTS = 512, 2_000


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files."""
    return s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events*.parquet")


def _mutations(e: DataFrame) -> DataFrame:
    """Each event as a mutation of one of its user's six records; ids come back for other data, and every fifth mutation is sent again."""
    k = F.get_json_object("props", "$.k").cast("int")
    grade = F.when(F.col("event_type").isin("purchase", "view"), "richtig").otherwise("falsch")
    deleted = F.col("event_type") == "error"
    value = F.to_json(F.struct((k % 3).alias("question_id"), grade.alias("correctness"), F.struct(F.col("event_id").alias("n")).alias("note")))
    rows = e.select(
        F.col("user_id").cast("string").alias("user_id"), F.when(k % 2 == 0, "attempts").otherwise("questionNotes").alias("entity"), (k % 3).cast("string").alias("id"), F.col("event_id").alias("seq"),
        (F.col("event_id") % 400).cast("string").alias("mutation_id"), (F.col("event_id") % 6).alias("base_revision"), deleted.alias("deleted"), F.when(~deleted, value).alias("value"),
    )
    again = F.when(F.col("seq") % 5 == 0, F.array(F.lit(0), F.lit(10_000_000))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("later", F.explode(again)).withColumn("seq", F.col("seq") + F.col("later")).drop("later")


SWAPS = """WITH RECURSIVE m AS (SELECT user_id::VARCHAR AS user_id, CASE WHEN k % 2 = 0 THEN 'attempts' ELSE 'questionNotes' END AS entity, (k % 3)::VARCHAR AS id, event_id + later AS seq, event_id, (event_id % 400)::VARCHAR AS mutation_id, event_id % 6 AS base,
  event_type = 'error' AS deleted, CASE WHEN event_type <> 'error' THEN CASE WHEN event_type IN ('purchase', 'view') THEN 'richtig' ELSE 'falsch' END END AS grade,
  CASE WHEN event_type <> 'error' THEN '{"question_id":' || k % 3 || ',"correctness":"' || CASE WHEN event_type IN ('purchase', 'view') THEN 'richtig' ELSE 'falsch' END || '","note":{"n":' || event_id || '}}' END AS value
  FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k, unnest(CASE WHEN event_id % 5 = 0 THEN [0, 10000000] ELSE [0] END) AS later FROM events)),
u AS (SELECT *, concat_ws('|', entity, id, base, deleted, value) AS said, first_value(concat_ws('|', entity, id, base, deleted, value)) OVER (PARTITION BY user_id, mutation_id ORDER BY seq) AS first_said, row_number() OVER (PARTITION BY user_id, mutation_id ORDER BY seq) AS use FROM m),
x AS (SELECT *, CASE WHEN use = 1 THEN 'new' WHEN said = first_said THEN 'again' ELSE 'reused' END AS kind, row_number() OVER (PARTITION BY user_id, entity, id ORDER BY seq, mutation_id) AS n FROM u),
f AS (SELECT DISTINCT user_id, entity, id, 0::BIGINT AS n, 0::BIGINT AS revision, NULL::VARCHAR AS value, FALSE AS deleted, NULL::VARCHAR AS history, NULL::VARCHAR AS reason FROM x
 UNION ALL SELECT user_id, entity, id, n, revision + ok::BIGINT, CASE WHEN ok THEN CASE WHEN d THEN NULL ELSE v END ELSE value END, CASE WHEN ok THEN d ELSE deleted END, CASE WHEN ok AND entity = 'attempts' AND NOT d THEN grade ELSE history END,
   CASE WHEN kind = 'new' AND NOT ok THEN CASE WHEN base <> revision THEN 'revision_mismatch' ELSE 'immutable_history' END END
  FROM (SELECT f.user_id, f.entity, f.id, x.n, f.revision, f.value, f.deleted, f.history, x.deleted AS d, x.value AS v, grade, kind, base,
    kind = 'new' AND base = f.revision AND (f.entity <> 'attempts' OR x.deleted OR f.history IS NULL OR f.history = grade) AS ok
   FROM f JOIN x ON (x.user_id, x.entity, x.id, x.n) = (f.user_id, f.entity, f.id, f.n + 1))),
told AS (SELECT x.*, f.revision, f.reason, f.value AS now, f.deleted AS gone FROM x JOIN f USING (user_id, entity, id, n)),
outcomes AS (SELECT t.user_id, t.entity, t.id, t.seq, t.mutation_id, CASE t.kind WHEN 'reused' THEN 'reused' WHEN 'new' THEN CASE WHEN t.reason IS NULL THEN 'applied' ELSE 'conflict' END ELSE CASE WHEN o.reason IS NULL THEN 'duplicate' ELSE 'conflict' END END AS status,
  CASE t.kind WHEN 'new' THEN t.reason WHEN 'again' THEN o.reason END AS reason, CASE WHEN t.kind = 'again' THEN o.revision ELSE t.revision END AS revision, t.now AS value, t.gone AS deleted
 FROM told t LEFT JOIN told o ON o.kind = 'new' AND t.kind = 'again' AND (o.user_id, o.mutation_id) = (t.user_id, t.mutation_id))
"""


@query("SELECT * FROM outcomes", SWAPS)
def t09_compare_and_swap(s, d):
    """The answer to every mutation of a stream: by user and id first, then by record, both with state in the state store."""
    at = work_folder(s, "swaps")
    buckets = max(BUCKETS, ceil(table(s, d, "events").count() / EVENTS))
    sync.started(sync.swapped(_mutations(_stream(s, d)), buckets=buckets), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return s.read.schema(sync._DDL(sync.OUTCOMES)).parquet(f"{at}/out")


@query("SELECT entity, status, reason, count(*) AS mutations FROM outcomes GROUP BY ALL", SWAPS)
def t10_decisions(s, d):
    """How often each entity's mutations were applied, repeated, refused, or told another use of their id; without a state store."""
    return sync.swapped_by_fold(_mutations(table(s, d, "events"))).groupBy("entity", "status", "reason").agg(F.count("*").alias("mutations"))


def _signals(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    what = F.when(kind == "signup", "login").when(kind == "error", "logout").when(kind == "view", "request").when(kind == "click", "online").otherwise("done")
    return e.select(F.col("user_id").cast("string").alias("device"), F.col("event_id").alias("seq"), at.alias("at"), what.alias("kind"), (F.get_json_object("props", "$.k").cast("int") % 2).cast("string").alias("user"))


_OUT = """STRUCT(run BIGINT, event VARCHAR, usr VARCHAR, generation BIGINT, "at" BIGINT, cause VARCHAR, joined BIGINT, outcome VARCHAR)[]"""
RUNS = f"""WITH RECURSIVE sig AS (SELECT user_id::VARCHAR AS device, event_id AS seq, (epoch_us(ts) // 1000)::BIGINT AS "at", CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'logout' WHEN 'view' THEN 'request' WHEN 'click' THEN 'online' ELSE 'done' END AS kind,
  (CAST(props->>'$.k' AS INT) % 2)::VARCHAR AS who FROM events),
-- each device's timer a second before the end of all signals
ends AS (SELECT device, 9223372036854775807 AS seq, (SELECT max("at") - 1001 FROM sig) AS "at", 'end' AS kind, NULL AS who FROM sig GROUP BY device),
ev AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY "at", seq) AS n FROM (SELECT * FROM sig UNION ALL SELECT * FROM ends)),
f AS (SELECT device, 0::BIGINT AS n, 0::BIGINT AS gen, NULL::VARCHAR AS account, NULL::VARCHAR AS usr, 0::BIGINT AS rgen, 0::BIGINT AS run, 0::BIGINT AS joined, []::STRUCT(u VARCHAR, c BIGINT)[] AS waiting, min("at") FILTER (kind <> 'end') + 30000 AS tick, []::{_OUT} AS outs FROM ev GROUP BY device
 UNION ALL
 SELECT device, n, gen, account, CASE WHEN head IS NOT NULL THEN head WHEN ended THEN NULL WHEN starts THEN caller ELSE usr END, CASE WHEN head IS NOT NULL OR starts THEN gen ELSE rgen END, run + (head IS NOT NULL OR starts)::BIGINT,
  CASE WHEN head IS NOT NULL THEN list_sum(list_transform(list_filter(waiting, lambda w: w.u = head), lambda w: w.c))::BIGINT - 1 WHEN starts THEN 0 WHEN joins THEN joined + 1 ELSE joined END,
  CASE WHEN head IS NOT NULL THEN list_filter(waiting, lambda w: w.u <> head) WHEN waits THEN list_append(waiting, {{'u': caller, 'c': 1::BIGINT}}) ELSE waiting END, tick,
  outs || CASE WHEN ended THEN [{{'run': run, 'event': 'end', 'usr': usr, 'generation': rgen, 'at': "at", 'cause': NULL, 'joined': joined, 'outcome': CASE WHEN rgen <> gen THEN 'account_changed' WHEN account = usr THEN 'completed' ELSE 'refused' END}}] ELSE []::{_OUT} END
   || CASE WHEN starts OR head IS NOT NULL THEN [{{'run': run + 1, 'event': 'start', 'usr': coalesce(head, caller), 'generation': gen, 'at': "at", 'cause': CASE WHEN head IS NULL THEN kind ELSE 'waited' END, 'joined': 0::BIGINT, 'outcome': NULL}}] ELSE []::{_OUT} END
 FROM (SELECT *, CASE WHEN ended THEN waiting[1].u END AS head, caller IS NOT NULL AND usr IS NULL AS starts, coalesce(caller = usr AND rgen = gen, FALSE) AS joins, caller IS NOT NULL AND usr IS NOT NULL AND NOT coalesce(caller = usr AND rgen = gen, FALSE) AS waits
 FROM (SELECT device, n, "at", kind, gen + (kind IN ('login', 'logout'))::BIGINT AS gen, CASE kind WHEN 'login' THEN who WHEN 'logout' THEN NULL ELSE account END AS account, CASE kind WHEN 'login' THEN who WHEN 'online' THEN account WHEN 'request' THEN who END AS caller,
   usr, rgen, run, joined, waiting, tick, outs, kind = 'done' AND usr IS NOT NULL AS ended
 FROM (SELECT device, n, "at", kind, who, gen, account, CASE WHEN starts THEN account ELSE usr END AS usr, CASE WHEN starts THEN gen ELSE rgen END AS rgen, run + starts::BIGINT AS run, CASE WHEN starts THEN c - 1 WHEN joins THEN joined + c ELSE joined END AS joined,
   CASE WHEN c > 0 AND account IS NOT NULL AND NOT starts AND NOT joins THEN list_append(waiting, {{'u': account, 'c': c}}) ELSE waiting END AS waiting, tick + c * 30000 AS tick,
   CASE WHEN starts THEN [{{'run': run + 1, 'event': 'start', 'usr': account, 'generation': gen, 'at': tick, 'cause': 'timer', 'joined': 0::BIGINT, 'outcome': NULL}}] ELSE []::{_OUT} END AS outs
 FROM (SELECT *, c > 0 AND account IS NOT NULL AND usr IS NULL AS starts, c > 0 AND coalesce(account = usr AND rgen = gen, FALSE) AS joins
 FROM (SELECT f.device, e.n, e."at", kind, who, gen, account, usr, rgen, run, joined, waiting, tick, CASE WHEN e."at" >= tick THEN (e."at" - tick) // 30000 + 1 ELSE 0 END AS c FROM f JOIN ev e ON e.device = f.device AND e.n = f.n + 1)))))),
runs AS (SELECT device, o.run, o.event, o.usr AS "user", o.generation, o."at", o.cause, o.joined, o.outcome FROM (SELECT device, unnest(outs) AS o FROM f))
"""


@query("SELECT * FROM runs", RUNS)
def t13_sync_runs(s, d):
    """Starts and ends of the runs of every device, with a timer that fires each 30 seconds of event time."""
    at = work_folder(s, "runs")
    sync.started(sync.runs(_signals(_stream(s, d))), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return s.read.schema(sync._DDL(sync.RUNS)).parquet(f"{at}/out")


@query("""SELECT device, "user", generation, count(*) FILTER (event = 'start') AS runs, sum(joined) FILTER (event = 'end')::BIGINT AS joined, count(*) FILTER (outcome = 'account_changed') AS changed FROM runs GROUP BY ALL""", RUNS)
def t46_coalesced_runs(s, d):
    """How many runs each user and generation of a device had, and how many calls joined one; as a fold without a state store."""
    found = sync.runs_by_fold(_signals(table(s, d, "events")))
    return found.groupBy("device", "user", "generation").agg(F.count_if(F.col("event") == "start").alias("runs"), F.sum(F.when(F.col("event") == "end", F.col("joined"))).alias("joined"), F.count_if(F.col("outcome") == "account_changed").alias("changed"))
