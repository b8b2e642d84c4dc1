"""Stores, caches and datasets over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemos.adapters import SQL, attempts, inventory, table
from mnemos.operators import bank, geometry, releases, results, storage
from mnemos.plans.base import query
from mnemos.plans.scalars import FLAGS, _flags
from mnemos.streaming import replication


@query("SELECT count(*) AS rows, count(*) FILTER (invalidated) AS invalid FROM a WHERE NOT coalesce(invalidated, FALSE) AND deleted_at IS NULL AND discarded_at IS NULL AND coalesce(valid, TRUE)", FLAGS)
def f02_eligible_rows(s, d):
    return _flags(s, d).where(results.eligible()).agg(F.count("*").alias("rows"), F.count_if("invalidated").alias("invalid"))


@query("SELECT device, mutation_id, (row_number() OVER (PARTITION BY device ORDER BY seq, mutation_id) - 1) // 100 AS batch FROM (SELECT user_id AS device, event_id // 2 AS mutation_id, min(event_id) AS seq FROM events GROUP BY ALL)")
def s26_pushed_batches(s, d):
    k = F.col("event_id")
    return storage.pushed(table(s, d, "events").select(F.col("user_id").alias("device"), F.floor(k / 2).alias("mutation_id"), k.alias("seq")))


@query("SELECT 'attempts' AS store, count(*) AS rows FROM events WHERE user_id = 7 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'none', 0")
def s22_snapshot(s, d):
    stores = {"attempts": table(s, d, "events").select("user_id"), "orders": table(s, d, "orders").select(F.col("o_custkey").alias("user_id")), "none": table(s, d, "events").limit(0).select("user_id")}
    return storage.snapshot(stores, F.col("user_id") == 7)


@query("SELECT o_custkey AS id, CASE WHEN o_custkey % 3 > 0 THEN 'kept' ELSE min(o_orderstatus) END AS status FROM orders GROUP BY o_custkey")
def s35_migrated_registry(s, d):
    derived = table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return storage.migrated(derived.where("id % 3 > 0").select("id", F.lit("kept").alias("status")).distinct(), derived, "id")


@query("SELECT o_orderkey AS page, coalesce(string_agg(l_returnflag || l_linenumber, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) FILTER (l_suppkey % 3 > 0), '') AS texts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def s06_page_lines(s, d):
    li = table(s, d, "lineitem")
    line = F.struct(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_partkey")).alias("x0"), F.col("l_linenumber").alias("y0"))
    pages = li.groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_list(line).alias("lines")).withColumns({"width": F.lit(595.0), "height": F.lit(842.0)})
    return storage.page_lines(pages).select("page", F.array_join(F.transform("lines", lambda x: x["text"]), ",").alias("texts"))


def _cached(s, d):
    k = F.col("o_orderkey")
    pages = table(s, d, "orders").select(F.col("o_custkey").alias("source"), k.alias("page"), F.lit("v2").alias("key"), F.md5(k.cast("string")).alias("mark"))
    p = F.col("page")
    return pages, pages.where(p % 3 > 0).select("source", "page", F.when(p % 4 > 0, "v2").otherwise("v1").alias("key"), F.when(p % 5 > 0, F.col("mark")).alias("mark"))


@query("SELECT o_custkey AS source, o_orderkey AS page FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 OR o_orderkey % 5 = 0")
def s37_changed_pages(s, d):
    return storage.changed_pages(*_cached(s, d)).select("source", "page")


@query("SELECT o_orderkey AS page FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 > 0 AND o_orderkey % 4 > 0")
def s38_changed_pixels(s, d):
    pages, cache = _cached(s, d)
    return storage.changed_pages(pages.join(cache.where("key = 'v2'").select("source", "page"), ["source", "page"], "left_semi"), cache).select("page")


@query("SELECT o_orderkey AS page FROM orders WHERE o_orderkey % 3 = 0")
def s41_pages_left(s, d):
    pages, cache = _cached(s, d)
    return storage.changed_pages(pages, pages.join(cache.select("page"), "page", "left_semi")).select("page")


CACHES = "WITH c AS (SELECT o_custkey AS source, count(*) AS n, count(*) FILTER (o_orderkey % 9 > 0) AS have FROM orders GROUP BY o_custkey), x AS (SELECT source, CASE WHEN source % 5 = 0 THEN 'incomplete' WHEN source % 7 = 0 THEN 'hash' WHEN have <> n THEN 'pages' END AS problem FROM c) SELECT source, problem FROM x WHERE problem IS NOT NULL"


def _caches(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("page"))
    k = F.col("source")
    caches = o.groupBy("source").agg(F.count("*").alias("pages")).select("source", "pages", F.when(k % 5 > 0, "complete").alias("status"), F.lit("h").alias("source_sha"), F.when(k % 7 > 0, "h").alias("sha"))
    return storage.complete_caches(caches, o.where("page % 9 > 0"))


@query(CACHES)
def s36_cache_gate(s, d):
    return _caches(s, d)


@query(CACHES + " AND problem = 'pages'")
def s39_preview_cache(s, d):
    return _caches(s, d).where("problem = 'pages'")


@query("SELECT scope, CASE WHEN key % 4 > 0 THEN 'report ' || key END AS report FROM (SELECT o_custkey AS scope, max(o_orderkey) AS key FROM orders GROUP BY o_custkey)")
def s40_active_evidence(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("key"))
    reports = o.where("key % 4 > 0").withColumn("report", F.concat(F.lit("report "), F.col("key").cast("string")))
    return storage.active_evidence(o.groupBy("scope").agg(F.max("key").alias("active_key")), reports).select("scope", "report")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 6 = 0 OR l_linenumber > 4 AS missing FROM lineitem")
def s33_attachments(s, d):
    w = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").cast("string").alias("sha"), F.col("l_linenumber").alias("page"))
    cache = w.where("l_orderkey % 6 > 0 and page <= 4").select("sha", "page").distinct().withColumn("image", F.concat_ws("/", "sha", F.col("page").cast("string")))
    return storage.attachments(w, cache).select("l_orderkey", "l_linenumber", "l_partkey", "missing")


@query("SELECT o_custkey AS source, o_orderkey AS page, 'a,b' AS profiles FROM orders WHERE o_custkey % 2 = 0 AND o_custkey % 3 = 0")
def s42_shared_pages(s, d):
    pages = table(s, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("page"))
    k = F.col("source")
    profiles = pages.where(k % 2 == 0).select("source", F.lit("a").alias("profile")).unionByName(pages.where(k % 3 == 0).select("source", F.lit("b").alias("profile"))).distinct()
    return storage.layout_reuse(profiles, pages).withColumn("profiles", F.array_join("profiles", ","))


@query("SELECT o_custkey AS profile, max(o_orderkey) AS run FROM orders GROUP BY o_custkey HAVING arg_max(o_orderkey % 3, o_orderkey) > 0 AND arg_max(o_orderkey % 4, o_orderkey) > 0")
def s43_promoted_runs(s, d):
    k = F.col("o_orderkey")
    return storage.promoted(table(s, d, "orders").select(F.col("o_custkey").alias("profile"), k.alias("run"), F.when(k % 3 > 0, "compatible").alias("status"), F.when(k % 4 > 0, True).alias("approved")))


@query("SELECT c_custkey AS topic, 'run ' || c_custkey AS run_id FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 5 > 0")
def f42_resumable_runs(s, d):
    t = table(s, d, "customer").select(F.col("c_custkey").alias("topic"), F.to_json(storage.topic_definition(F.col("c_custkey").cast("string"))).alias("definition_key"))
    run = F.concat(F.lit("run "), F.col("topic").cast("string")).alias("run_id")
    return storage.resumable(t, t.where("topic % 3 > 0").select("definition_key", run), t.where("topic % 5 > 0").select(run))


@query("""SELECT c_custkey AS topic, '{"examIds":[],"knowledgeTopicIds":[],"moduleIds":[],"questionTypeIds":[],"wisoTopicIds":["' || c_custkey || '"]}' AS definition FROM customer""")
def f58_topic_definitions(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("topic"), F.to_json(storage.topic_definition(F.col("c_custkey").cast("string"))).alias("definition"))


@query("SELECT question_id, question_id % 7 AS answer, CASE WHEN question_id % 2 = 0 THEN 3 END AS machine_answer, 'confirmed' AS status, TRUE AS locked FROM inventory WHERE question_id % 7 BETWEEN 1 AND 5 AND question_id % 3 > 0", SQL)
def f48_manual_rows(s, d):
    q, k = inventory(s, d), F.col("question_id")
    return storage.manual_rows(q.select("question_id", F.when(k % 2 == 0, 3).alias("answer"), F.lit("e").alias("evidence")), q.where(k % 3 > 0).select("question_id", (k % 7).alias("answer"))).drop("evidence")


@query("SELECT o_custkey AS folder, rule FROM (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderkey % 10) AS numbers, count(DISTINCT o_orderkey) AS anchors, count(*) FILTER (o_orderkey % 17 = 0) AS bad FROM orders GROUP BY o_custkey), (VALUES ('count'), ('numbers'), ('anchors'), ('hash')) r(rule) WHERE CASE rule WHEN 'count' THEN n <> 12 WHEN 'numbers' THEN numbers <> n WHEN 'anchors' THEN anchors <> n ELSE bad > 0 END")
def v23_preview_integrity(s, d):
    k = F.col("o_orderkey")
    return storage.preview_counts(table(s, d, "orders").select(F.col("o_custkey").alias("folder"), (k % 10).alias("number"), k.alias("anchor"), F.lit("h").alias("sha"), F.when(k % 17 > 0, "h").alias("actual")), 12)


@query("SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id % 6 = 0")
def v31_cache_evidence(s, d):
    x = table(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha"))
    return releases.artifact_problems(x, x.where("doc_id % 6 > 0")).select("path")


@query("SELECT question_id, CASE WHEN question_id % 4 = 0 THEN 'override' ELSE kind END AS kind FROM inventory", SQL)
def s27_bank_dataset(s, d):
    q = inventory(s, d).select("question_id", "kind")
    return bank.override(q, q.where("question_id % 4 = 0").withColumn("kind", F.lit("override")))


@query("SELECT question_id, exam, coalesce(n, 0) AS attempts FROM inventory LEFT JOIN (SELECT question_id, count(*) AS n FROM attempts WHERE correctness = 'falsch' GROUP BY question_id) USING (question_id)", SQL)
def s28_topic_dataset(s, d):
    n = attempts(s, d).where("correctness = 'falsch'").groupBy("question_id").agg(F.count("*").alias("n"))
    return inventory(s, d).join(n, "question_id", "left").select("question_id", "exam", F.coalesce("n", F.lit(0)).alias("attempts"))


@query("SELECT scope, number::INT AS number, 'missing' AS problem FROM (SELECT DISTINCT o_custkey AS scope FROM orders), range(1, 26) t(number) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = scope AND 1 + o_orderkey % 25 = number) UNION ALL SELECT o_custkey, (1 + o_orderkey % 25)::INT, 'duplicate' FROM orders GROUP BY o_custkey, o_orderkey % 25 HAVING count(*) > 1")
def a23_preview_coverage(s, d):
    found = table(s, d, "orders").select(F.col("o_custkey").alias("scope"), (F.col("o_orderkey") % 25 + 1).cast("int").alias("number"))
    return geometry.number_coverage(found, found.select("scope").distinct().select("scope", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("number")))


@query("SELECT source_id, CASE WHEN source_id % 4 = 0 THEN 'missing' WHEN source_id % 6 = 0 THEN 'changed' END AS problem FROM (SELECT o_orderkey AS source_id FROM orders) WHERE source_id % 4 = 0 OR source_id % 6 = 0")
def j36_decided_datasets(s, d):
    k = F.col("path").cast("bigint")
    x = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.md5("o_orderstatus").alias("sha"))
    return releases.artifact_problems(x, x.where(k % 4 > 0).withColumn("sha", F.when(k % 6 > 0, F.col("sha")).otherwise("x"))).select(k.alias("source_id"), "problem")


@query("SELECT o_orderkey AS source_id FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 3 > 0")
def s02_gated_members(s, d):
    k = F.col("o_orderkey")
    o = table(s, d, "orders").select(k.alias("source_id"), F.md5(k.cast("string")).alias("sha256"), F.when(k % 4 > 0, "validated").otherwise("blocked").alias("status"))
    members = table(s, d, "orders").where(k % 3 > 0).select(F.concat(F.lit("m"), k.cast("string")).alias("member"), F.md5(k.cast("string")).alias("sha256"))
    return storage.gated_members(members, o)[0].select("source_id")


@query("""SELECT p_partkey, sha256(CASE WHEN p_partkey % 2 = 0 THEN '{"a":"' || p_brand || '","b":"' || p_type || '"}' ELSE p_name END) AS digest FROM part""")
def s11_artifact_digests(s, d):
    k = F.col("p_partkey")
    m = F.when(k % 4 == 0, F.create_map(F.lit("b"), "p_type", F.lit("a"), "p_brand")).otherwise(F.create_map(F.lit("a"), "p_brand", F.lit("b"), "p_type"))
    x = table(s, d, "part").withColumns({"entries": m, "path": F.when(k % 2 == 0, "x.json").otherwise("x.png")})
    return x.select("p_partkey", storage.artifact_digest(F.col("path"), F.col("p_name"), "entries").alias("digest"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def s48_backup_to_send(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return storage.backup(o.where("o_orderkey % 5 > 0"), o, "o_orderkey", True)[2].select("o_orderkey")


@query(
    """SELECT question_id, CASE WHEN question_id % 3 = 0 AND question_id % 2 = 0 THEN 'c' WHEN question_id % 5 = 0 THEN 'p' WHEN question_id % 7 > 3 THEN 'own' WHEN question_id % 4 > 1 THEN 'o' END AS text,
 CASE WHEN question_id % 3 = 0 AND question_id % 2 = 0 THEN 'cache' WHEN question_id % 5 = 0 THEN 'pdf_text' WHEN question_id % 7 > 3 THEN 'existing' WHEN question_id % 4 > 1 THEN 'ocr' ELSE 'none' END AS method FROM inventory""",
    SQL,
)
def g18_extracted_texts(s, d):
    q, k = inventory(s, d), F.col("question_id")
    own = q.select("question_id", F.lit("r").alias("revision"), F.when(k % 7 > 3, "own").when(k % 7 == 3, " ").alias("text"))
    cache = q.where(k % 3 == 0).select("question_id", F.when(k % 2 == 0, "r").otherwise("old").alias("revision"), F.lit("c").alias("text"))
    return storage.extracted(own, cache, q.where(k % 5 == 0).select("question_id", F.lit("p").alias("text")), q.select("question_id", F.lit("o").alias("text"), F.when(k % 4 > 1, 0.5).when(k % 4 == 1, 0.4).alias("confidence")))


@query("SELECT p_partkey AS item, i::INT AS row, (p_size * 14)::DOUBLE AS x, (p_partkey % 800 + (i - 1) * 12)::DOUBLE AS y FROM part, range(1, 6) t(i) WHERE p_size * 14 <= 595 AND p_partkey % 800 + 48 <= 842")
def g04_grid_centres(s, d):
    k = F.col("p_partkey")
    c = table(s, d, "part").select(k.alias("item"), (F.col("p_size") * 14).cast("double").alias("x"), (k % 800).cast("double").alias("y"), F.lit(12.0).alias("pitch"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    return storage.grid_centres(c)


LOG = "WITH l AS (SELECT user_id, event_id, CASE WHEN user_id % 3 > 0 THEN user_id * 10 ELSE 0 END + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS cursor FROM events) "


def _log(s, d):
    e = table(s, d, "events").select("user_id", "event_id", F.col("event_id").alias("seq"))
    last = e.where("user_id % 3 > 0").select("user_id", (F.col("user_id") * 10).alias("cursor")).distinct()
    return replication.cursors(e, last).select("user_id", "event_id", "cursor")


@query("SELECT * FROM l", LOG)
def t09_allocated_cursors(s, d):
    return _log(s, d)


@query(
    """, dv AS (SELECT DISTINCT user_id || '-' || event_id % 2 AS device, user_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id * 10 + 7 END AS seen FROM events),
x AS (SELECT device, user_id, cursor, row_number() OVER w AS n, count(*) OVER (PARTITION BY device) AS c FROM dv JOIN l USING (user_id) WHERE cursor > seen WINDOW w AS (PARTITION BY device ORDER BY cursor))
SELECT device, user_id, cursor, (n - 1) // 20 AS page, ((n - 1) // 20 + 1) * 20 < c AS more FROM x""",
    LOG,
)
def t12_pulled_pages(s, d):
    u, k = F.col("user_id"), F.col("event_id") % 2
    devices = table(s, d, "events").select(F.concat_ws("-", u.cast("string"), k.cast("string")).alias("device"), "user_id", F.when(k == 0, 0).otherwise(u * 10 + 7).alias("cursor")).distinct()
    return replication.pulls(_log(s, d), devices, 20)
