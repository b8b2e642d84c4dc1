"""Review and promotion: queues, confirmations bound to their evidence, merges that people's decisions win, releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parts_in_order(modules: DataFrame, questions: DataFrame) -> DataFrame:
    """the questions that a module declares and that exist, with their place in the declaration."""
    return modules.select("module", F.posexplode("numbers").alias("pos", "number")).join(questions, ["module", "number"]).select("module", "pos", "number", "question_id")


def availability(modules: DataFrame, registry: DataFrame) -> DataFrame:
    """open, or why not: blocked in the registry, or an event that says so."""
    x = modules.join(registry, "module", "left")
    said = F.exists("events", lambda e: F.rlike(e, F.lit("missing|incomplete")))
    reason = F.when(F.col("status") == "blocked", "blocked").when(F.coalesce(said, F.lit(False)), "incomplete").when(F.col("status").isNull(), "unregistered")
    return x.select("module", reason.isNull().alias("open"), reason.alias("reason"))


def confirmed(queue: DataFrame, confirmations: DataFrame, evidence: list[str]) -> tuple[DataFrame, DataFrame]:
    """Queue rows whose confirmation names the same evidence, and confirmations that fit no row."""
    keys = ["id", *evidence]
    return queue.join(confirmations.select(*keys, "answer"), keys), confirmations.join(queue.select(*keys), keys, "left_anti")


def merged(machine: DataFrame, manual: DataFrame) -> DataFrame:
    """The machine's rows with a person's answer where there is one; the machine's stays beside it."""
    return machine.join(manual.select("id", F.col("answer").alias("manual")), "id", "left").select("id", F.coalesce("manual", "answer").alias("answer"), F.col("answer").alias("machine"), F.col("manual").isNotNull().alias("locked"))


def changed_evidence(old: Column, new: Column) -> Column:
    """null counts as a value."""
    return ~old.eqNullSafe(new)


def differences(promoted: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """(key, missing | extra | differs) between two releases."""
    rest = [c for c in accepted.columns if c != key]
    mark = lambda df, n: df.select(key, F.sha2(F.to_json(F.struct(*rest)), 256).alias(n))
    x = mark(promoted, "a").join(mark(accepted, "b"), key, "full_outer")
    return x.where(~F.col("a").eqNullSafe(F.col("b"))).select(key, F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").otherwise("differs").alias("problem"))


def unique_decision(decisions: DataFrame) -> DataFrame:
    """Keys with exactly one reviewed decision, whose evidence is the current one."""
    one = decisions.where("reviewed").groupBy("key").agg(F.count("*").alias("n"), F.first("evidence").alias("evidence"), F.first("current").alias("current"), F.min("decision").alias("decision"))
    return one.where("n = 1 and evidence = current").select("key", "decision")


def downgraded(found: DataFrame, expected: DataFrame) -> DataFrame:
    """All rows of a scope need review when its numbers aren't the expected ones."""
    f = found.groupBy("scope").agg(F.array_sort(F.collect_set("number")).alias("have"))
    e = expected.groupBy("scope").agg(F.array_sort(F.collect_set("number")).alias("want"))
    x = f.join(e, "scope", "full_outer")
    missing, extra = F.size(F.array_except(F.coalesce("want", F.array()), F.coalesce("have", F.array()))), F.size(F.array_except(F.coalesce("have", F.array()), F.coalesce("want", F.array())))
    return x.select("scope", missing.alias("missing"), extra.alias("extra"), F.when((missing == 0) & (extra == 0), "ok").otherwise("needs_review").alias("status"))


def summaries(membership: DataFrame, patterns: DataFrame, most: int = 3) -> DataFrame:
    """Of each topic its number of questions and its first patterns."""
    p = patterns.select("topic", "pattern").distinct().withColumn("n", F.row_number().over(W.partitionBy("topic").orderBy("pattern"))).where(F.col("n") <= most)
    p = p.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list("pattern")), "|").alias("patterns"))
    return membership.groupBy("topic").agg(F.count_distinct("question_id").alias("questions")).join(p, "topic", "left")


def reconciled(old: DataFrame, new: DataFrame) -> DataFrame:
    """Locked rows keep their topics and get the new reasons too; all others take the proposal."""
    o = old.select("id", F.col("topics").alias("old_topics"), F.col("reasons").alias("old_reasons"), "locked")
    x = new.join(o, "id", "left")
    lock = F.coalesce("locked", F.lit(False))
    return x.select("id", F.when(lock, F.col("old_topics")).otherwise(F.col("topics")).alias("topics"), F.when(lock, F.array_union("old_reasons", "reasons")).otherwise(F.col("reasons")).alias("reasons"), lock.alias("locked"))


def acknowledged(pending: DataFrame, acks: DataFrame) -> DataFrame:
    """What stays pending; a change made since the acknowledged one is rebased on its revision."""
    x = pending.join(acks.select("entity", "id", F.col("mutation_id").alias("acked"), F.col("revision").alias("remote")), ["entity", "id"], "left")
    return x.where(~F.col("mutation_id").eqNullSafe(F.col("acked"))).select("entity", "id", "mutation_id", F.coalesce("remote", "base_revision").alias("base_revision"))


def prefix_violations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids that lost or changed an event, or vanished: logs only grow."""
    x = old.select("id", F.col("events").alias("was")).join(new.select("id", F.col("events").alias("now")), "id", "left")
    return x.where(F.col("now").isNull() | (F.slice(F.coalesce("now", F.array().cast("array<string>")), F.lit(1), F.size("was")) != F.col("was"))).select("id")


def registered(latest: DataFrame, incoming: DataFrame) -> DataFrame:
    """What registering a file does: nothing for the same content, a first version, or the next that supersedes the last."""
    x = incoming.join(latest.select("scope", "source_id", "version", F.col("sha").alias("old_sha")), "scope", "left")
    action = F.when(F.col("version").isNull(), "first").when(F.col("old_sha") == F.col("sha"), "same").otherwise("replaces")
    return x.select("scope", action.alias("action"), (F.coalesce("version", F.lit(0)) + (action != "same").cast("int")).alias("version"), F.when(action == "replaces", F.col("source_id")).alias("supersedes"))


def open_runs(runs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Of each run its questions and how many distinct ones have a graded attempt; done if all have."""
    q = runs.select("run_id", F.explode("question_ids").alias("question_id")).distinct()
    done = attempts.where("correctness is not null").select("run_id", "question_id").distinct().withColumn("hit", F.lit(1))
    return q.join(done, ["run_id", "question_id"], "left").groupBy("run_id").agg(F.count("*").alias("questions"), F.count("hit").alias("done"), (F.count("*") == F.count("hit")).alias("complete"))


def retired(previous: DataFrame, active: DataFrame, earlier: DataFrame, key: str = "id") -> DataFrame:
    """Those retired before, and those that are no longer active."""
    return earlier.select(key).unionByName(previous.select(key).join(active.select(key), key, "left_anti")).distinct()
