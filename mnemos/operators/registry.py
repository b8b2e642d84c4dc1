"""Versioned sources and dated knowledge: the latest approved, supersession, validity on a date, ordered stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The stages of a source in order. Beside them stands ``blocked``, which ends a source.
STAGES = ("registered", "hash_verified", "profile_matched", "layout_validated", "preview_ready", "formal_segmented", "answers_extracted", "validated", "production")
BLOCKED = "blocked"


def latest_approved(sources: DataFrame, *scope: str) -> DataFrame:
    """Of each scope the approved source with the highest version."""
    rest = [c for c in sources.columns if c not in scope]
    best = sources.where("approved").groupBy(*scope).agg(F.max_by(F.struct(*rest), F.struct("version", "source_id")).alias("x"))
    return best.select(*scope, "x.*")


def both_kinds(sources: DataFrame, *scope: str) -> DataFrame:
    """scopes with an approved source of each of two kinds."""
    return sources.where("approved").groupBy(*scope).agg(F.count_distinct("kind").alias("kinds")).where("kinds = 2").select(*scope)


def chain_violations(sources: DataFrame) -> DataFrame:
    """(source_id, problem): a source must supersede an existing one of its scope, with the version before and other content."""
    old = sources.select(F.col("source_id").alias("supersedes"), F.col("scope").alias("old_scope"), F.col("version").alias("old_version"), F.col("sha256").alias("old_sha"))
    x = sources.where("supersedes is not null").join(old, "supersedes", "left")
    problem = F.when(F.col("old_version").isNull(), "missing").when(F.col("old_scope") != F.col("scope"), "scope").when(F.col("old_version") + 1 != F.col("version"), "version").when(F.col("old_sha") == F.col("sha256"), "same_content")
    return x.select("source_id", problem.alias("problem")).where("problem is not null")


def resolve(versions: DataFrame, as_of: str) -> DataFrame:
    """Of each topic the one version that holds on a date, or why none does.

    Versions hold from effective_from until before effective_until; superseded ones drop out; exactly one verified must be left.
    """
    day = F.lit(as_of).cast("date")
    holds = versions.where((F.col("effective_from") <= day) & (F.col("effective_until").isNull() | (day < F.col("effective_until"))))
    gone = holds.select("topic_id", F.explode("supersedes").alias("id"))
    left = holds.join(gone, ["topic_id", "id"], "left_anti").groupBy("topic_id").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.bool_and("verified").alias("verified"))
    x = versions.select("topic_id").distinct().join(left, "topic_id", "left")
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "none").when((F.col("n") == 1) & F.col("verified"), "current").otherwise("needs_review")
    return x.select("topic_id", status.alias("status"), F.when(status == "current", F.col("id")).alias("version"))


def stage_index(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage) - 1


def stage_violations(events: DataFrame) -> DataFrame:
    """(source_id, seq, stage, before) of events that skip, repeat or go back a stage, or have an unknown one.

    ``before`` is the stage of the event before (null for the first). A source in any stage but production may be blocked, with a
    ``reason``; nothing follows that. Null stages are unknown ones.
    """
    at = W.partitionBy("source_id").orderBy("at", "seq")
    x = events.withColumn("before", F.lag("stage").over(at)).withColumn("first", F.lag(F.lit(1)).over(at).isNull())
    index, last = stage_index(F.col("stage")), stage_index(F.col("before"))
    step = F.when(F.col("first"), index == 0).otherwise((last >= 0) & (index == last + 1))
    reason = F.coalesce(F.trim("reason") != "", F.lit(False)) if "reason" in events.columns else F.lit(False)
    block = reason & ~F.col("first") & (last >= 0) & (F.col("before") != STAGES[-1])
    fine = F.when(F.col("stage") == BLOCKED, block).otherwise(step & (index >= 0))
    return x.where(~F.coalesce(fine, F.lit(False))).select("source_id", "seq", "stage", "before")


def append(log: DataFrame, new: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """The rows to append (unknown keys, each once), and the keys that come with more than one payload, in the log or among the new rows.

    Identical rows are no-ops; a null payload is one like any other.
    """
    mark = F.unhex(F.sha2(F.to_json(F.struct(F.col(payload).alias("x")), {"ignoreNullFields": "false"}), 256))
    came = new.select(key, mark.alias("__mark"), F.lit(False).alias("__old"), F.struct(*[c for c in new.columns if c != key]).alias("__row"))
    seen = log.select(key, mark.alias("__mark"), F.lit(True).alias("__old"), F.lit(None).cast(came.schema["__row"].dataType).alias("__row"))
    # rows without key are each their own; all else of a key is told in one grouping, so its rows move once and no join sorts them again
    none = F.when(F.col(key).isNull(), F.col("__mark")).alias("__none")
    keys = came.unionByName(seen).groupBy(key, none).agg(F.min("__mark").alias("a"), F.max("__mark").alias("b"), F.bool_or("__old").alias("known"), F.first("__row", ignorenulls=True).alias("__row")).where("__row is not null")
    fresh = keys.where((~F.col("known") | F.col(key).isNull()) & (F.col("a") == F.col("b")))
    return fresh.select(key, "__row.*").select(new.columns), keys.where("a <> b").select(key)


def locked_write(old: Column, new: Column, locked: Column, machine: Column) -> Column:
    """A machine doesn't overwrite what a person locked."""
    return F.when(F.coalesce(locked, F.lit(False)) & machine, old).otherwise(new)


def short_id(*columns) -> Column:
    """The first 24 hex digits of the SHA-256 of the joined values."""
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 24)


def canonical_map(column: str) -> Column:
    """C14: JSON of a map with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))
