"""Module runs: which attempt counts, what a reset or a deletion leaves, saved states against new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free(test: str = "test_id", training: str = "training_run_id") -> Column:
    """neither of a test nor of a training."""
    return F.coalesce(F.col(test).cast("string"), F.col(training).cast("string")).isNull()


def state_of(correctness: Column) -> Column:
    """without a grade unanswered; any grade but right and wrong is partial."""
    return F.when(correctness.isNull(), "unanswered").when(correctness == "richtig", "correct").when(correctness == "falsch", "incorrect").otherwise("partial")


def in_run(generation: Column, run: Column, legacy: Column) -> Column:
    """attempts of the run's generation; those without one belong to the first if it lists them."""
    return (generation == run) | (generation.isNull() & (run == 1) & legacy)


def latest_in_run(attempts: DataFrame) -> DataFrame:
    """Of (user_id, question_id, generation, progress_order, ts, attempt_id, correctness) the last attempt of the newest generation.

    Generations count for each user, and for each exam and module where the attempts have these columns.
    """
    scope = ["user_id", *[c for c in ("exam", "module") if c in attempts.columns]]
    newest = attempts.groupBy(*scope).agg(F.max("generation").alias("generation"))
    own = attempts.join(newest, [*scope, "generation"])
    best = own.groupBy(*scope, "generation", "question_id").agg(F.max_by(F.struct("attempt_id", "correctness"), F.struct("progress_order", "ts", "attempt_id")).alias("x"))
    return best.select(*scope, "generation", "question_id", "x.attempt_id", state_of(F.col("x.correctness")).alias("state"))


def without(attempts: DataFrame, deleted: DataFrame) -> DataFrame:
    """The attempts without deleted ones; latest_in_run() of it falls back within the run."""
    return attempts.join(deleted.select("attempt_id"), "attempt_id", "left_anti")


def latest_note(attempts: DataFrame, drafts: DataFrame) -> DataFrame:
    """Of each question the last note that isn't empty; a draft comes before it."""
    last = attempts.where("note is not null and trim(note) <> ''").groupBy("user_id", "question_id").agg(F.max_by("note", F.struct("ts", "attempt_id")).alias("note"))
    x = last.join(drafts.select("user_id", "question_id", "draft"), ["user_id", "question_id"], "full_outer")
    return x.select("user_id", "question_id", F.coalesce(F.when(F.trim("draft") != "", F.col("draft")), F.col("note")).alias("note")).where("note is not null")


def strongest(candidates: DataFrame, key: str, margin: float) -> DataFrame:
    """The candidate with the highest score, null when the next one is within ``margin``."""
    x = candidates.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("score", "candidate")), asc=False).alias("c"))  # a handful of candidates
    clear = (F.size("c") == 1) | (F.col("c")[0]["score"] - F.get(F.col("c"), F.lit(1))["score"] > margin)
    return x.select(key, F.when(clear, F.col("c")[0]["candidate"]).alias("candidate"))


def resolved(rows: DataFrame, aliases: DataFrame, index: DataFrame) -> DataFrame:
    """An explicit hash, else the alias's, else the question's."""
    x = rows.join(aliases.select("alias", F.col("sha").alias("alias_sha")), "alias", "left").join(index.select("question_id", F.col("sha").alias("question_sha")), "question_id", "left")
    return x.withColumn("resolved", F.coalesce("sha", "alias_sha", "question_sha")).drop("alias_sha", "question_sha")


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Aliases with more than one hash."""
    return aliases.groupBy("alias").agg(F.count_distinct("sha").alias("hashes")).where("hashes > 1")


def shared_regions(regions: DataFrame) -> DataFrame:
    """Rectangles that several owners have alike, as one region with all of them."""
    box = ["page", "x0", "y0", "x1", "y1"]
    return regions.groupBy(*box).agg(F.array_sort(F.collect_set("owner")).alias("owners")).where(F.size("owners") > 1)


def resume(*candidates: DataFrame) -> DataFrame:
    """Of each user the newest of what may be resumed, from any source (user_id, kind, id, at)."""
    every = candidates[0]
    for c in candidates[1:]:
        every = every.unionByName(c)
    return every.groupBy("user_id").agg(F.max_by(F.struct("kind", "id"), F.struct("at", "kind", "id")).alias("x")).select("user_id", "x.*")


def natural_order(text: Column) -> list[Column]:
    """Numbers first by value, then prefixes by letter and number."""
    return [F.rlike(text, F.lit("^[0-9]")).cast("int") * -1, F.regexp_extract(text, r"^([^0-9]*)", 1), F.regexp_extract(text, r"([0-9]+)", 1).try_cast("int")]
