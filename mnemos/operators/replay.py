"""The staged replay of mistakes, in closed form over windows: no state outside the query.

A wrong or partial result that isn't dismissed puts a question to stage 1; each right one raises it, up to 4 (mastered).
Rows before a cutover, or those that are marked as a legacy, come first and raise it to stage 3 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MASTERED = 4
LABELS = {1: "1", 2: "2", 3: "3", MASTERED: "mastered"}


def result_key(id_: Column, ts: Column, correctness: Column) -> Column:
    """what a dismissal remembers of a result."""
    return F.concat_ws(":", id_.cast("string"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), correctness)


def dismissed(results: DataFrame, marks: DataFrame) -> DataFrame:
    """``dismissed`` for wrong results up to a user's mark (user_id, until)."""
    return results.join(marks, "user_id", "left").withColumn("dismissed", F.coalesce((F.col("correctness") != "richtig") & (F.col("ts") < F.col("until")), F.lit(False))).drop("until")


def legacies(results: DataFrame, cutover: DataFrame) -> DataFrame:
    """``legacy`` for the results whose ids a migration took (user_id, attempt_id)."""
    return results.join(cutover.select("user_id", "attempt_id").distinct().withColumn("legacy", F.lit(True)), ["user_id", "attempt_id"], "left").withColumn("legacy", F.coalesce("legacy", F.lit(False)))


def kept_states(stages: DataFrame, previous: DataFrame) -> DataFrame:
    """The replayed states, and those stored before whose questions have no result any more."""
    return stages.unionByName(previous.join(stages, ["user_id", "question_id"], "left_anti").select(stages.columns))


def replay(results: DataFrame, cutover: str | None = None) -> DataFrame:
    """For each user and question with a wrong result: stage (null if all are dismissed), entered_at, last_wrong_at, wrong_count, streak.

    ``results``: user_id, question_id, attempt_id, ts, correctness, ``dismissed`` if some are, and ``legacy`` if the
    results before the cutover are known by their ids (see legacies()) and not by their time.
    """
    x = results if "dismissed" in results.columns else results.withColumn("dismissed", F.lit(False))
    legacy = F.coalesce("legacy", F.lit(False)) if "legacy" in x.columns else F.col("ts") < F.lit(cutover).cast("timestamp") if cutover else F.lit(False)
    right = F.col("correctness") == "richtig"
    x = x.withColumn("legacy", legacy).withColumn("right", right).withColumn("back", ~right & ~F.col("dismissed"))
    order = W.partitionBy("user_id", "question_id").orderBy(F.desc("legacy"), "ts", "attempt_id")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    # spans: from one step back to the next; before the first there is none
    x = x.withColumn("span", F.count_if("back").over(upto)).withColumn("wrongs", F.count_if(~F.col("right")).over(upto))
    keys = ["user_id", "question_id"]
    spans = x.groupBy(*keys, "span").agg(
        F.count_if(F.col("right") & F.col("legacy")).alias("cc"), F.count_if(F.col("right") & ~F.col("legacy")).alias("nc"), F.min_by("ts", F.struct(~F.col("back"), F.col("ts"))).alias("at"),
        F.count_if(~F.col("right")).alias("wrong_count"), F.max(F.when(~F.col("right"), F.col("ts"))).alias("last_wrong_at"),
    )
    level = F.least(F.least(1 + F.col("cc"), F.lit(3)) + F.col("nc"), F.lit(MASTERED))
    spans = spans.withColumn("level", F.when(F.col("span") > 0, level))
    before = F.lag("level").over(W.partitionBy(*keys).orderBy("span"))
    spans = spans.withColumn("enters", (F.col("span") > 0) & ((F.col("span") == 1) | (before == MASTERED)))
    spans = spans.groupBy(*keys).agg(
        F.max_by("level", "span").alias("stage"), F.max_by(F.when(F.col("enters"), F.col("at")), F.when(F.col("enters"), F.col("span"))).alias("entered_at"),
        F.max("last_wrong_at").alias("last_wrong_at"), F.sum("wrong_count").alias("wrong_count"),
    )
    last = x.groupBy(*keys).agg(F.max("wrongs").alias("wrongs"))
    streak = x.join(last.withColumnRenamed("wrongs", "all_wrongs"), keys).where("right and wrongs = all_wrongs").groupBy(*keys).agg(F.count("*").alias("streak"))
    out = spans.where("wrong_count > 0").join(streak, keys, "left")
    return out.select(*keys, F.col("stage").cast("int").alias("stage"), "entered_at", "last_wrong_at", "wrong_count", F.coalesce("streak", F.lit(0)).alias("streak"))


def stage_counts(stages: DataFrame) -> DataFrame:
    """For each user wrong questions by stage, and mastered ones."""
    return stages.groupBy("user_id").agg(*[F.count_if(F.col("stage") == k).alias(f"stage_{v}") for k, v in LABELS.items()])


def unsure(attempts: DataFrame, stages: DataFrame) -> DataFrame:
    """Questions that were looked at last without a grade, less those with a stage below mastered."""
    latest = attempts.groupBy("user_id", "question_id").agg(F.max_by("viewed", F.struct("ts", "attempt_id")).alias("viewed")).where("viewed")
    return latest.select("user_id", "question_id").join(stages.where("stage < 4"), ["user_id", "question_id"], "left_anti")


def changed(new: DataFrame, old: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows whose values differ from the stored ones, or aren't stored."""
    mark = lambda df: df.select(*keys, F.sha2(F.to_json(F.struct(*values)), 256).alias("mark"))
    return new.join(mark(new).join(mark(old), [*keys, "mark"], "left_anti").select(*keys), keys, "left_semi")
