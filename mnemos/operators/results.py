"""Learning results: which count, the latest of each question, and the measures of the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Questions that a trend needs in both weeks.
SUPPORT = 5
MILESTONES = (10, 25, 50, 75, 100)


def eligible(invalidated="invalidated", deleted_at="deleted_at", discarded_at="discarded_at", valid="valid") -> Column:
    """not invalidated, deleted or discarded; a missing flag says nothing, a missing ``valid`` means yes."""
    return ~F.coalesce(F.col(invalidated), F.lit(False)) & F.col(deleted_at).isNull() & F.col(discarded_at).isNull() & F.coalesce(F.col(valid), F.lit(True))


def gradable(columns) -> Column:
    """scored automatically or by its user, who then has to have assessed every sub-part; columns that are absent don't decide."""
    flag = lambda n: F.coalesce(F.col(n), F.lit(False)) if n in columns else F.lit(None).cast("boolean")
    scored = F.coalesce(flag("auto_scored") | flag("self_assessed"), flag("auto_scored"), flag("self_assessed"), F.lit(True))
    if "subparts" not in columns:
        return scored
    parts = (F.size("subparts") > 0) & F.forall("subparts", lambda p: F.coalesce(p["correctness"].isin("richtig", "teilweise", "falsch"), F.lit(False)))
    return scored & (~F.coalesce(flag("self_assessed"), F.lit(False)) | F.coalesce(parts, F.lit(False)))


def formal(attempts: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """Graded practice attempts without a test, with the results of tests; of rows with one id the latest."""
    own = attempts.where(F.col("correctness").isNotNull() & ~F.coalesce(F.col("test_linked"), F.lit(False)) & gradable(attempts.columns)).select("attempt_id", "user_id", "question_id", "ts", "correctness")
    if tests is None:
        return own
    return last_wins(own.unionByName(tests.where("correctness is not null").select(own.columns)), ["user_id", "attempt_id"], "ts", "question_id")


def bounded(results: DataFrame, inventory: DataFrame, now: str) -> DataFrame:
    """Up to ``now``, of questions that the inventory has."""
    return results.where(F.col("ts") <= F.lit(now).cast("timestamp")).join(inventory.select("question_id").distinct(), "question_id", "left_semi")


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of each key the row that is last by ``order``; partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return best.select(*keys, "__x.*").select(df.columns)


def measures(correct: Column) -> list[Column]:
    """Answered, right, partly right, and the percentage right (null if none)."""
    right = F.count_if(correct == "richtig")
    return [F.count(correct).alias("answered"), right.alias("correct"), F.count_if(correct == "teilweise").alias("partial"), F.round(F.try_divide(100.0 * right, F.count(correct)), 6).alias("accuracy")]


def by_module(latest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Of each user and module the questions, the latest results, accuracy (null if none) and coverage in percent.

    Every user has a row for every module of the inventory, answered or not; results of questions that aren't in it don't count.
    """
    size = inventory.groupBy("module").agg(F.count_distinct("question_id").alias("total"))
    listed = size.agg(F.collect_list(F.struct("module", "total")).alias("modules"))  # one row
    users = latest.select("user_id").distinct().join(listed).select("user_id", F.explode("modules").alias("m")).select("user_id", "m.*")
    own = latest.join(inventory.select("question_id", "module").distinct(), "question_id").groupBy("user_id", "module").agg(*measures(F.col("correctness")))
    x = users.join(own, ["user_id", "module"], "left").na.fill(0, ["answered", "correct", "partial"])
    return x.withColumn("coverage", F.round(100.0 * F.col("answered") / F.col("total"), 6))


def coverage(latest: DataFrame, inventory: DataFrame) -> DataFrame:
    """For each user the share of the inventory answered, in percent, and how many questions are open."""
    total = inventory.agg(F.count_distinct("question_id").alias("total"))  # one row
    own = latest.groupBy("user_id").agg(F.count("*").alias("answered")).join(total)
    return own.select("user_id", "answered", (F.col("total") - F.col("answered")).alias("open"), F.round(F.lit(100.0) * F.col("answered") / F.greatest("total", F.lit(1)), 6).alias("coverage"))


def first_seen(results: DataFrame, since: str) -> DataFrame:
    """For each user the questions that were first answered at or after ``since``."""
    first = results.groupBy("user_id", "question_id").agg(F.min("ts").alias("first"))
    return first.groupBy("user_id").agg(F.count_if(F.col("first") >= F.lit(since).cast("timestamp")).alias("new_questions"), F.count("*").alias("seen"))


def weeks(results: DataFrame, now: str, support: int = SUPPORT) -> DataFrame:
    """Accuracy of the latest results within the last seven days and within the seven before; the change if both have enough."""
    end = F.lit(now).cast("timestamp")
    start, before = end - F.expr("interval 7 days"), end - F.expr("interval 14 days")
    window = F.when(F.col("ts") >= start, "this").when(F.col("ts") >= before, "previous")
    latest = last_wins(results.withColumn("window", window).where("window is not null"), ["user_id", "question_id", "window"], "ts", "attempt_id")
    parts = []
    for w in ("this", "previous"):
        own = F.when(F.col("window") == w, F.col("correctness"))
        parts += [F.count(own).alias(f"{w}_answered"), F.try_divide(100.0 * F.count_if(own == "richtig"), F.count(own)).alias(f"{w}_accuracy")]
    out = latest.groupBy("user_id").agg(*parts)
    enough = (F.col("this_answered") >= support) & (F.col("previous_answered") >= support)
    change = F.when(enough, F.col("this_accuracy") - F.col("previous_accuracy"))
    return out.select("user_id", "this_answered", "previous_answered", F.round("this_accuracy", 6).alias("this_accuracy"), F.round("previous_accuracy", 6).alias("previous_accuracy"), F.round(change, 6).alias("change"))


def streaks(results: DataFrame, now: str) -> DataFrame:
    """Days in a row with results that end today or yesterday, and days with results since Monday."""
    today = F.to_date(F.lit(now).cast("timestamp"))
    days = results.select("user_id", F.to_date("ts").alias("day")).where(F.col("day") <= today).distinct()
    back = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("day")))
    days = days.withColumn("island", F.date_add("day", back))
    newest = F.max("day").over(W.partitionBy("user_id"))
    current = (F.col("island") == F.date_add(F.col("newest"), 1)) & (F.col("newest") >= F.date_sub(today, 1))
    monday = F.to_date(F.date_trunc("week", F.lit(now).cast("timestamp")))
    return days.withColumn("newest", newest).groupBy("user_id").agg(F.count_if(current).alias("streak"), F.count_if(F.col("day") >= monday).alias("week_days"), F.count("*").alias("active_days"))


def milestones(latest: DataFrame, total: int, configured=MILESTONES) -> DataFrame:
    """The smallest milestone above what a user has answered; the whole inventory is one."""
    steps = F.array(*[F.lit(m) for m in sorted({*(m for m in configured if m <= total), total})])
    answered = latest.groupBy("user_id").agg(F.count("*").cast("int").alias("answered"))
    return answered.withColumn("next_milestone", F.array_min(F.filter(steps, lambda m: m > F.col("answered"))))


def lowest_module(latest: DataFrame, inventory: DataFrame) -> DataFrame:
    """For each user the module with the lowest coverage, the first of equal ones."""
    size = inventory.groupBy("module").agg(F.count("*").alias("total")).agg(F.collect_list(F.struct("module", "total")).alias("modules"))  # one row: the modules are a short list
    users = latest.select("user_id").distinct().join(size)
    own = latest.join(inventory.select("question_id", "module"), "question_id").groupBy("user_id", "module").agg(F.count("*").alias("answered"))
    grid = users.select("user_id", F.explode("modules").alias("m")).select("user_id", "m.*").join(own, ["user_id", "module"], "left")
    grid = grid.withColumn("coverage", F.round(100.0 * F.coalesce("answered", F.lit(0)) / F.col("total"), 6))
    return grid.groupBy("user_id").agg(F.min_by("module", F.struct("coverage", "module")).alias("module"), F.min("coverage").alias("coverage"))


def next_action(stages: DataFrame, unsure: DataFrame, covered: DataFrame, lowest: DataFrame, threshold: float = 60.0) -> DataFrame:
    """Wrong questions first, then unsure ones, then a test if enough is covered, else the weakest module."""
    wrong = stages.where("stage < 4").groupBy("user_id").agg(F.count("*").alias("wrong"))
    doubts = unsure.groupBy("user_id").agg(F.count("*").alias("doubts"))
    x = covered.select("user_id", "coverage").join(wrong, "user_id", "left").join(doubts, "user_id", "left").join(lowest.select("user_id", "module"), "user_id", "left")
    action = F.when(F.col("wrong") > 0, "wrong").when(F.col("doubts") > 0, "unsure").when(F.col("coverage") >= threshold, "test").otherwise(F.concat(F.lit("module "), F.col("module").cast("string")))
    return x.select("user_id", action.alias("action"))
