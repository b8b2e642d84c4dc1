"""Constraints as violation tables: a rule is a condition that good rows meet; what is returned breaks one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks, in one scan; an unknown condition counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def dangling(child: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """Rows of ``child`` whose reference doesn't exist."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that should be unique and aren't, with their rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def taxonomy(nodes: DataFrame) -> DataFrame:
    """(id, rule): unique ids, existing parents and merge targets, at most two levels, one kind in a tree."""
    p = nodes.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("grand"), F.col("kind").alias("parent_kind"))
    x = nodes.join(p, "parent_id", "left")
    m = nodes.select(F.col("id").alias("merged_into")).withColumn("target", F.lit(True)).distinct()
    x = x.join(m, "merged_into", "left")
    none = F.col("parent_id").isNull()
    rules = {"parent": none | F.col("parent_kind").isNotNull(), "depth": F.col("grand").isNull(), "kind": none | F.col("parent_kind").isNull() | (F.col("parent_kind") == F.col("kind")), "merge": F.col("merged_into").isNull() | F.coalesce("target", F.lit(False))}
    return violations(x, "id", rules).unionByName(repeated(nodes, "id").select("id", F.lit("unique").alias("rule")))


def attempts(df: DataFrame) -> DataFrame:
    """V01."""
    return violations(df, "attempt_id", {"user": F.col("user_id").isNotNull(), "question": F.col("question_id") >= 0, "time": F.col("ts").isNotNull(), "grade": F.col("correctness").isNull() | F.col("correctness").isin("richtig", "teilweise", "falsch")})


def total(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _text(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)) != "", F.lit(False))


def _stamp(column: str) -> Column:
    return F.try_to_timestamp(F.col(column)).isNotNull()


def _stamp_or_null(column: str) -> Column:
    return F.col(column).isNull() | _stamp(column)


def _revised() -> Column:
    """Revisions count from one."""
    return F.col("revision") >= 1


def wrong_states(df: DataFrame, key: str) -> DataFrame:
    """Stages known, times readable, counts not negative, dismissed ids not blank."""
    known = F.col("stage").isNull() | F.col("stage").isin("1", "2", "3", "mastered")
    return violations(df, key, {"stage": known, "entered": _stamp_or_null("entered_at"), "updated": _stamp("updated_at"), "revision": _revised(), "counts": (F.col("wrong_count") >= 0) & (F.col("streak") >= 0), "dismissed": F.forall("dismissed", lambda x: F.coalesce(x != "", F.lit(False)))})


def snapshots(df: DataFrame, key: str) -> DataFrame:
    """A choice has an answer of its question from 1 to 5 or none, and no solution; the others a solution and no answer."""
    choice = (F.col("answer_of") == F.col("question_id")) & (F.col("answer").isNull() | F.col("answer").between(1, 5)) & F.col("solution_of").isNull()
    written = F.col("answer_of").isNull() & (F.col("solution_of") == F.col("question_id"))
    return violations(df, key, {"kind": F.col("kind").isin("multiple_choice", "multi_part"), "content": F.when(F.col("kind") == "multiple_choice", choice).otherwise(written), "page": F.col("page") >= 1, "size": (F.col("width") > 0) & (F.col("height") > 0)})


def training_runs(df: DataFrame, key: str) -> DataFrame:
    """Distinct questions, a cursor among them, snapshots of exactly these, drafts and attempts of these only, a stage for stage runs only."""
    ids = F.col("question_ids")
    inside = lambda m: F.size(F.array_except(F.map_keys(m), ids)) == 0
    rules = {
        "questions": (F.size(ids) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids)), "cursor": F.array_contains(ids, F.col("current_question")), "kind": F.col("kind").isin("bank", "stage", "uncertainty"),
        "stage": (F.col("kind") == "stage") == F.col("stage").isNotNull(), "snapshots": inside("snapshots") & (F.size("snapshots") == F.size(ids)), "drafts": inside("drafts"), "attempts": inside("attempt_ids"), "revision": _revised(),
    }
    return violations(df, key, rules)


def module_states(df: DataFrame, key: str) -> DataFrame:
    """The id is exam/module, generation and revision from one, states of exactly the questions."""
    ids = F.array_sort(F.array_distinct("question_ids"))
    return violations(df, key, {"id": F.col("id") == F.concat_ws("/", "exam", "module"), "generation": F.col("generation") >= 1, "revision": _revised(), "states": F.array_sort(F.map_keys("states")) == ids})


def uncertainties(df: DataFrame, key: str) -> DataFrame:
    """An active one has a time of entering."""
    return violations(df, key, {"user": _text("user_id"), "question": _text("question_id"), "entered": _stamp_or_null("entered_at") & (~F.col("active") | F.col("entered_at").isNotNull()), "updated": _stamp("updated_at"), "revision": _revised()})


def notes(df: DataFrame, key: str) -> DataFrame:
    """A text, which may be empty, and readable times."""
    return violations(df, key, {"user": _text("user_id"), "question": _text("question_id"), "text": F.col("text").isNotNull(), "created": _stamp("created_at"), "updated": _stamp("updated_at"), "revision": _revised()})


def reviews(df: DataFrame, key: str) -> DataFrame:
    """A known status; a confirmed answer from 1 to 5 is locked and corrected by a person, a blocked one has none."""
    confirmed = F.col("status") == "confirmed"
    rules = {"status": F.col("status").isin("needs_review", "auto_ready", "confirmed", "rejected"), "answer": F.when(confirmed, F.col("answer").between(1, 5)).otherwise(F.col("answer").isNull() | F.col("answer").between(1, 5)), "lock": ~confirmed | (F.col("locked") & F.col("user_corrected"))}
    return violations(df, key, rules)


def sessions(df: DataFrame, key: str) -> DataFrame:
    """Known type and status, distinct questions with the cursor among them, answers to these only, times readable."""
    ids = F.col("question_ids")
    rules = {
        "type": F.col("test_type").isin("original", "module"), "status": F.col("status").isin("active", "paused", "completed", "abandoned", "discarded"), "questions": (F.size(ids) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids)),
        "cursor": F.array_contains(ids, F.col("current_question")), "answers": F.size(F.array_except(F.map_keys("answers"), ids)) == 0, "started": _stamp("started_at"), "completed": _stamp_or_null("completed_at"), "revision": F.col("revision") >= 0,
    }
    return violations(df, key, rules)


def envelopes(df: DataFrame, key: str, entities: list[str], most: int = 200_000) -> DataFrame:
    """A known entity, ids of 1 to 200 characters, a base revision from zero, a value if and only if it isn't deleted, and at most so many bytes."""
    short = lambda c: F.length(c).between(1, 200)
    return violations(df, key, {"entity": F.col("entity").isin(*entities), "id": short("id"), "mutation": short("mutation_id"), "base": F.col("base_revision") >= 0, "value": F.col("deleted") == F.col("value").isNull(), "size": F.octet_length(F.coalesce("value", F.lit(""))) <= most})


def accepted(df: DataFrame, key: str, entities: list[str], most: int = 200_000) -> DataFrame:
    """The rows that the sink lets in."""
    return df.join(envelopes(df, key, entities, most).select(key).distinct(), key, "left_anti")


def training_progress(df: DataFrame, key: str) -> DataFrame:
    """V26."""
    return violations(df, key, {"user": _text("user_id"), "definition": _text("definition_key"), "run": _text("run_id"), "revision": _revised(), "updated": _stamp("updated_at")})


def descriptors(df: DataFrame, key: str) -> DataFrame:
    """Exam, module and distinct questions, none blank."""
    ids = F.col("question_ids")
    return violations(df, key, {"exam": _text("exam"), "module": _text("module"), "questions": (F.size(ids) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(ids, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))})


def overrides(df: DataFrame, nodes: DataFrame, inventory: DataFrame, version: str, stale: bool = False, orphans: bool = False) -> DataFrame:
    """(question_id, rule) for overrides: a known question of the same revision, once, confirmed and locked, topics active, none twice, a confidence from 0 to 1.

    ``stale`` lets older revisions, versions and inactive topics pass, ``orphans`` unknown questions.
    """
    x = df.join(inventory.select("question_id", F.col("revision").alias("now")), "question_id", "left")
    good = nodes if stale else nodes.where("active")
    topics = df.select("question_id", F.explode("topic_ids").alias("id")).join(good.select("id"), "id", "left_anti").select("question_id", F.lit("topic").alias("rule")).distinct()
    rules = {
        "question": F.lit(orphans) | F.col("now").isNotNull(), "revision": F.lit(stale) | F.col("now").isNull() | (F.col("revision") == F.col("now")), "confirmed": (F.col("source") == "human_confirmed") & F.col("locked"),
        "version": F.lit(stale) | (F.col("taxonomy_version") == version), "confidence": F.col("confidence").between(0, 1), "repeats": F.size(F.array_distinct("topic_ids")) == F.size("topic_ids"),
    }
    twice = df.groupBy("question_id").agg(F.count("*").alias("n")).where("n > 1").select("question_id", F.lit("once").alias("rule"))
    return total([violations(x, "question_id", rules).distinct(), topics, twice])


def by_entity(df: DataFrame, key: str, checks: dict) -> DataFrame:
    """Each row checked by its entity's own validator; an unknown entity is a violation."""
    parts = [check(df.where(F.col("entity") == name), key) for name, check in checks.items()]
    unknown = df.where(~F.coalesce(F.col("entity").isin(*checks), F.lit(False))).select(F.col(key), F.lit("entity").alias("rule"))
    return total([*parts, unknown])


def without_source(modules: DataFrame, approved: DataFrame, scope: list[str]) -> DataFrame:
    """Production modules without approved sources of both kinds."""
    both = approved.groupBy(*scope).agg(F.count_distinct("kind").alias("kinds")).where("kinds = 2")
    return modules.select(*scope).distinct().join(both, scope, "left_anti")
