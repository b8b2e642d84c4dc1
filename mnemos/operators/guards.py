"""Writes that apply only to the state their author saw: expected revisions, frozen columns, owners.

Commands come as tables. Each gets an outcome; of several on one key in a batch the first by ``seq`` may apply, for the
next ones the revision has moved on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemos.operators.sessions import ARCHIVED, MOVES

#: Of an attempt, what may change after it was made; of a session, what may not (fixed values).
MUTABLE = ("note", "error_reason", "unsure", "confidence")
FROZEN = ("question_ids", "question_models", "source_mix", "official_answers", "started_at", "seed", "source_exams", "exam", "module")
OPEN = ("active", "paused")


def guarded(current: DataFrame, commands: DataFrame, keys: list[str], extra: Column | None = None) -> DataFrame:
    """The commands (keys, seq, expected, ...) with ``revision`` (0 if there is no row) and ``outcome``: applied, changed, or refused if ``extra`` doesn't hold.

    ``extra`` may name columns of both sides; those of the current row have the prefix ``old_``. A null expected
    revision fits nothing. An unknown condition refuses.
    """
    old = current.select(*keys, *[F.col(c).alias(f"old_{c}") for c in current.columns if c not in keys])
    x = commands.join(old, keys, "left").withColumn("revision", F.coalesce("old_revision", F.lit(0)))
    fits = F.coalesce(F.col("expected") == F.col("revision"), F.lit(False))
    allowed = F.coalesce(extra, F.lit(False)) if extra is not None else F.lit(True)
    place = F.row_number().over(W.partitionBy(*keys, F.col("fits") & F.col("allowed")).orderBy("seq"))
    x = x.withColumns({"fits": fits, "allowed": allowed}).withColumn("place", place)
    outcome = F.when(~F.col("fits"), "changed").when(~F.col("allowed"), "refused").when(F.col("place") > 1, "changed").otherwise("applied")
    return x.withColumn("outcome", outcome).drop("fits", "allowed", "place")


def toggled_uncertainty(current: DataFrame, commands: DataFrame) -> DataFrame:
    """(user_id, question_id, active, entered_at, revision) after (.., active, expected, at, seq): the time of entering stays while it is active."""
    keys = ["user_id", "question_id"]
    x = guarded(current, commands, keys).where("outcome = 'applied'")
    entered = F.when(F.col("active"), F.when(F.coalesce("old_active", F.lit(False)), F.col("old_entered_at")).otherwise(F.col("at")))
    new = x.select(*keys, "active", entered.alias("entered_at"), (F.col("revision") + 1).alias("revision"))
    return new.unionByName(current.select(new.columns).join(new.select(*keys), keys, "left_anti"))


def saved_notes(current: DataFrame, commands: DataFrame) -> DataFrame:
    """Notes (user_id, question_id, text, revision) after (.., text, expected, expected_text, seq): the text must be the one that was seen too."""
    keys = ["user_id", "question_id"]
    x = guarded(current, commands, keys, F.coalesce("old_text", F.lit("")) == F.coalesce("expected_text", F.lit(""))).where("outcome = 'applied'")
    new = x.select(*keys, "text", (F.col("revision") + 1).alias("revision"))
    return new.unionByName(current.select(new.columns).join(new.select(*keys), keys, "left_anti"))


def migrated_uncertainty(attempts: DataFrame, valid_tests: DataFrame, existing: DataFrame) -> DataFrame:
    """States from the latest graded attempt of each question that has none yet; an attempt linked to a test counts if that test counts.

    ``valid_tests``: (user_id, test_id, question_id) that count. An explicit state wins, also an inactive one.
    """
    keys = ["user_id", "question_id"]
    linked = attempts.join(valid_tests.select("user_id", "test_id", "question_id").distinct(), ["user_id", "test_id", "question_id"], "left_semi")
    good = attempts.where("test_id is null").unionByName(linked.select(attempts.columns)).where(F.col("correctness").isin("richtig", "teilweise", "falsch"))
    latest = good.groupBy(*keys).agg(F.max_by(F.struct("unsure", "ts", "attempt_id"), F.struct("ts", "attempt_id")).alias("x"))
    unsure = F.coalesce("x.unsure", F.lit(False))
    return latest.join(existing, keys, "left_anti").select(*keys, unsure.alias("active"), F.when(unsure, F.col("x.ts")).alias("entered_at"), F.lit(1).alias("revision"), F.col("x.attempt_id").alias("last_result_id"))


def migrated_notes(legacy: DataFrame, existing: DataFrame, tombstones: DataFrame, done: DataFrame) -> DataFrame:
    """Legacy notes (user_id, question_id, note) of users not migrated before, less those that exist or were deleted."""
    keys = ["user_id", "question_id"]
    taken = existing.select(*keys).unionByName(tombstones.select(*keys))
    return legacy.join(done.select("user_id"), "user_id", "left_anti").join(taken, keys, "left_anti").select(*keys, "note", F.lit(1).alias("revision"))


def inserted_attempts(current: DataFrame, attempts: DataFrame) -> DataFrame:
    """(attempt_id, outcome): added once; known ids and sessions of another user or question are refused."""
    x = attempts.join(current.select("attempt_id").distinct().withColumn("known", F.lit(True)), "attempt_id", "left")
    own = F.col("session_user").isNull() | ((F.col("session_user") == F.col("user_id")) & (F.col("session_question") == F.col("question_id")))
    first = F.row_number().over(W.partitionBy("attempt_id").orderBy("seq")) == 1
    return x.select("attempt_id", "seq", F.when(~F.coalesce(own, F.lit(False)), "foreign").when(F.coalesce("known", F.lit(False)) | ~first, "exists").otherwise("added").alias("outcome"))


def annotated(attempts: DataFrame, notes: DataFrame) -> DataFrame:
    """Attempts with the last note and reason given for them; no other column can change."""
    last = notes.groupBy("attempt_id").agg(F.max_by(F.struct("note", "error_reason"), "seq").alias("n"))
    return attempts.join(last, "attempt_id", "left").withColumns({c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)) for c in ("note", "error_reason")}).drop("n")


def updated_sessions(current: DataFrame, commands: DataFrame) -> DataFrame:
    """(session_id, outcome, status): an action on the revision that its author saw; to resume or restore, no other session of the scope may be open.

    The scope is user, type and module, and the exam too but for module tests.
    """
    scope = ["user_id", "test_type", "module", F.when(F.col("test_type") == "module", F.lit("")).otherwise(F.col("exam")).alias("own_exam")]
    opened = current.where(F.col("status").isin(*OPEN)).select("session_id", *scope)
    per = opened.groupBy("user_id", "test_type", "module", "own_exam").agg(F.count("*").alias("open"))
    x = current.select("session_id", "status", "revision", "previous_status", *scope).join(per, ["user_id", "test_type", "module", "own_exam"], "left")
    others = F.coalesce("open", F.lit(0)) - F.col("status").isin(*OPEN).cast("int")
    to = F.lit(None).cast("string")
    for (status, action), target in MOVES.items():
        to = F.when((F.col("old_status") == status) & (F.col("action") == action), target).otherwise(to)
    back = F.when(F.col("old_previous_status") == "active", "paused").when(F.col("old_previous_status").isin("paused", "completed", "abandoned"), F.col("old_previous_status"))
    to = F.when(F.col("action") == "restore", F.when(F.col("old_status") == "discarded", back)).when((F.col("action") == "discard") & (F.col("old_status") != "discarded"), "discarded").otherwise(to)
    competing = F.coalesce(F.col("action").isin("resume", "restore") & to.isin(*OPEN) & (F.col("old_others") > 0), F.lit(False))
    x = guarded(x.withColumn("others", others).select("session_id", "status", "revision", "previous_status", "others"), commands, ["session_id"], to.isNotNull() & ~competing)
    outcome = F.when(F.col("old_status").isNull(), "missing").when((F.col("outcome") == "refused") & competing, "competing").otherwise(F.col("outcome"))
    return x.select("session_id", "seq", outcome.alias("outcome"), F.when(F.col("outcome") == "applied", to).otherwise(F.col("old_status")).alias("status"))


def deleted_sessions(current: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sessions that stay, and tombstones of those deleted on the revision that was seen; attempts are no part of it."""
    gone = guarded(current, commands, ["session_id"], F.col("old_revision").isNotNull()).where("outcome = 'applied'").select("session_id")
    return current.join(gone, "session_id", "left_anti"), gone


def applied_remote(local: DataFrame, remote: DataFrame, frozen: list[str], generation: str | None = None) -> DataFrame:
    """(id, outcome) for remote rows (id, deleted, ...): they may not change a frozen column nor go back a generation; a delete may."""
    mine = local.select("id", *[F.col(c).alias(f"old_{c}") for c in {*frozen, *([generation] if generation else [])}], F.lit(True).alias("here"))
    x = remote.join(mine, "id", "left")
    rewritten = F.lit(False)
    for c in frozen:
        rewritten = rewritten | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    older = F.col(generation) < F.col(f"old_{generation}") if generation else F.lit(False)
    known = F.coalesce("here", F.lit(False)) & ~F.col("deleted")
    return x.select("id", F.when(known & F.coalesce(older, F.lit(False)), "older").when(known & rewritten, "history").when(F.col("deleted"), "deleted").otherwise("put").alias("outcome"))


def resolved_conflicts(conflicts: DataFrame, choices: DataFrame, outbox: DataFrame) -> DataFrame:
    """(entity, id, outcome, base_revision): what a choice (local or remote) makes of a conflict.

    The choice names the mutation and the remote revision that its author saw. The remote version isn't taken when the
    local one has changed since; the local one is sent again on the remote revision.
    """
    keys = ["entity", "id"]
    x = choices.join(conflicts.select(*keys, "mutation_id", F.col("revision").alias("remote")), keys, "left")
    x = x.join(outbox.select(*keys, F.col("mutation_id").alias("pending")), keys, "left")
    seen = (F.col("expected_mutation").isNull() | (F.col("expected_mutation") == F.col("mutation_id"))) & (F.col("expected_revision").isNull() | (F.col("expected_revision") == F.col("remote")))
    outcome = F.when(F.col("mutation_id").isNull(), "missing").when(~seen, "changed").when((F.col("choice") == "remote") & ~F.col("pending").eqNullSafe(F.col("mutation_id")), "local_changed")
    outcome = F.coalesce(outcome, F.when(F.col("choice") == "remote", "replaced").otherwise("sent_again"))
    return x.select(*keys, outcome.alias("outcome"), F.when(outcome.isin("replaced", "sent_again"), F.col("remote")).alias("base_revision"))


def bound_profiles(sources: DataFrame, commands: DataFrame) -> DataFrame:
    """(source_id, outcome): profiles are bound before the profile match only, both of them."""
    x = commands.join(sources.select("source_id", "status"), "source_id", "left")
    early = F.coalesce(F.col("status").isin("registered", "hash_verified"), F.lit(False))
    both = (F.coalesce("layout_profile", F.lit("")) != "") & (F.coalesce("answer_profile", F.lit("")) != "")
    return x.select("source_id", F.when(F.col("status").isNull(), "missing").when(~early, "late").when(~both, "incomplete").otherwise("bound").alias("outcome"))


def advanced(sources: DataFrame, commands: DataFrame, stages: list[str]) -> DataFrame:
    """(source_id, outcome): one stage on, with evidence; a stage already passed is no change."""
    at = lambda c: F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(c))
    x = commands.join(sources.select("source_id", "status"), "source_id", "left").withColumns({"now": at("status"), "to": at("target")})
    outcome = F.when(F.col("status").isNull(), "missing").when((F.col("now") == 0) | (F.col("to") == 0), "unknown").when(F.col("now") >= F.col("to"), "past").when(F.col("to") != F.col("now") + 1, "skips").when(~F.coalesce("evidence", F.lit(False)), "no_evidence")
    return x.select("source_id", F.coalesce(outcome, F.lit("advanced")).alias("outcome"))


def closed(status: Column) -> Column:
    """Sessions that no action but a restore reopens."""
    return status.isin("completed", *ARCHIVED)
