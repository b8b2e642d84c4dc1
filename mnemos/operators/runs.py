"""Training and module runs: start or resume, drafts, cursor, attempts, resets, and what a run's progress says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.operators.guards import guarded
from mnemos.operators.progress import state_of

UNANSWERED = "unanswered"


def started(requests: DataFrame, progress: DataFrame, runs: DataFrame) -> DataFrame:
    """(user_id, definition_key, action, run_id, kind): a saved run of the definition is resumed, unless a restart, a stage or unsure questions are asked for.

    A request needs questions, none twice. A saved progress whose run is gone is an error.
    """
    keys = ["user_id", "definition_key"]
    x = requests.join(progress.select(*keys, F.col("run_id").alias("saved")), keys, "left").join(runs.select("user_id", F.col("run_id").alias("saved"), F.lit(True).alias("there")), ["user_id", "saved"], "left")
    plain = F.col("stage").isNull() & ~F.coalesce("uncertainty", F.lit(False))
    resumes = plain & ~F.coalesce("restart", F.lit(False)) & F.col("saved").isNotNull()
    ids = F.coalesce("question_ids", F.array().cast("array<long>"))
    bad = (F.size(ids) == 0) | (F.size(F.array_distinct(ids)) < F.size(ids)) | (F.col("stage").isNotNull() & F.coalesce("uncertainty", F.lit(False)))
    action = F.when(resumes, F.when(F.col("there"), "resumed").otherwise("missing_run")).when(bad, "refused").otherwise("started")
    kind = F.when(F.coalesce("uncertainty", F.lit(False)), "uncertainty").when(F.col("stage").isNull(), "bank").otherwise("stage")
    return x.select(*keys, action.alias("action"), F.when(action == "resumed", F.col("saved")).alias("run_id"), F.when(action == "started", kind).alias("kind"))


def admitted(runs: DataFrame, commands: DataFrame) -> DataFrame:
    """The commands (run_id, seq, expected, question_id, ...) with their outcome: on the revision seen, and a question of the run."""
    return guarded(runs, commands, ["run_id"], F.array_contains("old_question_ids", F.col("question_id")))


def moved(runs: DataFrame, commands: DataFrame) -> DataFrame:
    """Runs with the cursor and revision that the commands leave."""
    to = admitted(runs, commands).where("outcome = 'applied'").select("run_id", F.col("question_id").alias("to"))
    x = runs.join(to, "run_id", "left")
    return x.withColumns({"current_question": F.coalesce("to", "current_question"), "revision": F.col("revision") + F.col("to").isNotNull().cast("int")}).drop("to")


def drafted(drafts: DataFrame, runs: DataFrame, commands: DataFrame, attempts: DataFrame) -> DataFrame:
    """Drafts (run_id, question_id, text, attempt_id) after commands that carry text and attempt_id; an attempt named must be of the run and question."""
    keys = ["run_id", "question_id"]
    ok = admitted(runs, commands).where("outcome = 'applied'").select(*keys, "text", "attempt_id")
    own = ok.where("attempt_id is not null").join(attempts.select(*keys, "attempt_id").distinct(), [*keys, "attempt_id"], "left_semi")
    new = ok.where("attempt_id is null").unionByName(own.select(ok.columns))
    return new.unionByName(drafts.select(new.columns).join(new, keys, "left_anti"))


def attempted(runs: DataFrame, snapshots: DataFrame, commands: DataFrame) -> DataFrame:
    """The attempts that are saved, with the provenance of the run's snapshot of the question: exam, module, revision and official answer."""
    ok = admitted(runs, commands).where("outcome = 'applied'").select("run_id", "question_id", "attempt_id", "correctness")
    return ok.join(snapshots, ["run_id", "question_id"], "left").withColumnRenamed("run_id", "training_run_id")


def attempt_removed(attempts: DataFrame, drafts: DataFrame, runs: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The attempts and drafts that stay; a draft that shows a removed attempt is emptied. Only attempts of the run go."""
    keys = ["run_id", "question_id", "attempt_id"]
    gone = admitted(runs, commands).where("outcome = 'applied'").select(*keys).join(attempts.select(*keys), keys, "left_semi")
    x = drafts.join(gone.withColumn("gone", F.lit(True)), keys, "left")
    kept = x.select("run_id", "question_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise("").alias("text"), F.when(F.col("gone").isNull(), F.col("attempt_id")).alias("attempt_id"))
    return attempts.join(gone, keys, "left_anti"), kept


def ensured(modules: DataFrame, progress: DataFrame, latest: DataFrame) -> DataFrame:
    """Progress (user_id, id, question_id, state, generation, revision) of modules that have none: a first generation with the states of the latest attempts."""
    new = modules.join(progress.select("user_id", "id").distinct(), ["user_id", "id"], "left_anti").select("user_id", "id", F.explode(F.array_distinct("question_ids")).alias("question_id"))
    x = new.join(latest.select("user_id", "question_id", "correctness"), ["user_id", "question_id"], "left")
    return x.select("user_id", "id", "question_id", F.when(F.col("correctness").isNull(), UNANSWERED).otherwise(state_of(F.col("correctness"))).alias("state"), F.lit(1).alias("generation"), F.lit(1).alias("revision"))


def saved_states(states: DataFrame, attempts: DataFrame) -> DataFrame:
    """(user_id, question_id, state, attempt_id) after new attempts of the run, the last one graded counting; ungraded ones change no state."""
    keys = ["user_id", "question_id"]
    last = attempts.where("correctness is not null").groupBy(*keys).agg(F.max_by(F.struct("correctness", "attempt_id"), F.struct("progress_order", "attempt_id")).alias("x"))
    x = states.join(last, keys, "left")
    return x.select(*keys, F.when(F.col("x").isNull(), F.col("state")).otherwise(state_of(F.col("x.correctness"))).alias("state"), F.coalesce("x.attempt_id", "attempt_id").alias("attempt_id"))


def stamped(sessions: DataFrame, progress: DataFrame) -> DataFrame:
    """Practice sessions (user_id, id, run_id, question_id) with exam, module and generation of the progress; those of another run are left out."""
    p = progress.select("user_id", "id", "run_id", "exam", "module", "generation")
    return sessions.join(p, ["user_id", "id", "run_id"])


def reset(progress: DataFrame, commands: DataFrame) -> DataFrame:
    """Progress (user_id, id, generation, revision, reset_at) after resets on the run and revision seen: the next generation, no state."""
    keys = ["user_id", "id"]
    x = guarded(progress, commands, keys, F.col("run_id").eqNullSafe(F.col("old_run_id"))).where("outcome = 'applied'").select(*keys, F.col("at").alias("to"))
    x = progress.join(x, keys, "left")
    hit = F.col("to").isNotNull()
    return x.select(*keys, (F.col("generation") + hit.cast("int")).alias("generation"), (F.col("revision") + hit.cast("int")).alias("revision"), F.coalesce("to", "reset_at").alias("reset_at"))


def module_progress(questions: DataFrame, states: DataFrame) -> DataFrame:
    """Of each (user_id, module) completed, correct, the rounded rate of the completed ones (null for none), the done question ids and where to resume.

    ``questions``: module, question_id, pos; ``states``: user_id, question_id, state. Resume: the first unanswered, else the
    first not right, else the first.
    """
    size = questions.groupBy("module").agg(F.count_distinct("question_id").alias("total"))
    own = states.where(F.col("state") != UNANSWERED).join(questions.select("question_id", "module").distinct(), "question_id")
    done = own.groupBy("user_id", "module").agg(F.count_distinct("question_id").alias("completed"), F.count_if(F.col("state") == "correct").alias("correct"), F.array_sort(F.collect_set("question_id")).alias("done"))
    users = states.select("user_id").distinct()
    grid = users.join(questions.select("module", "question_id", "pos")).join(states, ["user_id", "question_id"], "left")  # each user meets each question once
    rank = F.when(F.coalesce("state", F.lit(UNANSWERED)) == UNANSWERED, 0).when(F.col("state") != "correct", 1).otherwise(2)
    resume = grid.groupBy("user_id", "module").agg(F.min_by("question_id", F.struct(rank, "pos")).alias("resume"))
    x = resume.join(done, ["user_id", "module"], "left").join(size, "module")
    return x.select("user_id", "module", "total", F.coalesce("completed", F.lit(0)).alias("completed"), F.coalesce("correct", F.lit(0)).alias("correct"), F.round(F.try_divide(100.0 * F.col("correct"), F.col("completed"))).alias("rate"), "done", "resume")


def incomplete(runs: DataFrame, drafts: DataFrame) -> DataFrame:
    """runs with a question whose draft shows no attempt."""
    shown = drafts.where("attempt_id is not null").select("run_id", "question_id").distinct()
    return runs.select("run_id", F.explode("question_ids").alias("question_id")).join(shown, ["run_id", "question_id"], "left_anti").select("run_id").distinct()


def snapshots(chosen: DataFrame, modules: DataFrame, questions: DataFrame, reviews: DataFrame, answers: DataFrame, solutions: DataFrame) -> DataFrame:
    """What a training keeps of each chosen question: module, the reviewed text, and the answer or the solution by its kind; ``valid`` says whether that one exists."""
    x = chosen.join(modules, "module", "left").join(questions, "question_id", "left")
    x = x.join(reviews.select("question_id", F.col("text").alias("reviewed")), "question_id", "left").join(answers, "question_id", "left").join(solutions, "question_id", "left")
    choice = F.col("kind") == "multiple_choice"
    return x.select("question_id", "module", "title", F.coalesce("reviewed", "text").alias("text"), F.when(choice, F.col("answer")).alias("answer"), F.when(~choice, F.col("solution")).alias("solution"),
                    F.coalesce(F.when(choice, F.col("answer").isNotNull()).when(~choice, F.col("solution").isNotNull()), F.lit(False)).alias("valid"))
