"""Exam sessions: scoring, their state machine, and history."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemos.functions.folding import sorted_fold

ARCHIVED = ("abandoned", "discarded")


def combined(parts: Column) -> Column:
    """Null while a part is missing; all right, all wrong, else partly right."""
    missing = (F.size(parts) <= 0) | F.exists(parts, lambda x: x.isNull())
    return F.when(missing, None).when(F.forall(parts, lambda x: x == "richtig"), "richtig").when(F.forall(parts, lambda x: x == "falsch"), "falsch").otherwise("teilweise")


def grade(answer: Column, key: Column) -> Column:
    """by the official key, null without one."""
    return F.when(key.isNull(), None).when(answer == key, "richtig").otherwise("falsch")


def answered(answer: Column) -> Column:
    """a choice from one to five."""
    return F.coalesce(F.rlike(answer, F.lit("^[1-5]$")), F.lit(False))


def question_answered(kind: Column, choice: Column, parts: Column) -> Column:
    """a choice from one to five, or of several parts one that isn't blank; null parts are blank."""
    some = F.exists(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    return F.when(kind == "multiple_choice", answered(choice)).otherwise(some)


def unit_check(text: Column, unit: Column, value: Column, wanted: Column, tolerance: Column) -> Column:
    """C11: the number within the tolerance and exactly the unit; null if it isn't a number."""
    near = numeric_check(text, value, tolerance)
    return F.when(near.isNotNull(), near & F.coalesce(F.trim(unit) == wanted, F.lit(False)))


def for_analysis() -> Column:
    """completed, and neither discarded nor deleted."""
    return (F.col("status") == "completed") & F.col("discarded_at").isNull() & F.col("deleted_at").isNull()


def archived(status: Column) -> Column:
    """F11."""
    return status.isin(*ARCHIVED)


def exams_of(mix: Column, own: Column) -> Column:
    """the distinct exams of a session's questions in order, or its own."""
    return F.when(F.size(F.coalesce(mix, F.array().cast("array<string>"))) > 0, F.array_distinct(mix)).otherwise(F.array(own))


def restored() -> Column:
    """what a discarded session goes back to, null if it can't."""
    was = F.col("previous_status")
    back = F.when(was == "active", "paused").when(was.isin("paused", "completed", "abandoned"), was)
    return F.when((F.col("status") == "discarded") & F.col("deleted_at").isNull(), back)


def numeric_check(text: Column, value: Column, tolerance: Column) -> Column:
    """C11: a decimal comma counts as a point; null if it isn't a number."""
    number = F.regexp_replace(F.trim(text), ",", ".").try_cast("double")
    return F.abs(number - value) <= tolerance + 1e-9


def score(items: DataFrame) -> DataFrame:
    """Of (session_id, question_id, correctness, answered): the counts of a session; answered but ungraded is pending."""
    done = F.col("answered")
    return items.groupBy("session_id").agg(
        F.count("*").alias("total"), F.count_if(done).alias("answered"), F.count_if(F.col("correctness") == "richtig").alias("correct"), F.count_if(F.col("correctness") == "falsch").alias("wrong"),
        F.count_if(F.col("correctness") == "teilweise").alias("partial"), F.count_if(~done).alias("unanswered"), F.count_if(done & F.col("correctness").isNull()).alias("pending"),
    )


#: Which action leads where, of those that only need a status; discard, restore, answer, move and assess have rules of their own.
MOVES = {("active", "pause"): "paused", ("paused", "resume"): "active", ("active", "submit"): "completed", ("paused", "submit"): "completed", ("active", "abandon"): "abandoned", ("paused", "abandon"): "abandoned"}
GRADES = ("richtig", "teilweise", "falsch")


@dataclass
class Session:
    """One session's state; ``since`` is set while it runs."""

    status: str = "active"
    revision: int = 0
    elapsed: int = 0
    since: int | None = None
    previous: str | None = None
    current: int | None = None
    answers: dict = field(default_factory=dict)
    assessments: dict = field(default_factory=dict)
    refused: int = 0

    def ran(self, at: int) -> int:
        return self.elapsed + (max(0, at - self.since) if self.status == "active" and self.since is not None else 0)

    def answered(self, question: int, kind: str) -> bool:
        own = self.answers.get(question, {})
        return own.get("choice", "") in ("1", "2", "3", "4", "5") if kind == "multiple_choice" else any(v.strip() for v in own.values())

    def act(self, a: dict) -> bool:
        """Applies an action that fits; the revision counts those."""
        fits = self._apply(a)
        self.revision, self.refused = self.revision + fits, self.refused + (not fits)
        return fits

    def _apply(self, a: dict) -> bool:
        action, at, question, kind, parts, value = a["action"], a["at"], a["question_id"], a["kind"], a["parts"] or [], a["value"]
        if action == "answer":
            own = json.loads(value) if value else {}
            allowed = ["choice"] if kind == "multiple_choice" else parts
            if self.status != "active" or kind is None or any(k not in allowed or not isinstance(v, str) for k, v in own.items()) or (kind == "multiple_choice" and own.get("choice", "") not in ("", "1", "2", "3", "4", "5")):
                return False
            self.answers[question] = own
        elif action == "move":
            if self.status in ARCHIVED or kind is None:
                return False
            self.current = question
        elif action == "assess":
            own = json.loads(value) if value else {}
            if self.status != "completed" or kind != "multi_part" or not self.answered(question, kind) or any(k not in parts or v not in GRADES for k, v in own.items()):
                return False
            self.assessments[question] = own
        elif action == "discard":
            if self.status == "discarded":
                return False
            self.elapsed, self.since, self.previous, self.status = self.ran(at), None, self.status, "discarded"
        elif action == "restore":
            if self.status != "discarded" or self.previous is None:
                return False
            self.status, self.previous, self.since = "paused" if self.previous == "active" else self.previous, None, None
        else:
            to = MOVES.get((self.status, action))
            if to is None:
                return False
            self.elapsed = self.ran(at)
            self.status, self.since = to, at if to == "active" else None
        return True


def fold(actions: DataFrame, models: DataFrame, key: str = "session_id") -> DataFrame:
    """Each session after its actions in order: status, revision (accepted actions), elapsed milliseconds, current question, answered and assessed questions, refused actions.

    ``actions``: key, seq, at in ms, action, question_id and value (JSON: ``choice`` or parts of an answer, or grades of parts);
    ``models``: key, question_id, kind and parts of the session's questions. A session begins, running, at its first action. An action
    that its status, question or value doesn't allow changes nothing. Actions pass one after the other, however many they are.
    """
    rows = actions.join(models.select(key, "question_id", "kind", "parts"), [key, "question_id"], "left")
    rows = rows.select(key, F.col("seq").cast("long").alias("seq"), F.col("at").cast("long").alias("at"), "action", F.col("question_id").cast("long").alias("question_id"), "value", "kind", "parts")

    def start(row: dict) -> tuple:
        return row[key], Session(since=row["at"])

    def step(state: tuple, row: dict) -> tuple:
        state[1].act(row)
        return ()

    def finish(state: tuple) -> tuple:
        own, s = state
        answered = sum(any(v.strip() for v in x.values()) for x in s.answers.values())
        return ({key: own, "status": s.status, "revision": s.revision, "elapsed": s.elapsed, "current_question": s.current, "answered": answered, "assessed": len(s.assessments), "refused": s.refused},)

    kinds = {key: rows.schema[key].dataType.simpleString(), "status": "string", "revision": "long", "elapsed": "long", "current_question": "long", "answered": "long", "assessed": "long", "refused": "long"}
    return sorted_fold(rows, [key], ["seq"], start, step, finish, kinds)


def elapsed(base: Column, since: Column, now: Column, active: Column) -> Column:
    """W10."""
    return base + F.when(active, F.greatest(F.lit(0), now - since)).otherwise(0)


def hms(seconds: Column) -> Column:
    """C22."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))


def open_twice(sessions: DataFrame, *scope: str) -> DataFrame:
    """Scopes with more than one open session."""
    return sessions.where(F.col("status").isin("active", "paused")).groupBy(*scope).agg(F.count("*").alias("open")).where("open > 1")


def history(sessions: DataFrame, status=None, exam=None, archived: bool = False) -> DataFrame:
    """Sessions that meet the filters, the newest first, then by id."""
    out = sessions.where(F.col("status").isin(*ARCHIVED) == F.lit(archived))
    if status is not None:
        out = out.where(F.col("status") == status)
    if exam is not None:
        out = out.where(F.array_contains("exams", exam))
    return out.orderBy(F.desc("started_at"), "session_id")


def next_question(questions: DataFrame, states: DataFrame, right: str = "richtig") -> DataFrame:
    """Of questions (question_id, pos) and states (user_id, question_id, state; null: unanswered): where each user goes on, the counts, and the rounded rate.

    That is the first unanswered question, else the first that isn't right, else the first. A user's answers are numbered in
    the order of the questions: the first whose number isn't its question's place shows the first gap. So users meet only
    the questions that they have answered; no user is paired with all questions.
    """
    place = F.row_number().over(W.orderBy("pos", "question_id"))  # one row for each question of the bank
    placed = questions.select("question_id", "pos").distinct().select("question_id", place.alias("place"))
    size = placed.count()
    own = states.where("state is not null").join(placed, "question_id").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("place")))
    found = own.groupBy("user_id").agg(F.min(F.when(F.col("n") != F.col("place"), F.col("n"))).alias("gap"), F.min(F.when(F.col("state") != right, F.col("place"))).alias("wrong"), F.count("*").alias("answered"), F.count_if(F.col("state") == right).alias("correct"))
    x = states.select("user_id").distinct().join(found, "user_id", "left").na.fill(0, ["answered", "correct"])
    after = F.when(F.col("answered") < size, F.col("answered") + 1)
    x = x.withColumn("place", F.coalesce("gap", after, "wrong", F.lit(1)).cast("int")).join(placed, "place", "left")
    return x.select("user_id", F.col("question_id").alias("next_question"), "answered", "correct", F.round(F.try_divide(F.lit(100.0) * F.col("correct"), F.col("answered"))).alias("rate"))
