"""Topics: membership, statistics, relevance, priority and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemos.functions.text import fold
from mnemos.operators.bank import closure

#: Distinct answered questions below which a topic has no accuracy.
SUPPORT = 3
#: Weights of questions, seasons and recent seasons, and the limits of the labels.
RELEVANCE, OFTEN = (0.4, 0.4, 0.2), (0.7, 0.5, 0.25)
#: Weights of relevance, need and weakness, the bonus of what was never practised, the limits of the labels, and the accuracy below which a topic is weak.
PRIORITY, UNPRACTISED, URGENT, WEAK = (1.0, 2.0, 1.0), 0.25, (0.9, 0.5), 60


def season_key(season: Column) -> list[Column]:
    """By year, summer before the rest, then as text."""
    return [F.substring(season, 1, 4).cast("int"), F.when(F.contains(season, F.lit("sommer")), 0).otherwise(1), season]


def recent(seasons: DataFrame, n: int) -> DataFrame:
    """The last n seasons; the window has one row for each season."""
    rank = F.row_number().over(W.orderBy(*[c.desc() for c in season_key(F.col("season"))]))
    return seasons.select("season").distinct().withColumn("rank", rank).where(F.col("rank") <= n).select("season")


def members(classified: DataFrame, nodes: DataFrame) -> DataFrame:
    """(topic, question_id), each pair once; topics overlap."""
    tagged = classified.select("question_id", F.explode("topic_ids").alias("member"))
    return tagged.join(closure(nodes), "member").select("topic", "question_id").distinct()


def statistics(membership: DataFrame, questions: DataFrame, latest: DataFrame, last_seasons: DataFrame, support: int = SUPPORT) -> DataFrame:
    """Of each topic its questions, seasons, the recent ones, kinds, answers, accuracy (null below ``support`` answered questions), first and last season, last practice."""
    q = questions.join(last_seasons.withColumn("new", F.lit(True)), "season", "left").select("question_id", "season", "kind", F.coalesce("new", F.lit(False)).alias("new"))
    order = F.struct(*season_key(F.col("season")))
    size = membership.join(q, "question_id").groupBy("topic").agg(
        F.count_distinct("question_id").alias("questions"), F.count_distinct("season").alias("seasons"), F.count_distinct(F.when(F.col("new"), F.col("season"))).alias("recent_seasons"),
        F.count_if(F.col("kind") == "multi_part").alias("multi_part"), F.min_by("season", order).alias("first_season"), F.max_by("season", order).alias("last_season"),
    )
    own = membership.join(latest, "question_id").groupBy("topic").agg(F.count_distinct("question_id").alias("answered_questions"), F.count("*").alias("answers"), F.count_if(F.col("correctness") == "richtig").alias("correct"), F.max("ts").alias("last_practiced"))
    out = size.join(own, "topic", "left").na.fill(0, ["answered_questions", "answers", "correct"])
    accuracy = F.when(F.col("answered_questions") >= support, F.round(F.try_divide(100.0 * F.col("correct"), F.col("answers")), 6))
    return out.withColumn("accuracy", accuracy)


def relevance(stats: DataFrame, all_questions: int, all_seasons: int, all_recent: int) -> DataFrame:
    """The shares of questions, seasons and recent seasons, weighed; four labels."""
    shares = (("questions", all_questions), ("seasons", all_seasons), ("recent_seasons", all_recent))
    score = F.round(sum((F.lit(w) * F.col(c) / F.lit(max(n, 1)) for w, (c, n) in zip(RELEVANCE, shares, strict=True)), F.lit(0.0)), 6)
    label = F.when(F.col("relevance") >= OFTEN[0], "very_high").when(F.col("relevance") >= OFTEN[1], "high").when(F.col("relevance") >= OFTEN[2], "medium").otherwise("low")
    return stats.withColumn("relevance", score).withColumn("relevance_label", label)


def priority(stats: DataFrame, needs: DataFrame) -> DataFrame:
    """A10: relevance, with the share of questions that need work (topic, needed), weakness below an accuracy, and a bonus for what was never practised."""
    x = stats.join(needs, "topic", "left")
    need = F.coalesce(F.try_divide(F.coalesce("needed", F.lit(0)), F.col("questions")), F.lit(0.0))
    weak = F.when(F.col("accuracy") < WEAK, 1 - F.col("accuracy") / 100).otherwise(0.0)
    own = F.when(F.col("answers") == 0, UNPRACTISED).otherwise(0.0)
    score = F.round(PRIORITY[0] * F.col("relevance") + PRIORITY[1] * need + PRIORITY[2] * weak + own, 6)
    label = F.when(F.col("priority") >= URGENT[0], "now").when(F.col("priority") >= URGENT[1], "soon").otherwise("later")
    return x.withColumn("priority", score).withColumn("priority_label", label).drop("needed")


def candidates(membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """Topics with a question that none of their children has: what is ranked, so that a parent doesn't repeat its children."""
    children = nodes.where("parent_id is not null").select(F.col("id").alias("topic"), "parent_id")
    covered = membership.join(children, "topic").select(F.col("parent_id").alias("topic"), "question_id").distinct()
    return membership.join(covered, ["topic", "question_id"], "left_anti").select("topic").distinct()


def frequent(stats: DataFrame, n: int = 8) -> DataFrame:
    """O09, of the candidates."""
    return stats.orderBy(F.desc("relevance"), F.desc("questions"), "topic").limit(n)


def ranked(stats: DataFrame) -> DataFrame:
    """O10, of the candidates: by priority, the longest unpractised first, with the rank; the first is the next focus."""
    order = W.orderBy(F.desc("priority"), F.coalesce("last_practiced", F.lit("1970-01-01").cast("timestamp")), "topic")
    return stats.withColumn("rank", F.row_number().over(order))


def usable(text: Column) -> Column:
    """60 characters without white space around, four words of three letters, 45 letters, and fewer than three replacement characters."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return (F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) >= 60) & (count("[A-Za-zÄÖÜäöüß]{3,}") >= 4) & (count("[A-Za-zÄÖÜäöüß]") >= 45) & (count("\ufffd") < 3)


#: Reasons that ask for an ordinary review (fixed values).
CHANGES = ("source_changed_since_confirmation", "source_changed", "taxonomy_labels_inactive", "proposed_new_wiso_topic")


def ordinary_review(topics: Column, confidence: Column, reasons: Column) -> Column:
    """no classification, no topic, unsure, or a reason that says that something changed."""
    listed = F.coalesce(F.exists(reasons, lambda r: r.isin(*CHANGES)), F.lit(False))
    return topics.isNull() | (F.size(topics) == 0) | F.coalesce(confidence < 0.8, F.lit(True)) | listed


def legal_review(reasons: Column) -> Column:
    """F19."""
    return F.coalesce(F.exists(reasons, lambda r: F.startswith(r, F.lit("legal_"))), F.lit(False))


def legal_reasons(relevant: Column, current: Column, begins: Column, supersedes: Column) -> Column:
    """why a summary needs a legal look; none where the law doesn't matter. ``supersedes``: number of versions replaced."""
    all_ = F.array(F.when(~F.coalesce(current, F.lit(False)), "validity"), F.when(current.isNotNull() & begins.isNull(), "begin_unknown"), F.when(supersedes > 0, "replacement"))
    return F.when(relevant, F.filter(all_, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def trusted_text(text: Column, confidence: Column) -> Column:
    """The text, or an empty one if it isn't usable or sure enough."""
    return F.when(F.coalesce(usable(text) & (confidence >= 0.85), F.lit(False)), text).otherwise("")


def stem(text: Column) -> Column:
    """What stands before the first question mark, 700 characters at most."""
    return F.substring(F.split_part(text, F.lit("?"), F.lit(1)), 1, 700)


def cue_hits(texts: DataFrame, cues: dict[str, str], text: str = "text") -> DataFrame:
    """``topics``: the cues (topic to pattern) that the stem matches, in the order of the list.

    Both are without blanks, and the stem is folded and has its words put together again that a line's end cut.
    """
    own = F.replace(F.replace(F.replace(fold(stem(F.col(text))), F.lit("-\n")), F.lit("\n")), F.lit(" "))
    return texts.withColumn("topics", F.filter(F.array(*[F.when(F.rlike(own, F.lit(p.replace(" ", ""))), F.lit(t)) for t, p in cues.items()]), lambda x: x.isNotNull()))


def policy(score: Column, topics: Column, locked: Column) -> Column:
    """What becomes of a proposal; a locked one stays, whatever its score, and without topics or a score it needs a person."""
    unsure = F.coalesce(F.size(topics) <= 0, F.lit(True)) | F.coalesce(score < 0.8, F.lit(True))
    return F.when(F.coalesce(locked, F.lit(False)), "locked").when(unsure, "classification_needs_review").when(score >= 0.95, "machine_accepted_high_confidence").otherwise("machine_suggested")


def proposals(hits: DataFrame, season: str, least: int = 3) -> DataFrame:
    """Cues that occur in so many seasons at least, most seasons first.

    Where ``hits`` has them, only rows whose ``classified`` is false, whose ``confidence`` is at least 0.85 and whose ``text`` is
    usable support a cue.
    """
    for column, rule in (("classified", ~F.col("classified")), ("confidence", F.col("confidence") >= 0.85), ("text", usable(F.col("text")))):
        hits = hits.where(rule) if column in hits.columns else hits
    found = hits.select(F.explode("topics").alias("topic"), F.col(season).alias("season"))
    return found.groupBy("topic").agg(F.count_distinct("season").alias("seasons"), F.count("*").alias("questions")).where(F.col("seasons") >= least)
