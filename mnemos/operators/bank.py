"""The question bank: reconciliation with a taxonomy, filters, facets and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence below which a classification is looked at by a person.
SURE = 0.8
#: Review reasons that don't ask for a person.
ORDINARY = ("new_question", "parent_only")


def closure(nodes: DataFrame) -> DataFrame:
    """(topic, member): each node with itself, and each parent with its children (trees are two deep)."""
    own = nodes.select(F.col("id").alias("topic"), F.col("id").alias("member"))
    return own.unionByName(nodes.where("parent_id is not null").select(F.col("parent_id").alias("topic"), F.col("id").alias("member"))).distinct()


def reconcile(inventory: DataFrame, previous: DataFrame, now: str) -> DataFrame:
    """Each question of either side with what becomes of its classification.

    New questions are to be classified; of changed ones the locked stay with a reason and the others lose their topics;
    questions that have gone become inactive; all others stay as they are.
    """
    new = inventory.select("question_id", F.col("revision").alias("new_revision"))
    x = new.join(previous, "question_id", "full_outer")
    fresh, gone = F.col("revision").isNull(), F.col("new_revision").isNull()
    differs = ~fresh & ~gone & (F.col("revision") != F.col("new_revision"))
    status = F.when(fresh, "new").when(gone, "removed").when(differs & F.col("locked"), "locked_changed").when(differs, "changed").otherwise("same")
    reason = F.when(fresh, F.array(F.lit("new_question"))).when(differs & F.col("locked"), F.array(F.lit("source_changed"))).otherwise(F.array().cast("array<string>"))
    topics = F.when(fresh | (differs & ~F.col("locked")), F.array().cast("array<int>")).otherwise(F.col("topic_ids"))
    stamp = F.when(status == "same", F.col("updated_at")).otherwise(F.lit(now).cast("timestamp"))
    return x.select("question_id", status.alias("status"), topics.alias("topic_ids"), reason.alias("reasons"), (~gone).alias("active"), F.coalesce("locked", F.lit(False)).alias("locked"), F.coalesce("new_revision", "revision").alias("revision"), stamp.alias("updated_at"))


def override(base: DataFrame, overrides: DataFrame, key: str = "question_id") -> DataFrame:
    """The override's columns where there is one, the base's otherwise; rows of either side."""
    rest = [c for c in base.columns if c != key]
    o = overrides.select(key, F.struct(*rest).alias("o"))
    return base.select(key, F.struct(*rest).alias("b")).join(o, key, "full_outer").select(key, *[F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in rest])


def edit_conflicts(current: DataFrame, expected: DataFrame, key: str = "question_id") -> DataFrame:
    """Keys whose current row isn't the one that an edit expects; edits apply if there is none."""
    rest = [c for c in expected.columns if c != key]
    mark = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*rest)), 256).alias("mark"))
    return mark(expected).join(mark(current), [key, "mark"], "left_anti").select(key)


def needs_review(confidence: Column, reasons: Column, active: Column) -> Column:
    """active, and unsure or with a reason that isn't ordinary."""
    return active & ((confidence < SURE) | (F.size(F.filter(reasons, lambda r: ~r.isin(*ORDINARY))) > 0))


#: Reasons that never ask for a person, and those that do so only after a confirmation (fixed values).
SILENT = ("candidate_requires_confirmation", "text_not_trustworthy", "taxonomy_changed_since_confirmation")
MACHINE_SILENT = ("knowledge_unclassified", "question_type_unclassified")


def exceptional(reasons: Column, source: Column) -> Column:
    """the reasons that ask for a person."""
    return F.filter(reasons, lambda r: ~r.isin(*SILENT) & ((source == "human_confirmed") | ~r.isin(*MACHINE_SILENT)))


def includes_source(chosen: Column, exam: Column) -> Column:
    """null stands for all."""
    return chosen.isNull() | F.array_contains(chosen, exam)


def confirmation(knowledge: Column, primary: Column, secondary: Column) -> Column:
    """topics without repeats, the main type not among the others, and the reasons that stay open."""
    others = F.array_distinct(F.filter(secondary, lambda x: ~x.eqNullSafe(primary)))
    reasons = F.filter(F.array(F.when(F.size(knowledge) == 0, "knowledge_unclassified"), F.when(primary.isNull(), "question_type_unclassified")), lambda x: x.isNotNull())
    return F.struct(F.array_distinct(knowledge).alias("knowledge"), primary.alias("primary_type"), others.alias("secondary"), reasons.alias("reasons"))


def select(questions: DataFrame, classified: DataFrame, nodes: DataFrame, modules=None, exams=None, kinds=None, topics=None, only: DataFrame | None = None, unclassified: bool = False) -> DataFrame:
    """questions that meet all facets given; a topic stands for its children too; ``only`` is a list of ids (such as wrong ones)."""
    out = questions
    for column, values in (("module", modules), ("exam", exams), ("kind", kinds)):
        if values is not None:
            out = out.where(F.col(column).isin(*values))
    if topics is not None:
        members = closure(nodes).where(F.col("topic").isin(*topics)).select(F.col("member").alias("t")).distinct()
        tagged = classified.select("question_id", F.explode("topic_ids").alias("t")).join(members, "t", "left_semi")
        out = out.join(tagged, "question_id", "left_semi")
    if unclassified:
        out = out.join(classified.where("size(topic_ids) > 0"), "question_id", "left_anti")
    return out if only is None else out.join(only.select("question_id"), "question_id", "left_semi")


def facets(questions: DataFrame, classified: DataFrame, nodes: DataFrame) -> DataFrame:
    """Questions of each topic with its children, empty ones dropped, and the largest count for scaling."""
    tagged = classified.select("question_id", F.explode("topic_ids").alias("member")).join(questions.select("question_id"), "question_id", "left_semi")
    counts = tagged.join(closure(nodes), "member").groupBy("topic").agg(F.count_distinct("question_id").alias("questions"))
    return counts.join(counts.agg(F.max("questions").alias("most")))  # one row


def classification_counts(inventory: DataFrame, classified: DataFrame, *by: str) -> DataFrame:
    """Questions, classified, unclassified, locked and to be reviewed, for each value of ``by`` or overall."""
    x = inventory.join(classified, "question_id", "left")
    has = F.size(F.coalesce("topic_ids", F.array().cast("array<int>"))) > 0
    review = needs_review(F.coalesce("confidence", F.lit(0.0)), F.coalesce("reasons", F.array().cast("array<string>")), F.lit(True))
    return x.groupBy(*by).agg(F.count("*").alias("questions"), F.count_if(has).alias("classified"), F.count_if(~has).alias("unclassified"), F.count_if(F.coalesce("locked", F.lit(False))).alias("locked"), F.count_if(review).alias("review"))


def canonical(*lists: str) -> Column:
    """One key for a definition, whatever the order and repeats in its lists."""
    return F.to_json(F.struct(*[F.array_sort(F.array_distinct(F.col(c))).alias(c) for c in lists]))


def parent_only(classified: DataFrame, nodes: DataFrame) -> DataFrame:
    """(topic, questions): questions tagged with a parent but with none of its children."""
    tagged = classified.select("question_id", F.explode("topic_ids").alias("id"))
    parents = nodes.where("parent_id is null").select("id")
    children = nodes.where("parent_id is not null").select("id", "parent_id")
    below = tagged.join(children, "id").select("question_id", F.col("parent_id").alias("id"))
    return tagged.join(parents, "id").join(below, ["question_id", "id"], "left_anti").groupBy(F.col("id").alias("topic")).agg(F.count_distinct("question_id").alias("questions"))


def pool_changes(now: DataFrame, saved: DataFrame) -> DataFrame:
    """question_id and added, removed or changed, for pools of (question_id, revision)."""
    x = now.select("question_id", F.col("revision").alias("a")).join(saved.select("question_id", F.col("revision").alias("b")), "question_id", "full_outer")
    return x.where(~F.col("a").eqNullSafe(F.col("b"))).select("question_id", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed").alias("change"))


def set_equal(a: Column, b: Column) -> Column:
    """The same ids, in any order."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def source_list(text: Column) -> Column:
    """A comma-separated list, trimmed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def toggled(chosen: Column, one: Column) -> Column:
    """the list without the id if it has it, else with it at the end."""
    return F.when(F.array_contains(chosen, one), F.array_remove(chosen, one)).otherwise(F.array_append(chosen, one))


def all_available(chosen: Column, available: Column) -> Column:
    """F16."""
    return F.size(F.array_except(chosen, available)) == 0


def found(term: Column, *columns: str) -> Column:
    """the term, in any case, within the columns' text."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(term))
