"""Lookups with fallbacks, orders, and small derived tables around questions, modules and exams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemos.functions.dealing import in_lists

#: Ranks of known modules; all others come after them (fixed values).
RANKS = {"arbeitsplanung": 10, "funktionsanalyse": 20, "wiso": 30}
LAST_RANK = 100


def module_rank(module: Column) -> Column:
    """The configured rank, 100 without one."""
    out = F.lit(LAST_RANK)
    for name, rank in RANKS.items():
        out = F.when(F.lower(module) == name, rank).otherwise(out)
    return out


def exam_label(exam: Column) -> Column:
    """2024-sommer and 2024-25-winter as seasons, anything else as it is."""
    summer, winter = F.regexp_extract(exam, r"^(\d{4})-sommer$", 1), F.regexp_extract(exam, r"^(\d{4}-\d{2})-winter$", 1)
    return F.when(summer != "", F.concat(F.lit("Sommer "), summer)).when(winter != "", F.concat(F.lit("Winter "), F.replace(winter, F.lit("-"), F.lit("/")))).otherwise(exam)


def exam_options(modules: DataFrame) -> DataFrame:
    """The distinct exams with labels and their place: by year, summer first, then as text. A row for each exam: few."""
    x = modules.select("exam").where("exam is not null").distinct()
    order = W.orderBy(F.substring("exam", 1, 4).try_cast("int"), F.endswith("exam", F.lit("winter")), "exam")
    return x.select("exam", exam_label(F.col("exam")).alias("label"), F.row_number().over(order).alias("place"))


def module_list(modules: DataFrame, exams: DataFrame) -> DataFrame:
    """Modules (exam, module) with their place: by the exam's place, rank, name."""
    x = modules.select("exam", "module").distinct().join(exams.select("exam", F.col("place").alias("exam_place")), "exam")
    return x.select("exam", "module", F.row_number().over(W.orderBy("exam_place", module_rank(F.col("module")), "module")).alias("place"))


def first_per_module(listed: DataFrame) -> DataFrame:
    """Of each module the first of the list."""
    return listed.groupBy("module").agg(F.min_by("exam", "place").alias("exam"))


def ranked_modules(inventory: DataFrame) -> DataFrame:
    """The distinct modules with their place by rank and name."""
    return inventory.select("module").distinct().select("module", F.row_number().over(W.orderBy(module_rank(F.col("module")), "module")).alias("place"))


def retargeted(routes: DataFrame, modules: DataFrame, questions: DataFrame) -> DataFrame:
    """routes (id, module, number, exam to go to) at another exam: its same module, else its first one; the number stays if the module has it, else its first.

    ``modules``: exam, module, place; ``questions``: exam, module, number, pos. A route to an exam without modules stays.
    """
    first = modules.groupBy("exam").agg(F.min_by("module", "place").alias("first_module"))
    same = modules.select("exam", "module", F.lit(True).alias("same"))
    x = routes.join(same, ["exam", "module"], "left").join(first, "exam", "left")
    x = x.withColumn("target", F.when(F.col("same"), F.col("module")).otherwise(F.col("first_module")))
    q = questions.select("exam", F.col("module").alias("target"), "number", F.lit(True).alias("has")).distinct()
    begin = questions.groupBy("exam", F.col("module").alias("target")).agg(F.min_by("number", "pos").alias("begin"))
    x = x.join(q, ["exam", "target", "number"], "left").join(begin, ["exam", "target"], "left")
    return x.select("id", "exam", F.coalesce("target", "module").alias("module"), F.when(F.col("target").isNull() | F.col("has"), F.col("number")).otherwise(F.col("begin")).alias("number"))


def selection_label(chosen: Column, label: Column, one: str = "Jahrgänge ausgewählt") -> Column:
    """what a selection is called; null stands for all. ``label``: of the first chosen."""
    n = F.size(chosen)
    return F.when(chosen.isNull(), "Alle Jahre").when(n == 0, "Keine ausgewählt").when(n == 1, F.coalesce(label, F.lit("Nicht verfügbar"))).otherwise(F.concat(n.cast("string"), F.lit(" " + one)))


def context_pages(own: Column, description: Column, attachments: Column, is_open: Column) -> Column:
    """the pages given for a question; else, of open questions, the description's and the attachments'."""
    shared = F.array_distinct(F.filter(F.concat(F.array(description), attachments), lambda p: p > 0))
    return F.when(own.isNotNull(), F.array_distinct(own)).when(is_open, shared).otherwise(F.array().cast("array<int>"))


def headings(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """F32: (page, top, number) of lines that head a question: a named number, or a bare one near the left margin and above the foot, from 1 to 40."""
    x = lines.join(pages.select("page", "width", "height"), "page")
    text = F.trim("text")
    named, bare = F.regexp_extract(text, r"(?i)^(?:Aufgabe\s+|U\s*)(\d{1,2})[.):]?$", 1), F.regexp_extract(text, r"^(\d{1,2})[.)]?$", 1)
    at_margin = (F.col("x0") < F.col("width") * 0.14) & (F.col("y0") < F.col("height") * 0.9)
    number = F.when(named != "", named).when((bare != "") & at_margin, bare).try_cast("int")
    return x.select("page", F.col("y0").alias("top"), number.alias("number")).where("number between 1 and 40")


def suspected(lines: DataFrame, slots: DataFrame) -> DataFrame:
    """the heading slots (page, slot, x, y) near which a short, tall line stands."""
    short = lines.where((F.length(F.trim("text")) <= 4) & (F.col("y1") - F.col("y0") >= 18)).select("page", "x0", "y0")
    near = (F.abs(F.col("x0") - F.col("x")) < 14) & (F.col("y0") >= F.col("y") - 8) & (F.col("y0") <= F.col("y") + 24)
    return slots.join(short, "page").where(near).select("page", "slot").distinct()


def solution_pages(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(question_id, page) where a solution page names the question's module and, after Aufgabe or U, its number.

    The numbers are taken out of a text once, and texts and modules that many rows share are compared once. What comes out
    can be far more than questions and pages: lists of both meet, and the pairs of lists are dealt out to all tasks before they
    are written out.
    """
    found = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(r"(?i)(?:Aufgabe|U)\s*(\d+)\b"), F.lit(1)))
    listed = in_lists(pages.select("page", "text"), ["text"], "page", "pages")
    numbers = listed.select("pages", F.lower("text").alias("text"), F.explode(found).alias("number"))
    asked = in_lists(questions.select("question_id", "number", F.lower("module").alias("module")), ["number", "module"], "question_id", "questions")
    met = asked.join(numbers.hint("merge"), "number").where(F.contains("text", "module")).select("questions", "pages")
    met = met.repartition(8 * met.sparkSession.sparkContext.defaultParallelism, F.xxhash64("questions"), F.xxhash64("pages"))
    return met.select("pages", F.explode("questions").alias("q")).select("q.question_id", F.explode("pages").alias("p")).select("question_id", "p.page")


def corrections(questions: DataFrame, notes: DataFrame) -> DataFrame:
    """Each question with its corrections, one row each; those without have none."""
    return questions.join(notes, "question_id")


def eligible_cards(cards: DataFrame, summaries: DataFrame, today: str) -> DataFrame:
    """cards of the topic's current and valid version, checked by today, with an answer, sources, and only questions of the summary."""
    x = cards.join(summaries.select("topic", F.col("version").alias("current"), F.col("question_ids").alias("own"), "valid"), "topic")
    inside = (F.size("question_ids") > 0) & (F.size(F.array_except("question_ids", "own")) == 0)
    return x.where(F.col("valid") & (F.col("version") == F.col("current")) & (F.col("verified_at") <= F.lit(today).cast("date")) & (F.trim("answer") != "") & (F.col("sources") > 0) & inside).select("card", "topic")


def still_valid(versions: DataFrame, today: str) -> DataFrame:
    """(topic_id, id) of the versions marked current that are verified by today, hold on it, and aren't overtaken by a later one that began since."""
    day = F.lit(today).cast("date")
    now = versions.where(F.col("current") & F.col("verified") & (F.col("verified_at") <= day))
    now = now.where((F.col("effective_from").isNull() | (F.col("effective_from") <= day)) & (F.col("effective_until").isNull() | (day < F.col("effective_until"))))
    later = versions.where(F.col("effective_from") <= day).select("topic_id", F.col("id").alias("other"), F.col("effective_from").alias("began"))
    last = later.groupBy("topic_id").agg(F.max(F.struct("began", "other")).alias("x"))
    x = now.join(last, "topic_id", "left")
    return x.where(F.col("x").isNull() | (F.col("x.other") == F.col("id")) | (F.col("x.began") <= F.col("as_of"))).select("topic_id", "id")


def provenance(questions: DataFrame, solutions: DataFrame, scope: list[str]) -> DataFrame:
    """of each scope the ids, hashes and revisions of its question and solution sources; scopes with one of them only are left out."""
    q = questions.select(*scope, F.col("source_id").alias("question_source_id"), F.col("sha256").alias("question_source_sha256"), F.col("layout_profile").alias("source_revision"))
    a = solutions.select(*scope, F.col("source_id").alias("solution_source_id"), F.col("sha256").alias("solution_source_sha256"), F.coalesce("manual_revision", "answer_profile").alias("official_answer_revision"))
    return q.join(a, scope)


def usable_source(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """(source_id, problem) of requests: unregistered, blocked or with another hash; none means usable."""
    x = requests.join(registry.select("source_id", "status", F.col("sha256").alias("known")), "source_id", "left")
    problem = F.when(F.col("known").isNull(), "unregistered").when(F.col("status") == "blocked", "blocked").when(~F.col("known").eqNullSafe(F.col("sha256")), "hash")
    return x.select("source_id", problem.alias("problem"))


def scopes(requests: DataFrame, known: DataFrame) -> DataFrame:
    """each requested scope with its settings, or ``missing``."""
    return requests.join(known, "scope", "left").withColumn("missing", F.col("settings").isNull())


def need_work(membership: DataFrame, wrong: DataFrame, unsure: DataFrame) -> DataFrame:
    """(topic, needed): questions that are wrong or unsure, each once."""
    ids = wrong.select("question_id").unionByName(unsure.select("question_id")).distinct()
    return membership.join(ids, "question_id").groupBy("topic").agg(F.count_distinct("question_id").alias("needed"))


def overall(questions: DataFrame, membership: DataFrame, latest: DataFrame, support: int = 3) -> DataFrame:
    """One row: questions, classified, unclassified, coverage in percent, answered, accuracy (null below ``support``)."""
    q = questions.select("question_id").distinct()
    size = q.join(membership.select("question_id").distinct().withColumn("in", F.lit(1)), "question_id", "left").agg(F.count("*").alias("questions"), F.count("in").alias("classified"))
    own = latest.join(q, "question_id", "left_semi").agg(F.count("*").alias("answered"), F.count_if(F.col("correctness") == "richtig").alias("correct"))
    x = size.join(own)  # one row each
    accuracy = F.when(F.col("answered") >= support, F.round(F.lit(100.0) * F.col("correct") / F.col("answered"), 6))
    return x.select("questions", "classified", (F.col("questions") - F.col("classified")).alias("unclassified"), F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("classified"), "questions"), F.lit(0.0)), 6).alias("coverage"), "answered", accuracy.alias("accuracy"))


def inventory(modules: DataFrame, provenance_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The questions of all modules (module, questions array of struct number, question_id, text) with provenance and revision hash, and ids that come twice."""
    q = modules.select("module", F.explode("questions").alias("q")).select("module", "q.*").join(provenance_, "module", "left")
    revision = F.sha2(F.to_json(F.struct("module", "number", "question_id", "text", "source_sha"), {"ignoreNullFields": "false"}), 256)
    out = q.withColumn("revision", revision)
    return out, out.groupBy("question_id").agg(F.count("*").alias("n")).where("n > 1")


def examined(documents: DataFrame) -> DataFrame:
    """(document, page, number, text) of the proposals of all pages, flattened; pages without one have no row."""
    pages = documents.select("document", F.explode("pages").alias("p"))
    return pages.select("document", "p.page", F.explode("p.proposals").alias("c")).select("document", "page", "c.number", "c.text")


def unclear_marks(measured: DataFrame, rings: tuple[float, float], margin: float, thresholds: int) -> DataFrame:
    """(item, answer, reasons): at every threshold one row that is strong, no other possible, by a margin; all thresholds agree.

    ``measured``: item, threshold, row, ring; ``rings``: least of a strong and of a possible ring.
    """
    strong, possible = F.col("ring") >= rings[0], F.col("ring") >= rings[1]
    per = measured.groupBy("item", "threshold").agg(
        F.count_if(strong).alias("strong"), F.count_if(possible).alias("possible"), F.max_by("row", F.struct("ring", "row")).alias("row"), F.max("ring").alias("top"), F.sort_array(F.collect_list("ring"), asc=False).alias("all"), F.count("*").alias("rows")
    )
    second = F.coalesce(F.get("all", F.lit(1)), F.lit(0.0))
    per = per.withColumns({"unique": (F.col("strong") == 1) & (F.col("possible") == 1), "clear": (F.col("strong") != 1) | (F.col("top") - second >= margin), "five": F.col("rows") == 5})
    x = per.groupBy("item").agg(F.bool_and("unique").alias("unique"), F.bool_and("clear").alias("clear"), F.bool_and("five").alias("five"), F.count_distinct(F.when(F.col("strong") == 1, F.col("row"))).alias("answers"), F.count_if(F.col("strong") == 1).alias("decided"), F.max("row").alias("answer"))
    reasons = F.filter(F.array(F.when(~F.col("five"), "five_dot_positions_not_clear"), F.when(~F.col("clear"), "insufficient_margin"), F.when(~F.col("unique"), "no_unique_circle"), F.when((F.col("answers") != 1) | (F.col("decided") != thresholds), "threshold_disagreement")), lambda r: r.isNotNull())
    return x.select("item", F.when(F.size(reasons) == 0, F.col("answer")).alias("answer"), reasons.alias("reasons"))
