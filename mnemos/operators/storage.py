"""Stores and caches: pushes, migrations, page caches, active evidence, datasets with overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Mutations of a push, at most.
BATCH = 100


def pushed(mutations: DataFrame, most: int = BATCH) -> DataFrame:
    """(device, mutation_id, batch): each mutation of a device once, in batches of at most so many, in order."""
    once = mutations.groupBy("device", "mutation_id").agg(F.min("seq").alias("seq"))
    return once.select("device", "mutation_id", F.floor((F.row_number().over(W.partitionBy("device").orderBy("seq", "mutation_id")) - 1) / most).alias("batch"))


def snapshot(tables: dict[str, DataFrame], owner: Column) -> DataFrame:
    """The rows of one owner in several tables, as (store, rows): all from the same read of each table."""
    out = None
    for name, df in tables.items():
        own = df.where(owner).agg(F.count("*").alias("rows")).select(F.lit(name).alias("store"), "rows")
        out = own if out is None else out.unionByName(own)
    return out


def migrated(registry: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """The registry with the derived rows that it doesn't have; of derived ones with one key the first stays."""
    columns = [c for c in registry.columns if c != key]
    new = derived.groupBy(key).agg(F.min(F.struct(*columns)).alias("x")).select(key, "x.*")
    return registry.unionByName(new.join(registry, key, "left_anti").select(registry.columns))


def page_lines(pages: DataFrame) -> DataFrame:
    """Page, width, height and its lines as structs, from top to bottom; ``lines``: text and box; lines without a box are left out."""
    boxed = F.filter("lines", lambda x: x["x0"].isNotNull())
    return pages.select("page", "width", "height", F.array_sort(F.transform(boxed, lambda x: F.struct(x["y0"].alias("y0"), x["x0"].alias("x0"), x["text"].alias("text")))).alias("lines"))


def changed_pages(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages (source, page, key, mark) to work on: those that the cache doesn't have under the same key and content mark."""
    return pages.join(cache.select("source", "page", "key", "mark"), ["source", "page", "key", "mark"], "left_anti")


def complete_caches(caches: DataFrame, pages: DataFrame) -> DataFrame:
    """(source, problem): caches that aren't complete, whose hash isn't the source's, or that lack pages."""
    n = pages.groupBy("source").agg(F.count_distinct("page").alias("have"))
    x = caches.join(n, "source", "left")
    problem = F.when(F.coalesce("status", F.lit("")) != "complete", "incomplete").when(~F.col("sha").eqNullSafe(F.col("source_sha")), "hash").when(F.coalesce("have", F.lit(0)) != F.col("pages"), "pages")
    return x.select("source", problem.alias("problem")).where("problem is not null")


def active_evidence(manifest: DataFrame, reports: DataFrame) -> DataFrame:
    """Of each scope the report of the manifest's active key; null if it is gone."""
    return manifest.join(reports.select("scope", F.col("key").alias("active_key"), "report"), ["scope", "active_key"], "left")


def attachments(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """The cached image of each attachment's page by hash and page; ``missing`` where there is none."""
    return wanted.join(cache.select("sha", "page", "image"), ["sha", "page"], "left").withColumn("missing", F.col("image").isNull())


def layout_reuse(profiles: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages that several profiles read, each once, with the profiles: a shared cache serves them all."""
    return profiles.join(pages, "source").groupBy("source", "page").agg(F.array_sort(F.collect_set("profile")).alias("profiles")).where(F.size("profiles") > 1)


def promoted(runs: DataFrame) -> DataFrame:
    """Of each profile its last run, if that run is compatible and approved; an earlier one never stands in for it."""
    last = runs.groupBy("profile").agg(F.max_by(F.struct("run", "status", "approved"), "run").alias("x")).select("profile", "x.*")
    return last.where((F.col("status") == "compatible") & F.coalesce("approved", F.lit(False))).select("profile", "run")


def resumable(topics: DataFrame, progress: DataFrame, runs: DataFrame) -> DataFrame:
    """the saved run of a topic's definition, by the definition's key and then the run's id; topics without one are left out."""
    return topics.join(progress, "definition_key").join(runs.select("run_id"), "run_id", "left_semi").select("topic", "run_id")


def topic_definition(topic: Column) -> Column:
    """a training over one topic and nothing else; lists are sorted and empty ones stay."""
    empty = F.array().cast("array<string>")
    return F.struct(empty.alias("examIds"), empty.alias("knowledgeTopicIds"), empty.alias("moduleIds"), empty.alias("questionTypeIds"), F.array(topic).alias("wisoTopicIds"))


def manual_rows(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """confirmation rows for queue items with an answer from 1 to 5; others are refused and left out. The machine's answer stays beside it."""
    x = queue.join(answers.select("question_id", F.col("answer").alias("chosen")), "question_id").where("chosen between 1 and 5")
    return x.select("question_id", F.col("chosen").alias("answer"), F.col("answer").alias("machine_answer"), F.lit("confirmed").alias("status"), F.lit(True).alias("locked"), "evidence")


def preview_counts(items: DataFrame, expected: int) -> DataFrame:
    """(folder, rule): previews without exactly so many items, or with a number, an anchor or a bad hash twice."""
    x = items.groupBy("folder").agg(F.count("*").alias("n"), F.count_distinct("number").alias("numbers"), F.count_distinct("anchor").alias("anchors"), F.count_if(~F.col("sha").eqNullSafe(F.col("actual"))).alias("bad"))
    rules = F.filter(F.array(F.when(F.col("n") != expected, "count"), F.when(F.col("numbers") != F.col("n"), "numbers"), F.when(F.col("anchors") != F.col("n"), "anchors"), F.when(F.col("bad") > 0, "hash")), lambda r: r.isNotNull())
    return x.select("folder", F.explode(rules).alias("rule"))


def gated_members(members: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Archive members (member, sha256) whose hash is registered and not blocked, and registered sources that no member has."""
    good = registry.where("status <> 'blocked'").select("source_id", "sha256")
    return members.join(good, "sha256"), good.join(members, "sha256", "left_anti").select("source_id")


def artifact_digest(path: Column, content: Column, entries: str) -> Column:
    """Of a .json artifact the digest of its canonical form (``entries``: its top level as a map), of any other that of its bytes."""
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
    return F.sha2(F.when(F.endswith(path, F.lit(".json")), canonical).otherwise(content), 256)


def backup(current: DataFrame, incoming: DataFrame, key: str, synced: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a backup's import adds, its conflicts, and the rows to send: those added if the account is synced, else none."""
    from mnemos.sources.tables import merge_import

    new, conflicts = merge_import(current, incoming, key)
    return new, conflicts, new if synced else new.limit(0)


def extracted(questions: DataFrame, cache: DataFrame, clip: DataFrame, ocr: DataFrame, least: float = 0.5) -> DataFrame:
    """A question's text by the first that has one: the cache of its revision, the page's text, its own, or OCR at ``least`` confidence; with the method, ``none`` if all fail.

    Blank texts count as missing.
    """
    some = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    x = questions.join(cache.select("question_id", "revision", F.col("text").alias("cached")), ["question_id", "revision"], "left")
    x = x.join(clip.select("question_id", F.col("text").alias("clipped")), "question_id", "left").join(ocr.select("question_id", F.col("text").alias("read"), "confidence"), "question_id", "left")
    read = F.when(F.col("confidence") >= least, some("read"))
    method = F.when(some("cached").isNotNull(), "cache").when(some("clipped").isNotNull(), "pdf_text").when(some("text").isNotNull(), "existing").when(read.isNotNull(), "ocr").otherwise("none")
    return x.select("question_id", F.coalesce(some("cached"), some("clipped"), some("text"), read).alias("text"), method.alias("method"))


def grid_centres(columns: DataFrame, rows: int = 5) -> DataFrame:
    """(item, row, x, y): the centres of a column's fields, ``pitch`` apart from the first one down; columns off the page have none."""
    inside = columns.where((F.col("x").between(0, F.col("width"))) & (F.col("y") >= 0) & (F.col("y") + (rows - 1) * F.col("pitch") <= F.col("height")))
    return inside.select("item", F.explode(F.sequence(F.lit(1), F.lit(rows))).alias("row"), "x", "y", "pitch").select("item", "row", "x", (F.col("y") + (F.col("row") - 1) * F.col("pitch")).alias("y"))
