"""Releases of answers and solutions: identities, bindings, promotion plans, and checks of their artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.operators.registry import STAGES
from mnemos.operators.validators import violations

FORMAL = STAGES[STAGES.index("formal_segmented") :]


def hashed(column: Column) -> Column:
    """A SHA-256 in lower-case hex."""
    return F.coalesce(F.rlike(column, F.lit("^[0-9a-f]{64}$")), F.lit(False))


def identity_problems(questions: DataFrame, expected: DataFrame) -> DataFrame:
    """(scope, problem): numbers missing or unexpected, a number or an id twice."""
    found = questions.groupBy("scope", "number").agg(F.count("*").alias("n"))
    x = found.join(expected.select("scope", "number").distinct().withColumn("wanted", F.lit(True)), ["scope", "number"], "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "number_twice")
    twice = questions.groupBy("scope", "question_id").agg(F.count("*").alias("n")).where("n > 1").select("scope", F.lit("id_twice").alias("problem"))
    return x.select("scope", problem.alias("problem")).where("problem is not null").unionByName(twice).groupBy("scope", "problem").agg(F.count("*").alias("rows"))


def bundle(questions: DataFrame, answers: DataFrame, solutions: DataFrame) -> DataFrame:
    """(scope, question_id, problem) of questions: numerics need one safe answer of their id, the others one solution; rows that fit no question are extra."""
    numeric = F.rlike("number", F.lit(r"^\d+$"))
    a = answers.groupBy("scope", "number").agg(F.count("*").alias("n"), F.min("question_id").alias("answer_id"), F.bool_and((F.col("answer") >= 1) & (F.col("answer") <= 5) & F.col("status").isin("auto_ready", "confirmed")).alias("safe"))
    u = solutions.groupBy("scope", "number").agg(F.count("*").alias("m"), F.min("question_id").alias("solution_id"))
    x = questions.select("scope", "number", "question_id").join(a, ["scope", "number"], "full_outer").join(u, ["scope", "number"], "full_outer")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    problem = (
        F.when(F.col("question_id").isNull(), "extra").when(numeric & (n != 1), "answer_coverage").when(numeric & ~F.coalesce("safe", F.lit(False)), "unsafe_answer").when(numeric & (F.col("answer_id") != F.col("question_id")), "answer_identity")
        .when(~numeric & (m != 1), "solution_coverage").when(~numeric & (F.col("solution_id") != F.col("question_id")), "solution_identity")
    )
    return x.select("scope", "number", problem.alias("problem")).where("problem is not null")


def preview_problems(items: DataFrame, anchors: DataFrame, regions: DataFrame) -> DataFrame:
    """(anchor_id, problem): an accepted item whose anchor is gone or has another number, hash or number of regions, and anchors without an item."""
    r = regions.groupBy(F.col("owner").alias("anchor_id")).agg(F.count("*").alias("found"))
    a = anchors.select("anchor_id", F.col("number").alias("anchor_number"), F.col("sha").alias("anchor_sha"))
    x = items.join(a, "anchor_id", "full_outer").join(r, "anchor_id", "left")
    problem = F.when(F.col("anchor_number").isNull(), "no_anchor").when(F.col("number").isNull(), "no_item").when(F.col("number") != F.col("anchor_number"), "number").when(F.col("sha") != F.col("anchor_sha"), "hash").when(F.coalesce("found", F.lit(0)) != F.col("regions"), "regions")
    return x.select("anchor_id", problem.alias("problem")).where("problem is not null")


def dataset_bindings(gates: DataFrame) -> DataFrame:
    """Of each source the dataset it is bound to: of its artifacts (source_id, path, sha) that end in _segmented.json the first, public ones first; null where their hashes differ."""
    own = gates.where(F.endswith("path", F.lit("_segmented.json")))
    x = own.groupBy("source_id").agg(F.min_by("path", F.struct(~F.startswith("path", F.lit("public/")), F.col("path"))).alias("path"), F.count_distinct("sha").alias("hashes"), F.min("sha").alias("sha"))
    return x.select("source_id", F.when(F.col("hashes") == 1, F.col("path")).alias("path"), F.when(F.col("hashes") == 1, F.col("sha")).alias("sha"))


def identity_bindings(sources: DataFrame, bindings: DataFrame) -> DataFrame:
    """Each replacing source with the bindings of the old and the new dataset."""
    old, new = (bindings.select(F.col("source_id").alias(k), F.col("sha").alias(f"{p}_sha"), F.col("path").alias(f"{p}_path")) for p, k in (("old", "supersedes"), ("new", "source_id")))
    return sources.where("supersedes is not null").select("source_id", "supersedes").join(old, "supersedes", "left").join(new, "source_id", "left")


def first_formal(sources: DataFrame, stages: DataFrame) -> DataFrame:
    """Replacing sources (scope, version) whose predecessors never reached a formal stage, with a digest of those predecessors.

    Of ``stages`` (source_id, stage) those in FORMAL count. No predecessor, no row.
    """
    formal = stages.where(F.col("stage").isin(*FORMAL)).select("source_id").distinct().withColumn("formal", F.lit(True))
    x = sources.join(formal, "source_id", "left")
    old = x.select("scope", F.col("source_id").alias("old_id"), F.col("version").alias("old_version"), F.coalesce("formal", F.lit(False)).alias("old_formal"), F.col("sha256").alias("old_sha"))
    pairs = sources.join(old, "scope").where("old_version < version")  # a scope has a handful of versions
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("old_id").cast("string"), "old_sha"))), ","), 256)
    return pairs.groupBy("source_id").agg(F.bool_or("old_formal").alias("any"), digest.alias("predecessors")).where("not any").drop("any")


def decision_problems(decisions: DataFrame, bindings: DataFrame) -> DataFrame:
    """(source_id, problem) of preserving decisions: both id lists whole, without repeats and equal as sets to each other and to the datasets', and reviewed."""
    same = lambda a, b: F.array_sort(F.array_distinct(F.col(a))) == F.array_sort(F.array_distinct(F.col(b)))
    x = decisions.join(bindings.select("source_id", "old_dataset_ids", "new_dataset_ids"), "source_id", "left")
    once = lambda c: F.size(F.array_distinct(F.col(c))) == F.size(F.col(c))
    rules = {"bound": F.col("old_dataset_ids").isNotNull(), "repeats": once("old_ids") & once("new_ids"), "mapping": same("old_ids", "new_ids"), "old": same("old_ids", "old_dataset_ids"), "new": same("new_ids", "new_dataset_ids"), "reviewed": F.trim("reviewed_by") != ""}
    return violations(x, "source_id", rules)


def promotion_plan(machine: DataFrame, ledger: DataFrame, holds: DataFrame) -> DataFrame:
    """Of each module its answers, how many a person must still confirm, whether it is held, and whether it is ready.

    ``machine``: module, question_id, status; an answer that isn't auto_ready needs a row of the ledger.
    """
    x = machine.join(ledger.select("question_id").distinct().withColumn("confirmed", F.lit(True)), "question_id", "left")
    open_ = (F.col("status") != "auto_ready") & F.col("confirmed").isNull()
    x = x.groupBy("module").agg(F.count("*").alias("answers"), F.count_if(F.coalesce(open_, F.lit(True))).alias("unresolved"))
    held = holds.select("module").distinct().withColumn("held", F.lit(True))
    return x.join(held, "module", "left").select("module", "answers", "unresolved", F.coalesce("held", F.lit(False)).alias("held"), ((F.col("unresolved") == 0) & F.col("held").isNull()).alias("ready"))


def applied_plan(current: DataFrame, machine: DataFrame, plan: DataFrame) -> DataFrame:
    """The released answers after a plan: those of ready modules are replaced, all others stay."""
    ready = plan.where("ready").select("module")
    return current.join(ready, "module", "left_anti").unionByName(machine.join(ready, "module", "left_semi").select(current.columns))


def rewritten_owners(attachments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Attachments with the owners of a confirmed decision that names their evidence; all others keep theirs."""
    ok = decisions.where("decision = 'confirmed'").select("id", "evidence", F.col("owners").alias("new"))
    return attachments.join(ok, ["id", "evidence"], "left").select("id", "evidence", F.coalesce("new", "owners").alias("owners"), F.col("new").isNotNull().alias("rewritten"))


def frozen_changes(original: DataFrame, reviewed: DataFrame, allowed: list[str], changed: DataFrame, key: str = "id") -> DataFrame:
    """(key, problem): rows missing or extra, and rows that differ beyond the allowed columns, or at all if they aren't among those that may change."""
    frozen = [c for c in original.columns if c != key and c not in allowed]
    mark = lambda df, n: df.select(key, F.sha2(F.to_json(F.struct(*frozen), {"ignoreNullFields": "false"}), 256).alias(f"{n}_frozen"), F.sha2(F.to_json(F.struct(*frozen, *allowed), {"ignoreNullFields": "false"}), 256).alias(f"{n}_all"))
    x = mark(original, "a").join(mark(reviewed, "b"), key, "full_outer").join(changed.select(key).distinct().withColumn("may", F.lit(True)), key, "left")
    problem = F.when(F.col("b_all").isNull(), "missing").when(F.col("a_all").isNull(), "extra").when(F.col("a_frozen") != F.col("b_frozen"), "frozen").when((F.col("a_all") != F.col("b_all")) & F.col("may").isNull(), "not_allowed")
    return x.select(key, problem.alias("problem")).where("problem is not null")


def current_proposals(events: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals (source_id, proposal_hash) that the source's last proposal event names."""
    last = events.where("stage = 'profile_revision_proposed'").groupBy("source_id").agg(F.max_by("proposal_hash", "seq").alias("proposal_hash"))
    return proposals.join(last, ["source_id", "proposal_hash"], "left_semi")


def evidence_problems(gates: DataFrame) -> DataFrame:
    """(source_id, rule): a gate names its source's hash, has passed, and has artifacts, all with a path and a hash (map path to hash)."""
    good = F.forall(F.map_entries("artifacts"), lambda e: (e["key"] != "") & hashed(e["value"]))
    return violations(gates, "source_id", {"hash": F.col("source_sha256") == F.col("sha256"), "passed": F.col("result") == "passed", "artifacts": (F.size("artifacts") > 0) & good})


def artifact_problems(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): artifacts that are missing or have another hash."""
    x = expected.join(found.select("path", F.col("sha").alias("have")), "path", "left")
    return x.select("path", F.when(F.col("have").isNull(), "missing").when(~F.col("have").eqNullSafe(F.col("sha")), "changed").alias("problem")).where("problem is not null")


def answer_problems(answers: DataFrame) -> DataFrame:
    """(id, rule): a ready answer is 1 to 5 without reasons, any other has none but reasons; the box lies on the page."""
    ready = F.col("status") == "auto_ready"
    rules = {
        "answer": F.when(ready, F.col("answer").between(1, 5) & (F.size("reasons") == 0)).otherwise(F.col("answer").isNull() & (F.size("reasons") > 0)),
        "box": (F.col("x0") >= 0) & (F.col("x0") < F.col("x1")) & (F.col("x1") <= F.col("width")) & (F.col("y0") >= 0) & (F.col("y0") < F.col("y1")) & (F.col("y1") <= F.col("height")),
        "rows": F.col("measurements") == 5,
    }
    return violations(answers, "id", rules)


def solution_problems(solutions: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, rule): a solution is of a written question with that id, ready, of the source, and names no sub-part twice."""
    q = questions.where(F.startswith("number", F.lit("U"))).select("number", F.col("question_id").alias("wanted"))
    x = solutions.join(q, "number", "left")
    return violations(x, "id", {"question": F.col("question_id") == F.col("wanted"), "status": F.col("status") == "auto_ready", "parts": F.size(F.array_distinct("parts")) == F.size("parts")})


def card_problems(cards: DataFrame, versions: DataFrame, summaries: DataFrame) -> DataFrame:
    """(card, rule): ids once, question and answer not blank, questions of the summary, a verified current version of the same date, https sources."""
    v = versions.select("topic", "version", F.col("verified_at").alias("version_at"), (F.col("verified") & F.col("current")).alias("fine"))
    x = cards.join(v, ["topic", "version"], "left").join(summaries.select("topic", F.col("question_ids").alias("own")), "topic", "left")
    twice = cards.groupBy("card").agg(F.count("*").alias("n")).where("n > 1").select("card", F.lit("unique").alias("rule"))
    rules = {
        "text": (F.trim("question") != "") & (F.trim("answer") != ""), "questions": (F.size("question_ids") > 0) & (F.size(F.array_except("question_ids", "own")) == 0), "version": F.col("fine"), "date": F.col("verified_at") == F.col("version_at"),
        "sources": (F.size("urls") > 0) & F.forall("urls", lambda u: F.startswith(u, F.lit("https://"))),
    }
    return violations(x, "card", rules).distinct().unionByName(twice)


def clipped(boxes: DataFrame) -> DataFrame:
    """Boxes cut to their page (width, height), whether that changed them, and whether nothing is left."""
    x0, y0, x1, y1 = F.greatest("x0", F.lit(0.0)), F.greatest("y0", F.lit(0.0)), F.least("x1", "width"), F.least("y1", "height")
    same = (x0 == F.col("x0")) & (y0 == F.col("y0")) & (x1 == F.col("x1")) & (y1 == F.col("y1"))
    return boxes.select("id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), (~same).alias("changed"), ((x0 >= x1) | (y0 >= y1)).alias("empty"))


def bounds_problems(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids whose new box isn't exactly the old one cut to the page, or is empty."""
    x = clipped(old).join(new.select("id", *[F.col(c).alias(f"new_{c}") for c in ("x0", "y0", "x1", "y1")]), "id", "full_outer")
    exact = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        exact = exact & F.col(c).eqNullSafe(F.col(f"new_{c}"))
    return x.where(~exact | F.coalesce("empty", F.lit(False))).select("id")


def binding_problems(confirmations: DataFrame, proposals: DataFrame, fields: list[str]) -> DataFrame:
    """(id, rule): a confirmation equals its proposal in every field, null too, is confirmed and has a time."""
    x = confirmations.join(proposals.select("id", *[F.col(c).alias(f"wanted_{c}") for c in fields], F.lit(True).alias("there")), "id", "left")
    rules = {"proposal": F.col("there")} | {c: F.col("there").isNull() | F.col(c).eqNullSafe(F.col(f"wanted_{c}")) for c in fields} | {"status": F.col("status") == "confirmed", "time": F.try_to_timestamp("confirmed_at").isNotNull()}
    return violations(x, "id", rules)


def profile_of(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each source with the one profile of its exam, module and exact hash; null where there is none: no fallback."""
    return sources.join(profiles, ["exam", "module", "sha256"], "left").select("source_id", "profile")


def accepted_geometry(pages: DataFrame, sizes: list[tuple[float, float]], within: float = 1.0) -> DataFrame:
    """Pages whose size is nearly one of those allowed."""
    near = F.lit(False)
    for width, height in sizes:
        near = near | ((F.abs(F.col("width") - width) < within) & (F.abs(F.col("height") - height) < within))
    return pages.withColumn("accepted", F.coalesce(near, F.lit(False)))


def patch(image: Column, row_bytes: Column, x0: Column, y0: Column, x1: Column, y1: Column, depth: int = 1) -> Column:
    """The bytes of a rectangle of raw pixels, row by row; x1 and y1 are outside it."""
    rows = F.transform(F.sequence(y0, y1 - 1), lambda y: F.substring(image, (y * row_bytes + x0 * depth + 1).cast("int"), ((x1 - x0) * depth).cast("int")))
    return F.when((x1 > x0) & (y1 > y0), F.aggregate(rows, F.lit(b""), lambda a, b: F.concat(a, b))).otherwise(F.lit(b""))


def pixel_hash(pixels: Column, width: Column, height: Column) -> Column:
    """Of pixels together with their size."""
    return F.sha2(F.concat(F.encode(F.concat_ws("x", width.cast("string"), height.cast("string")), "utf-8"), F.encode(F.lit(":"), "utf-8"), pixels), 256)
