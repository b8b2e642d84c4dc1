"""Change logs: compare-and-swap per key as a batch fold, outboxes, pulls and remote rows.

A mutation names the revision it was made on. It applies if that is the current one, is a conflict otherwise, and does
nothing if its id has been seen. Late rows are those with a revision at or below the known one; they are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemos.functions.folding import sorted_fold

#: Bytes of a mutation, at most.
LIMIT = 200_000


def valid(mutations: DataFrame) -> DataFrame:
    """Mutations with ids, a base revision and a bounded value."""
    return mutations.where("mutation_id is not null and entity is not null and id is not null and base_revision >= 0").where(F.octet_length(F.coalesce("value", F.lit(""))) <= LIMIT)


def fold(mutations: DataFrame, state: DataFrame | None = None, receipts: DataFrame | None = None) -> DataFrame:
    """For each (entity, id) the revision, value, deletion and counts after its mutations, in the order of ``seq``.

    ``state``: (entity, id, revision, value, deleted) before; ``receipts``: (entity, id, mutation_id) that came before,
    whose repetition does nothing, as within the batch. A key's mutations pass one after the other, so its log may be of
    any length. ``streaming.sync`` has the whole protocol, with answers to each mutation.
    """
    first = F.row_number().over(W.partitionBy("entity", "id", "mutation_id").orderBy("seq", "base_revision", "deleted", "value"))
    rows = mutations.withColumn("again", first > 1)
    if receipts is not None:
        known = receipts.select("entity", "id", "mutation_id").distinct().withColumn("known", F.lit(True))
        rows = rows.join(known, ["entity", "id", "mutation_id"], "left").withColumn("again", F.col("again") | F.coalesce("known", F.lit(False)))
    if state is not None:
        rows = rows.join(state.select("entity", "id", F.col("revision").alias("r0"), F.col("value").alias("v0"), F.col("deleted").alias("d0")), ["entity", "id"], "left")
    else:
        rows = rows.withColumns({"r0": F.lit(None).cast("long"), "v0": F.lit(None).cast("string"), "d0": F.lit(None).cast("boolean")})
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("entity", "id")}

    def start(m: dict) -> dict:
        return {"entity": m["entity"], "id": m["id"], "revision": m["r0"] or 0, "value": m["v0"], "deleted": m["d0"] or False, "conflicts": 0, "repeats": 0}

    def step(s: dict, m: dict) -> tuple:
        if m["again"]:
            s["repeats"] += 1
        elif m["base_revision"] != s["revision"]:
            s["conflicts"] += 1
        else:
            s |= {"revision": s["revision"] + 1, "value": None if m["deleted"] else m["value"], "deleted": m["deleted"]}
        return ()

    rows = rows.select("entity", "id", "seq", "mutation_id", F.col("base_revision").cast("long").alias("base_revision"), "deleted", F.col("value").cast("string").alias("value"), "again", "r0", "v0", "d0")
    out = kinds | {"revision": "long", "value": "string", "deleted": "boolean", "conflicts": "long", "repeats": "long"}
    return sorted_fold(rows, ["entity", "id"], ["seq", "mutation_id"], start, step, lambda s: (s,), out)


def receive(local: DataFrame, pending: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows to apply, and the conflicts with local pending changes; rows that aren't newer are dropped.

    Both versions of a conflict stay: the remote one in the second table, the local one pending.
    """
    newest = remote.groupBy("entity", "id").agg(F.max_by(F.struct("value", "deleted"), "revision").alias("x"), F.max("revision").alias("revision")).select("entity", "id", "revision", "x.*")
    known = local.select("entity", "id", F.col("revision").alias("known"))
    news = newest.join(known, ["entity", "id"], "left").where(F.col("revision") > F.coalesce("known", F.lit(0))).drop("known")
    return news.join(pending, ["entity", "id"], "left_anti"), news.join(pending, ["entity", "id"], "left_semi")


def outbox(changes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The latest pending change of each key, less those in conflict."""
    latest = changes.groupBy("entity", "id").agg(F.max_by(F.struct("mutation_id", "base_revision", "value"), "seq").alias("x")).select("entity", "id", "x.*")
    return latest.join(conflicts, ["entity", "id"], "left_anti")


def cursors(applied: DataFrame, last: DataFrame) -> DataFrame:
    """The applied changes (user_id, seq, ...) with the next numbers of their user's log, in the order of ``seq``; ``last``: (user_id, cursor) so far, none is zero."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("seq"))
    return applied.withColumn("place", place).join(last.select("user_id", F.col("cursor").alias("before")), "user_id", "left").withColumn("cursor", F.coalesce("before", F.lit(0)) + F.col("place")).drop("before", "place")


def pulls(log: DataFrame, devices: DataFrame, limit: int = 100) -> DataFrame:
    """(device, user_id, cursor, page, more): all that a device hasn't seen of its user's log, in pages of ``limit``, and whether another page follows.

    ``devices``: device, user_id, cursor. A device that has seen everything has no row.
    """
    x = devices.select("device", "user_id", F.col("cursor").alias("seen")).join(log.select("user_id", "cursor"), "user_id").where("cursor > seen")
    by = W.partitionBy("device")
    x = x.withColumns({"n": F.row_number().over(by.orderBy("cursor")), "all": F.count("*").over(by)})
    page = F.floor((F.col("n") - 1) / limit)
    return x.select("device", "user_id", "cursor", page.alias("page"), ((page + 1) * limit < F.col("all")).alias("more"))
