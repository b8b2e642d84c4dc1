"""Exact deduplication by counting quotient filters.

Each partition keeps the 64-bit fingerprints of its texts in counting quotient filters, one for each range: the high
bits (quotient) choose a slot, the slot's run holds sorted remainders with counts. Filters of one range merge losslessly:
their runs are sorted by quotient and remainder already, so one is inserted into the other place by place, and equal
remainders add their counts; nothing is sorted anew. Fingerprints counted more than once are verified byte by byte; all
others are unique.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import materialize, table, text_of

#: Quotient bits of a filter; its slots are one run length each.
QUOTIENT = 14
#: Filters of one range that a task holds before it merges them.
HELD = 8


class CountingQuotientFilter:
    """The fingerprints of one range: those that share their bits above QUOTIENT and the remainder.

    ``runs``: how many remainders each quotient has (the filter's occupied and run-end bits, as one number a slot);
    ``remainders``: all runs one after the other, each sorted; ``counts``: one for each remainder.
    """

    def __init__(self, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.runs, self.remainders, self.counts = runs, remainders, counts

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> CountingQuotientFilter:
        """Of unsigned fingerprints below 2**bits, in any order and with repeats."""
        return cls.of_sorted(*np.unique(values, return_counts=True), bits)

    @classmethod
    def of_sorted(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """Of distinct fingerprints in ascending order."""
        low = np.uint64(bits - QUOTIENT)
        runs = np.bincount((values >> low).astype(np.int64), minlength=1 << QUOTIENT)
        return cls(runs.astype("<u4"), (values & ((np.uint64(1) << low) - np.uint64(1))).astype("<u8"), counts.astype("<u8"))

    def values(self, bits: int) -> np.ndarray:
        quotients = np.repeat(np.arange(1 << QUOTIENT, dtype=np.uint64), self.runs)
        return (quotients << np.uint64(bits - QUOTIENT)) | self.remainders

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter], bits: int) -> CountingQuotientFilter:
        """Two at a time, as sorted runs: equal remainders of a quotient add their counts, others go in at their place."""
        held = [(f.values(bits), f.counts) for f in filters]
        while len(held) > 1:
            held = [_merged(*held[i], *held[i + 1]) if i + 1 < len(held) else held[i] for i in range(0, len(held), 2)]
        return cls.of_sorted(*held[0], bits)

    def dump(self) -> bytes:
        slots = np.flatnonzero(self.runs).astype("<u2")
        return b"".join([len(slots).to_bytes(4, "little"), slots.tobytes(), self.runs[slots].tobytes(), self.remainders.tobytes(), self.counts.tobytes()])

    @classmethod
    def load(cls, data: bytes) -> CountingQuotientFilter:
        n = int.from_bytes(data[:4], "little")
        slots, held = np.frombuffer(data, "<u2", n, 4), np.frombuffer(data, "<u4", n, 4 + 2 * n)
        runs = np.zeros(1 << QUOTIENT, "<u4")
        runs[slots] = held
        m = int(held.sum())
        return cls(runs, np.frombuffer(data, "<u8", m, 4 + 6 * n), np.frombuffer(data, "<u8", m, 4 + 6 * n + 8 * m))


def _merged(values: np.ndarray, counts: np.ndarray, more: np.ndarray, more_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending lists of distinct values with counts as one."""
    if len(values) < len(more):
        values, counts, more, more_counts = more, more_counts, values, counts
    at = np.searchsorted(values, more)
    known = at < len(values)
    known[known] = values[at[known]] == more[known]
    counts = counts.copy()
    counts[at[known]] += more_counts[known]
    return np.insert(values, at[~known], more[~known]), np.insert(counts, at[~known], more_counts[~known])


def repeated(fingerprints: DataFrame, column: str, ranges: int) -> DataFrame:
    """The fingerprints (long) that stand in more than one row, with ``n``: one filter for each partition and range, merged by range."""
    top = max(1, (ranges - 1).bit_length())
    bits = 64 - top

    def build(batches):
        held: dict[int, list[CountingQuotientFilter]] = {}
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            where = values >> np.uint64(bits)
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[order])) + 1
            parts = np.split(values[order], cuts) if len(values) else []
            low = (np.uint64(1) << np.uint64(bits)) - np.uint64(1)
            for p in parts:
                own = held.setdefault(int(p[0] >> np.uint64(bits)), [])
                own.append(CountingQuotientFilter.build(p & low, bits))
                if len(own) == HELD:
                    own[:] = [CountingQuotientFilter.merge(own, bits)]
        for at, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([CountingQuotientFilter.merge(own, bits).dump()], pa.binary())], names=["range", "filter"])

    def merge(key, rows):
        held = [CountingQuotientFilter.load(data) for data in rows.column("filter").to_pylist()]
        merged = CountingQuotientFilter.merge(held, bits)
        more = merged.counts > 1
        values = merged.values(bits)[more] | (np.uint64(key[0].as_py()) << np.uint64(bits))
        return pa.table({"fingerprint": values.view(np.int64), "n": merged.counts[more].astype(np.int64)})

    filters = fingerprints.select(column).mapInArrow(build, "range long, filter binary")
    return filters.groupBy("range").applyInArrow(merge, "fingerprint long, n long")


def normalised(text: str = "text"):
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their normalised bytes are; of equal texts the row with the smallest key stays (a null key
    counts as larger than all others), and of rows with that same key exactly one. Null texts count as empty.
    """
    spark = df.sparkSession
    norm = normalised(text)
    rows = df.select(F.col(key).alias("key"), norm.alias("norm"))
    rows = rows.select("key", F.xxhash64("norm").alias("fingerprint"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "exact")
    found = materialize(repeated(rows, "fingerprint", max(16, rows.count() // 200_000)), "repeated")

    # byte verification: copies meet by fingerprint and digest, and their bytes must all agree
    texts = df.select(norm.alias("norm")).select("norm", F.xxhash64("norm").alias("fingerprint"))
    texts = texts.join(found.select("fingerprint"), "fingerprint", "left_semi")
    checked = texts.groupBy("fingerprint", F.unhex(F.sha2("norm", 256)).alias("sha")).agg((F.min("norm") == F.max("norm")).alias("same"))
    if not materialize(checked, "verified").where(~F.col("same")).isEmpty():
        raise ValueError("texts with equal SHA-256 differ: use another digest")
    order = F.struct(F.col("key").isNull(), "key", "row")
    again = rows.join(found.select("fingerprint"), "fingerprint", "left_semi")
    best = again.groupBy("fingerprint", "sha").agg(F.min(order).alias("best"), F.count("*").alias("size"))
    best = materialize(best, "best")  # so that both sides of the join are dealt anew and a hot group can be split
    out = rows.join(best, ["fingerprint", "sha"], "left")
    return out.select(
        F.col("key").alias(key),
        F.when(F.col("size").isNull(), F.col("key")).otherwise(F.col("best.key")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay; of rows with one key and one text exactly one.

    Null texts are empty ones, whole texts count, however long, and a null key stays only if its text has no other key.
    Columns may have any names but ``__k``, ``__s`` and ``__sha``, which raise ValueError. An empty table stays empty.
    """
    if {"__k", "__s", "__sha"} & set(df.columns):
        raise ValueError("__k, __s and __sha are names of helper columns")
    found = groups(df, key, text).select(F.col(key).alias("__k"), F.col("text_sha256").alias("__s"), "kept")
    marked = df.withColumn("__sha", F.sha2(normalised(text), 256))
    kept = materialize(found.groupBy("__k", "__s").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")), "kept")
    same = [marked[key].eqNullSafe(F.col("__k")), F.col("__sha") == F.col("__s")]
    once = marked.join(kept.where("kept and n = 1").select("__k", "__s"), same, "left_semi")
    again = kept.where("kept and n > 1")
    if not again.isEmpty():
        more = marked.join(again.select("__k", "__s"), same, "left_semi").dropDuplicates([key, "__sha"])
        once = once.unionByName(more)
    return once.select(df.columns)


def op10_exact_dedup(spark, sf_dir) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM d
"""
