"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts, repeated epochs.

Each row gets a random key, the MD5 of the seed and its own key. A source's rows stand in the order of their random
keys, which are evenly spread: equal ranges of them are the partitions of the range sort, as many as the source's
size asks for, so a hot source is split and no sampling is needed. Prefix sums are sums over the ranges before plus a
running sum within the range. A source's budget is as many whole epochs as fit and a cut at the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemos.llm.common import materialize, table, text_of

#: Words that a range of random keys holds, about.
RANGE_WORDS = 2_000_000
#: Hex digits of the random key that the finest ranges are made of.
DIGITS = 3


def words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: int = 150, most: int = 2) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each row of ``sizes`` (source, source_size: one row for each source).

    Sources by code point, null last, get the weights in turn. They share ``share`` percent of all sizes by weight; a
    target stops at ``most`` times its source's size and the excess is reshared by weight until none is above. The
    numbers up to the last division are integers, so the result is exact. If all stop, all targets are at their limit.
    The windows have one row for each source. Sources of size zero have target zero.
    """
    rank = W.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(rank) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long")
    x = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    # sources by what they can take for a unit of weight; the first of them stop while the level lies above
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = W.partitionBy(F.lit(1))
    x = x.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # in hundredths of a word: what is left once those before have stopped
    x = x.withColumn("left", F.lit(share) * F.col("all_size") - 100 * F.col("cap_before")).withColumn("weight_left", F.col("all_weight") - F.col("weight_before"))
    x = x.withColumn("stops", 100 * F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("weight"))
    x = x.withColumn("first_left", F.max(F.when(~F.col("stops"), F.col("left"))).over(every)).withColumn("first_weight", F.max(F.when(~F.col("stops"), F.col("weight_left"))).over(every))
    level = (F.col("first_left") * F.col("weight")).cast("double") / (F.lit(100) * F.col("first_weight")).cast("double")
    return x.select("source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (3, 1, 2), share: int = 150, most: int = 2, seed: int = 0) -> DataFrame:
    """One row for each row of ``df``: ``key``, ``size``, ``source_size``, ``target``, ``taken`` and the ``row`` number it had in ``df``.

    ``taken`` is the words that the mix takes of the row: its whole size in every full epoch of its source, and in the
    last one the part before the cut, so a source's sum is its target rounded down. Null and empty texts have size
    zero and nothing taken; null sources are one source; rows with the same key are ordered by size, and those that
    are alike in both are interchangeable. An empty table gives no rows. Reruns give the same rows.
    """
    random = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), words(text).alias("size"), random.alias("random"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "mix")
    fine = rows.groupBy("source", F.substring("random", 1, DIGITS).alias("fine")).agg(F.sum("size").alias("words"))
    fine = materialize(fine, "ranges")  # at most 16 ** DIGITS rows for each source
    own = targets(fine.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    # fine ranges are gathered until RANGE_WORDS are reached; their order is that of the random keys
    by = W.partitionBy("source").orderBy("fine").rowsBetween(W.unboundedPreceding, -1)
    fine = fine.withColumn("before", F.coalesce(F.sum("words").over(by), F.lit(0)))
    fine = fine.withColumn("range", (F.col("before") / RANGE_WORDS).cast("long"))
    start = W.partitionBy("source", "range")
    fine = fine.withColumn("range_start", F.min("before").over(start)).select(F.col("source").alias("s"), "fine", "range", "range_start")
    rows = rows.join(fine, rows.source.eqNullSafe(fine.s) & (F.substring("random", 1, DIGITS) == fine.fine)).drop("s")
    inside = W.partitionBy("source", "range").orderBy("random", "key", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    own = own.withColumnRenamed("source", "s")
    rows = rows.join(own, rows.source.eqNullSafe(own.s)).drop("s")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start")))
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"), "row")


def mixed(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` that the mix takes, one copy for each epoch that takes them; a row that a cut goes through stays whole.

    Rows that the mix takes no word of go, those without words (null, empty and blank texts) among them. Rows alike in
    key and size get the copies of the one that has most; null keys and sources are values like any other. Columns named
    ``__key``, ``__size``, ``__words``, ``__copies`` or ``__copy`` raise ValueError. An empty table stays empty.
    """
    if {"__key", "__size", "__words", "__copies", "__copy"} & set(df.columns):
        raise ValueError("__key, __size, __words, __copies and __copy are names of helper columns")
    copies = mix(df, key, source, text, **how).where("taken > 0").groupBy(F.col(key).alias("__key"), F.col("size").alias("__size")).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("__copies"))
    sized = df.withColumn("__words", words(text))
    met = sized.join(copies, sized[key].eqNullSafe(copies["__key"]) & (sized["__words"] == copies["__size"]))
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(df.columns)


def op8_mix_sources(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("row")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('0:' || doc_id) AS random FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::HUGEINT AS weight, 2 * source_size AS cap FROM s),
x AS (SELECT *, 150 * sum(source_size) OVER () - 100 * coalesce(sum(cap) OVER f, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS weight_left
      FROM w WINDOW f AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, 100 * cap * weight_left <= rest * weight AS stops FROM x),
t AS (SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE (max(rest) FILTER (NOT stops) OVER () * weight)::DOUBLE / (100 * max(weight_left) FILTER (NOT stops) OVER ())::DOUBLE END AS target FROM y),
r AS (SELECT d.*, source_size, target, coalesce(floor(target)::HUGEINT // nullif(source_size, 0), 0) AS epochs, coalesce(floor(target)::HUGEINT % nullif(source_size, 0), 0) AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY random, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM r
"""
