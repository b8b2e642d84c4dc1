"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import forget, materialize


def _least(edges: DataFrame) -> DataFrame:
    """``u``, ``m``: the least of u and its neighbours; partial minima are taken before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = _least(down)
    hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node reachable) for each node of ``edges`` (columns u, v of one orderable type).

    Loops and repeated edges don't matter; no edges give no rows. Each round is a table in the shared folder; the
    driver sees its row count and checksum only. Rounds go on until nothing changes: the sum of the labels sinks with each.
    """
    now = materialize(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    mark = state(now)
    while True:
        new = materialize(_round(now), "edges")
        forget(now)
        seen, mark, now = mark, state(new), new
        if seen == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
