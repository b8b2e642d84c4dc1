"""How rows are dealt out to tasks before work that multiplies or sorts them."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tasks(df: DataFrame, rows: int) -> int:
    """How many tasks get about ``rows`` rows of ``df`` each; one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, ceil(df.count() / rows))


def dealt(df: DataFrame, *keys: str, rows: int) -> DataFrame:
    """``df`` dealt out by ``keys`` (by turns without) to so many tasks that each gets about ``rows`` rows, so that a task doesn't grow with the table.

    A small file is one task, however much its rows become later; and neither sizes of files nor adaptive execution see that.
    The rows are counted first, which Parquet answers without reading them.
    """
    return df.repartition(tasks(df, rows), *keys)


def in_lists(df: DataFrame, keys: list[str], value: str, into: str, rows: int = 50_000, size: int = 1_000) -> DataFrame:
    """``value`` of rows with equal ``keys`` as lists of at most ``size`` structs, for keys that few values share among many rows: a list holds what one task has, no task a whole key."""
    mine = dealt(df, rows=rows).withColumn("__task", F.spark_partition_id())
    lists = mine.groupBy(*keys, "__task").agg(F.collect_list(F.struct(value)).alias("__all"))
    cut = F.transform(F.sequence(F.lit(0), F.size("__all") - 1, F.lit(size)), lambda i: F.slice("__all", i + 1, F.lit(size)))
    return lists.select(*keys, F.explode(cut).alias(into))
