"""The number that each row has in an order over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemos.llm.common import materialize


def numbered(df: DataFrame, *order: Column, into: str = "position") -> DataFrame:
    """The rows of ``df`` with ``into``, their number from 0 in ``order``; rows alike in it are numbered in any way.

    Ranges of the order are sorted on their own and written once; what lies before a range is a sum over the ranges'
    counts (one row for each range, the only window without a partition), which is sent to every task.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(ordered.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("__range", F.shiftright("__at", 33))
    ranges = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__at").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(ranges), "__range").withColumn(into, F.col("__before") + inside).drop("__range", "__at", "__before")
