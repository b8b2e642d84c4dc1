"""Regions and lines on pages: overlaps, containment, hulls, markers, coverage of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemos.functions.dealing import dealt

#: Edge of the squares that rectangles are dealt out to, so that only near ones meet.
SQUARE = 100.0
#: How many ids of equal rectangles stand together, and how many rectangles of squares a task compares.
TOGETHER, TASK = 64, 2_000


def overlap_area(a: str, b: str) -> Column:
    """Of rectangles with the columns x0, y0, x1, y1 under two prefixes."""
    c = lambda p, n: F.col(f"{p}{n}")
    width = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    height = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def _squares(df: DataFrame, square: float) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(F.col(a) / square).cast("int"), F.floor(F.col(b) / square).cast("int"))
    return df.withColumn("sx", F.explode(span("x0", "x1"))).withColumn("sy", F.explode(span("y0", "y1")))


def _alike(df: DataFrame, keys: list[str]) -> DataFrame:
    """The ids of rows alike in ``keys`` as lists ``ids``, each of a bounded length."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy("id"))
    return df.withColumn("block", F.floor((n - 1) / TOGETHER)).groupBy(*keys, "block").agg(F.collect_list("id").alias("ids"))


def _shapes_that_overlap(regions: DataFrame, least: float, square: float) -> DataFrame:
    """(page, area, a_ids, b_ids): lists of equal rectangles whose area in common is more than ``least``, of two owners, each pair of lists once.

    Pairs are many more than rectangles, so the squares are dealt out to tasks by number, not by their size.
    """
    names = ("owner", "x0", "y0", "x1", "y1")
    lists = _alike(regions.where("owner is not null and id is not null").select("page", "id", *names), ["page", *names])
    g = dealt(_squares(lists, square), "page", "sx", "sy", rows=TASK)
    a, b = (g.select("page", "sx", "sy", *[F.col(n).alias(f"{p}_{n}") for n in (*names, "ids")]) for p in "ab")
    corner = lambda n, at: F.floor(F.greatest(f"a_{n}", f"b_{n}") / square).cast("int") == F.col(at)
    met = a.join(b.hint("merge"), ["page", "sx", "sy"]).where("a_owner < b_owner").where(corner("x0", "sx") & corner("y0", "sy"))
    return met.withColumn("area", F.round(overlap_area("a_", "b_"), 6)).where(F.col("area") > least).select("page", "area", "a_ids", "b_ids")


def overlaps(regions: DataFrame, least: float = 1.0, square: float = SQUARE) -> DataFrame:
    """Pairs on one page with different owners that share more than ``least`` area; regions without an owner don't count.

    Rectangles meet in the squares of a grid that both touch, so a page with many isn't compared all against all; equal ones
    of one owner meet others together. A pair is told only in the square that holds the first corner of what they share, so
    none comes twice.
    """
    x = _shapes_that_overlap(regions, least, square)
    x = x.select("page", "area", "b_ids", F.explode("a_ids").alias("a")).select("page", "area", "a", F.explode("b_ids").alias("b")).where("a <> b")
    return x.select("page", F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"), "area")


def overlap_counts(regions: DataFrame, least: float = 1.0, square: float = SQUARE) -> DataFrame:
    """(page, pairs): how many pairs overlaps() has, by the lengths of the lists; pairs of a region with itself, where its id stands under two owners, are none."""
    x = _shapes_that_overlap(regions, least, square)
    lengths = F.size("a_ids").cast("long") * F.size("b_ids")
    shared = F.when(F.arrays_overlap("a_ids", "b_ids"), F.aggregate("a_ids", F.lit(0).cast("long"), lambda n, i: n + F.size(F.filter("b_ids", lambda j: j == i)))).otherwise(0)
    return x.groupBy("page").agg(F.sum(lengths - shared).alias("pairs")).where("pairs > 0")


def texts_in(lines: DataFrame, regions: DataFrame, band: float = 6.0, square: float = SQUARE) -> DataFrame:
    """Of each region of a page the text of the lines whose middle lies in it, by bands from top to bottom, then left to right.

    Regions alike are looked at once, lines of one place meet them together, and the squares are dealt out to tasks by number.
    """
    mid = lines.withColumn("mx", (F.col("x0") + F.col("x1")) / 2).withColumn("my", (F.col("y0") + F.col("y1")) / 2)
    spots = mid.groupBy("page", "mx", "my", F.col("x0").alias("lx")).agg(F.collect_list(F.struct("text")).alias("texts"))
    spots = spots.withColumns({"sx": F.floor(F.col("mx") / square).cast("int"), "sy": F.floor(F.col("my") / square).cast("int")})
    own = regions.groupBy("page", "id").agg(F.array_sort(F.collect_list(F.struct("x0", "y0", "x1", "y1"))).alias("boxes"))
    g = dealt(_squares(_alike(own, ["page", "boxes"]).select("*", F.explode("boxes").alias("box")).select("page", "boxes", "block", "ids", "box.*"), square), "page", "sx", "sy", rows=TASK)
    met = g.join(spots.hint("merge"), ["page", "sx", "sy"]).where("mx between x0 and x1 and my between y0 and y1")
    found = met.groupBy("page", "boxes", "block").agg(F.any_value("ids").alias("ids"), F.collect_list(F.struct(F.round(F.col("my") / band).alias("band"), "lx", "texts")).alias("spots"))
    each = F.flatten(F.transform("spots", lambda p: F.transform(p["texts"], lambda t: F.struct(p["band"].alias("band"), p["lx"].alias("lx"), t["text"].alias("text")))))
    return found.withColumn("text", F.array_join(F.transform(F.array_sort(each), lambda x: x["text"]), " ")).select(F.explode("ids").alias("id"), "text")


def hulls(regions: DataFrame, *by: str) -> DataFrame:
    """The rectangle around all of a group."""
    return regions.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("regions"))


def kept_markers(markers: DataFrame, gap: float = 5.0) -> DataFrame:
    """Markers from top to bottom, less those within ``gap`` of the last one kept; a page's markers are few and fold in one row."""
    tops = F.array_sort(F.collect_list("top"))
    start = F.array().cast("array<double>")
    kept = F.aggregate(tops, start, lambda a, t: F.when((F.size(a) == 0) | (t - F.coalesce(F.array_max(a), t) > gap), F.concat(a, F.array(t))).otherwise(a))
    return markers.groupBy("page").agg(kept.alias("kept")).select("page", F.explode("kept").alias("top"))


def bounds(markers: DataFrame, height: float) -> DataFrame:
    """Each marker's bottom is the next one's top, or the page's height."""
    return markers.withColumn("bottom", F.lead("top", 1, height).over(W.partitionBy("page").orderBy("top")))


def carried(cells: DataFrame) -> DataFrame:
    """Cells without owner take the one above; runs of one owner in a column become one rectangle."""
    down = W.partitionBy("page", "col").orderBy("row")
    x = cells.withColumn("owner", F.last("owner", ignorenulls=True).over(down.rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn("begins", (~F.col("owner").eqNullSafe(F.lag("owner").over(down))).cast("int"))
    x = x.withColumn("run", F.sum("begins").over(down.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy("page", "col", "run", "owner").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row")).drop("run")


def number_coverage(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(scope, number, problem): missing, unexpected and repeated numbers."""
    counts = found.groupBy("scope", "number").agg(F.count("*").alias("n"))
    x = counts.join(expected.withColumn("wanted", F.lit(True)), ["scope", "number"], "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return x.select("scope", "number", problem.alias("problem")).where("problem is not null")


def pixel_box(scale: Column, *box: Column) -> Column:
    """Whole pixels around a box in points."""
    x0, y0, x1, y1 = box
    return F.struct(F.floor(x0 * scale).alias("x0"), F.floor(y0 * scale).alias("y0"), F.ceil(x1 * scale).alias("x1"), F.ceil(y1 * scale).alias("y1"))
