"""Questions on a printed grid: headings at anchors, bands, owners that go on through L shapes, one rectangle for each run of cells.

Pages meet by merging sorted sides: half pages, anchors and marks are made of few columns of small files, and Spark would take
them for small and send them through the driver to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How far a heading may lie from its anchor, its least height, that of an unreadable one, and the certainty of results.
LEFT, ABOVE, BELOW, TALL, TALL_UNREAD = 14, 8, 24, 16, 18
READ, BROKEN, LOOSE = 0.96, 0.84, 0.93
WORKSPACE = r"Nebenrechnung Aufgabe\s+(\d+)\s*[:;]"


def marked(lines: DataFrame, halves: DataFrame, heading_x: tuple[float, ...], most: int) -> DataFrame:
    """``halves`` with a heading, one row each: ``marks``, an array of struct (row, col, number, top, read), and ``ys`` moved to just above the uppermost heading of each band but the first.

    A heading is one or two digits up to ``most`` near its place, tall enough, and the only one there. Where there is none but
    a tall text of four letters or fewer, the number is ``UNRESOLVED-`` and the place, and ``read`` false. Lines meet
    half pages by page, once, and are held against the few places of theirs where they lie; all that follows stays by page.
    """
    tall = F.col("y1") - F.col("y0")
    digits = F.rlike("word", F.lit(r"^\d{1,2}$")) & F.coalesce(F.col("word").try_cast("int").between(1, most), F.lit(False)) & (tall >= TALL)
    odd = (F.length("word") <= 4) & (tall >= TALL_UNREAD)
    own = lines.withColumn("word", F.trim("text")).select("page", "word", "x0", "y0", digits.alias("digits"), odd.alias("odd")).where("digits or odd")
    met = own.join(halves.select("page", "side", "offset", "ys", "supported").hint("merge"), "page")
    met = met.select("*", F.posexplode(F.slice("ys", 1, F.size("ys") - 1)).alias("row", "top")).withColumn("ay", F.col("top") + 2).where(F.col("y0").between(F.col("ay") - ABOVE, F.col("ay") + BELOW))
    met = met.select("*", F.posexplode(F.array(*[F.lit(float(x)) for x in heading_x])).alias("col", "hx")).where(F.abs(F.col("x0") - (F.col("offset") + F.col("hx"))) < LEFT)
    of_half = [F.any_value(c).alias(c) for c in ("offset", "ys", "supported")]
    found = met.groupBy("page", "side", "row", "col", "ay").agg(F.count_if("digits").alias("n"), F.max(F.when(F.col("digits"), F.col("word"))).alias("word"), F.max(F.when(F.col("digits"), F.col("y0"))).alias("y"), F.count_if("odd").alias("odds"), *of_half)
    one = F.col("n") == 1
    unread = F.concat_ws("-", F.lit("UNRESOLVED"), "side", "row", "col")
    mark = F.struct("row", "col", F.when(one, F.col("word")).otherwise(unread).alias("number"), F.when(one, F.col("y")).otherwise(F.col("ay") + 6).alias("top"), one.alias("read"))
    x = found.where(one | (F.col("odds") > 0)).groupBy("page", "side").agg(F.collect_list(mark).alias("marks"), *of_half)
    above = lambda i: F.round(F.array_min(F.transform(F.filter("marks", lambda m: (m["row"] == i) & (m["row"] > 0)), lambda m: m["top"])) - 5, 1)
    return x.withColumn("ys", F.transform("ys", lambda y, i: F.coalesce(above(i), y)))


def held(sheets: DataFrame, lines: DataFrame, body_x: tuple[float, float, float], rows: int) -> DataFrame:
    """``sheets`` as marked() gives them, with a row for each band (row, left, right): who owns its two cells.

    A line that names a number of the half as a workspace gives its cell to that; of several the lowest line counts, then the
    rightmost. Lines meet sheets by page, where both lie already.
    """
    said = lines.withColumn("owner", F.regexp_extract("text", WORKSPACE, 1)).where("owner <> ''").select(F.col("page").alias("said_on"), "owner", F.col("x0").alias("lx"), F.col("y0").alias("ly"))
    inside = (F.col("lx") >= F.col("offset") + body_x[0]) & (F.col("lx") < F.col("offset") + body_x[2]) & F.array_contains(F.col("marks.number"), F.col("owner"))
    x = sheets.join(said.hint("merge"), (F.col("page") == F.col("said_on")) & inside, "left")
    col = F.when(F.col("lx") < F.col("offset") + body_x[1], 0).otherwise(1)
    cells = [(r, c) for r in range(rows) for c in (0, 1)]
    within = lambda r, c: (F.col("ly") >= F.get("ys", F.lit(r))) & (F.col("ly") < F.get("ys", F.lit(r + 1))) & (col == c)
    given = [F.max_by("owner", F.when(within(r, c), F.struct("ly", "lx", "owner"))).alias(f"owner{r}{c}") for r, c in cells]
    x = x.groupBy("page", "side").agg(*[F.any_value(n).alias(n) for n in ("offset", "ys", "supported", "marks")], *given)
    number = lambda r, c: F.array_max(F.transform(F.filter("marks", lambda m: (m["row"] == r) & (m["col"] == c)), lambda m: m["number"]))
    return _carried(x.withColumns({f"number{r}{c}": number(r, c) for r, c in cells}), rows, "offset", "ys", "supported", "marks")


def owners(marks: DataFrame, given: DataFrame, rows: int) -> DataFrame:
    """(page, side, row, left, right): the owners of each band's two cells, carried down together.

    A heading on the left takes both cells unless the right one has its own, one on the right takes the right; cells without
    go on with what is above; a workspace takes its cell, and what is below goes on with it.
    """
    at = lambda value, c: [F.max(F.when((F.col("row") == r) & (F.col("col") == c), F.col(value))).alias(f"{value}{r}{c}") for r in range(rows)]
    x = marks.groupBy("page", "side").agg(*at("number", 0), *at("number", 1))
    w = given.groupBy("page", "side").agg(*at("owner", 0), *at("owner", 1))
    return _carried(x.join(w.hint("merge"), ["page", "side"], "left"), rows)


def _carried(x: DataFrame, rows: int, *also: str) -> DataFrame:
    """Cells from columns number00, owner00 and so on of a half's row, and the columns ``also``."""
    left = right = F.lit(None).cast("string")
    cells = []
    for r in range(rows):
        own, beside = F.col(f"number{r}0"), F.col(f"number{r}1")
        x = x.withColumn(f"left{r}", F.coalesce(F.col(f"owner{r}0"), own, left))
        x = x.withColumn(f"right{r}", F.coalesce(F.col(f"owner{r}1"), beside, own, right))
        left, right = F.col(f"left{r}"), F.col(f"right{r}")
        cells.append(F.struct(F.lit(r).alias("row"), left.alias("left"), right.alias("right")))
    return x.select("page", "side", *also, F.explode(F.array(*cells)).alias("c")).select("page", "side", *also, "c.*")


def regions(held: DataFrame, halves: DataFrame, body_x: tuple[float, float, float]) -> DataFrame:
    """(page, side, number, seq, x0, y0, x1, y1): cells of one owner side by side fused, then runs of equal width below each other merged."""
    return _merged(held.join(halves.select("page", "side", "offset", "ys").hint("merge"), ["page", "side"]), body_x)


def _merged(x: DataFrame, body_x: tuple[float, float, float], *also: str) -> DataFrame:
    """regions() of cells that have their half's ``offset`` and ``ys``, and its columns ``also``."""
    place = lambda i: F.col("offset") + body_x[i]
    box = lambda owner, a, b: F.struct(owner.alias("number"), place(a).alias("x0"), place(b).alias("x1"))
    fused = F.coalesce(F.col("left") == F.col("right"), F.lit(False))
    boxes = F.when(fused, F.array(box(F.col("left"), 0, 2))).otherwise(F.array(box(F.col("left"), 0, 1), box(F.col("right"), 1, 2)))
    x = x.select("page", "side", *also, "row", F.get("ys", F.col("row")).alias("y0"), F.get("ys", F.col("row") + 1).alias("y1"), F.explode(boxes).alias("b")).select("page", "side", *also, "row", "y0", "y1", "b.*").where("number is not null")
    run = W.partitionBy("page", "side", "number").orderBy("row", "x0")
    goes_on = (F.lag("x0").over(run) == F.col("x0")) & (F.lag("x1").over(run) == F.col("x1")) & (F.lag("y1").over(run) == F.col("y0"))
    x = x.withColumn("begins", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("seq", F.sum("begins").over(run))
    return x.groupBy("page", "side", "number", "seq").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), *[F.any_value(c).alias(c) for c in also])


def detected(lines: DataFrame, halves: DataFrame, heading_x: tuple[float, float], body_x: tuple[float, float, float], most: int = 28, rows: int = 3) -> tuple[DataFrame, DataFrame]:
    """The regions of the questions of each half page, one row a region, and its unread headings.

    ``lines``: page, text, x0, y0, x1, y1; ``halves``: page, side, offset, ys (the bands' edges) and ``supported`` (how many of
    them a printed line confirms). Regions have ``confidence``, ``reasons`` and the ``anchor`` of their heading; cells under
    an unread heading belong to nobody else. Numbers repeated in a half keep an anchor each.
    """
    sheets = marked(lines, halves, heading_x, most)
    found = _merged(held(sheets, lines, body_x, rows), body_x, "supported", "marks")
    found = found.withColumn("many", F.count("*").over(W.partitionBy("page", "side", "number")) > 1)
    found = found.withColumn("m", F.explode(F.filter("marks", lambda m: m["read"] & (m["number"] == F.col("number")))))
    confidence = F.least(F.lit(READ), F.when(F.col("many"), BROKEN), F.when(F.col("supported") < 2, LOOSE))
    reasons: Column = F.when(F.col("many"), F.array(F.lit("non_rectangular_layout"))).otherwise(F.array().cast("array<string>"))
    anchor = F.format_string("h%d-r%d-c%d", F.col("side").cast("int"), "m.row", "m.col").alias("anchor")
    out = found.select("page", "side", "number", "seq", "x0", "y0", "x1", "y1", confidence.alias("confidence"), reasons.alias("reasons"), anchor)
    unread = sheets.select("page", "side", F.explode("marks").alias("m")).where("not m.read").select("page", "side", anchor, F.lit("unreadable_heading").alias("reason"))
    return out, unread
