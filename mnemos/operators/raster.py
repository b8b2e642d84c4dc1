"""Marks and lines found in pixels: thresholds by summed areas, rings around centres, seams by votes of edges, and composed pictures.

A raster is a table of pixels (page, y, x, v: grey from 0 to 255) or of rows (page, y, bytes). No page is a row or a group of
its own anywhere: sums run along rows and columns of pixels, centres and regions meet pixels by their places.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WHITE = 255
#: Side of the squares through which centres meet pixels.
TILE = 16


def pixels(rows: DataFrame) -> DataFrame:
    """The pixels of raster rows (page, y, bytes)."""
    each = F.transform(F.sequence(F.lit(1), F.octet_length("bytes")), lambda i: F.conv(F.hex(F.substring(F.col("bytes"), i, F.lit(1))), 16, 10).cast("int"))
    return rows.select("page", "y", F.posexplode(F.when(F.octet_length("bytes") > 0, each)).alias("x", "v"))


def box_means(raster: DataFrame, radius: int) -> DataFrame:
    """``total`` and ``cells`` of the square of ``radius`` around each pixel, cut at the page's edges.

    Running sums along the rows and then along the columns are a summed-area table; a square's sum is four of its values,
    the same cost for any radius.
    """

    def spans(df: DataFrame, along: str, by: list[str], **sums: str) -> DataFrame:
        # all running sums in one window, all differences in a second: each window holds and copies every pixel once more
        line = W.partitionBy(*by).orderBy(along)
        so_far, whole = line.rowsBetween(W.unboundedPreceding, W.currentRow), line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        df = df.withColumns({f"__sum_{out}": F.sum(value).over(so_far) for out, value in sums.items()})
        ahead = lambda c: F.coalesce(F.lead(c, radius).over(line), F.last(c).over(whole))
        return df.withColumns({out: ahead(c) - F.coalesce(F.lag(c, radius + 1).over(line), F.lit(0)) for out in sums for c in [f"__sum_{out}"]}).drop(*[f"__sum_{out}" for out in sums])

    x = spans(raster.withColumn("__one", F.lit(1)), "x", ["page", "y"], __row="v", __wide="__one")
    return spans(x, "y", ["page", "x"], total="__row", cells="__wide").drop("__row", "__wide", "__one")


def adaptive_ink(raster: DataFrame, offsets: list[int], radius: int = 15) -> DataFrame:
    """(page, threshold, y, x, ink): darker than the mean around by the offset at least; a row for each offset.

    The mean is that of a square, all pixels weighing alike. Whole numbers throughout, so nothing is rounded.
    """
    x = box_means(raster, radius).withColumn("threshold", F.explode(F.array(*[F.lit(o) for o in offsets])))
    return x.select("page", "threshold", "y", "x", (F.col("v") * F.col("cells") <= F.col("total") - F.col("threshold") * F.col("cells")).alias("ink"))


def fixed_ink(raster: DataFrame, thresholds: list[int]) -> DataFrame:
    """As adaptive_ink(), darker than fixed greys."""
    return raster.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).select("page", "threshold", "y", "x", (F.col("v") < F.col("threshold")).alias("ink"))


@dataclass(frozen=True)
class Rule:
    """What a detector asks for; ``strong`` and ``possible``: ring ink and share of sectors at least."""

    ring: tuple[float, float]
    dot: float
    sector: float
    strict: bool
    strong: tuple[float, float]
    possible: tuple[float, float]
    least_dot: float
    margin: float | None
    thresholds: int
    #: reasons for: positions, uniqueness, margin, thresholds
    names: tuple[str, str, str, str]
    reach: int = 13


#: The three detectors' limits and the names of their reasons.
ADAPTIVE = Rule((8, 11.8), 3, 0.20, False, (0.45, 0.75), (0.35, 0.5), 0.12, 0.12, 1, ("five_dot_positions_not_clear", "no_unique_clear_circle", "insufficient_ring_margin", "threshold_disagreement"))
TWOFOLD = Rule((8, 12), 3, 0.18, True, (0.48, 0.75), (0.40, 0.58), 0.1, 0.15, 2, ("five_dots_not_clear", "no_unique_circle", "insufficient_margin", "threshold_disagreement"))
FIXED = Rule((4.8, 6.5), 1.7, 0.12, True, (0.24, 0.75), (0.18, 0.58), 0.05, None, 2, ("five_dots_not_clear", "no_unique_circle", "insufficient_margin", "threshold_disagreement"), 8)


def _met(raster: DataFrame, centres: DataFrame, reach: int) -> DataFrame:
    """The pixels in the square of ``reach`` around each centre, with the centre's columns.

    They meet by tiles, so that a centre moves as a few rows and not as all places of its square. Both sides are dealt out by
    tile: from the size of the files Spark would take the pixels for few and send them all through the driver.
    """
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / TILE).cast("int"), F.floor((F.col(c) + reach) / TILE).cast("int")))
    own = centres.withColumns({"__y": F.rint("cy").cast("int"), "__x": F.rint("cx").cast("int")}).withColumn("__ty", tiles("__y")).withColumn("__tx", tiles("__x"))
    each = raster.withColumns({"__ty": F.floor(F.col("y") / TILE).cast("int"), "__tx": F.floor(F.col("x") / TILE).cast("int")})
    near = (F.abs(F.col("y") - F.col("__y")) <= reach) & (F.abs(F.col("x") - F.col("__x")) <= reach)
    return each.join(own.hint("shuffle_hash"), ["page", "__ty", "__tx"]).where(near).drop("__ty", "__tx")


def snapped(raster: DataFrame, centres: DataFrame, far: int = 3, size: int = 2) -> DataFrame:
    """Centres (page, item, row, cx, cy) moved by up to ``far`` pixels to the darkest square of ``size``; the first in reading order of ties."""
    # one more, as halves are rounded to even; of the moves that may do those are kept whose square holds the pixel
    met = _met(raster, centres, far + size + 1)
    moves = lambda at, c: F.explode(F.sequence(F.greatest(F.lit(-far), F.col(at) - F.col(c) - size - 1), F.least(F.lit(far), F.col(at) - F.col(c) + size + 1)))
    holds = lambda at, c, o: F.abs(F.col(at) - F.rint(F.col(c) + F.col(o))) <= size
    around = met.withColumn("oy", moves("y", "__y")).where(holds("y", "cy", "oy")).withColumn("ox", moves("x", "__x")).where(holds("x", "cx", "ox"))
    dark = around.groupBy("page", "item", "row", "oy", "ox", "cx", "cy").agg(F.avg("v").alias("grey"))
    best = dark.groupBy("page", "item", "row").agg(F.min_by(F.struct((F.col("cx") + F.col("ox")).alias("cx"), (F.col("cy") + F.col("oy")).alias("cy")), F.struct("grey", "oy", "ox")).alias("c"))
    return best.select("page", "item", "row", "c.*")


def rings(ink: DataFrame, centres: DataFrame, rule: Rule) -> DataFrame:
    """(page, item, row, threshold, ring_ink, angular_support, center_ink) of the centres whose square lies on the page.

    Centres meet pixels by place, not by page. The ring's pixels count in twelve sectors, so partial sums of a centre are
    thirteen rows, however many pixels it has.
    """
    met = _met(ink, centres, rule.reach)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    r = F.sqrt(dx * dx + dy * dy)
    sector = (F.floor((F.atan2(dy, dx) + math.pi) / (2 * math.pi) * 12) % 12).cast("int")
    zone = F.when((r >= rule.ring[0]) & (r <= rule.ring[1]), sector).when(r <= rule.dot, -1).otherwise(-2)
    sums = met.withColumn("zone", zone).groupBy("page", "item", "row", "threshold", "zone").agg(F.count("*").alias("n"), F.count_if("ink").alias("k"))
    on, dot = F.col("zone") >= 0, F.col("zone") == -1
    share = F.col("k") / F.col("n")
    supported = on & ((share > rule.sector) if rule.strict else (share >= rule.sector))
    found = sums.groupBy("page", "item", "row", "threshold").agg(
        F.sum("n").alias("seen"), F.round(F.sum(F.when(on, F.col("k"))) / F.sum(F.when(on, F.col("n"))), 4).alias("ring_ink"), F.round(F.count_if(supported) / 12, 4).alias("angular_support"),
        F.round(F.sum(F.when(dot, F.col("k"))) / F.sum(F.when(dot, F.col("n"))), 4).alias("center_ink"),
    )
    return found.where(F.col("seen") == (2 * rule.reach + 1) ** 2).drop("seen")


def decided(measured: DataFrame, columns: DataFrame, rule: Rule) -> DataFrame:
    """A35 from pixels: (page, item, answer, reasons) for each of ``columns`` (page, item, numbered: whether its number is certain).

    At each threshold five measured rows with visible dots, exactly one of them strong and no other possible, by the margin;
    all thresholds agree.
    """
    strong = (F.col("ring_ink") >= rule.strong[0]) & (F.col("angular_support") >= rule.strong[1])
    possible = (F.col("ring_ink") >= rule.possible[0]) & (F.col("angular_support") >= rule.possible[1])
    per = measured.groupBy("page", "item", "threshold").agg(
        F.count("*").alias("rows"), F.count_if(strong).alias("strong"), F.count_if(possible).alias("possible"), F.min("center_ink").alias("dot"), F.max_by("row", F.struct(strong, "row")).alias("row"),
        F.max(F.when(strong, F.col("ring_ink"))).alias("top"), F.max(F.when(~strong, F.col("ring_ink"))).alias("next"),
    )
    one = F.col("strong") == 1
    close = F.lit(False) if rule.margin is None else one & (F.coalesce("next", F.lit(0.0)) > F.round(F.col("top") - rule.margin, 6))
    per = per.groupBy("page", "item").agg(
        F.count("*").alias("seen"), F.count_if((F.col("rows") != 5) | (F.col("dot") < rule.least_dot)).alias("dots"), F.count_if(~one | (F.col("possible") != 1)).alias("unclear"), F.count_if(close).alias("close"),
        F.count_if(one).alias("found"), F.count_distinct(F.when(one, F.col("row"))).alias("answers"), F.max(F.when(one, F.col("row"))).alias("answer"),
    )
    x = columns.join(per.hint("merge"), ["page", "item"], "left").na.fill(0, ["seen", "dots", "unclear", "close", "found", "answers"])
    said = [
        (F.col("dots") + (F.col("seen") < rule.thresholds).cast("int") > 0, rule.names[0]), (F.col("unclear") > 0, rule.names[1]), (F.col("close") > 0, rule.names[2]),
        ((F.col("found") != rule.thresholds) | (F.col("answers") != 1), rule.names[3]), (~F.col("numbered"), "question_number_uncertain"),
    ]
    if rule.thresholds == 1:
        said = [(c, n) for c, n in said if n != rule.names[3]]
    reasons = F.filter(F.array(*[F.when(c, n) for c, n in said]), lambda r: r.isNotNull())
    return x.select("page", "item", F.when((F.size(reasons) == 0) & (F.col("answers") == 1), F.col("answer")).alias("answer"), reasons.alias("reasons"))


def edges(raster: DataFrame, least: int) -> DataFrame:
    """(page, y, x) of the pixels that differ from the one above them by ``least`` or more."""
    step = F.abs(F.col("v") - F.lag("v").over(W.partitionBy("page", "x").orderBy("y")))
    return raster.withColumn("step", step).where(F.col("step") >= least).select("page", "y", "x")


def segments(cells: DataFrame, votes: int, least: float, gap: int, tilt: int = 12) -> DataFrame:
    """(page, angle, offset, x0, x1, y0, y1) of nearly level lines; ``angle`` in tenths of a degree from -tilt to tilt.

    Every edge cell votes for the lines through it, one for each angle; a bin is sorted once for its count and its cuts. A
    bin with ``votes`` cells is a peak; its cells in the order of x are cut where ``gap`` is exceeded, and pieces as long
    as ``least`` are segments.
    """
    angle = F.explode(F.sequence(F.lit(-tilt), F.lit(tilt)))
    turn = F.radians(F.col("angle") / 10)
    bins = cells.select("page", "y", "x", angle.alias("angle")).withColumn("offset", F.round(F.round(F.col("y") * F.cos(turn) - F.col("x") * F.sin(turn), 9)).cast("int"))
    line = W.partitionBy("page", "angle", "offset").orderBy("x", "y")
    counted = bins.withColumn("votes", F.count("*").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    on = counted.where(F.col("votes") >= votes).withColumn("cut", (F.col("x") - F.lag("x").over(line) > gap).cast("int"))
    on = on.withColumn("piece", F.sum(F.coalesce("cut", F.lit(0))).over(line))
    ends = on.groupBy("page", "angle", "offset", "piece").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min_by("y", F.struct("x", "y")).alias("y0"), F.max_by("y", F.struct("x", "y")).alias("y1"))
    return ends.where(F.col("x1") - F.col("x0") >= least).drop("piece")


def seams(found: DataFrame, bands: DataFrame, near: float, least: float) -> DataFrame:
    """Bands (page, band, nominal, lo, hi: where a line must begin, end: up to where it goes) snapped to the longest segment near them.

    Returns page, band, ``seam`` (the nominal place where no segment is near) and ``supported``. Of equally long segments the
    uppermost counts.
    """
    middle = (F.col("y0") + F.col("y1")) / 2
    x = bands.join(found.withColumn("middle", middle).hint("merge"), "page", "left")
    fits = (F.abs(F.col("y1") - F.col("y0")) < 4) & (F.abs(F.col("middle") - F.col("nominal")) < near) & F.col("x0").between(F.col("lo"), F.col("hi")) & (F.col("x1") <= F.col("end")) & (F.col("x1") - F.col("x0") > least)
    best = F.max_by("middle", F.when(F.coalesce(fits, F.lit(False)), F.struct(F.col("x1") - F.col("x0"), -F.col("middle"))))
    y = x.groupBy("page", "band", "nominal").agg(best.alias("seam"), F.count_if(F.coalesce(fits, F.lit(False))).alias("n"))
    return y.select("page", "band", F.when(F.col("n") > 0, F.round("seam", 1)).otherwise(F.col("nominal").cast("double")).alias("seam"), (F.col("n") > 0).alias("supported"))


def _white(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("FF"), n.cast("int")))


def scaled_rows(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Raster rows (page, y, bytes) at ``num / den`` of their size; a pixel of the result is the one that its corner falls on."""
    # source row y serves the result's rows from ceil(y * num / den) below ceil((y + 1) * num / den)
    first = lambda y: F.ceil(y * num / F.lit(den)).cast("int")
    wide = F.ceil(F.octet_length("bytes") * num / F.lit(den)).cast("int")
    take = F.transform(F.sequence(F.lit(0), wide - 1), lambda i: F.hex(F.substring(F.col("bytes"), (F.floor(i * den / F.lit(num)) + 1).cast("int"), F.lit(1))))
    x = rows.withColumns({"a": first(F.col("y")), "b": first(F.col("y") + 1)}).where("b > a")
    wide_rows = F.when(F.octet_length("bytes") > 0, F.unhex(F.array_join(take, ""))).otherwise(F.col("bytes"))
    return x.select("page", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("y"), wide_rows.alias("bytes"))


def composed(rows: DataFrame, regions: DataFrame, gap: int = 24) -> DataFrame:
    """Pictures (question, y, bytes) of regions (question, owner, seq, page, x0, y0, x1, y1), right and lower ends excluded.

    The regions of a page keep their places to each other within a white panel of their hull, later ones above earlier
    ones; panels stand below each other in the order of their first region, ``gap`` white rows apart, left-aligned and
    padded with white to the widest. Where a region leaves the page, it is white. Questions with several owners or a null one
    raise no error and give no row: see refused(). Only slices of rows move.
    """
    # from the size of the files Spark would take regions and slices for few and send them all through the driver
    kept = regions.join(refused(regions).select("question").hint("merge"), "question", "left_anti").where("x1 > x0 and y1 > y0")
    panels = kept.groupBy("question", "page").agg(F.min("seq").alias("first"), F.min("x0").alias("left"), F.min("y0").alias("top"), F.max("x1").alias("right"), F.max("y1").alias("bottom"))
    order = W.partitionBy("question").orderBy("first")
    before = F.coalesce(F.sum(F.col("bottom") - F.col("top") + gap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = W.partitionBy("question")
    panels = panels.withColumns({"at": before, "wide": F.max(F.col("right") - F.col("left")).over(whole), "panels": F.count("*").over(whole), "pos": F.row_number().over(order)})

    lines = panels.select("question", "page", "left", "wide", "at", "top", F.explode(F.sequence(F.col("top"), F.col("bottom") - 1)).alias("py"))
    slices = kept.select("question", "page", "seq", "x0", "x1", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("py"))
    cut = F.substring(F.col("bytes"), F.col("x0") + 1, F.col("x1") - F.col("x0"))
    slices = slices.join(rows.select("page", F.col("y").alias("py"), "bytes").hint("merge"), ["page", "py"]).select("question", "page", "py", "seq", "x0", cut.alias("cut"))
    slices = slices.groupBy("question", "page", "py").agg(F.array_sort(F.collect_list(F.struct("seq", "x0", "cut"))).alias("cuts"))
    x = lines.join(slices.hint("merge"), ["question", "page", "py"], "left")
    # a row's slices are laid over white; an empty slice would stretch it
    laid = F.aggregate(
        F.filter(F.coalesce("cuts", F.array().cast(slices.schema["cuts"].dataType)), lambda c: F.octet_length(c["cut"]) > 0), _white(F.col("wide")), lambda acc, c: F.overlay(acc, c["cut"], (c["x0"] - F.col("left") + 1).cast("int"), F.octet_length(c["cut"]))
    )
    drawn = x.select("question", (F.col("at") + F.col("py") - F.col("top")).cast("int").alias("y"), laid.alias("bytes"))
    blank = panels.where("pos < panels and " + str(gap) + " > 0").select("question", "wide", F.explode(F.sequence(F.col("at") + F.col("bottom") - F.col("top"), F.col("at") + F.col("bottom") - F.col("top") + F.lit(gap - 1))).alias("y"))
    return drawn.unionByName(blank.select("question", F.col("y").cast("int").alias("y"), _white(F.col("wide")).alias("bytes")))


def refused(regions: DataFrame) -> DataFrame:
    """(question, problem): ``unresolved`` for a region without owner, ``mixed`` for several owners."""
    x = regions.groupBy("question").agg(F.count_if(F.col("owner").isNull() | (F.col("owner") == "")).alias("none"), F.count_distinct("owner").alias("owners"))
    return x.where("none > 0 or owners > 1").select("question", F.when(F.col("none") > 0, "unresolved").otherwise("mixed").alias("problem"))


def picture_hashes(rows: DataFrame) -> DataFrame:
    """(question, width, height, sha256) of composed pictures: size and bytes row by row, as pixel_hash() takes them."""
    x = rows.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("y", F.hex("bytes").alias("h")))).alias("r"), F.max(F.octet_length("bytes")).alias("width"), F.count("*").alias("height"))
    data = F.unhex(F.array_join(F.transform("r", lambda r: r["h"]), ""))
    return x.select("question", "width", "height", F.sha2(F.concat(F.encode(F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(":")), "utf-8"), data), 256).alias("sha256"))


def choices(found: DataFrame, centres: DataFrame, reach: float = 12.0, pad: tuple[float, float] = (24.0, 14.0)) -> DataFrame:
    """(page, item, answer, reasons, crop, circle) of decided() columns: the column's box, and the box of the ring that was found."""
    rows = F.collect_list(F.struct("row", "cx", "cy"))  # of one column
    own = centres.groupBy("page", "item").agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"), rows.alias("rows"))
    x = found.join(own.hint("merge"), ["page", "item"])
    x = x.select("*", F.explode_outer(F.filter("rows", lambda r: r["row"] == F.col("answer"))).alias("ring")).withColumns({"cx": F.col("ring")["cx"], "cy": F.col("ring")["cy"]})
    crop = F.array(F.col("x0") - pad[0], F.col("y0") - pad[1], F.col("x1") + pad[0], F.col("y1") + pad[1])
    circle = F.when(F.col("answer").isNotNull(), F.array(F.col("cx") - reach, F.col("cy") - reach, F.col("cx") + reach, F.col("cy") + reach))
    return x.select("page", "item", "answer", "reasons", crop.alias("crop"), circle.alias("circle"))
