"""Seeded sampling: a 32-bit generator as column expressions, shuffles of arrays, and exams drawn from several sources.

The generator's state after i draws is the seed's hash plus i times a constant, so any draw is computed by itself and the
draws of one exam are told apart by offsets: no state passes from row to row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: The start and the factor of the seed's hash, and what a draw adds to the state.
START, FACTOR, STEP = 2166136261, 16777619, 0x6D2B79F5
#: How many questions of each kind a drawn exam has, by mode, in the order in which they are drawn.
SIZES = {"kurz": {"multiple_choice": 6, "multi_part": 2}, "standard": {"multiple_choice": 12, "multi_part": 4}}


def times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit numbers, in halves so that no product leaves 64 bits."""
    low = a * b.bitwiseAND(0xFFFF)
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(0xFFFF), 16)
    return (low + high).bitwiseAND(MASK)


def seeded(seed: Column) -> Column:
    """The generator's first state: a hash over the UTF-16 units that the seed's characters begin with; null for null."""
    unit = lambda c: F.when(F.ascii(c) > 0xFFFF, F.lit(0xD800) + F.shiftright(F.ascii(c) - 0x10000, 10)).otherwise(F.ascii(c)).cast("long")
    letters = F.filter(F.split(seed, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(START).cast("long"), lambda n, c: (n.bitwiseXOR(unit(c)) * FACTOR).bitwiseAND(MASK))


def draw(state: Column, i: Column) -> Column:
    """Draw number i (from 1) as an unsigned 32-bit number."""
    # shared subexpressions go by way of one-element arrays: written out, each step would repeat the one before
    n = (state + (i.cast("long") * STEP)).bitwiseAND(MASK)
    first = F.transform(F.array(n), lambda n: times(n.bitwiseXOR(F.shiftright(n, 15)), n.bitwiseOR(F.lit(1).cast("long"))))
    second = F.transform(first, lambda t: t.bitwiseXOR((t + times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(MASK)))
    return F.transform(second, lambda t: t.bitwiseXOR(F.shiftright(t, 14)))[0]


def below(state: Column, i: Column, n: Column) -> Column:
    """Draw number i as a whole number from 0 below n: the draw's fraction of 2**32 times n, rounded down."""
    return F.shiftright(draw(state, i) * n.cast("long"), 32)


def shuffled(items: Column, state: Column, skip: Column) -> Column:
    """The array from its last place to its second, each exchanged with a drawn one up to it; len - 1 draws after ``skip``."""
    n = F.size(items)
    places = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(places, lambda i: F.struct(i.alias("i"), below(state, skip + (n - i), i + 1).cast("int").alias("j")))

    def swap(a: Column, p: Column) -> Column:
        return F.transform(a, lambda x, k: F.when(k == p["i"], F.get(a, p["j"])).when(k == p["j"], F.get(a, p["i"])).otherwise(x))

    return F.aggregate(pairs, items, swap)


def draws_of(n: Column) -> Column:
    """Draws that a shuffle of n items takes."""
    return F.greatest(n - 1, F.lit(0))


def _by_mode(mode: Column, kind: Column) -> Column:
    found = F.lit(None).cast("int")
    for m, sizes in SIZES.items():
        for k, size in sizes.items():
            found = F.when((mode == m) & (kind == k), size).otherwise(found)
    return found


def draw_exams(requests: DataFrame, pools: DataFrame) -> DataFrame:
    """For each request (session_id, seed, module, mode, sources) its ``question_ids`` in order, or why it is ``refused``.

    ``pools``: exam, module, kind, place and question_id of the questions, exams in the order of ``exam``. Of each kind in
    turn, each exam's questions are shuffled, then the exams; one question of each exam after the other is taken until
    the mode's number is reached, and the whole is shuffled at last. ``sources`` is a list of exams, null for all.
    Refused: ``sources`` (an exam that the module lacks, or an empty list), ``too_few`` (of a kind), ``one_exam``
    (several exams to draw from, but all questions from one), ``mode`` (an unknown one). An exam's questions of a kind are one array; requests
    are rows of their own throughout, whatever their number.
    """
    groups = pools.groupBy("module", "exam", "kind").agg(F.array_sort(F.collect_list(F.struct("place", "question_id"))).alias("q"))
    groups = groups.select("module", "exam", "kind", F.col("q.question_id").alias("ids"))
    bank = groups.groupBy("module").agg(F.array_sort(F.collect_set("exam")).alias("exams"))
    asked = requests.join(bank, "module", "left").withColumn("exams", F.coalesce("exams", F.array().cast(bank.schema["exams"].dataType)))
    lacking = F.col("sources").isNotNull() & ((F.size("sources") == 0) | (F.size(F.array_except("sources", "exams")) > 0))
    used = F.when(F.col("sources").isNull(), F.col("exams")).otherwise(F.array_intersect("exams", "sources"))
    asked = asked.withColumns({"state": seeded(F.col("seed")), "lacking": lacking | (F.size("exams") == 0), "used": used})

    first, last = next(iter(SIZES.values())), W.partitionBy("session_id")
    order = F.lit(0)
    for i, kind in enumerate(first):
        order = F.when(F.col("kind") == kind, i).otherwise(order)
    rows = asked.where("not lacking").join(groups.where(F.col("kind").isin(*first)), "module").where(F.array_contains("used", F.col("exam")))
    rows = rows.withColumns({"turn": order, "n": F.size("ids")})
    # draws before an exam's shuffle: of all earlier exams' shuffles, and of the exams' own for each earlier kind
    by = last.orderBy("turn", "exam")
    before = F.coalesce(F.sum(draws_of(F.col("n"))).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kinds = W.partitionBy("session_id", "turn")
    rows = rows.withColumns({"before": before, "members": F.count(F.lit(1)).over(kinds), "leads": F.row_number().over(kinds.orderBy("exam")) == 1})
    own = F.when(F.col("leads"), draws_of(F.col("members"))).otherwise(0)
    extra = F.coalesce(F.sum(own).over(last.orderBy("turn").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("skip", F.col("before") + extra)
    mixed = rows.select("session_id", "turn", "kind", "mode", "state", "exam", "skip", "n", shuffled(F.col("ids"), F.col("state"), F.col("skip")).alias("ids"))

    of_kind = mixed.groupBy("session_id", "turn", "kind", "mode", "state").agg(
        F.array_sort(F.collect_list(F.struct("exam", "ids"))).alias("sets"), F.sum("n").alias("there"), F.max(F.col("skip") + draws_of(F.col("n"))).alias("done")
    )
    sets = shuffled(F.col("sets"), F.col("state"), F.col("done"))
    # one of each exam in turn: by place within the exam, then by the exam's place
    dealt = F.flatten(F.transform(sets, lambda s, g: F.transform(s["ids"], lambda x, r: F.struct(r.alias("r"), g.alias("g"), x.alias("id"), s["exam"].alias("exam")))))
    of_kind = of_kind.withColumns({"amount": _by_mode(F.col("mode"), F.col("kind")), "dealt": F.array_sort(dealt), "end": F.col("done") + draws_of(F.size("sets"))})
    of_kind = of_kind.select("session_id", "turn", "state", "end", (F.col("there") >= F.col("amount")).alias("enough"), F.slice("dealt", 1, F.coalesce("amount", F.lit(0))).alias("chosen"))
    drawn = of_kind.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "chosen"))).alias("parts"), F.count_if("enough").alias("kinds"), F.max("end").alias("end")
    )
    chosen = F.flatten(F.transform("parts", lambda p: p["chosen"]))
    out = asked.join(drawn, "session_id", "left").withColumns({"chosen": chosen, "known": F.col("mode").isin(*SIZES)})
    refused = (
        F.when(F.col("lacking"), "sources").when(~F.coalesce("known", F.lit(False)), "mode").when(F.coalesce("kinds", F.lit(0)) < len(first), "too_few")
        .when((F.size("used") > 1) & (F.size(F.array_distinct(F.transform("chosen", lambda c: c["exam"]))) < 2), "one_exam")
    )
    ids = F.transform(shuffled(F.col("chosen"), F.col("state"), F.col("end")), lambda c: c["id"])
    return out.withColumn("refused", refused).select("session_id", F.when(F.col("refused").isNull(), ids).alias("question_ids"), "refused")
