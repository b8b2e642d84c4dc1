"""Quality classifier: an interpolated modified Kneser-Ney model over characters, trained on trusted documents.

Counts are tables with a row for each n-gram; the model is never gathered in one place. A document's n-grams meet the
counts in sharded joins: each block of documents asks once for each of its distinct n-grams, the distinct questions of
all blocks are joined order by order to counts, contexts and lower orders, and the answers return to the blocks, which
add them up to a perplexity for each document. Documents are kept up to a quantile of their language's trusted ones, as
models of other trusted documents score them. A text that repeats itself can have the perplexity of good text, so its
variety must reach a quantile as well: the distinct n-grams of its pieces against those that pieces of their length would have if the
model's n-grams were drawn at random.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemos.llm.chunking import ranges
from mnemos.llm.common import forget, materialize, table
from mnemos.llm.textblocks import forget_blocks, kept_blocks, starts, unpack

#: Characters of an n-gram, and bits of a character's symbol; an n-gram has 64 bits at most.
ORDER, BITS = 4, 8
#: The models: of all trusted documents, and of those that aren't in the first or the second half.
MODELS = ("", "0", "1")
#: Bits of the query's symbols: every character up to U+FFFF is one of its own.
WIDE = 16
#: Part of the trusted documents of a language whose perplexity a document may not exceed, and that exceed its least variety.
QUANTILE = 0.995
#: Variety is counted in pieces of two to this power n-grams and summed up, so that it doesn't sink with the length of a text.
PIECE = 11
#: Width of the bins of log perplexity in which quantiles are found.
BIN = 0.001
#: Bytes of text that are turned into codes at a time, about.
SLICE = 512 << 10
EMPTY = np.zeros(0, np.int64)
#: Trusted documents below which a language goes by all languages' limit.
SUPPORT = 30


def symbols(data: bytes, at: np.ndarray, order: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all n-grams of a block's texts, and where each text's begin and how many there are.

    ASCII characters are symbols of their own. With 8 bits others share 128 by their lowest seven bits; with more,
    characters share a symbol only if all these bits are equal. A text stands between symbols of zero: its n-grams end
    at its characters and at the zero after them.
    """
    pad = "\0" * (order - 1)
    texts = [data[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    points = np.frombuffer((pad + pad.join(texts) + pad).encode("utf-32-le"), dtype="<u4")
    s = (np.where(points < 128, points, 128 + (points & 127)) if bits == 8 else points & ((1 << bits) - 1)).astype(np.int64)
    codes = np.zeros(max(0, len(s) - order + 1), np.int64)
    for i in range(order):
        codes = (codes << bits) | s[i : i + len(codes)]
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    first = np.cumsum(sizes + order - 2) - (sizes + order - 2)
    return codes, first, sizes


def _slices(row, order: int, bits: int):
    """The block's texts some at a time, as (first, last, codes, first places, sizes): arrays of a whole block would be large."""
    data, at = unpack(row["data"], row["n_bytes"]), starts(row["sizes"])
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + SLICE, "right")) - 1)
        yield low, high, *symbols(data, at[low : high + 1], order, bits)
        low = high


def _folds(row) -> np.ndarray:
    """Of each text of a block: its half of the trusted documents (0 or 1), or -1."""
    fold = np.full(len(row["sizes"]), -1, np.int64)
    for x in row["trusted"] or []:
        fold[x["place"]] = x["fold"]
    return fold


def _gather(order: int, bits: int):
    """blocks with their trusted documents -> (block, known, n, m, asked): n-grams of trusted documents with counts in all and in the first half, and each distinct one of the block."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fold = _folds(row)
                known, counts, firsts, asked = [], [], [], []
                for low, high, codes, first, sizes in _slices(row, order, bits):
                    own = fold[low:high]
                    good = own >= 0
                    found, same = np.unique(codes[ranges(first[good], sizes[good])], return_inverse=True)
                    known.append(found)
                    counts.append(np.bincount(same, minlength=len(found)))
                    firsts.append(np.bincount(same, weights=np.repeat(own[good] == 0, sizes[good]), minlength=len(found)))
                    asked.append(np.unique(codes[ranges(first, sizes)]))
                known, same = np.unique(np.concatenate(known or [EMPTY]), return_inverse=True)
                n, m = (np.bincount(same, weights=np.concatenate(x or [EMPTY]), minlength=len(known)).astype(np.int64) for x in (counts, firsts))
                asked = np.unique(np.concatenate(asked or [EMPTY]))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), *[pa.array([x]) for x in (known, n, m, asked)]], names=["block", "known", "n", "m", "asked"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of n-grams counted once, twice, and more often, by the numbers of n-grams with counts one to four."""
    if not n1 or not n2 or not n3:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(found, (1, 2, 3), strict=True))


def model(counts: DataFrame, order: int, bits: int) -> list[tuple[DataFrame, DataFrame, list[tuple[float, float, float]]]]:
    """For each order from 1: (code and the counts of each of MODELS), (context and their totals and numbers of n-grams counted once, twice, more often), discounts.

    The highest order counts occurrences, the others the distinct n-grams that they end.
    """
    out = []
    for k in range(order, 0, -1):
        counts = materialize(counts, f"counts{k}")
        kinds = [(f"total{i}", F.sum(f"n{i}")) for i in MODELS] + [(f"{name}{i}", F.count_if(cond(F.col(f"n{i}")))) for i in MODELS for name, cond in (("once", lambda n: n == 1), ("twice", lambda n: n == 2), ("more", lambda n: n > 2))]
        contexts = counts.groupBy(F.shiftrightunsigned("code", bits).alias("context")).agg(*[x.alias(name) for name, x in kinds])
        few = counts.agg(*[F.count_if(F.col(f"n{i}") == times) for i in MODELS for times in (1, 2, 3, 4)]).first()
        out.append((counts, contexts, [discounts(*few[at : at + 4]) for at in range(0, len(few), 4)]))
        counts = counts.groupBy(F.col("code").bitwiseAND(F.lit((1 << bits * (k - 1)) - 1)).alias("code")).agg(*[F.count_if(F.col(f"n{i}") > 0).alias(f"n{i}") for i in MODELS])
    return out[::-1]


def probabilities(asked: DataFrame, levels, order: int, bits: int) -> DataFrame:
    """``code`` and the probability ``p`` by each of MODELS for each distinct ``code`` of ``asked``: interpolated down to the uniform distribution."""
    lower_code = F.col("code").bitwiseAND(F.lit((1 << bits * (order - 1)) - 1))
    asked = asked.select("code", F.shiftrightunsigned("code", bits).alias("context"), lower_code.alias("lower"))
    if order > 1:
        renamed = {"code": "lower"} | {f"p{i}": f"q{i}" for i in MODELS}
        asked = asked.join(probabilities(asked.select(F.col("lower").alias("code")).distinct(), levels, order - 1, bits).withColumnsRenamed(renamed), "lower")
    else:
        asked = asked.withColumns({f"q{i}": F.lit(1.0 / (1 << bits)) for i in MODELS})
    counts, contexts, all_discounts = levels[order - 1]
    found = asked.join(counts, "code", "left").join(contexts, "context", "left")

    def p(i: str, d1: float, d2: float, d3: float):
        n, total, q = F.coalesce(f"n{i}", F.lit(0)), F.coalesce(f"total{i}", F.lit(0)), F.col(f"q{i}")
        less = F.when(n == 0, 0.0).when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        rest = (d1 * F.col(f"once{i}") + d2 * F.col(f"twice{i}") + d3 * F.col(f"more{i}")) / total
        return F.when(total == 0, q).otherwise((n - less) / total + rest * q).alias(f"p{i}")

    return found.select("code", *[p(i, *own) for i, own in zip(MODELS, all_discounts, strict=True)])


def _score(order: int, bits: int):
    """blocks with answers (code, p, p0, p1) -> key, lang, n_symbols, n_distinct, log_perplexity and held of each document."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                told = np.array(row["told"] or [], dtype=np.int64)
                by = np.argsort(told)
                told, logs, *halves = told[by], *[np.log(np.array(row[x] or [], dtype=float))[by] for x in ("p", "p0", "p1")]
                halves, fold = np.stack(halves), _folds(row)
                seen = np.zeros(len(told), np.int64)
                means, held, all_sizes, distinct = [], np.full(len(fold), np.nan), [], []
                for first_text, last_text, codes, first, sizes in _slices(row, order, bits):
                    which = np.searchsorted(told, codes[ranges(first, sizes)])
                    ends = np.cumsum(sizes)
                    means.append(-np.add.reduceat(logs[which], ends - sizes) / sizes)
                    all_sizes.append(sizes)
                    own = fold[first_text:last_text]
                    good = np.flatnonzero(own >= 0)
                    if len(good):
                        of = which[ranges((ends - sizes)[good], sizes[good])]
                        held[first_text + good] = -np.add.reduceat(halves[np.repeat(own[good], sizes[good]), of], np.cumsum(sizes[good]) - sizes[good]) / sizes[good]
                    places = np.arange(len(which))
                    for low, high in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                        found = 0
                        for a in range(low, high, 1 << PIECE):
                            own, at = which[a : min(high, a + (1 << PIECE))], places[a : min(high, a + (1 << PIECE))]
                            seen[own[::-1]] = at[::-1]  # each n-gram's first place in the piece
                            found += np.count_nonzero(seen[own] == at)
                        distinct.append(found)
                mean, sizes = np.concatenate(means or [EMPTY]), np.concatenate(all_sizes or [EMPTY])
                empty = sizes <= 1
                kinds = (
                    pa.array(row["keys"], pa.int64()), pa.array(row["tags"], pa.string()), pa.array(sizes - 1, pa.int64()), pa.array(np.array(distinct, np.int64), mask=empty),
                    pa.array(mean, pa.float64(), mask=empty), pa.array(held, pa.float64(), mask=empty | (fold < 0)),
                )
                yield pa.RecordBatch.from_arrays(list(kinds), names=["key", "lang", "n_symbols", "n_distinct", "log_perplexity", "held"])

    return run


def expected(counts: DataFrame) -> list[float] | None:
    """The distinct n-grams in 2^i draws from the counted ones, up to those of a piece; None if nothing was counted."""
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    return [float(x) for x in counts.agg(*[F.sum(-F.expm1(F.col("n") * F.lit(-(2.0**i) / total))).alias(f"e{i}") for i in range(PIECE + 1)]).first()]


def score(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang", order: int = ORDER, bits: int = BITS) -> DataFrame:
    """One row for each row of ``df``: ``key``, ``lang``, ``n_symbols``, ``log_perplexity`` (for a character), ``variety`` (1: as expected), ``held``.

    ``held`` is a trusted document's log perplexity under a model of the half of the trusted ones that it isn't in (a
    key's half is its hash), null for others. All three are null for empty and null texts, ``variety`` too where no
    document is trusted.

    ``trusted``: a table with the keys of the documents that the model is trained on, all of them. Null keys are never
    trusted; rows with one key are all scored, and all train if that key is trusted. With no trusted document each
    character has the same probability. An empty table gives no rows.
    """
    spark = df.sparkSession
    blocks, parts = kept_blocks(df, key, text, lang)
    places = blocks.select("block", F.posexplode("keys").alias("place", "key"))
    fold = F.pmod(F.xxhash64(F.lit(9), F.col("key").cast("long")), F.lit(2)).alias("fold")
    good = places.join(trusted.select(F.col(key).alias("key")).distinct(), "key", "left_semi").select("block", F.struct(F.col("place").cast("long").alias("place"), fold).alias("x"))
    good = materialize(good.repartition(parts, "block").groupBy("block").agg(F.collect_list("x").alias("trusted")), "trusted").repartition(parts, "block")
    texts = blocks.select("block", "sizes", "n_bytes", "data")
    gathered = materialize(texts.join(good, "block", "left").mapInArrow(_gather(order, bits), "block long, known array<long>, n array<long>, m array<long>, asked array<long>"), "ngrams")
    of = F.explode(F.arrays_zip("known", "n", "m")).alias("x")
    # a document's half is judged by a model of the other one
    n, m = F.sum("x.n"), F.sum("x.m")
    counts = gathered.select(of).groupBy(F.col("x.known").alias("code")).agg(n.alias("n"), (n - m).alias("n0"), m.alias("n1"))
    levels = model(counts, order, bits)
    asked = gathered.select("block", F.explode("asked").alias("code"))
    p = materialize(probabilities(asked.select("code").distinct(), levels, order, bits), "probabilities")
    told = asked.join(p, "code").repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("code", "p", "p0", "p1")).alias("x"))
    told = told.select("block", F.col("x.code").alias("told"), *[F.col(f"x.{x}").alias(x) for x in ("p", "p0", "p1")])
    scored = blocks.join(told, "block", "left").join(good, "block", "left").select("keys", "tags", "sizes", "n_bytes", "data", "trusted", "told", "p", "p0", "p1")
    out = materialize(scored.mapInArrow(_score(order, bits), "key long, lang string, n_symbols long, n_distinct long, log_perplexity double, held double"), "scores")
    lines, variety = expected(levels[order - 1][0]), F.lit(None).cast("double")
    if lines:
        # whole pieces, and the rest on a straight line between the powers of two around it
        places = F.col("n_symbols") + 1
        rest = places % (1 << PIECE)
        power = F.log2(F.greatest(rest, F.lit(1)).cast("double"))
        low = F.least(F.floor(power), F.lit(PIECE - 1)).cast("int")
        least, most = (F.element_at(F.array(*map(F.lit, lines)), low + i) for i in (1, 2))
        last = F.when(rest == 0, 0.0).otherwise(least + (most - least) * (F.pow(F.lit(2.0), power - low) - 1))
        variety = F.col("n_distinct") / (F.floor(places / (1 << PIECE)) * lines[-1] + last)
    forget_blocks(blocks)
    for done in (gathered, p, *[x for x, _, _ in levels]):
        forget(done)
    return out.select(F.col("key").alias(key), "lang", "n_symbols", "log_perplexity", variety.alias("variety"), "held")


def limits(scores: DataFrame, trusted: DataFrame, key: str, quantile: float, of: str = "log_perplexity") -> DataFrame:
    """``lang`` (null: all together) and ``most``: the quantile of the trusted documents' ``of``, up to BIN.

    Rows without a score and null keys don't count; rows that repeat do. No trusted document, no rows.
    """
    own = scores.join(trusted.select(F.col(key)).distinct(), key, "left_semi").where(F.col(of).isNotNull())
    bins = own.groupBy("lang", F.ceil(F.col(of) / BIN).alias("bin")).agg(F.count("*").alias("n"))
    bins = bins.where("lang is not null").select("lang", "bin", "n").unionByName(bins.groupBy(F.lit(None).cast("string").alias("lang"), "bin").agg(F.sum("n").alias("n")))
    up = W.partitionBy("lang").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(W.partitionBy("lang")))
    reached = bins.where((F.col("upto") >= quantile * F.col("all")) & (F.col("lang").isNull() | (F.col("all") >= SUPPORT)))
    return reached.groupBy("lang").agg((F.min("bin") * BIN).alias("most"))


def held_out(df: DataFrame, trusted: DataFrame, key: str, text: str, lang: str, order: int, bits: int = BITS) -> DataFrame:
    """The trusted documents of score(), with ``held`` as their log perplexity."""
    return score(df, trusted, key, text, lang, order, bits).where("held is not null").withColumn("log_perplexity", F.col("held"))


def classify(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, order: int = ORDER, bits: int = BITS) -> DataFrame:
    """score() with ``most`` and ``least`` (the limits of perplexity and variety in the language, or in all if it has under SUPPORT trusted documents or is null) and ``kept``.

    Texts without characters aren't kept; without trusted documents there is no limit and all others are.
    """
    scores = score(df, trusted, key, text, lang, order, bits)
    held = scores.withColumn("log_perplexity", F.col("held"))
    most = limits(held, trusted, key, quantile)
    # below the lower limit lies as much as beyond the upper one: the quantile of the negative values
    least = limits(held.withColumn("variety", -F.col("variety")), trusted, key, quantile, "variety").select("lang", (-F.col("most")).alias("least"))
    both = materialize(most.join(least, most["lang"].eqNullSafe(least["lang"]), "left").select(most["lang"], "most", "least"), "limits")
    own = both.where("lang is not null")
    every = both.where("lang is null").agg(F.max("most"), F.max("least")).first()
    out = scores.join(own, "lang", "left")
    out = out.withColumns({"most": F.coalesce("most", F.lit(every[0]).cast("double")), "least": F.coalesce("least", F.lit(every[1]).cast("double"))})
    good = (F.col("log_perplexity") <= F.col("most")) & (F.col("variety") >= F.col("least"))
    kept = F.col("log_perplexity").isNotNull() & (F.col("most").isNull() | F.coalesce(good, F.lit(False)))
    return out.select(key, "lang", "n_symbols", "log_perplexity", "most", "variety", "least", kept.alias("kept"))


def op9_kneser_ney_quality(spark, sf_dir) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), trusted, bits=WIDE)
