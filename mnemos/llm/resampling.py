"""Importance resampling towards a target: n-gram buckets of the corpus against those of a target text, Gumbel top-k.

Words stand in a table by document and place; lead() over a document's window puts the following words beside each, so
each order's n-grams are a column, and their checksums are buckets. The buckets are counted over all documents and over the
target, the log ratio of the smoothed counts is a bucket's gain, and a document's weight the mean gain of its n-grams.
Weights plus Gumbel noise from a hash of the key draw without replacement, each time the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemos.llm.common import materialize, table, text_of
from mnemos.llm.numbering import numbered

#: What stands between words, before letters are lower-cased: ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def features(df: DataFrame, key: str, text: str, orders: int, buckets: int) -> DataFrame:
    """``row``, ``key`` and the buckets ``b1`` to ``b<orders>`` of the n-grams that begin at each word, null beyond the text's end.

    A text without words has one row of nulls. Texts are dealt out by row and split up where they lie, so the window moves
    nothing; it takes one document at a time and spills long ones.
    """
    texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), text_of(text).alias("text")).repartition("row")
    words = F.filter(F.split("text", BETWEEN), lambda w: w != "")
    rows = texts.select("row", "key", F.posexplode_outer(words).alias("place", "word")).withColumn("word", lowered(F.col("word")))
    by = W.partitionBy("row").orderBy("place")
    grams, n = [F.col("word")], [F.col("word")]
    for j in range(1, orders):
        n.append(F.lead("word", j).over(by))
        grams.append(F.when(n[-1].isNotNull(), F.concat_ws(" ", *n)))
    rows = rows.select("row", "key", *[g.alias(f"g{j}") for j, g in enumerate(grams, 1)])
    return rows.select("row", "key", *[(F.crc32(F.col(f"g{j}").cast("binary")) % buckets).cast("int").alias(f"b{j}") for j in range(1, orders + 1)])


def counts(found: DataFrame, orders: int) -> DataFrame:
    """``bucket`` and its number of n-grams ``n``, counted in each task before they move."""
    each = found.select(F.explode(F.array(*[f"b{j}" for j in range(1, orders + 1)])).alias("bucket")).where("bucket IS NOT NULL")
    return each.groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket`` and its ``gain`` in thousandths, for every bucket: one row each, however large the corpus is."""
    s, t = (x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (corpus, target))
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    both = both.unionByName(corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t")))
    both = both.groupBy("bucket").agg((F.sum("s") + 1).cast("double").alias("s"), (F.sum("t") + 1).cast("double").alias("t"))
    ratio = F.col("t") * F.lit(float(s + buckets)) / (F.col("s") * F.lit(float(t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", orders: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """One row for each row of ``df``: ``key``, ``n_features``, ``weight``, ``score``, ``rank`` (null: not drawn).

    ``percent`` of the rows with ``least_words`` words or more are drawn, highest score first, ties to the smaller key.
    Null texts have no words, and texts without n-grams weight 0. A null key has no hash, so its score is null: it counts
    among the rows to draw from, and comes last. Rows that repeat a key get the same noise; those alike in key and score
    are ranked in any order. Without target text every gain still is defined (all its counts are zero). An empty table
    gives no rows. Other columns are not read.
    """
    found = materialize(features(df, key, text, orders, buckets), "features")
    gain = materialize(gains(counts(found, orders), counts(features(target, target_text, target_text, orders, buckets), orders), buckets), "gains")
    for j in range(1, orders + 1):
        own = F.broadcast(gain.select(F.col("bucket").alias(f"b{j}"), F.col("gain").alias(f"gain{j}")))  # ``buckets`` rows
        found = found.join(own, f"b{j}", "left")
    names = range(1, orders + 1)
    total = sum((F.coalesce(f"gain{j}", F.lit(0)) for j in names), F.lit(0).cast("long"))
    n = sum((F.col(f"b{j}").isNotNull().cast("long") for j in names), F.lit(0).cast("long"))
    docs = found.groupBy("row").agg(F.first("key").alias("key"), F.count("b1").alias("words"), F.sum(n).alias("n_features"), F.sum(total).alias("total"))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    docs = docs.select("row", "key", "words", "n_features", weight.alias("weight"))
    docs = materialize(docs.withColumn("score", F.col("weight") + noise), "scores")
    able = docs.where(F.col("words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = numbered(able, F.col("score").desc_nulls_last(), F.col("key").asc_nulls_last(), F.col("row"))
    ranked = ranked.withColumn("rank", F.when(F.col("position") < drawn, F.col("position") + 1))
    rest = docs.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = (F.col("key").alias(key), "n_features", "weight", "score", "rank")
    return ranked.select(*columns).unionByName(rest.select(*columns))


def op12_importance_resampling(spark, sf_dir) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The table of CRC-32 comes from its polynomial; each distinct n-gram is hashed once.
OP12_SQL = r"""
WITH RECURSIVE crc(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
crc_table AS (SELECT list(c::BIGINT ORDER BY i) AS t FROM crc WHERE k = 8),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1])) AS gram FROM words),
each AS (SELECT side, id, gram, count(*) AS n FROM grams GROUP BY ALL),
bytes AS (SELECT gram, hex(encode(gram)) AS x FROM (SELECT DISTINCT gram FROM each)),
hashed AS (SELECT gram, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, p, 2))::BIGINT), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295::BIGINT) % 10000 AS bucket FROM bytes, crc_table),
known AS (SELECT side, id, bucket, n FROM each JOIN hashed USING (gram)),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM known GROUP BY bucket),
alls AS (SELECT sum(s) AS s, sum(t) AS t FROM sums),
gains AS (SELECT bucket, floor(1000 * ln((sums.t + 1)::DOUBLE * (alls.s + 10000)::DOUBLE / ((sums.s + 1)::DOUBLE * (alls.t + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, alls),
totals AS (SELECT id, sum(n * gain)::BIGINT AS total, sum(n)::BIGINT AS n FROM known JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
docs AS (SELECT id AS doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT AS h FROM words LEFT JOIN totals USING (id) WHERE side = 'd'),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 25 // 100 AS most FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= most THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
