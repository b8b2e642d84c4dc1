"""Quality rules as a learned decision list.

Sequential covering: a rule is grown as a conjunction of thresholds on text statistics, each the one with the largest
information gain on the rows not yet covered, then pruned on rows held out from growing, kept if it is precise enough
there, and the rows it covers are taken away. The ordered rules become one Spark conditional expression.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import small_batches, table, text_of

#: Labelled rows that rules are learned from, at most: those with the least hash of their key.
LABELLED = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_digits", "n_distinct", "n_bars")
#: What conditions may test: one count for each unit of another.
RATIOS = (
    ("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_upper", "n_letters"),
    ("n_marks", "n_words"), ("n_digits", "n_words"), ("n_distinct", "n_words"), ("n_bars", "n_words"), ("n_letters", "word_chars"), ("n_words", "n_lines"),
)
SYMBOLS = b"#*$%&|<>"
#: Other punctuation, words' ends aside.
MARKS = b"!?~^_=+{}\\@/;:"


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of a text; words are what ASCII white space separates, lines what line feeds do."""
    data = text.encode()
    words = data.split()
    n = len(words)
    three = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(three)) < len(three):
        seen = Counter(three)
        covered = bytearray(n)
        for i, t in enumerate(three):
            if seen[t] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeat = covered.count(1)
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    joined = b"".join(words)
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(data) - len(data.translate(None, UPPER))
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(data) - len(data.translate(None, LETTERS))
    marks, digits = len(data) - len(data.translate(None, MARKS)), len(data) - len(data.translate(None, b"0123456789"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return n, len(joined.decode()), symbols, len(lines) - len(set(lines)), repeat, len(lines), upper, letters, marks, digits, len(set(words)), data.count(b"|")


UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))


def statistics(text: Column) -> Column:
    """A struct of COUNTS."""

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def counted(texts: pa.Array) -> pa.Array:
        rows = [counts(t.as_py() or "") for t in texts]
        columns = zip(*rows, strict=True) if rows else [[]] * len(COUNTS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))

    return counted.asNondeterministic()(text)


@dataclass(frozen=True)
class Condition:
    """``over``: at least ``value``; else at most."""

    ratio: int
    over: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.ratio] >= self.value if self.over else x[:, self.ratio] <= self.value


def covered(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.ones(len(x), bool)


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    inside = np.ones(len(x), bool)
    while len(rule) < most and bad[inside].any() and not bad[inside].all():
        xs, bs = x[inside], bad[inside]
        share = np.log2(bs.mean())
        best = (0.0, None)
        for k in range(x.shape[1]):
            order = np.argsort(xs[:, k], kind="stable")
            v, b = xs[order, k], bs[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            n, p = cut + 1, np.cumsum(b)[cut]
            for over, pos, num in ((False, p, n), (True, b.sum() - p, len(b) - n)):
                with np.errstate(divide="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1e-9) / num) - share), 0)
                i = int(gain.argmax())
                if gain[i] > best[0] + 1e-9:
                    best = float(gain[i]), Condition(k, over, float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def _prune(rule: tuple[Condition, ...], x: np.ndarray, bad: np.ndarray) -> tuple[Condition, ...]:
    """Drops last conditions while (bad - good) / covered on the held-out rows doesn't fall."""

    def worth(r):
        hit = covered(r, x)
        return (2 * bad[hit].sum() - hit.sum()) / max(1, hit.sum())

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.98, conditions: int = 4, rules: int = 12) -> list[tuple[Condition, ...]]:
    """The ordered rules that tell bad rows; a third of the rows, every third one, is for pruning."""
    found: list[tuple[Condition, ...]] = []
    held = np.arange(len(x)) % 3 == 2
    while len(found) < rules and bad[~held].any():
        rule = _prune(_grow(x[~held], bad[~held], conditions), x[held], bad[held])
        hit = covered(rule, x)
        if not rule or not hit[held].any() or bad[hit & held].mean() < precision or bad[hit].mean() < precision or hit.sum() < 5:
            break
        found.append(rule)
        x, bad, held = x[~hit], bad[~hit], held[~hit]
    return found


def expression(rules: list[tuple[Condition, ...]], stats: str) -> Column:
    """The number of the first rule that fires, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule:
            a, b = (F.col(f"{stats}.{n}").cast("double") for n in RATIOS[c.ratio])
            value = a / F.greatest(b, F.lit(1.0))
            test &= (value >= c.value) if c.over else (value <= c.value)
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = LABELLED) -> list[tuple[Condition, ...]]:
    """Rules from the labelled rows (``label`` 0: bad); at most ``most`` of them, chosen by the hash of their key.

    Rows without a label, a key or a text, and labels other than 0 and 1, teach nothing; of rows with one key the least
    statistics teach, so that no more than ``most`` rows reach the driver. Without labels there are no rules.
    """
    own = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where("key is not null and label in (0, 1)").groupBy("key").agg(F.min("label").alias("label"))
    own = own.orderBy(F.xxhash64("key"), "key").limit(most)  # bounded: it may be broadcast
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null").join(F.broadcast(own), "key")
    rows = rows.select("key", "label", statistics(F.col("text")).alias("s")).groupBy("key", "label").agg(F.min("s").alias("s")).select("key", "label", "s.*").toPandas().sort_values(["key", *COUNTS])
    x = np.stack([rows[a].to_numpy(float) / np.maximum(rows[b].to_numpy(float), 1) for a, b in RATIOS], axis=1)
    return learn(x, rows["label"].to_numpy() == 0)


def judge(df: DataFrame, rules: list[tuple[Condition, ...]], text: str = "text", stats: str = "stats", rule: str = "rule", base: str = "base_failed") -> DataFrame:
    """``df`` with ``stats`` (COUNTS), ``base`` (fewer than 50 words, or over half of them in repeated windows) and ``rule`` (the first that fires, else 0).

    A null or empty text has no words and fails the base. Rows, repeats and other columns pass; columns with the same names are replaced.
    """
    small_batches(df.sparkSession)
    out = df.withColumn(stats, statistics(text_of(text)))
    n, again = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return out.withColumn(base, (n < 50) | (100 * again > 50 * n)).withColumn(rule, expression(rules, stats))


def accepted(df: DataFrame, rules: list[tuple[Condition, ...]], text: str = "text") -> DataFrame:
    """The rows of ``df`` that pass the base and that no rule fires on."""
    return judge(df, rules, text, "__stats", "__rule", "__failed").where("not __failed and __rule = 0").select(df.columns)


def op3_quality_rules(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *[F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))
