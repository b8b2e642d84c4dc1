"""URL filter: an ordered rule list first, gradient-boosted trees on lexical features for the rest.

Features are Spark expressions, the trees are learned on the driver from a bounded sample of labelled URLs, and the
learned model goes back as Spark expressions, so scoring needs no Python and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import table

#: Labelled URLs that a model is learned from, at most: those with the least hash.
LABELLED = 20_000
#: Labelled URLs below which a suffix has no statistic of its own, and what it counts for beyond its URLs.
SUPPORT, PRIOR = 20, 10.0
#: Rules of a list, at most: they become one conditional expression.
RULES = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Signs that entropy is taken over; all others count as one more.
SIGNS = LOWER + "0123456789.-_/?&=%:#+~"
NUMBERS = ("length", "host_length", "path_length", "query_length", "depth", "labels", "digits", "path_digits", "longest_digits", "hyphens", "entropy", "parameters", "fragment", "extension", "suffix_rate", "domain_rate", "segment_rate")


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, rule: str) -> Rule:
        host, slash, path = rule.partition("/")
        return cls(verdict, host, slash + path)

    def __str__(self):
        return self.host + self.path


#: The list of the query.
LISTED = tuple(Rule.parse(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    """What stands after the first ://; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def listed(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, null if none; of rules of one length the first listed."""
    if len(rules) > RULES:
        raise ValueError(f"more than {RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for _, r in sorted(enumerate(rules), key=lambda x: (len(str(x[1])), -x[0])):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule, verdict = F.when(fits, str(r)).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need the URL only; a null URL counts as empty."""
    url = F.coalesce(url, F.lit(""))
    low = F.translate(url, UPPER, LOWER)
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    counts = [F.length(low) - F.length(F.translate(low, s, "")) for s in SIGNS]
    counts.append(F.length(F.translate(low, SIGNS, "")))
    entropy = sum((F.when(c > 0, -c / n * F.log2(c / n)).otherwise(0.0) for c in counts), F.lit(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = lambda x: F.length(x) - F.length(F.translate(x, "0123456789", ""))
    found = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "depth": F.length(path) - F.length(F.translate(path, "/", "")), "labels": F.length(host) - F.length(F.translate(host, ".", "")) + 1,
        "digits": digits(url) / n, "path_digits": digits(path) / F.greatest(F.length(path), F.lit(1)), "longest_digits": F.array_max(F.transform(F.split(path, r"[^0-9]+"), lambda x: F.length(x))),
        "hyphens": F.length(url) - F.length(F.translate(url, "-", "")), "entropy": entropy,
        "parameters": F.when(F.length(query) > 0, F.length(query) - F.length(F.translate(query, "&", "")) + 1).otherwise(0),
        "fragment": F.instr(url, "#") > 0, "extension": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)),
    }
    return {k: v.cast("double") for k, v in found.items()}


def suffix_of(host: Column) -> Column:
    """The last label of the host."""
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def segment_of(path: Column) -> Column:
    """The path's first segment, empty if no slash ends it."""
    return F.regexp_extract(path, r"^/([^/]*)/", 1)


@dataclass
class Tree:
    """Split ``feature`` at ``value`` (below goes to ``low``), or a leaf that gives ``value``."""

    value: float
    feature: int = -1
    low: Tree | None = None
    high: Tree | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] < self.value, self.low.score(x), self.high.score(x))

    def expression(self, prefix: str) -> str:
        if self.feature < 0:
            return f"{self.value!r}D"
        return f"CASE WHEN {prefix}{NUMBERS[self.feature]} < {self.value!r}D THEN {self.low.expression(prefix)} ELSE {self.high.expression(prefix)} END"


@dataclass
class Model:
    base: float
    trees: list[Tree]
    suffixes: dict[str, float]
    domains: dict[str, float]
    segments: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.score(x) for t in self.trees), np.zeros(len(x)))


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float, least: int = 20, l2: float = 1.0) -> Tree:
    g, h = grad.sum(), hess.sum()
    leaf = Tree(float(round(-rate * g / (h + l2), 9)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best = (1e-6, None, None)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v = x[order, k]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= least) & (cut <= len(v) - least)]
        if not len(cut):
            continue
        gl, hl = np.cumsum(grad[order])[cut - 1], np.cumsum(hess[order])[cut - 1]
        gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = float(gain[i]), k, float((v[cut[i] - 1] + v[cut[i]]) / 2)
    if best[1] is None:
        return leaf
    low = x[:, best[1]] < best[2]
    return Tree(best[2], best[1], _tree(x[low], grad[low], hess[low], depth - 1, rate), _tree(x[~low], grad[~low], hess[~low], depth - 1, rate))


def boost(x: np.ndarray, bad: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3) -> tuple[float, list[Tree]]:
    """Second-order boosting of the logistic loss; positive scores are bad."""
    share = min(max(float(bad.mean()), 1e-3), 1 - 1e-3) if len(bad) else 1e-3
    base = float(np.log(share / (1 - share)))
    grown, f = [], np.full(len(bad), base)
    for _ in range(trees if 0 < bad.sum() < len(bad) else 0):
        p = 1 / (1 + np.exp(-f))
        grown.append(_tree(x, p - bad, p * (1 - p), depth, rate))
        f += grown[-1].score(x)
    return base, grown


def _rates(names, bad: np.ndarray) -> dict[str, float]:
    """Of each suffix with enough URLs: the smoothed log odds of bad."""
    out, all_bad = {}, (bad.sum() + 1) / (len(bad) + 2)
    for name in sorted(set(names)):
        own = bad[names == name]
        if len(own) >= SUPPORT:
            share = (own.sum() + PRIOR * all_bad) / (len(own) + PRIOR)
            out[name] = float(round(np.log(share / (1 - share)) - np.log(all_bad / (1 - all_bad)), 9))
    return out


def fit(labelled: DataFrame, url: str = "url", label: str = "bad", most: int = LABELLED) -> Model:
    """A model from labelled URLs (``label`` true: to block); at most ``most`` of them, those with the least hash of the URL.

    Rows without a URL or label teach nothing; with one kind of label, or none, the model is a constant: without any it allows.
    """
    rows = labelled.select(F.col(url).alias("url"), F.col(label).cast("int").alias("bad")).where("url is not null and bad is not null")
    rows = rows.groupBy("url").agg(F.max("bad").alias("bad")).orderBy(F.xxhash64("url"), "url").limit(most)
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.select("url", "bad", suffix_of(F.col("host")).alias("suffix"), domain_of(F.col("host")).alias("domain"), segment_of(F.col("path")).alias("segment"), *[c.alias(k) for k, c in lexical(F.col("url"), F.col("host"), F.col("path")).items()])
    got = rows.toPandas().sort_values("url")
    bad = got["bad"].to_numpy(float)
    rates = [_rates(got[c].to_numpy(), bad) for c in ("suffix", "domain", "segment")]
    for c, known in zip(("suffix", "domain", "segment"), rates, strict=True):
        got[f"{c}_rate"] = [known.get(x, 0.0) for x in got[c]]
    base, trees = boost(got[list(NUMBERS)].to_numpy(float), bad)
    return Model(base, trees, *rates)


def _rate(name: Column, rates: dict[str, float]) -> Column:
    """Bounded: a sample of LABELLED URLs has LABELLED / SUPPORT such suffixes at most."""
    if not rates:
        return F.lit(0.0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), name), F.lit(0.0))


def judge(df: DataFrame, rules, model: Model, url: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``score`` (log odds of bad) and ``verdict``: the rule's, else block for a score above zero.

    A null URL, or one without ://, has empty host and path and is judged by its features. Rows, repeats and other
    columns pass unchanged; columns with the new names are replaced; an empty table gives an empty table.
    """
    out = df.withColumn("host", host_of(F.coalesce(F.col(url), F.lit("")))).withColumn("path", path_of(F.coalesce(F.col(url), F.lit(""))))
    numbers = lexical(F.col(url), F.col("host"), F.col("path"))
    numbers |= {
        "suffix_rate": _rate(suffix_of(F.col("host")), model.suffixes), "domain_rate": _rate(domain_of(F.col("host")), model.domains), "segment_rate": _rate(segment_of(F.col("path")), model.segments),
    }
    out = out.withColumn("__x", F.struct(*[numbers[k].alias(k) for k in NUMBERS]))
    score = F.lit(model.base)
    for t in model.trees:
        score += F.expr(t.expression("__x."))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    out = out.withColumn("score", score).withColumn("rule", rule)
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow"))).drop("__x")


def by_rules(df: DataFrame, rules, url: str = "url") -> DataFrame:
    """Labelled URLs (url, bad): those that the rules decide."""
    u = F.coalesce(F.col(url), F.lit(""))
    _, verdict = listed(host_of(u), path_of(u), rules)
    return df.select(F.col(url).alias("url"), (verdict == "block").alias("bad")).where("bad is not null")


def op1_url_filter(spark, sf_dir) -> DataFrame:
    """The labelled URLs are the pages that the rules decide."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, LISTED, fit(by_rules(pages, LISTED))).select("page_id", "host", "path", "rule", "verdict", "score")
