import re
from collections import Counter

import numpy as np

from mnemos.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), failed


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = q.op3_quality_rules(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:-1] for r in found} == {k: brute(t) for k, t in docs.items()}
    assert not any(r.kept and r.base_failed for r in found)


def test_rules_tell_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rules = q.fit(docs, labels.where("doc_id % 2 = 0"))
    found = q.judge(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), rules).select("quality", "rule").toPandas()
    bad, hit = found["quality"] == 0, found["rule"] > 0
    assert rules and hit[~bad].mean() < 0.005 and hit[bad].mean() > 0.85, (rules, hit[~bad].mean(), hit[bad].mean())


def test_learned_conjunction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(q.RATIOS)))
    bad = ((x[:, 1] > 0.8) & (x[:, 4] < 0.5)) | (x[:, 6] > 0.95)
    rules = q.learn(x, bad)
    hit = np.logical_or.reduce([q.covered(r, x) for r in rules])
    assert (hit == bad).mean() > 0.99 and not q.learn(x, np.zeros(3000, bool)) and not q.learn(x[:0], bad[:0])


def test_odd_tables(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "a b c " * 40), (4, " ".join(f"w{i}" for i in range(60))), (None, "é x\n\né x\x0b \n"), (5, "x " * 200_000)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, rule int, stats int")
    found = q.judge(df, []).collect()
    assert sorted((r.stats.n_words, r.stats.word_chars, r.stats.n_symbols, r.stats.n_dup_lines, r.stats.n_repeat_words, r.base_failed) for r in found) == sorted(brute(t) for _, t in rows)
    labels = spark.createDataFrame([(None, 0), (3, None), (4, 7)], "doc_id long, quality int")
    assert q.fit(df, labels) == [] and q.judge(df.limit(0), []).count() == 0
