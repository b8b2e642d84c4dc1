import hashlib
import math
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline as c
from mnemos.llm import bpe, mixing, quality_rules
from tests.llm.test_mixing import level
from tests.llm.test_quality_rules import brute as base
from tests.llm.test_similar import brute_least

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    rules = quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    fired = {r.doc_id: r.rule for r in quality_rules.judge(docs, rules).collect()}
    kept = {k: r for k, r in rows.items() if not base(r.text)[-1] and not fired[k]}
    got = c.quality(spark, docs, SF)
    assert got.columns == docs.columns and {r.doc_id: r for r in got.collect()} == kept

    first = {}
    for k in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[k].text), k)
    kept = {k: kept[k] for k in first.values()}
    got = c.exact(spark, got, SF)
    assert got.columns == docs.columns and {r.doc_id: r for r in got.collect()} == kept

    least = brute_least([(k, r.text) for k, r in kept.items()])
    assert any(least[k] != k for k in kept)
    kept = {k: r for k, r in kept.items() if least[k] == k}
    got = c.near(spark, got, SF)
    assert got.columns == docs.columns and {r.doc_id: r for r in got.collect()} == kept

    taken = {r.doc_id: r for r in mixing.mix(got).collect()}
    sizes = {}
    for r in kept.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    want = level(sizes)
    assert all(abs(want[r.source] - taken[k].target) < 1e-6 for k, r in kept.items())
    many = sorted(k for k in kept for _ in range(math.ceil(taken[k].taken / taken[k].size)))
    got = c.mix(spark, got, SF)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == many

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    found = sorted((r.doc_id, r.ids, r.decoded_sha256) for r in c.encode(spark, got, SF).collect())
    assert found == [(k, library.encode_ordinary(rows[k].text), hashlib.sha256(rows[k].text.encode()).hexdigest()) for k in many]


def test_stages_on_odd_tables(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, None, None, None, None), (None, text + " more", "en", None, 1), (3, "", "en", "a", 0), (4, "long " + "Xy zt " * 50_000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = c.exact(spark, docs, SF)
    assert sorted((repr(r.doc_id) for r in kept.collect())) == ["1", "2", "4", "None"]
    assert sorted(repr(r.doc_id) for r in c.near(spark, kept, SF).collect()) in (["1", "2", "4"], ["1", "2", "4", "None"])
    assert {r.doc_id for r in c.mix(spark, docs, SF).collect()} <= {1, 4, None}
    assert {repr(r.doc_id) for r in c.quality(spark, docs, SF).collect()} == {"1", "None"}
    for _, stage in c.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
