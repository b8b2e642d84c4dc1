import re

import numpy as np

from mnemos.llm import url_filter as u


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in u.LISTED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(str(r)), default=None)
    return host, path, best and str(best), best and best.verdict


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in u.op1_url_filter(spark, sf).collect():
        host, path, rule, verdict = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score > 0 else "allow"))


def test_learned_verdicts_on_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    model = u.fit(u.by_rules(pages.where("page_id % 2 = 0"), u.LISTED))
    held = u.judge(u.by_rules(pages.where("page_id % 2 = 1"), u.LISTED), (), model).toPandas()
    right = ((held["verdict"] == "block") == held["bad"]).mean()
    assert right > max(held["bad"].mean(), 1 - held["bad"].mean()) + 0.03, right


def test_expressions_score_as_the_trees_do(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(f"https://{'good' if i % 2 else 'bad-1-2-3'}.example.{'org' if i % 3 else 'net'}/a/{i}?x={i}", i % 2 == 0) for i in range(400)]
    model = u.fit(spark.createDataFrame(rows, "url string, bad boolean"))
    assert model.trees
    numbers = u.lexical(u.F.col("url"), u.host_of(u.F.col("url")), u.path_of(u.F.col("url")))
    host = u.host_of(u.F.col("url"))
    got = u.judge(pages, (), model).select("score", u.suffix_of(host).alias("s"), u.domain_of(host).alias("d"), u.segment_of(u.path_of(u.F.col("url"))).alias("p"), *[c.alias(k) for k, c in numbers.items()]).toPandas()
    got["suffix_rate"], got["domain_rate"] = [model.suffixes.get(x, 0.0) for x in got["s"]], [model.domains.get(x, 0.0) for x in got["d"]]
    got["segment_rate"] = [model.segments.get(x, 0.0) for x in got["p"]]
    assert np.allclose(model.score(got[list(u.NUMBERS)].to_numpy(float)), got["score"])


def test_odd_tables(spark):
    urls = [None, "", "no scheme", "HTTP://Sub.EXAMPLE.org/en/1x?q#f", "x://a.com", "x://com/fr/", "://org/", "a://b.org?://c", "x://notorg/", "x://é.com/de/ü", "x://y.com/" + "1/" * 50_000]
    df = spark.createDataFrame([(i, x, "h", 1.0) for i, x in enumerate(urls + urls[:2])], "page_id long, url string, host string, score double")
    model = u.fit(df.limit(0).withColumn("bad", u.F.lit(True)))
    found = u.judge(df, u.LISTED, model).collect()
    assert len(found) == 13
    for r in found:
        host, path, rule, verdict = brute(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert u.judge(df.limit(0), u.LISTED, model).count() == 0
