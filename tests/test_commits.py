"""Leases, commits by manifest and the keyed store, with crashes at each step and writers that meet."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from mnemos.sources import commits

SCHEMA = "k long, v string, p string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_commits_and_crashes(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    one = [(1, "a", "x"), (2, "b", "x"), (2, "b", "x"), (3, None, "y"), (4, "d", None)]
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    said = lambda df: {r.part: r.change for r in df.collect()}
    assert rows(commits.read_version(spark, at, SCHEMA)) == []
    assert said(commits.commit(frame(one), at, "p")) == {"x": "written", "y": "written", None: "written"}
    two = [(4, "d", None), (2, "b", "x"), (1, "a", "x"), (2, "b", "x"), (5, "e", "y"), (6, "f", "z")]
    for step in ("manifest", "version"):
        commits.commit(frame(two), at, "p", stop_before=step)
        assert commits.latest(spark, at) == 1 and rows(commits.read_version(spark, at, SCHEMA)) == rows(frame(one))
    assert said(commits.commit(frame(two), at, "p")) == {"x": "kept", None: "kept", "y": "written", "z": "written"}
    assert rows(commits.read_version(spark, at, SCHEMA)) == rows(frame(two)) and rows(commits.read_version(spark, at, SCHEMA, 1)) == rows(frame(one))
    # a repeat less is a change; equal content is none, though rows come in another order; a part that goes is told
    three = [(2, "b", "x"), (1, "a", "x"), (4, "d", None), (5, "e", "y")]
    assert said(commits.commit(frame(three), at, "p")) == {"x": "written", None: "kept", "y": "kept", "z": "removed"}
    assert len(commits.manifest(spark, at).select("folder").distinct().collect()) == 3
    assert said(commits.commit(frame([]), at, "p")) == {"x": "removed", "y": "removed", None: "removed"} and rows(commits.read_version(spark, at, SCHEMA)) == []


def test_leases(spark, tmp_path):
    at = f"file://{tmp_path}"
    first = commits.acquire(spark, at, "s", "a", 1000, now_ms=10)
    assert first.token == 1 and commits.acquire(spark, at, "s", "b", 1000, now_ms=1000) is None and commits.acquire(spark, at, "other", "b", 1000, now_ms=0).token == 1
    second = commits.acquire(spark, at, "s", "b", 1000, now_ms=1010)
    assert second.token == 2 and not commits.holds(spark, first) and commits.holds(spark, second)
    df = spark.createDataFrame([(1, "a", "x")], SCHEMA)
    commits.commit(df, f"{at}/t", "p", second)
    with pytest.raises(commits.Fenced):
        commits.commit(df.withColumn("v", F.lit("late")), f"{at}/t", "p", first)
    assert rows(commits.read_version(spark, f"{at}/t", SCHEMA)) == [(1, "a", "x")]
    commits.release(spark, second)
    third = commits.acquire(spark, at, "s", "c", 1000, now_ms=1011)
    assert third.token == 3 and not commits.holds(spark, second)


def test_one_of_many_writers(spark, tmp_path):
    at = f"file://{tmp_path}"
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: commits.acquire(spark, at, "s", str(i), 10**6, now_ms=5), range(8)))
    assert sum(x is not None for x in got) == 1
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda i: commits._create(spark, f"{at}/versions/9", str(i)), range(4)))
    assert made.count(True) == 1 and commits._content(spark, f"{at}/versions/9") == str(made.index(True))


def test_two_commits_on_one_version(spark, tmp_path, monkeypatch):
    at, df = f"file://{tmp_path}", spark.createDataFrame([(1, "a", "x")], SCHEMA)
    commits.commit(df, at, "p")
    monkeypatch.setattr(commits, "latest", lambda *_: 0)  # a writer that saw the table before
    with pytest.raises(FileExistsError):
        commits.commit(df, at, "p")


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "O", None), (2, "F", 0), (3, "open", 1), (4, "x", 2), (5, "y", 7)], "id int, s string, schema_version int")
    steps = [lambda d: d.withColumn("s", F.concat("s", F.lit("+"))), lambda d: d.withColumn("r", F.lit(1))]
    assert rows(commits.migrated(old, steps).select("id", "s", "r", "schema_version")) == [(1, "O+", 1, 2), (2, "F+", 1, 2), (3, "open", 1, 2), (4, "x", None, 2), (5, "y", None, 2)]
    assert rows(commits.repeated_keys(old.withColumn("k", F.col("id") % 2), "k")) == [(0, 2), (1, 3)]
    data = spark.range(2000).select(F.col("id"), (F.col("id") % 100).alias("user"))
    found = commits.index(data, "user", ["id"], f"file://{tmp_path}/index").where("user = 7")
    assert rows(found.select("id")) == rows(data.where("user = 7").select("id"))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan prunes all the same, but doesn't say so
    try:
        assert "SelectedBucketsCount: 1 out of 16" in found.where("id > 0")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert commits.migrated(old.limit(0), steps).count() == 0
