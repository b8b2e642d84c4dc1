"""Operators on small hand-made rows: edges that the driver's tables don't have."""

import datetime as dt
import itertools
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from mnemos.functions import text as fn
from mnemos.operators import bank, geometry, registry, replay, results, sessions, topics, validators
from mnemos.sources import tables
from mnemos.streaming import replication

DAY = dt.timedelta(days=1)
BEGIN = dt.datetime(2024, 1, 1)


def staged(marks, cut):
    """The replay as a loop; marks: r(ight), w(rong), d(ismissed wrong); the first ``cut`` are before the cutover."""
    stage, entered, wrongs, streak, last = None, None, 0, 0, None
    for i, m in enumerate(marks):
        at = BEGIN + i * DAY
        if m == "r":
            streak += 1
            if stage is not None:
                stage = min(stage + 1, 3) if i < cut else min(stage + 1, 4)
        else:
            wrongs, streak, last = wrongs + 1, 0, at
            if m == "w":
                if stage in (None, 4):
                    entered = at
                stage = 1
    return (stage, entered, last, wrongs, streak) if wrongs else None


def test_replay_against_the_loop(spark):
    rows, want, n = [], {}, 0
    for size in range(1, 6):
        for marks in itertools.product("rwd", repeat=size):
            for cut in {0, size // 2}:
                n += 1
                want[n] = staged(marks, cut)
                # before the cutover: the same days in the year before
                rows += [(n, 1, i, BEGIN + i * DAY - (366 * DAY if i < cut else 0 * DAY), "richtig" if m == "r" else "falsch", m == "d") for i, m in enumerate(marks)]
    df = spark.createDataFrame(rows, "user_id int, question_id int, attempt_id int, ts timestamp, correctness string, dismissed boolean")
    got = {r.user_id: r for r in replay.replay(df, "2024-01-01").collect()}
    back = lambda t: t and (t + 366 * DAY if t < BEGIN else t)
    for k, w in want.items():
        g = got.get(k)
        assert (g and (g.stage, back(g.entered_at), back(g.last_wrong_at), g.wrong_count, g.streak)) == w, k


def test_last_wins_and_measures(spark):
    df = spark.createDataFrame([(1, 1, 5, "falsch"), (1, 1, 5, "richtig"), (1, 2, 3, None)], "user_id int, attempt_id int, t int, correctness string")
    rows = results.last_wins(df, ["user_id"], "t", "attempt_id").collect()
    assert len(rows) == 1 and rows[0].t == 5
    empty = df.limit(0).agg(*results.measures(F.col("correctness"))).first()
    assert empty.answered == 0 and empty.accuracy is None


def test_eligibility(spark):
    df = spark.createDataFrame([(None, None, None, None), (True, None, None, None), (False, "x", None, True), (None, None, None, False)], "invalidated boolean, deleted_at string, discarded_at string, valid boolean")
    assert [r[0] for r in df.select(results.eligible()).collect()] == [True, False, False, False]


def test_combined_and_numbers(spark):
    df = spark.createDataFrame([(["richtig"] * 2,), (["falsch"],), (["richtig", "falsch"],), (["richtig", None],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(sessions.combined(F.col("p"))).collect()] == ["richtig", "falsch", "teilweise", None, None]
    n = spark.createDataFrame([(" 3,5",), ("3.6",), ("x",), (None,)], "t string").select(sessions.numeric_check(F.col("t"), F.lit(3.5), F.lit(0.05)))
    assert [r[0] for r in n.collect()] == [True, False, None, None]
    assert spark.range(1).select(sessions.hms(F.lit(3725))).first()[0] == "01:02:05"


def test_policy_edges(spark):
    rows = [(0.799, [1], None), (0.8, [1], False), (0.949, [1], False), (0.95, [1], None), (1.0, [], False), (1.0, None, None), (None, [1], None), (0.1, [], True)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "s double, t array<int>, l boolean, i int").orderBy("i")
    review, suggested, accepted = "classification_needs_review", "machine_suggested", "machine_accepted_high_confidence"
    assert [r[0] for r in df.select(topics.policy(F.col("s"), F.col("t"), F.col("l"))).collect()] == [review, suggested, suggested, accepted, review, review, review, "locked"]
    texts = spark.createDataFrame([(t, i) for i, t in enumerate(["wörter " * 9, "wörter " * 8, "wörter " * 9 + "\ufffd" * 3, "a1 " * 40, "\n" * 9 + "wör ter " * 7 + "\t"])], "t string, i int").orderBy("i")
    assert [r[0] for r in texts.select(topics.usable(F.col("t"))).collect()] == [True, False, False, False, False]
    seasons = spark.createDataFrame([(x, i) for i, x in enumerate(["2024-25-winter", "2018-sommer", "2017-18-Winter", "x", None])], "s string, i int").orderBy("i")
    assert [r[0] for r in seasons.select(fn.season_label(F.col("s"))).collect()] == ["Winter 2024/25", "Sommer 2018", "2017-18-Winter", "x", None]


def test_where_to_go_on(spark):
    questions = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "question_id int, pos int")
    states = [("none", 10, None), ("gap", 10, "richtig"), ("gap", 12, "falsch"), ("tail", 10, "falsch"), ("tail", 11, "richtig"), ("wrong", 10, "richtig"), ("wrong", 11, "teilweise"), ("wrong", 12, "falsch"), *[("done", q, "richtig") for q in (10, 11, 12)], ("alien", 99, "richtig")]
    got = {r.user_id: r.next_question for r in sessions.next_question(questions, spark.createDataFrame(states, "user_id string, question_id int, state string")).collect()}
    assert got == {"none": 10, "gap": 11, "tail": 12, "wrong": 11, "done": 10, "alien": 10}


def test_canonical_definition(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), (["a", "b"],), (["a,b"],)], "x array<string>")
    keys = [r[0] for r in df.select(bank.canonical("x")).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_text_functions(spark):
    df = spark.createDataFrame([("Maßé 12,5 Punkte 90 Minuten", "2024-sommer", "bad")], "t string, s string, d string")
    r = df.select(fn.fold(F.col("t")).alias("f"), fn.points(F.col("t")).alias("p"), fn.minutes(F.col("t")).alias("m"), fn.season_label(F.col("s")).alias("s"), fn.stamp(F.col("d")).alias("d"), fn.half_even(F.lit(2.5)).alias("h")).first()
    assert tuple(r) == ("masse 12,5 punkte 90 minuten", 12.5, 90, "Sommer 2024", None, 2.0)


def test_region_text(spark):
    regions = spark.createDataFrame([(1, 1, 0.0, 0.0, 250.0, 100.0), (2, 1, 300.0, 0.0, 400.0, 100.0)], "id int, page int, x0 double, y0 double, x1 double, y1 double")
    lines = spark.createDataFrame([(1, "b", 50.0, 10.0, 90.0, 14.0), (1, "a", 10.0, 11.0, 40.0, 15.0), (1, "c", 210.0, 40.0, 240.0, 44.0), (1, "out", 260.0, 10.0, 280.0, 14.0)], "page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in geometry.texts_in(lines, regions).collect()] == [(1, "a b c")]


def test_append_and_chain(spark):
    log = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "k string, v string")
    rows, bad = registry.append(log, new, "k", "v")
    assert [tuple(r) for r in rows.collect()] == [("c", "4")] and [r.k for r in bad.collect()] == ["b"]


def test_taxonomy_rules(spark):
    nodes = spark.createDataFrame([(1, None, "k", None), (2, 1, "k", None), (3, 2, "k", None), (4, 9, "k", None), (5, 1, "q", None), (6, None, "k", 77), (1, None, "k", None)], "id int, parent_id int, kind string, merged_into int")
    assert {tuple(r) for r in validators.taxonomy(nodes).collect()} == {(3, "depth"), (4, "parent"), (5, "kind"), (6, "merge"), (1, "unique")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = f"file://{tmp_path}/t"
    assert tables.write_changed(df, path) and not tables.write_changed(df.repartition(3), path) and tables.write_changed(df.where("k = 1"), path)
    assert spark.read.parquet(path).count() == 1
    assert tables.read_json(spark, f"file://{tmp_path}/none", "a int").count() == 0
    new, conflicts = tables.merge_import(df, spark.createDataFrame([(1, "a"), (2, "x"), (3, "y")], "k int, v string"), "k")
    assert [r.k for r in new.collect()] == [3] and [r.k for r in conflicts.collect()] == [2]
    assert tables.to_do(df, df.where("k = 1"), "k").count() == 1


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/a.txt", "hello")
        z.writestr("b.txt", "")
    rows = tables.archive_members(spark, f"file://{tmp_path}/a.zip").collect()
    assert {(r.member, r.size) for r in rows} == {("x/a.txt", 5), ("b.txt", 0)}
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../a.txt", "hello")
    with pytest.raises(Exception, match="unsafe"):
        tables.archive_members(spark, f"file://{tmp_path}/bad.zip").collect()
