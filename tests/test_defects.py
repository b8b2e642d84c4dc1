"""Repeats, retries, several modules and crashes, on hand-made rows."""

import datetime as dt
import zipfile

import pytest

from mnemos.operators import geometry, progress, registry, replay, results
from mnemos.sources import tables
from mnemos.streaming import replication

T = dt.datetime(2024, 1, 1)


def test_overlaps_on_two_pages_and_without_owner(spark):
    rows = [(i, page, owner, 0.0 + x, 0.0, 150.0 + x, 250.0) for page in (1, 2) for i, owner, x in ((1, "a", 0), (2, "b", 90), (3, None, 10))]
    df = spark.createDataFrame(rows, "id int, page int, owner string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, geometry.overlaps(df).collect())) == [(1, 1, 2, 15000.0), (2, 1, 2, 15000.0)]


def test_a_retry_in_the_next_batch_is_no_conflict(spark):
    schema = "mutation_id string, entity string, id string, seq long, base_revision long, deleted boolean, value string"
    one = spark.createDataFrame([("m1", "note", "1", 1, 0, False, "a")], schema)
    two = spark.createDataFrame([("m1", "note", "1", 2, 0, False, "a"), ("m2", "note", "1", 3, 1, False, "b"), ("m2", "note", "1", 4, 1, False, "b")], schema)
    state = replication.fold(one)
    r = replication.fold(two, state, one).first()
    assert (r.revision, r.value, r.conflicts, r.repeats) == (2, "b", 0, 2)


def test_append_with_null_payloads_and_repeats(spark):
    log = spark.createDataFrame([("a", None), ("b", "1")], "k string, v string")
    new = spark.createDataFrame([("a", None), ("b", None), ("c", "1"), ("c", "1"), ("d", "1"), ("d", "2")], "k string, v string")
    rows, bad = registry.append(log, new, "k", "v")
    assert [tuple(r) for r in rows.collect()] == [("c", "1")] and sorted(r.k for r in bad.collect()) == ["b", "d"]


def test_generations_count_for_each_module(spark):
    rows = [(1, 5, 1, 0, T, 1, "richtig", "e", "m"), (1, 6, 3, 0, T, 2, "falsch", "e", "n"), (1, 6, 2, 9, T, 3, "richtig", "e", "n")]
    df = spark.createDataFrame(rows, "user_id int, question_id int, generation int, progress_order int, ts timestamp, attempt_id int, correctness string, exam string, module string")
    assert sorted((r.module, r.attempt_id) for r in progress.latest_in_run(df).collect()) == [("m", 1), ("n", 2)]


def test_a_cutover_by_ids(spark):
    rows = [(1, 1, i, T + dt.timedelta(days=i), "falsch" if i == 0 else "richtig") for i in range(5)]
    df = spark.createDataFrame(rows, "user_id int, question_id int, attempt_id int, ts timestamp, correctness string")
    ids = spark.createDataFrame([(1, i) for i in range(5)], "user_id int, attempt_id int")
    assert replay.replay(df).first().stage == 4
    states = replay.replay(replay.legacies(df, ids))
    assert states.first().stage == 3
    old = states.selectExpr("user_id", "99 as question_id", "2 as stage", "entered_at", "last_wrong_at", "wrong_count", "streak")
    assert sorted((r.question_id, r.stage) for r in replay.kept_states(states, old).collect()) == [(1, 3), (99, 2)]


def test_only_assessed_attempts_are_formal(spark):
    schema = "attempt_id int, user_id int, question_id int, ts timestamp, correctness string, test_linked boolean, auto_scored boolean, self_assessed boolean, subparts array<struct<correctness: string>>"
    rows = [(1, True, False, []), (2, False, False, []), (3, False, True, [("richtig",)]), (4, False, True, [("richtig",), (None,)]), (5, False, True, []), (6, None, None, None)]
    df = spark.createDataFrame([(i, 1, 1, T, "richtig", False, a, s, p) for i, a, s, p in rows], schema)
    assert sorted(r.attempt_id for r in results.formal(df).collect()) == [1, 3]


def test_a_table_set_aside_by_a_crash_comes_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    path = f"file://{tmp_path}/t"
    assert tables.write_changed(df, path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert not tables.write_changed(df, path) and spark.read.parquet(path).count() == 1 and not (tmp_path / "t.old").exists()


def test_pages_tell_whether_more_follow(spark):
    log = spark.range(10).withColumnRenamed("id", "cursor")
    assert [(r.cursor, r.more) for r in tables.page(log, 3, 2).orderBy("cursor").collect()] == [(4, True), (5, True)]
    assert [(r.cursor, r.more) for r in tables.page(log, 7, 2).orderBy("cursor").collect()] == [(8, False), (9, False)]
    assert tables.page(log, 9, 2).count() == 0


@pytest.mark.parametrize("kind", ["link", "back", "drive"])
def test_unsafe_members(spark, tmp_path, kind):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        info = zipfile.ZipInfo({"link": "a", "back": "a\\b", "drive": "c:/a"}[kind])
        if kind == "link":
            info.external_attr = 0o120777 << 16
        z.writestr(info, "target")
    with pytest.raises(Exception, match="unsafe"):
        tables.archive_members(spark, f"file://{tmp_path}/x.zip").collect()
