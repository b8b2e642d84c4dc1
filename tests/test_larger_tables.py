"""Queries on tables like the given ones, but larger or with other keys; each against its SQL."""

from math import floor

import duckdb
import pytest

from mnemos.operators import geometry, registry
from mnemos.plans import raster as pictures
from mnemos.plans import states
from mnemos.plans.registry import QUERIES, SQL
from tests.test_queries import SF, TABLES, plain


def compared(spark, folder, name, **changed):
    """Query ``name`` and its SQL over the smallest tables, some of them ``changed`` by SQL over their rows."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"COPY (SELECT {changed.get(t, '*')} FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    found = con.execute(SQL[name])
    order = {x[0]: i for i, x in enumerate(found.description)}
    want = sorted([plain(r[order[c]]) for c in columns] for r in found.fetchall())
    return sorted([plain(r[c]) for c in columns] for r in df.collect()), want


def test_summary_of_users_with_many_answers(spark, tmp_path):
    got, want = compared(spark, tmp_path, "a16_progress_summary", events="* REPLACE (user_id % 3 AS user_id)")
    assert got == want and len(got) == 3


@pytest.mark.parametrize("name", ["a16_progress_summary", "a04_coverage"])
def test_questions_beyond_a_hundred_are_their_own(spark, tmp_path, name):
    # numbers far beyond those given: none is folded onto another or missed in the inventory
    far = "'{\"k\": ' || (CAST(props->>'$.k' AS INT) * 37 + event_id % 3) || '}' AS props, user_id % 3 AS user_id"
    got, want = compared(spark, tmp_path, name, events=f"* REPLACE ({far})")
    assert got == want and len(got) == 3


def test_results_of_tests_and_attempts_whose_numbers_meet(spark, tmp_path):
    # two events of one user, a million apart: a test's row must not replace an attempt's
    near = "event_id - event_id % 2 + event_id % 2 * 1000000 AS event_id, user_id % 3 AS user_id, CASE WHEN event_id % 2 = 0 THEN 'signup' ELSE 'click' END AS event_type"
    got, want = compared(spark, tmp_path, "u06_union_of_results", events=f"* REPLACE ({near})")
    assert got == want and got


@pytest.mark.parametrize("name", ["a35_marks_from_pixels", "g01_adaptive_marks", "g02_twofold_marks", "g03_ring_figures", "g11_seams", "g24_choices", "g13_page_regions", "g13_unread_headings", "g28_cell_owners"])
def test_nothing_of_pages_goes_through_the_driver(spark, capsys, name):
    # pixels and anchors are many, however small the file that they're made of
    QUERIES[name](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["g01_adaptive_marks", "g02_twofold_marks", "g03_ring_figures"])
def test_no_pixels_are_sent_to_the_driver_while_running(spark, name):
    # adaptive execution plans joins anew once it knows their sizes; the plan that ran counts
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        df = QUERIES[name](spark, SF)
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "isFinalPlan=true" in plan and "Join" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["g28_cell_owners", "g13_page_regions"])
def test_lines_and_half_pages_move_once(spark, name):
    # each move of all lines is written to disk
    df = QUERIES[name](spark, SF)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [x.split("hashpartitioning(")[1].split("#")[0] for x in plan.splitlines() if " Exchange hashpartitioning" in x and "ReusedExchange" not in x]
    assert sorted(moved) == ["l_orderkey", "o_orderkey"]


@pytest.mark.parametrize("name", ["g01_adaptive_marks", "g02_twofold_marks"])
def test_means_take_two_windows_along_rows_and_two_along_columns(spark, capsys, name):
    QUERIES[name](spark, SF).explain()
    assert sum("- Window [" in x for x in capsys.readouterr().out.splitlines()) == 4


@pytest.mark.parametrize("name", ["j10_solution_pages", "j15_overlaps", "j16_small_overlaps"])
def test_pairs_are_made_in_several_tasks(spark, name):
    # a small file is one task, and its pairs are many
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() > 1


@pytest.mark.parametrize("name", ["j10_solution_pages", "j17_strict_overlaps", "j18_region_texts"])
def test_lists_meet_without_the_driver(spark, capsys, name):
    QUERIES[name](spark, SF).explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_equal_rectangles_meet_in_lists(spark):
    # more copies than a list holds, an id under two owners, and squares' edges
    boxes = [(1, i, i % 3, *b) for i, b in enumerate([(0.0, 0.0, 120.0, 150.0)] * 150 + [(100.0, 100.0, 110.0, 110.0)] * 70)] + [(1, 7, 2, 5.0, 5.0, 9.0, 9.0), (2, 1, 0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "page int, id int, owner int, x0 double, y0 double, x1 double, y1 double")
    area = lambda a, b: max(0.0, min(a[5], b[5]) - max(a[3], b[3])) * max(0.0, min(a[6], b[6]) - max(a[4], b[4]))
    want = sorted((a[0], a[1], b[1], area(a, b)) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and area(a, b) > 1)
    assert sorted(map(tuple, geometry.overlaps(df).collect())) == want
    assert [tuple(r) for r in geometry.overlap_counts(df).collect()] == [(1, len(want))]
    lines = [(1, f"t{n}", 2.0 + n % 2, 2.0 + n % 5, 4.0, 4.0) for n in range(40)]
    inside = lambda b, l: b[0] == l[0] and b[3] <= (l[2] + l[4]) / 2 <= b[5] and b[4] <= (l[3] + l[5]) / 2 <= b[6]  # noqa: E731, E741
    texts = {}
    for b in boxes:
        texts.setdefault((b[0], b[1]), []).extend((floor((l[3] + l[5]) / 2 / 6 + 0.5), l[2], l[1]) for l in lines if inside(b, l))  # noqa: E741
    want = sorted((k[1], " ".join(t for *_, t in sorted(v))) for k, v in texts.items() if v)
    rows = spark.createDataFrame(lines, "page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, geometry.texts_in(rows, df).collect())) == want


def test_review_order_has_no_window_over_all_sessions(spark, tmp_path, capsys):
    got, want = compared(spark, tmp_path, "o11_review_order", orders="* REPLACE (o_orderkey * 37000 AS o_orderkey)")
    assert got == want and got
    QUERIES["o11_review_order"](spark, str(tmp_path)).explain()
    numbered = [x for x in capsys.readouterr().out.splitlines() if "Window [row_number()" in x]
    # rows are numbered in parts: a key stands before the order
    assert numbered and not any(" ASC" in x.split("windowspecdefinition(")[1].split(",")[0] for x in numbered)


def test_appended_rows_are_told_apart_in_one_grouping(spark, tmp_path, capsys):
    log = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, None, 7), (3, None, 7), (4, None, 0), (4, "c", 0), (None, "a", 0), (None, "b", 0), (None, "a", 0)], "k int, v string, n int")
    rows, bad = registry.append(log, new, "k", "v")
    assert rows.columns == new.columns and sorted(map(tuple, rows.collect()), key=str) == [(3, None, 7), (None, "a", 0), (None, "b", 0)]
    assert sorted(r.k for r in bad.collect()) == [2, 4]
    got, want = compared(spark, tmp_path, "t26_audit_events", orders="* REPLACE (o_custkey % 40 AS o_custkey)")
    assert got == want and got
    QUERIES["t26_audit_events"](spark, str(tmp_path)).explain()
    assert "Join" not in capsys.readouterr().out


@pytest.mark.parametrize("name", ["t16_updated_sessions", "t42_saved_drafts"])
def test_order_lines_are_dealt_out_by_their_number(spark, tmp_path, capsys, monkeypatch, name):
    monkeypatch.setattr(states, "LINES", 500)
    got, want = compared(spark, tmp_path, name)
    assert got == want and got
    QUERIES[name](spark, str(tmp_path)).explain()
    moved = [x for x in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning(l_orderkey" in x]
    # as many tasks as there are 500 lines, and no second move by order before they are numbered
    parts = -(-spark.read.parquet(f"{tmp_path}/lineitem.parquet").count() // 500)
    assert moved and all(f", {parts}), REPARTITION_BY_NUM" in x for x in moved)


def test_parts_are_dealt_out_by_their_number(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(pictures, "PARTS", 30)
    got, want = compared(spark, tmp_path, "g08_composed")
    assert got == want and got
    QUERIES["g08_composed"](spark, str(tmp_path)).explain()
    plan = capsys.readouterr().out
    parts = -(-spark.read.parquet(f"{tmp_path}/part.parquet").count() // 30)
    assert f", {parts}), REPARTITION_BY_NUM" in plan and "Broadcast" not in plan
