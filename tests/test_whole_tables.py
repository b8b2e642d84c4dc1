"""Queries over whole tables against loops in Python: no row of the input is left out."""

from mnemos.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_sessions_take_every_event(spark):
    """Every event is an accepted or a refused action of its session, none is left out."""
    n = {r.user_id: r.n for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").count().toDF("user_id", "n").collect()}
    got = QUERIES["t14_session_machine_whole"](spark, SF).collect()
    assert {r.session_id: r.revision + r.refused for r in got} == n
    assert len({r.status for r in got}) >= 3 and sum(r.refused for r in got) and sum(r.revision for r in got)


def test_coverage_takes_every_line(spark):
    n = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        at = r.l_orderkey % 200, r.l_linenumber + r.l_partkey % 2
        n[at] = n.get(at, 0) + 1
    wanted = {(r.o_orderkey % 210, i) for r in spark.read.parquet(f"{SF}/orders.parquet").collect() for i in range(1, 8)}
    want = {at: "missing" if at not in n else "unexpected" if at not in wanted else "duplicate" for at in n.keys() | wanted if at not in n or at not in wanted or n[at] > 1}
    assert {(r.scope, r.number): r.problem for r in QUERIES["a21_number_coverage_whole"](spark, SF).collect()} == want


def test_next_question_takes_every_question(spark):
    latest = {}
    for r in QUERIES["a02_latest_results"](spark, SF).collect():
        latest.setdefault(r.user_id, {})[r.question_id] = r.correctness
    ids = [r.question_id for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(get_json_object(props, '$.k') as int) as question_id").distinct().collect()]
    assert max(ids) >= 12
    got = {r.user_id: (r.next_question, r.answered, r.correct) for r in QUERIES["w09_next_question_whole"](spark, SF).collect()}
    assert got == {u: (min(ids, key=lambda i: (0 if i not in own else 1 if own[i] != "richtig" else 2, i)), len(own), sum(x == "richtig" for x in own.values())) for u, own in latest.items()}
