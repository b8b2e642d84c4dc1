"""The nine actions of an exam session, their guards and times."""

import json

from mnemos.operators import sessions

MODELS = [(1, "multiple_choice", []), (2, "multi_part", ["a", "b"])]
STEPS = "s string, seq int, at long, action string, question_id long, value string"


def run(spark, *acts):
    """acts: name -> list of (at, action, question, value); the last state of each."""
    rows = [(name, i, at, action, q, None if v is None else json.dumps(v)) for name, own in acts for i, (at, action, q, v) in enumerate(own)]
    models = [(name, *m) for name, _ in acts for m in MODELS]
    out = sessions.fold(spark.createDataFrame(rows, STEPS), spark.createDataFrame(models, "s string, question_id long, kind string, parts array<string>"), "s")
    return {r.s: r for r in out.collect()}


def test_every_action(spark):
    go = lambda *acts: [(a[0], a[1], a[2] if len(a) > 2 else None, a[3] if len(a) > 3 else None) for a in acts]
    got = run(
        spark,
        ("open discarded", go((1000, "answer", 1, {"choice": "3"}), (6000, "discard"), (999_999, "restore"))),
        ("pauses", go((1000, "move", 1), (6000, "pause"), (20_000, "resume"), (22_000, "submit"), (30_000, "resume"))),
        ("completed back", go((1000, "move", 2), (3000, "submit"), (4000, "discard"), (4500, "discard"), (9000, "restore"))),
        ("abandoned back", go((1000, "pause"), (3000, "abandon"), (3100, "move", 1), (4000, "discard"), (5000, "restore"), (6000, "restore"))),
        ("assess", go((0, "assess", 2, {"a": "richtig"}), (1, "answer", 2, {"a": " x"}), (2, "submit"), (3, "assess", 2, {"a": "richtig", "b": "falsch"}), (4, "assess", 2, {"c": "richtig"}), (5, "assess", 2, {"a": "gut"}), (6, "assess", 1, {"choice": "richtig"}), (7, "answer", 1, {"choice": "1"}))),
        ("answers", go((0, "answer", 1, {"choice": "6"}), (1, "answer", 1, {"a": "1"}), (2, "answer", 9, {"choice": "1"}), (3, "answer", 1, {"choice": "5"}), (4, "answer", 1, {"choice": ""}), (5, "answer", 2, {"b": "  "}), (6, "move", 9), (7, "move", 2), (8, "unknown"), (9, "answer", 2, {"a": 1}))),
    )
    pick = lambda name, *c: tuple(got[name][x] for x in c)
    # an open session may be discarded, its time counts, and it comes back paused
    assert pick("open discarded", "status", "revision", "elapsed", "answered", "refused") == ("paused", 3, 5000, 1, 0)
    assert pick("pauses", "status", "revision", "elapsed", "current_question", "refused") == ("completed", 4, 7000, 1, 1)
    assert pick("completed back", "status", "revision", "elapsed", "refused") == ("completed", 4, 2000, 1)
    assert pick("abandoned back", "status", "revision", "elapsed", "refused") == ("abandoned", 4, 0, 2)
    assert pick("assess", "status", "revision", "assessed", "refused") == ("completed", 3, 1, 5)
    assert pick("answers", "status", "revision", "answered", "current_question", "refused") == ("active", 4, 0, 2, 6)


def test_a_long_log(spark):
    acts = [(i, ("pause", "resume")[i % 2], None, None) for i in range(30_000)]
    r = run(spark, ("long", acts))["long"]
    assert (r.status, r.revision, r.elapsed, r.refused) == ("active", 30_000, 14_999, 0)
