"""The stateful streams against loops, over splits of the input and restarts from the checkpoint."""

import json
import random

from mnemos.streaming import sync


def split_runs(spark, tmp_path, rows, schema, make, timers):
    """Each third of the rows is written and streamed by a query of its own on the same checkpoint."""
    for part in range(3):
        own = rows[part * len(rows) // 3 : (part + 1) * len(rows) // 3]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        sync.started(make(source), f"{tmp_path}/out", f"{tmp_path}/check", timers=timers).awaitTermination()
    sync.started(make(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/check", timers=timers).awaitTermination()  # nothing new


def ddl(schema):
    return ", ".join(f"{c} {k}" for c, k in schema.items())


def brute_runs(signals, every, last):
    """A clock that goes on by the millisecond events only: (device, run, event, user, generation, at, cause, joined, outcome)."""
    out, devices = [], {}
    for device, seq, at, kind, user in sorted(signals, key=lambda s: s[2:3] + s[1:2]):
        devices.setdefault(device, []).append((at, 1, seq, kind, user))
    for device, own in devices.items():
        end = max(last, own[-1][0])
        ticks = [(t, 0, 0, "timer", None) for t in range(own[0][0] + every, end + 1, every) if t <= last or t <= own[-1][0]]
        generation, account, running, waiting, n = 0, None, None, [], 0

        def call(user, at, cause):
            nonlocal running, n
            if running is None:
                n += 1
                running = [user, generation, 0, n]
                out.append((device, n, "start", user, generation, at, cause, 0, None))
            elif running[:2] == [user, generation]:
                running[2] += 1
            else:
                waiting.append(user)

        for at, _, _, kind, user in sorted(ticks + own):
            if kind in ("login", "logout"):
                generation, account = generation + 1, user if kind == "login" else None
            if kind in ("login", "timer", "online") and account is not None:
                call(account, at, kind)
            if kind == "request":
                call(user, at, kind)
            if kind == "done" and running:
                out.append((device, running[3], "end", *running[:2], at, None, running[2], "account_changed" if running[1] != generation else "completed" if running[0] == account else "refused"))
                running, again = None, waiting[:]
                waiting.clear()
                for u in again:
                    call(u, at, "waited")
    return sorted(out, key=repr)


def test_runs(spark, tmp_path):
    rng, signals = random.Random(1), []
    for seq in range(240):
        kind = rng.choice(["login", "logout", "online", "request", "request", "done", "done"])
        signals.append((f"d{seq % 4}", seq, 1_000_000 + seq * 7_000 + rng.randrange(6_000), kind, rng.choice("ab")))
    schema = ddl(sync.SIGNALS)
    split_runs(spark, tmp_path, signals, schema, sync.runs, True)
    want = brute_runs(signals, sync.EVERY, max(s[2] for s in signals) - 1001)
    assert sorted(map(tuple, sync.runs_by_fold(spark.createDataFrame(signals, schema)).collect()), key=repr) == want
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*sync.RUNS).collect()), key=repr) == want
    assert {r[6] for r in want if r[2] == "start"} >= {"timer", "login", "request", "waited"} and {r[8] for r in want} == {None, "account_changed", "completed", "refused"}
    assert any(r[7] > 1 for r in want)


def brute_swaps(rows):
    first, records, told, out = {}, {}, {}, []
    for user, entity, id_, seq, mutation, base, deleted, value in sorted(rows, key=lambda r: r[3]):
        said = (entity, id_, base, deleted, json.loads(value) if value else None)
        revision, now, gone, history = records.get((user, entity, id_), (0, None, False, None))
        if first.setdefault((user, mutation), said) != said:
            answer = "reused", None, revision
        elif (user, mutation) in told:
            status, *rest = told[user, mutation]
            answer = "duplicate" if status == "applied" else status, *rest
        else:
            new = json.loads(value) if value else None
            frozen = lambda v: {k: x for k, x in v.items() if k != "note"}
            if base != revision:
                answer = "conflict", "revision_mismatch", revision
            elif entity == "attempts" and new and history and frozen(new) != frozen(history):
                answer = "conflict", "immutable_history", revision
            else:
                revision, now, gone, history = revision + 1, value, deleted, new or history
                records[user, entity, id_] = revision, now, gone, history
                answer = "applied", None, revision
            told[user, mutation] = answer
        out.append((user, entity, id_, seq, mutation, *answer, now, gone))
    return sorted(out, key=repr)


def test_swaps(spark, tmp_path):
    """Repetitions, ids used for another record or other data, stale bases, frozen fields, deletions, keys in another order."""
    rng, rows, at = random.Random(2), [], {}
    for seq in range(300):
        if rows and rng.random() < 0.2:
            again = list(rng.choice(rows))
            again[3] = seq
            if rng.random() < 0.3 and again[7]:
                again[7] = json.dumps(dict(reversed(json.loads(again[7]).items())))  # the same value
            elif rng.random() < 0.4:
                again[2], again[5] = rng.choice([("9", again[5]), (again[2], again[5] + 1)])
            rows.append(tuple(again))
            continue
        user, entity, id_ = rng.choice("uv"), rng.choice(["attempts", "notes"]), rng.choice("123")
        deleted = rng.random() < 0.15
        base = at.get((user, entity, id_), 0) if rng.random() < 0.7 else rng.randrange(4)
        at[user, entity, id_] = base + 1
        rows.append((user, entity, id_, seq, f"m{seq}", base, deleted, None if deleted else json.dumps({"grade": rng.choice("aab"), "note": seq, "deep": {"y": 1, "x": [1, 2]}})))
    schema = ddl(sync.MUTATIONS)
    want = brute_swaps(rows)
    split_runs(spark, tmp_path, rows, schema, lambda s: sync.swapped(s, keep=3_600_000), False)
    assert sorted(map(tuple, sync.swapped_by_fold(spark.createDataFrame(rows, schema)).collect()), key=repr) == want
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*sync.OUTCOMES).collect()), key=repr) == want
    assert {r[5] for r in want} == {"applied", "conflict", "duplicate", "reused"} and "immutable_history" in {r[6] for r in want}


def test_swaps_in_buckets(spark, tmp_path):
    """Users, ids and records that share a bucket, over two queries; the state has a key for a bucket, not for each id and record."""
    rng, rows = random.Random(4), []
    for seq in range(200):
        user, id_, grade = rng.choice("uvw"), rng.choice("123"), rng.choice("ab")
        rows.append((user, rng.choice(["attempts", "notes"]), id_, seq, f"m{rng.randrange(60)}", rng.randrange(3), seq % 9 == 0, None if seq % 9 == 0 else json.dumps({"grade": grade})))
        rows += [(*rows[-1][:3], 1000 + seq, *rows[-1][4:])] * (seq % 4 == 0)  # sent again
    rows.sort(key=lambda r: r[3])
    schema = ddl(sync.MUTATIONS)
    for part in (rows[:120], rows[120:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = sync.started(sync.swapped(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), buckets=2), f"{tmp_path}/out", f"{tmp_path}/check")
        run.awaitTermination()
    want = brute_swaps(rows)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*sync.OUTCOMES).collect()), key=repr) == want
    assert {r[5] for r in want} == {"applied", "conflict", "duplicate", "reused"}
    held = [x["numRowsTotal"] for p in run.recentProgress for x in p["stateOperators"]]
    assert len(held) >= 2 and max(held) <= 2 * 2


def test_frozen_fields():
    """A completed exam keeps its answers; what may change may; a run never does; a generation only grows."""
    exam = {"test_id": 1, "seed": "s", "status": "completed", "completed_at": "t", "answers": {"a": 1}, "note": "x"}
    assert sync.compatible("testSessions", exam, exam | {"note": "y", "status": "discarded"})
    assert not sync.compatible("testSessions", exam, exam | {"answers": {"a": 2}})
    assert not sync.compatible("testSessions", exam | {"status": "active", "completed_at": None}, exam | {"seed": "t"})
    assert sync.compatible("testSessions", {"test_id": 1, "status": "active", "answers": {}}, {"test_id": 1, "status": "active", "answers": {"a": 1}})
    assert sync.compatible("moduleRuns", {"a": 1, "b": [1]}, {"b": [1], "a": 1}) and not sync.compatible("moduleRuns", {"a": 1}, {"a": "1"})
    assert sync.compatible("moduleProgress", {"generation": 2}, {"generation": 2}) and not sync.compatible("moduleProgress", {"generation": 2}, {"generation": 1})
    assert sync.compatible("settings", {"a": 1}, {"a": 2})
