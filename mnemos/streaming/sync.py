"""Standing synchronisation: compare-and-swap with receipts, and the runs of a device, kept in the stream's state store.

The rules are plain classes over one key's state. They run in two ways: as ``transformWithState`` on a stream, with the
state in the state store, receipts that expire and timers on event time; and as a fold over all rows of a batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from hashlib import blake2b
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemos.functions.folding import sorted_fold

#: Entities whose earlier value binds the next one, and the fields that may change all the same.
HISTORICAL = ("attempts", "testSessions", "moduleRuns", "moduleProgress")
ATTEMPT_FREE = ("note", "error_reason", "unsure", "confidence", "updated_at", "revision", "sync_state", "device_id")
SESSION_FROZEN = (
    "test_id", "userId", "exam_session_id", "test_type", "exam", "module", "mode", "seed", "sourceExams", "question_ids", "question_models", "source_mix", "official_answers", "started_at",
)
SESSION_FREE = (
    "status", "previous_status", "discarded_from", "discarded_at", "deleted_at", "revision", "updated_at", "sync_state", "device_id", "current_question", "note", "notes", "reflection", "subpart_assessments", "assessment_updated_at", "result",
)


def _whole(text: str) -> float | int:
    x = float(text)
    return int(x) if x.is_integer() else x


def parsed(value: str | None) -> dict | None:
    return None if value is None else json.loads(value, parse_float=_whole)


def canonical(value) -> str:
    """JSON with the keys of every level in order."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def compatible(entity: str, old: dict, new: dict) -> bool:
    """Whether a value may follow an earlier one of its record."""
    same = lambda free: canonical({k: v for k, v in old.items() if k not in free}) == canonical({k: v for k, v in new.items() if k not in free})
    if entity == "moduleProgress":
        return (new.get("generation") or 0) >= (old.get("generation") or 0)
    if entity == "moduleRuns":
        return same(())
    if entity == "attempts":
        return same(ATTEMPT_FREE)
    if entity == "testSessions":
        if any(canonical(old.get(k)) != canonical(new.get(k)) for k in SESSION_FROZEN):
            return False
        if old.get("completed_at") or "completed" in (old.get("status"), old.get("discarded_from"), old.get("previous_status")):
            return same(SESSION_FREE)
    return True


@dataclass
class Record:
    """A record's envelope and, of historical entities, its last value that was not a deletion."""

    revision: int = 0
    value: str | None = None
    deleted: bool = False
    history: str | None = None

    def swap(self, m) -> str | None:
        """Applies the mutation, or tells why it conflicts."""
        if m["base_revision"] != self.revision:
            return "revision_mismatch"
        kept = m["entity"] in HISTORICAL
        if kept and not m["deleted"] and self.history is not None and m["value"] is not None and not compatible(m["entity"], parsed(self.history), parsed(m["value"])):
            return "immutable_history"
        self.revision, self.value, self.deleted = self.revision + 1, None if m["deleted"] else m["value"], m["deleted"]
        self.history = (self.history if m["deleted"] else m["value"]) if kept else None
        return None


def content(m) -> str:
    """What a mutation says, for telling a repetition from another use of its id."""
    return canonical([m["entity"], m["id"], m["base_revision"], m["deleted"], parsed(m["value"])])


OUTCOMES = {"user_id": "string", "entity": "string", "id": "string", "seq": "long", "mutation_id": "string", "status": "string", "reason": "string", "revision": "long", "value": "string", "deleted": "boolean"}
_DDL = lambda schema: ", ".join(f"{c} {k}" for c, k in schema.items())


class CompareAndSwap(StatefulProcessor):
    """T09 for a bucket of records.

    Input: user_id, entity, id, seq, mutation_id, base_revision, deleted, value, and ``said`` and ``reused`` (what it says, and
    whether its id was first used for something else, see Uses). A repetition gets the answer of the first use, ``duplicate`` if
    that was applied. A reused id changes nothing. Receipts go after ``keep`` milliseconds (0: never).
    """

    def __init__(self, keep: int = 0):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getListState("records", "user_id string, entity string, id string, revision long, value string, deleted boolean, history string")
        self.receipts = handle.getListState("receipts", "user_id string, entity string, id string, mutation_id string, said string, status string, reason string, revision long", self.keep or None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        records = {tuple(r[:3]): Record(*r[3:]) for r in self.records.get()}
        receipts = {tuple(r[:4]): tuple(r[4:]) for r in self.receipts.get()}
        known, swaps = len(receipts), 0
        for m in sorted(rows, key=lambda r: (r.seq, r.mutation_id)):
            at = m.user_id, m.entity, m.id
            record, receipt = records.setdefault(at, Record()), receipts.get((*at, m.mutation_id))
            if m.reused or receipt and receipt[0] != m.said:
                status, reason, revision = "reused", None, record.revision
            elif receipt:
                status, reason, revision = "duplicate" if receipt[1] == "applied" else receipt[1], receipt[2], receipt[3]
            else:
                reason = record.swap(m)
                status, revision, swaps = ("conflict" if reason else "applied"), record.revision, swaps + (not reason)
                receipts[(*at, m.mutation_id)] = m.said, status, reason, revision
            yield Row(user_id=m.user_id, entity=m.entity, id=m.id, seq=m.seq, mutation_id=m.mutation_id, status=status, reason=reason, revision=revision, value=record.value, deleted=record.deleted)
        if len(receipts) > known:  # the new ones are the last ones
            self.receipts.appendList([(*k, *v) for k, v in islice(receipts.items(), known, None)])
        if swaps:
            self.records.put([(*k, r.revision, r.value, r.deleted, r.history) for k, r in records.items() if r.revision])


class Uses(StatefulProcessor):
    """``said``, a digest of each mutation's content, and ``reused``, whether that is another than the first use of the id, whatever record that was for; for a bucket of users' mutation ids."""

    def __init__(self, keep: int = 0):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getListState("first", "user_id string, mutation_id string, said string", self.keep or None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = {(user, mutation): said for user, mutation, said in self.first.get()}
        known = len(first)
        for m in sorted(rows, key=lambda r: r.seq):
            said = blake2b(content(m).encode("utf-8", "surrogatepass"), digest_size=20).hexdigest()
            yield Row(**{c: m[c] for c in MUTATIONS}, said=said, reused=first.setdefault((m.user_id, m.mutation_id), said) != said)
        if len(first) > known:
            self.first.appendList([(*k, said) for k, said in islice(first.items(), known, None)])


MUTATIONS = {"user_id": "string", "entity": "string", "id": "string", "seq": "long", "mutation_id": "string", "base_revision": "long", "deleted": "boolean", "value": "string"}
#: State stores that hold more than memory does.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def swapped(mutations: DataFrame, keep: int = 0, buckets: int = 4096) -> DataFrame:
    """The outcome of every mutation; a stream, or a batch of everything. Starts with started().

    Two stateful steps: by user and mutation id, so that an id used for two records is seen, then by record. Both go by
    ``buckets`` of their keys' hashes: a bucket's state is read in one call and its new entries are written in another, where
    a key of its own would take several calls and an Arrow batch for itself. A bucket's entries and its mutations of a batch
    are in memory, so there should be a bucket for every few thousand mutations. Queries on one checkpoint take one number.
    """
    rows, time = mutations.select(*[F.col(c).cast(k) for c, k in MUTATIONS.items()]), "processingTime" if keep else "none"
    bucket = lambda *keys: F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")
    rows = rows.select("*", bucket("user_id", "mutation_id")).groupBy("bucket").transformWithState(Uses(keep), _DDL(MUTATIONS | {"said": "string", "reused": "boolean"}), "append", time)
    return rows.select("*", bucket("user_id", "entity", "id")).groupBy("bucket").transformWithState(CompareAndSwap(keep), _DDL(OUTCOMES), "append", time)


def swapped_by_fold(mutations: DataFrame) -> DataFrame:
    """swapped() of a batch, as two sorted folds without a state store."""
    rows = mutations.select(*[F.col(c).cast(k) for c, k in MUTATIONS.items()])

    def use(first: list, row: dict) -> Iterable[dict]:
        first[:] = first or [content(row)]
        yield row | {"first": first[0]}

    def swap(state: tuple[Record, dict], m: dict) -> Iterable[dict]:
        record, receipts = state
        said = content(m)
        if m["first"] != said:
            status, reason, revision = "reused", None, record.revision
        elif m["mutation_id"] in receipts:
            status, reason, revision = receipts[m["mutation_id"]]
            status = "duplicate" if status == "applied" else status
        else:
            reason = record.swap(m)
            status, revision = ("conflict" if reason else "applied"), record.revision
            receipts[m["mutation_id"]] = status, reason, revision
        yield {c: m[c] for c in ("user_id", "entity", "id", "seq", "mutation_id")} | {"status": status, "reason": reason, "revision": revision, "value": record.value, "deleted": record.deleted}

    used = sorted_fold(rows, ["user_id", "mutation_id"], ["seq"], lambda _: [], use, lambda _: (), MUTATIONS | {"first": "string"})
    return sorted_fold(used, ["user_id", "entity", "id"], ["seq", "mutation_id"], lambda _: (Record(), {}), swap, lambda _: (), OUTCOMES)


#: Milliseconds between two runs that nobody asked for (fixed value).
EVERY = 30_000
RUNS = {"device": "string", "run": "long", "event": "string", "user": "string", "generation": "long", "at": "long", "cause": "string", "joined": "long", "outcome": "string"}
SIGNALS = {"device": "string", "seq": "long", "at": "long", "kind": "string", "user": "string"}


@dataclass
class Device:
    """Who is signed in on a device, what runs and who waits. ``waiting``: users and how many of their calls wait, in order."""

    device: str
    tick: int
    every: int = EVERY
    generation: int = 0
    account: str | None = None
    run: int = 0
    user: str | None = None
    run_generation: int = 0
    joined: int = 0
    waiting: list = field(default_factory=list)

    def _row(self, event: str, at: int, cause: str | None = None, outcome: str | None = None) -> dict:
        return {"device": self.device, "run": self.run, "event": event, "user": self.user, "generation": self.run_generation, "at": at, "cause": cause, "joined": self.joined, "outcome": outcome}

    def sync(self, user: str, at: int, cause: str, calls: int = 1) -> Iterable[dict]:
        """One run for a user and a generation: further calls join it, and calls of others wait for its end."""
        if self.user is None:
            self.run, self.user, self.run_generation, self.joined = self.run + 1, user, self.generation, 0
            yield self._row("start", at, cause)
            self.joined = calls - 1
        elif (self.user, self.run_generation) == (user, self.generation):
            self.joined += calls
        else:
            self.waiting.append((user, calls))

    def advance(self, to: int) -> Iterable[dict]:
        """The timer up to an instant: each tick is a call for whoever is signed in."""
        if to < self.tick:
            return
        first, calls = self.tick, (to - self.tick) // self.every + 1
        self.tick += calls * self.every
        if self.account is not None:
            yield from self.sync(self.account, first, "timer", calls)

    def signal(self, at: int, kind: str, user: str | None) -> Iterable[dict]:
        yield from self.advance(at)
        if kind == "login":
            self.generation, self.account = self.generation + 1, user
            yield from self.sync(user, at, "login")
        elif kind == "logout":
            self.generation, self.account = self.generation + 1, None
        elif kind == "online" and self.account is not None:
            yield from self.sync(self.account, at, "online")
        elif kind == "request":
            yield from self.sync(user, at, "request")
        elif kind == "done" and self.user is not None:
            yield self._row("end", at, outcome="account_changed" if self.run_generation != self.generation else "completed" if self.account == self.user else "refused")
            self.user = None
            if self.waiting:
                head, calls = self.waiting[0][0], sum(n for u, n in self.waiting if u == self.waiting[0][0])
                self.waiting = [w for w in self.waiting if w[0] != head]
                yield from self.sync(head, at, "waited", calls)


class Runs(StatefulProcessor):
    """The runs of each device. A timer on event time wakes a device for its next tick when no signal comes."""

    def __init__(self, every: int = EVERY):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("device", "state string")

    def _load(self, key, at: int) -> Device:
        known = self.state.get()
        return Device(key[0], at, self.every) if known is None else Device(**json.loads(known[0]))

    def _save(self, device: Device, before: int | None) -> None:
        self.state.update((json.dumps(asdict(device)),))
        if before != device.tick:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(device.tick)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: (r.at, r.seq))
        before = None if self.state.get() is None else self._load(key, 0).tick
        device = self._load(key, rows[0].at + self.every)
        for row in rows:
            for out in device.signal(row.at, row.kind, row.user):
                yield Row(**out)
        self._save(device, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        device = self._load(key, 0)
        for out in device.advance(timerValues.getCurrentWatermarkInMs() - 1):
            yield Row(**out)
        self.state.update((json.dumps(asdict(device)),))
        self.handle.registerTimer(device.tick)


def runs(signals: DataFrame, every: int = EVERY, delay: int = 1000) -> DataFrame:
    """Starts and ends of the runs of a stream of signals (device, seq, at, kind, user); ``at`` in milliseconds.

    Ticks are counted from a device's first signal. Signals may come ``delay`` milliseconds late.
    """
    rows = signals.select(*[F.col(c).cast(k) for c, k in SIGNALS.items()], F.timestamp_millis("at").alias("time"))
    rows = rows.withWatermark("time", f"{delay} milliseconds")
    return rows.groupBy("device").transformWithState(Runs(every), _DDL(RUNS), "append", "eventTime")


def runs_by_fold(signals: DataFrame, every: int = EVERY, delay: int = 1000) -> DataFrame:
    """runs() of a batch of all signals: timers go on until ``delay`` before the last of all signals, as the watermark does."""
    rows = signals.select(*[F.col(c).cast(k) for c, k in SIGNALS.items()])
    last = rows.agg(F.max("at")).first()[0]

    def end(device: Device) -> Iterable[dict]:
        return device.advance(last - delay - 1)

    return sorted_fold(rows, ["device"], ["at", "seq"], lambda r: Device(r["device"], r["at"] + every, every), lambda d, r: d.signal(r["at"], r["kind"], r["user"]), end, RUNS)


def started(result: DataFrame, target: str, checkpoint: str, timers: bool = True, **trigger):
    """A query that appends a stateful stream's rows to ``target``; by default over what its source has by now.

    A later one with the same checkpoint goes on from there. ``timers``: whether batches without rows run, so that timers on
    event time fire; with receipts that expire by the clock such batches would never end, so they go without.
    """
    spark = result.sparkSession
    own = dict([PROVIDER, ("spark.sql.streaming.noDataMicroBatches.enabled", str(timers).lower())])
    was = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:  # a query takes the settings with it when it starts
        writer = result.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
