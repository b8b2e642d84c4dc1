"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Of every string of LENGTH bytes one inner place stands for it: the anchor, the place of the least hash among the
strings of ANCHOR bytes inside it. Equal strings have equal anchors, so only suffixes that begin at anchors need
sorting (a sparse suffix array), and of these only those whose anchor occurs more than once.

1. Documents are packed into blocks. Each block sends the hashes of its anchors to buckets, which answer with those
   that occur again, in the block or in another.
2. Each block sorts the suffixes at these anchors (LENGTH bytes at most, and the bytes before the anchor that strings
   around it may reach) into runs, one for each bucket, front-coded: a suffix is the length of the prefix that it
   shares with the one before, and the rest. Suffixes alike in all are sent once, as the earliest.
3. A bucket merges its runs by a loser tree that knows how much each contender shares with the last winner: a longer
   known prefix wins without a look at the text, and equal ones are compared behind it only. In the merged order
   suffixes with the same anchor stand together; comparing what they share after and before the anchor tells which
   strings around the anchor start earlier elsewhere.
4. The blocks get the covered ranges back and give each document's spans and remaining bytes.

An anchor that occurs more than HOT times is dealt out by longer stretches of its surroundings, for a few ranges of
offsets, so that only suffixes which share nearly a whole string meet in one group.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import materialize, table
from mnemos.llm.textblocks import BLOCK, kept_blocks, starts, unpack

LENGTH = 100
ANCHOR = 32
#: Distinct anchors of a bucket, about.
BUCKET = 300_000
#: An anchor with more occurrences is dealt out by its surroundings.
HOT = 20_000
#: Ranges of offsets that hot anchors are dealt out for.
RANGES = 4
#: Suffixes of one anchor that are compared pair by pair; more are compared by way of a table of their strings.
FEW = 24


def _hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes from each place on (ANCHOR is a power of two)."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step, factor = 1, 0xBF58476D1CE4E5B9
    while step < ANCHOR:
        if len(h) <= step:
            return h[:0]
        h = h[:-step] * np.uint64(factor) + h[step:]
        h ^= h >> np.uint64(31)
        factor = (factor * 0xD6E8FEB86659FD93 + 2) & ((1 << 64) - 1) | 1
        step *= 2
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block whose texts begin at ``at``: the places of the anchors, their hashes, and the least and largest offset of the anchor in the strings it stands for."""
    none = np.zeros(0, np.int64)
    h = _hashes(np.frombuffer(data, dtype=np.uint8))
    width = LENGTH - ANCHOR + 1
    if len(h) < width:
        return none, none.astype(np.uint64), none, none
    low = np.uint64(0xFFFFFFFF)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    place = (least & low).astype(np.int64)
    valid = np.ones(len(place), bool)  # strings that begin here stay in their text
    for end in at[1:]:
        valid[max(0, end - LENGTH + 1) : end] = False
    starts_ok = np.flatnonzero(valid)
    if not len(starts_ok):
        return none, none.astype(np.uint64), none, none
    own = place[starts_ok]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (starts_ok[1:] != starts_ok[:-1] + 1)))
    last = np.append(first[1:], len(own)) - 1
    where = own[first]
    return where, h[where], where - starts_ok[last], where - starts_ok[first]


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """How long a prefix both share, if they share ``at`` bytes."""
    end = min(len(a), len(b))
    while at + 16 <= end and a[at : at + 16] == b[at : at + 16]:
        at += 16
    while at < end and a[at] == b[at]:
        at += 1
    return at


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted strings: the prefixes shared with the one before, and the rests."""
    shared = [0, *[common(a, b) for a, b in zip(strings, strings[1:], strict=False)]] if strings else []
    return shared, [s[n:] for s, n in zip(strings, shared, strict=True)]


def dump_run(entries: list[tuple]) -> bytes:
    """A run of entries (suffix, before, low, high, key, document, place), sorted by suffix."""
    shared, rest = front_code([e[0] for e in entries])
    arrays = [
        np.array(shared, "<u1"), np.array([len(r) for r in rest], "<u1"), np.array([len(e[1]) for e in entries], "<u1"),
        np.array([e[2] for e in entries], "<u1"), np.array([e[3] for e in entries], "<u1"),
        np.array([e[4] for e in entries], "<i8"), np.array([e[5] for e in entries], "<u4"), np.array([e[6] for e in entries], "<u8"),
    ]
    data = b"".join([len(entries).to_bytes(4, "little"), *[a.tobytes() for a in arrays], *rest, *[e[1] for e in entries]])
    return len(data).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def load_run(data: bytes) -> tuple[list[int], list[bytes], list[tuple]]:
    """The suffixes' known shared prefixes, the suffixes, and (before, low, high, key, document, place) of each."""
    data = unpack(data[4:], int.from_bytes(data[:4], "little"))
    n, at = int.from_bytes(data[:4], "little"), 4
    columns = []
    for kind in ("<u1", "<u1", "<u1", "<u1", "<u1", "<i8", "<u4", "<u8"):
        columns.append(np.frombuffer(data, kind, n, at).tolist())
        at += n * np.dtype(kind).itemsize
    shared, sizes, befores, low, high, key, doc, place = columns
    strings, last = [], b""
    for s, size in zip(shared, sizes, strict=True):
        last = last[:s] + data[at : at + size]
        strings.append(last)
        at += size
    before = []
    for size in befores:
        before.append(data[at : at + size])
        at += size
    return shared, strings, list(zip(before, low, high, key, doc, place, strict=True))


def merged(runs: list[tuple[list[int], list[bytes]]]):
    """All strings of the sorted runs in order, as (run, index, prefix shared with the one before), by a loser tree.

    Each inner node keeps the run that lost there and the prefix it shares with the last string given out; a
    contender with the longer known prefix is the smaller one, and only ties look at text, behind that prefix.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * k
    head: list[bytes | None] = [r[1][0] if r[1] else None for r in runs] + [None] * (k - len(runs))
    loser, known = [0] * k, [0] * k

    def play(a, ka, b, kb):
        """winner, its known prefix, loser, its prefix shared with the winner"""
        sa, sb = head[a], head[b]
        if sb is None:
            return a, ka, b, 0
        if sa is None:
            return b, kb, a, 0
        if ka > kb:
            return a, ka, b, kb
        if kb > ka:
            return b, kb, a, ka
        n = common(sa, sb, ka)
        if n == len(sa) or (n < len(sb) and sa[n] < sb[n]):
            return a, ka, b, n
        return b, kb, a, n

    def build(node):
        if node >= k:
            return node - k, 0
        a, ka = build(2 * node)
        b, kb = build(2 * node + 1)
        w, kw, loser[node], known[node] = play(a, ka, b, kb)
        return w, kw

    w, kw = build(1)
    while head[w] is not None:
        yield w, at[w], kw
        at[w] += 1
        if at[w] < len(runs[w][1]):
            head[w], kw = runs[w][1][at[w]], runs[w][0][at[w]]
        else:
            head[w], kw = None, 0
        node = (w + k) // 2
        while node:
            w, kw, loser[node], known[node] = play(w, kw, loser[node], known[node])
            node //= 2


def repeats(entries: list[tuple], few: int = FEW) -> list[tuple]:
    """Of suffixes with one anchor, (suffix, before, low, high, order): (order, low, high) of the offsets at which the string starts earlier elsewhere."""
    entries.sort(key=lambda e: e[4])
    out, first = [], {}
    for e in entries:
        if first.setdefault(e[:4], e) is not e:
            out.append((e[4], e[2], e[3]))
    kinds = list(first.values())
    if len(kinds) <= few:
        for i, (suffix, before, low, high, order) in enumerate(kinds):
            for other in kinds[:i]:
                a = max(low, LENGTH - common(suffix, other[0]))
                b = min(high, common(before, other[1]))
                if a <= b:
                    out.append((order, a, b))
        return out
    seen = set()
    for suffix, before, low, high, order in kinds:
        left = before[::-1]
        whole, at = left + suffix, len(left)
        begin = None
        for d in range(low, high + 2):
            string = (d, whole[at - d : at - d + LENGTH])
            if d <= high and string in seen:
                begin = d if begin is None else begin
            else:
                if begin is not None:
                    out.append((order, begin, d - 1))
                    begin = None
                if d <= high:
                    seen.add(string)
    return out


def _ask(buckets: int):
    """blocks -> (bucket, block, hashes): each block's distinct anchors with their counts, by bucket."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, h, _, _ = anchors(unpack(row["data"], row["n_bytes"]), starts(row["sizes"]))
                h, n = np.unique(h, return_counts=True)
                where = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                cuts = np.flatnonzero(np.diff(where[order])) + 1
                parts = np.split(order, cuts) if len(h) else []
                data = []
                for p in parts:
                    many = n[p] > 1
                    data.append(b"".join([int(many.sum()).to_bytes(4, "little"), h[p][many].tobytes(), n[p][many].astype("<u4").tobytes(), h[p][~many].tobytes()]))
                yield pa.RecordBatch.from_arrays([pa.array([int(where[p[0]]) for p in parts], pa.int64()), pa.array([row["block"]] * len(parts), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "block", "hashes"])

    return run


def _answer(limit: int):
    """A bucket's (bucket, block, hashes) -> (block, hashes): those that occur again, hot ones apart."""

    def run(rows):
        hashes, counts, of = [], [], []
        for i, data in enumerate(rows.column("hashes").to_pylist()):
            m = int.from_bytes(data[:4], "little")
            many, n, one = np.frombuffer(data, "<u8", m, 4), np.frombuffer(data, "<u4", m, 4 + 8 * m), np.frombuffer(data, "<u8", -1, 4 + 12 * m)
            hashes += [many, one]
            counts += [n, np.ones(len(one), "<u4")]
            of.append(np.full(m + len(one), i))
        h, n, of = np.concatenate(hashes), np.concatenate(counts).astype(np.int64), np.concatenate(of)
        _, same = np.unique(h, return_inverse=True)
        total = np.bincount(same, weights=n)[same]
        blocks = rows.column("block").to_pylist()
        again = np.flatnonzero(total > 1)
        hot = total[again] > limit
        cuts = np.searchsorted(of[again], np.arange(len(blocks) + 1))
        out = [(b, h[again[x:y]][~hot[x:y]].tobytes(), h[again[x:y]][hot[x:y]].tobytes()) for b, x, y in zip(blocks, cuts, cuts[1:]) if y > x]
        return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "again": pa.array([o[1] for o in out], pa.binary()), "hot": pa.array([o[2] for o in out], pa.binary())})

    return run


def _runs(buckets: int):
    """blocks with their repeated anchors -> (bucket, block, kind, data): front-coded runs (1), and ranges that the block itself tells (0)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, at = unpack(row["data"], row["n_bytes"]), starts(row["sizes"])
                again, hot = (np.sort(np.frombuffer(b"".join(row[c] or []), "<u8")) for c in ("again", "hot"))
                where, h, low, high = anchors(data, at)
                is_hot, use = np.isin(h, hot), np.isin(h, again)
                keep = is_hot | use
                where, h, low, high, is_hot = where[keep], h[keep], low[keep], high[keep], is_hot[keep]
                doc = np.searchsorted(at, where, "right") - 1
                keys = [NULL if k is None else k for k in row["keys"]]
                by: dict[int, list[tuple]] = {}
                for p, x, a, b, d, burning in zip(where.tolist(), h.tolist(), low.tolist(), high.tolist(), doc.tolist(), is_hot.tolist(), strict=True):
                    begin, end = int(at[d]), int(at[d + 1])
                    suffix, before = data[p : min(end, p + LENGTH)], data[max(begin, p - (LENGTH - ANCHOR)) : p]
                    rest = (keys[d], d, p - begin)
                    if not burning:
                        by.setdefault(x % buckets, []).append((x.to_bytes(8, "big") + suffix, before[::-1], a, b, *rest))
                        continue
                    width = -(-(LENGTH - ANCHOR + 1) // RANGES)
                    for i in range(RANGES):
                        la, lb = max(a, i * width), min(b, (i + 1) * width - 1)
                        if la <= lb:  # what every string of this range has in common
                            top = min(LENGTH - ANCHOR, (i + 1) * width - 1)
                            x = xxhash.xxh64_intdigest(bytes([i]) + before[len(before) - i * width :] + suffix[: LENGTH - top])
                            by.setdefault(x % buckets, []).append((x.to_bytes(8, "big") + suffix, before[::-1], la, lb, *rest))
                local, out = [], []
                for bucket, entries in by.items():
                    entries.sort(key=lambda e: (e[0], e[1], e[2], e[3], e[4], e[5], e[6]))
                    kept = []
                    for e in entries:
                        if kept and kept[-1][:4] == e[:4]:
                            local.append((e[5], e[6] - e[3], e[6] - e[2]))
                        else:
                            kept.append(e)
                    out.append((bucket, row["block"], 1, dump_run(kept)))
                if local:
                    out.append((row["block"] % buckets, row["block"], 0, np.array(local, "<u8").tobytes()))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "block", "kind", "data"])

    return run


#: Stands for a null key: after all others.
NULL = (1 << 63) - 1


def _merge(few: int):
    """A bucket's runs -> (block, ranges): documents and ranges of places at which covered strings begin."""

    def run(rows):
        found: dict[int, list[tuple[int, int, int]]] = {}
        blocks, runs, rest = [], [], []
        out_blocks, out = [], []
        for block, kind, data in zip(rows.column("block").to_pylist(), rows.column("kind").to_pylist(), rows.column("data").to_pylist(), strict=True):
            if kind == 0:
                out_blocks.append(block)
                out.append(data)
                continue
            shared, strings, own = load_run(data)
            blocks.append(block)
            runs.append((shared, strings))
            rest.append(own)
        group: list[tuple] = []

        def close():
            if len(group) > 1:
                for (_, block, doc, place), low, high in repeats(group, few):
                    found.setdefault(block, []).append((doc, place - high, place - low))
            group.clear()

        for own_run, i, shared in merged(runs) if runs else ():
            if shared < 8 + ANCHOR:
                close()
            before, low, high, key, doc, place = rest[own_run][i]
            group.append((runs[own_run][1][i][8:], before, low, high, (key, blocks[own_run], doc, place)))
        close()
        out_blocks += found
        out += [np.array(x, "<u8").tobytes() for x in found.values()]
        return pa.table({"block": pa.array(out_blocks, pa.int64()), "ranges": pa.array(out, pa.binary())})

    return run


def _finish(batches):
    """blocks with their ranges -> a row for each document."""
    for batch in batches:
        for row in batch.to_pylist():
            data, at = unpack(row["data"], row["n_bytes"]), starts(row["sizes"])
            ranges = np.frombuffer(b"".join(row["ranges"] or []), "<u8").reshape(-1, 3).astype(np.int64)
            spans: dict[int, list[list[int]]] = {}
            for doc, own in groupby(sorted(map(tuple, ranges.tolist())), key=lambda x: x[0]):
                mine = spans[doc] = []
                for _, a, b in own:
                    if mine and a <= mine[-1][1]:
                        mine[-1][1] = max(mine[-1][1], b + LENGTH)
                    else:
                        mine.append([a, b + LENGTH])
            kept, begins, ends = [], [], []
            for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                mine = spans.get(d, [])
                begins.append([x for x, _ in mine])
                ends.append([y for _, y in mine])
                kept.append(data[a:b] if not mine else b"".join(data[a + x : a + y] for x, y in zip([0, *ends[-1]], [*begins[-1], b - a], strict=True)))
            n = len(kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["keys"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                names=["key", "n_bytes", "starts", "stops", "kept"],
            ) if n else pa.RecordBatch.from_arrays([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())], names=["key", "n_bytes", "starts", "stops", "kept"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``df``: ``key``, ``n_bytes``, ``starts`` and ``stops`` (the removed spans, in bytes, ascending and apart) and ``kept`` (the remaining bytes).

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document with a smaller key or in
    the same document before; strings are judged on the input and overlap freely. Keys are integers, null ones come
    last; rows with the same key follow each other in the order in which they were packed, so of two alike one stays
    whole. Null texts count as empty; texts under LENGTH bytes stay. An empty table gives no rows.
    """
    blocks, parts = kept_blocks(df, key, text, size=block)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, -(-2 * total // ((LENGTH - ANCHOR + 2) * BUCKET)))
    asked = blocks.select("block", "sizes", "n_bytes", "data").mapInArrow(_ask(buckets), "bucket long, block long, hashes binary")
    again = asked.groupBy("bucket").applyInArrow(_answer(hot), "block long, again binary, hot binary")
    again = again.repartition(parts, "block").groupBy("block").agg(F.collect_list("again").alias("again"), F.collect_list("hot").alias("hot"))  # no more than the block's anchors
    runs = blocks.join(again, "block").mapInArrow(_runs(buckets), "bucket long, block long, kind int, data binary")
    ranges = materialize(runs.groupBy("bucket").applyInArrow(_merge(few), "block long, ranges binary"), "ranges")
    ranges = ranges.repartition(parts, "block").groupBy("block").agg(F.collect_list("ranges").alias("ranges"))
    out = blocks.join(ranges, "block", "left").select("keys", "sizes", "n_bytes", "data", "ranges").mapInArrow(_finish, "key long, n_bytes long, starts array<long>, stops array<long>, kept binary")
    return out.withColumnRenamed("key", key)


def op6_suffix_dedup(spark, sf_dir) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
