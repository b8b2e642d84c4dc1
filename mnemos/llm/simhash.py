"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the vector of their bit counts (0, 1 or 2).
The Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints. The coordinates are
gathered in GROUPS groups of axes; embeddings within Manhattan distance r differ in at most r groups, so such a pair
shares its grid cell on at least GROUPS - r of them, whichever. Each fingerprint enters one cell for each choice of
so many groups; within a cell, rows are ordered by their total bit count, another Manhattan lower bound, so that a row
meets only the range within r of its own; a pair goes on if the Manhattan distance of its whole embeddings is within r,
and is then verified by its exact Hamming distance. A cell reports a
spanning forest of its links, not all pairs; cells beyond CELL rows are cut into pairs of blocks, so that every task's
memory is bounded and no link is lost.
"""

from __future__ import annotations

import string
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import materialize, small_batches, table, text_of
from mnemos.llm.components import components

#: Fingerprints of a cell that one task takes at once.
CELL = 8_192
#: In cells of at most so many rows each pair is looked at and each link reported.
FEW = 16
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def fingerprint(text: str, shingle: int) -> int:
    """A bit is 1 if it is set in over half the XXH64 (seed 42) of the shingles; no words: zero."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    size = np.array([len(w) for w in words])
    joined = b" ".join(words)
    ends = np.cumsum(size + 1) - 1
    n = min(shingle, len(words))
    starts, ends = (ends - size)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    counts, count = np.zeros(64, np.int64), len(starts)
    for at in range(0, count, 65_536):
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[at : at + 65_536], ends[at : at + 65_536], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > count, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int) -> Column:
    """The fingerprint as a long (its bits as two's complement)."""

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t or "", shingle) for t in (x.as_py() for x in texts)), dtype=np.uint64, count=len(texts)).view(np.int64))

    return hashed.asNondeterministic()(text)


def cells(prints: DataFrame, distance: int, groups: int) -> DataFrame:
    """``cell``, ``f`` for each choice of ``groups - distance`` groups of axes; the embedding is packed, two bits an axis."""
    sizes = [32 // groups + (i < 32 % groups) for i in range(groups)]
    masks, at = [], 0
    for n in sizes:
        masks.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    chosen = [sum(masks[i] for i in own) for own in combinations(range(groups), groups - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    half = F.lit(0x5555555555555555)
    one, other = F.col("f").bitwiseAND(half), F.shiftrightunsigned("f", 1).bitwiseAND(half)
    counts = one.bitwiseXOR(other).bitwiseOR(F.shiftleft(one.bitwiseAND(other), 1))  # the sum of each two bits
    rows = prints.select("f", counts.alias("e"))
    return rows.select("f", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("e").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])).alias("cell"))


def embedded(f: np.ndarray) -> np.ndarray:
    """The bit counts of all segments, packed as the fingerprint is."""
    half = np.uint64(0x5555555555555555)
    one, other = f & half, (f >> np.uint64(1)) & half
    return (one ^ other) | ((one & other) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of packed embeddings: counts 0 and 2 are two apart (only the high bit differs), any other unequal ones one."""
    half = np.uint64(0x5555555555555555)
    x = a ^ b
    low = x & half
    return np.bitwise_count(low) + 2 * np.bitwise_count((x >> np.uint64(1)) & half & ~low)


def forest(own: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``distance`` among distinct fingerprints."""
    total = np.bitwise_count(own).astype(np.int64)
    order = np.argsort(total, kind="stable")
    rest, total = own[order], total[order]
    embeddings, edges = embedded(rest), []
    while len(rest):
        queue, rest, total, embeddings = [rest[0]], rest[1:], total[1:], embeddings[1:]
        while queue and len(rest):
            f = queue.pop()
            mid = int(np.bitwise_count(f))
            a, b = np.searchsorted(total, mid - distance), np.searchsorted(total, mid + distance, "right")
            near = a + np.flatnonzero(manhattan(embeddings[a:b], embedded(np.uint64(f))) <= distance)
            near = near[np.bitwise_count(rest[near] ^ f) <= distance]
            if len(near):
                found = rest[near]
                edges += [(f, x) for x in found]
                queue += list(found)
                rest, total, embeddings = np.delete(rest, near), np.delete(total, near), np.delete(embeddings, near)
    return edges


def _verify(distance: int):
    """Of rows (cell, f) sorted by cell, so that a cell's rows are together: the links (u, v)."""

    def links(cell: np.ndarray, f: np.ndarray):
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        size = np.diff(np.append(first, len(cell)))
        few = np.repeat(size <= FEW, size)
        e, out = embedded(f), []
        for step in range(1, min(FEW, int(size.max()))):
            a, b = f[:-step], f[step:]
            near = np.flatnonzero((cell[:-step] == cell[step:]) & few[:-step] & (a != b))
            near = near[manhattan(e[near], e[near + step]) <= distance]
            near = near[np.bitwise_count(a[near] ^ b[near]) <= distance]
            out.append(np.stack([a[near], b[near]], axis=1))
        for at, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            if edges := forest(np.unique(f[at : at + n]), distance):
                out.append(np.array(edges, dtype=np.uint64))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.uint64)

    def run(batches):
        held_c, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def give(cell, f):
            got = links(cell, f)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, i]).view(np.int64)) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            cell = np.concatenate([held_c, batch.column("cell").to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column("f").to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(cell):
                continue
            cut = int(np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))[-1])  # the last cell may go on
            if cut:
                yield give(cell[:cut], f[:cut])
            held_c, held_f = cell[cut:], f[cut:]
        if len(held_c):
            yield give(held_c, held_f)

    return run


def groups_for(n: int, distance: int, mates: int = 16) -> int:
    """The fewest groups of axes, ``distance`` + 3 at least, at which n unrelated fingerprints share a cell with about ``mates`` others at most.

    An axis holds 1.5 bits; a cell fixes all but ``distance`` groups. So the work for each row grows slowly (35 cells up to
    some 25 million fingerprints at distance 4, 70 up to 270 million, 126 up to 1.7 billion), not with the rows of a cell.
    """
    groups = distance + 3
    while n > mates * 2.0 ** (48 * (groups - distance) / groups) and groups < 32:
        groups += 1
    return groups


def links(prints: DataFrame, distance: int, groups: int | None = None) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``f`` which are reachable by steps of at most ``distance`` bits.

    ``groups``: how many groups of axes; more make more and smaller cells, and the links found are the same. By default
    groups_for() the number of rows.
    """
    rows = cells(prints, distance, groups or groups_for(prints.count(), distance))
    large = materialize(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL), "large")
    # larger cells: block i meets block j in the cell (i, j); a block's own links come up in each of its pairs
    split = rows.join(large, "cell").withColumn("parts", F.ceil(F.col("n") / CELL).cast("int"))
    split = split.withColumn("i", F.pmod(F.xxhash64("f", F.lit(7)), F.col("parts")).cast("int"))
    split = split.select("cell", "f", "i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j")).where("i <> j")
    split = split.select(F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "f")
    dealt = rows if large.isEmpty() else rows.join(large, "cell", "left_anti").unionByName(split)
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verify(distance), "u long, v long").distinct()


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 4, groups: int | None = None) -> DataFrame:
    """One row for each row of ``df``: ``key``, ``f`` (fingerprint as a long) and ``component_id``.

    Rows link when their fingerprints differ in at most ``distance`` bits; ``component_id`` is the smallest key reachable
    (null keys aside). Texts with fewer words than a shingle count as one shingle; null, empty and blank texts have
    fingerprint zero and link like any other; rows with the same key or text are all returned. No table, no rows.
    """
    small_batches(df.sparkSession)
    rows = materialize(df.select(F.col(key).alias("key"), fingerprints(text_of(text), shingle).alias("f")), "simhash")
    prints = rows.groupBy("f").agg(F.min("key").alias("least"))
    prints = materialize(prints, "prints")
    roots = components(links(prints.select("f"), distance, groups))
    # each component's smallest key, by way of its root
    named = prints.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.withColumnRenamed("node", "f").join(least, "root").select("f", "component_id")
    own = prints.join(linked, "f", "left").select("f", F.coalesce("component_id", "least").alias("component_id"))
    own = materialize(own, "named")  # so that both sides of the join are dealt anew and a hot fingerprint can be split
    return rows.join(own, "f").select(F.col("key").alias(key), "f", "component_id")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` with the smallest key of their component; of components with null keys only, all rows.

    Null, empty and blank texts are near-duplicates of each other; rows with the key that stays all stay. A column named
    ``__k`` raises ValueError. An empty table stays empty.
    """
    if "__k" in df.columns:
        raise ValueError("__k is the name of a helper column")
    found = near_groups(df, key, text, **how)
    gone = materialize(found.where(F.col("component_id").isNotNull() & ~F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__k")).distinct(), "gone")
    return df.join(gone, df[key].eqNullSafe(gone["__k"]), "left_anti").select(df.columns)


def op4_simhash_near_dedup(spark, sf_dir) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
