"""Near-duplicates by MinHash: one permutation with optimal densification, banded buckets, star-shaped candidate edges.

A text's shingles are hashed to a set. One hash does for all minima: its high bits choose a bin, and a bin's minimum is its
first value in the sorted set. An empty bin takes the minimum of another one, drawn by a hash of the bin and the attempt
until that one holds something, so two sets agree in a bin with a probability of their Jaccard similarity. ROWS bins
are a band, and equal bands a bucket; of pairs of sets at 0.85 one in a million shares no bucket (at 0.8, one in five
thousand), while of pairs at 0.2 fewer than one in two thousand share any.

Each bucket is a star: its candidate edges go from the node whose buckets hold most to every other one, so n nodes give
n - 1 edges. Edges whose signatures (a byte of each minimum) disagree far more than similar sets' could are dropped, all
others are verified on the whole sets, and verified links are closed to components. A bucket whose nodes are then
of one component is done. The others may hold links that no star has: what such buckets have beside their centres, together
where they have the same first member, is searched whole through an inverted index of its shingles, in pairs of blocks of bounded size. So a link is
lost only if its pair shares no bucket.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.llm.common import forget, materialize, small_batches, table, text_of
from mnemos.llm.components import components
from mnemos.llm.simhash import LOWER

#: Bins of a set, a power of two; bands, and bins of a band.
BINS, BANDS, ROWS = 256, 36, 7
#: Nodes, and shingles, of a bucket that one task searches at once (twice as many for a pair of blocks).
GROUP, SHINGLES = 2048, 2 << 20
#: Bytes of a text that are split to words at a time, and words whose hashes a task keeps.
PIECE, KEPT = 4 << 20, 500_000
#: Of 256 bins, those in which two sets must agree before they are read; at 0.8 the mean is 205, with a deviation of 6.4.
AGREE = 150
SPACE = re.compile(rb"[\x20\x09-\x0D]+")
MIX, MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
FIRST = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 42)
        if len(self) < KEPT:
            self[word] = h
        return h


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MORE
    return x ^ (x >> np.uint64(29))


def shingles(text: str, shingle: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of ``shingle`` words; fewer words are one shingle, none no shingle."""
    data, found, a = text.encode(), [], 0
    while a < len(data):
        m = SPACE.search(data, a + PIECE) if a + PIECE < len(data) else None
        b = m.end() if m else len(data)
        words = data[a:b].translate(LOWER).split()
        found.append(np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)))
        a = b
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    if not len(words):
        return words
    n = min(shingle, len(words))
    many = len(words) - n + 1
    h = np.full(many, n, np.uint64)
    for i in range(n):
        h = (h ^ (h >> np.uint64(31))) * MIX + words[i : i + many]
    return np.unique(_mixed(h))


def _tries(bins: np.ndarray, first: int, many: int) -> np.ndarray:
    """Where the empty bins look in these attempts, a row for each."""
    t = np.arange(first, first + many, dtype=np.uint64)[:, None]
    return (_mixed((bins.astype(np.uint64) + np.uint64(1)) * MIX + t * MORE) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


#: The first attempts of all bins.
EARLY = _tries(np.arange(BINS), 0, 16)


def minima(own: np.ndarray) -> np.ndarray:
    """One value for each bin of a set that isn't empty."""
    at = np.searchsorted(own, FIRST)
    full = at < np.append(at[1:], len(own))
    value = own[np.minimum(at, len(own) - 1)]
    empty, source = np.flatnonzero(~full), np.arange(BINS)
    tries, first = EARLY[:, empty], 0
    while len(empty):
        hit = full[tries]
        some = hit.any(axis=0)
        source[empty[some]] = tries[hit.argmax(axis=0)[some], np.flatnonzero(some)]
        first += len(tries)
        empty = empty[~some]
        tries = _tries(empty, first, 64)
    return value[source]


def buckets(value: np.ndarray) -> np.ndarray:
    """Of the minima of all bins."""
    value = value[: BANDS * ROWS].reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = _mixed((h ^ value[:, j]) * MIX)
    return h


def sketches(text: Column, shingle: int, num: int, den: int) -> Column:
    """``n``, the size of the set, two halves of its 128-bit hash, its buckets and its signature, the last byte of each
    minimum: none where no other set can be similar."""

    @F.arrow_udf("struct<n: long, h1: long, h2: long, cells: array<long>, signature: binary>")
    def sketched(texts: pa.Array) -> pa.Array:
        n, hashes, cells, signatures = [], [], [], []
        for x in texts:
            own = shingles(x.as_py() or "", shingle)
            n.append(len(own))
            hashes.append(xxhash.xxh3_128_digest(own.tobytes()))
            # the most similar other set has one shingle more
            value = minima(own) if len(own) * den >= num * (len(own) + 1) else None
            cells.append(None if value is None else buckets(value).view(np.int64))
            signatures.append(None if value is None else (value & np.uint64(255)).astype(np.uint8).tobytes())
        halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        arrays = [pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(cells, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
        return pa.StructArray.from_arrays(arrays, names=["n", "h1", "h2", "cells", "signature"])

    return sketched.asNondeterministic()(text)


def sets_of(text: Column, shingle: int) -> Column:
    @F.arrow_udf("array<long>")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(x.as_py() or "", shingle).view(np.int64) for x in texts], pa.list_(pa.int64()))

    return made.asNondeterministic()(text)


def _close(a: Column, b: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(a, b) * den >= F.greatest(a, b) * num


def in_several(cells: DataFrame) -> DataFrame:
    """The rows (node, n, cell) of buckets that hold several, with the bucket's ``size``.

    They move once and are counted where they lie: nearly all buckets hold one node, so a table of counts would be as many rows.
    """
    return cells.withColumn("size", F.count("*").over(Window.partitionBy("cell"))).where("size > 1")


def stars(shared: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Candidate edges (u, v) of the nodes that share buckets, of (node, n, cell, size): a bucket's others with its centre; and (cell, v), the centres."""
    popular = materialize(shared.groupBy("node").agg(F.sum("size").alias("popular")), "popular")
    known = shared.join(popular, "node")
    centre = F.max(F.struct("popular", (-F.col("node")).alias("minus"), F.col("n"))).alias("c")
    centres = materialize(known.groupBy("cell").agg(centre).select("cell", (-F.col("c.minus")).alias("v"), F.col("c.n").alias("m")), "centres")
    met = shared.join(centres, "cell").where((F.col("node") != F.col("v")) & _close(F.col("n"), F.col("m"), num, den))
    return materialize(met.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct(), "stars"), centres.select("cell", "v")


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def agreement(one: Column, other: Column) -> Column:
    """In how many bins two signatures agree."""

    @F.arrow_udf("int")
    def agree(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((_signs(a) == _signs(b)).sum(axis=1), pa.int32())

    return agree(one, other)


def likely(edges: DataFrame, signatures: DataFrame) -> DataFrame:
    """The edges (u, v) whose signatures (node, signature) agree as much as similar sets' do."""
    one, other = (signatures.select(F.col("node").alias(c), F.col("signature").alias(f"g{c}")) for c in "uv")
    return materialize(edges.join(one, "u").join(other, "v").where(agreement(F.col("gu"), F.col("gv")) >= AGREE).select("u", "v"), "likely")


def verified(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The edges (u, v) whose sets have a Jaccard similarity of ``num / den`` or more."""
    one, other = (sets.select(F.col("node").alias(c), F.col("members").alias(f"s{c}")) for c in "uv")
    both = edges.join(one, "u").join(other, "v")
    common = F.size(F.array_intersect("su", "sv")).cast("long")
    return both.where(common * den >= num * (F.size("su") + F.size("sv") - common)).select("u", "v")


def forest(sets: list[np.ndarray], labels: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Places of pairs that link, enough to join all that do; those with one label are joined already."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    posts, at, labels, edges = owner[order], np.concatenate([[0], np.cumsum(sizes)]), labels.copy(), []
    for q in range(len(sets) - 1):
        others = (labels != labels[q]) & (np.minimum(sizes, sizes[q]) * den >= np.maximum(sizes, sizes[q]) * num)
        others[: q + 1] = False
        if not others.any():
            continue
        own = ids[at[q] : at[q + 1]]
        if others.sum() <= 4:
            common = np.zeros(len(sets), np.int64)
            for x in np.flatnonzero(others):
                common[x] = np.isin(ids[at[x] : at[x + 1]], own, assume_unique=True).sum()
        else:
            lengths = start[own + 1] - start[own]
            ends = np.cumsum(lengths)
            met = posts[np.repeat(start[own] - ends + lengths, lengths) + np.arange(ends[-1])]
            common = np.bincount(met, minlength=len(sets))
        near = np.flatnonzero(others & (common * den >= num * (sizes + sizes[q] - common)))
        for x in near.tolist():
            if labels[x] != labels[q]:
                edges.append((q, x))
                labels[labels == labels[x]] = labels[q]
    return edges


def _grouped(give: Callable, columns: tuple[str, ...], schema: pa.Schema):
    """Of rows (group, node, label and ``columns``) sorted by group: what ``give`` makes of each group's lists."""

    def run(batches):
        group, held = None, [[] for _ in ("node", "label", *columns)]
        for batch in batches:
            parts = [batch.column(c).to_pylist() for c in ("group", "node", "label")] + [batch.column(c) for c in columns]
            for g, *own in zip(*parts, strict=True):
                if g != group:
                    if held[0]:
                        yield pa.RecordBatch.from_pydict(give(*held), schema)
                    group, held = g, [[] for _ in held]
                for x, value in zip(held, own, strict=True):
                    x.append(value)
        if held[0]:
            yield pa.RecordBatch.from_pydict(give(*held), schema)

    return run


def _promising(num: int, den: int):
    """The nodes of a group whose signature agrees with one of another label and a fitting size."""

    def give(nodes, labels, sizes, signatures):
        sign, label, n = _signs(pa.array(signatures)), np.array(labels), np.array([x.as_py() for x in sizes])
        some = np.zeros(len(nodes), bool)
        for q in range(len(nodes) - 1):
            near = q + 1 + np.flatnonzero((label[q + 1 :] != label[q]) & (np.minimum(n[q + 1 :], n[q]) * den >= np.maximum(n[q + 1 :], n[q]) * num))
            near = near[(sign[near] == sign[q]).sum(axis=1) >= AGREE]
            some[near] = True
            some[q] |= len(near) > 0
        return {"node": [x for x, s in zip(nodes, some.tolist(), strict=True) if s]}

    return _grouped(give, ("n", "signature"), pa.schema([("node", pa.int64())]))


def _search(num: int, den: int):
    """The links (u, v) of a group between nodes of different labels, enough to join all that link."""

    def give(nodes, labels, members):
        got = forest([m.values.to_numpy() for m in members], np.array(labels), num, den) if len(nodes) > 1 else []
        return {"u": [nodes[q] for q, _ in got], "v": [nodes[x] for _, x in got]}

    return _grouped(give, ("members",), pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def rest(shared: DataFrame, centres: DataFrame, labels: DataFrame, signatures: DataFrame, sets_for: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """Links (u, v) between components within the buckets that hold several beside their centre, which has met all others.

    Buckets with the same first member are searched as one, so that nodes which share many buckets meet once; two members that
    sizes alone tell apart don't. A large group is cut into blocks by node, and block i meets block j in the group (i, j). Signatures meet first; only nodes that have a promising other in
    their group come again with their whole sets.
    """
    named = shared.where("size > 2").join(centres, "cell").where("node <> v")
    named = named.join(labels, "node", "left").select("cell", "node", "n", F.coalesce("root", "node").alias("label"))
    named = materialize(named, "named")
    cells = named.groupBy("cell").agg(F.count("*").alias("size"), F.min("node").alias("head"), F.min("label").alias("a"), F.max("label").alias("b"), F.min("n").alias("least"), F.max("n").alias("most"))
    cells = cells.where("a < b").where((F.col("size") > 2) | _close(F.col("least"), F.col("most"), num, den))
    members = materialize(named.join(materialize(cells.select("cell", "head"), "open"), "cell").select("head", "node", "n", "label").distinct(), "members")
    sizes = members.groupBy("head").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("parts"))
    dealt = members.join(materialize(sizes, "sizes"), "head").withColumn("i", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("i")))
    dealt = dealt.withColumn("j", F.explode(others)).select(F.xxhash64("head", F.least("i", "j"), F.greatest("i", "j")).alias("group"), "node", "n", "label")
    dealt = materialize(dealt, "dealt")
    met = dealt.join(signatures, "node").repartition("group").sortWithinPartitions("group")
    some = materialize(met.select("group", "node", "label", "n", "signature").mapInArrow(_promising(num, den), "node long").distinct(), "promising")
    met = dealt.join(sets_for(some), "node").select("group", "node", "label", "members")
    return met.repartition("group").sortWithinPartitions("group").mapInArrow(_search(num, den), "u long, v long")


def sketched(df: DataFrame, key: str, text: str, shingle: int, num: int, den: int, also: dict[str, Column] | None = None) -> DataFrame:
    """``key``, ``row``, ``text`` and the sketch of each row, materialized; ``also``: other columns made of ``text``."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), text_of(text).alias("text"))
    return materialize(rows.withColumn("s", sketches(F.col("text"), shingle, num, den)).select("key", "row", "text", "s.*", *[c.alias(n) for n, c in (also or {}).items()]), "sketches")


def linked(rows: DataFrame, nodes: DataFrame, shingle: int, num: int, den: int, more: DataFrame | None = None) -> DataFrame:
    """``node``, ``root`` of every node that links with another; of sketched() rows, and their distinct sets' first rows ``node``.

    ``more``: candidate edges (u, v) beside those of the buckets.
    """
    cells = rows.select("row", "n", "cells").where("cells IS NOT NULL").join(nodes.select(F.col("node").alias("row")), "row")
    cells = materialize(cells.select(F.col("row").alias("node"), "n", F.explode("cells").alias("cell")), "cells")
    shared = materialize(in_several(cells), "shared")
    forget(cells)
    edges, centres = stars(shared, num, den)
    signatures = rows.select(F.col("row").alias("node"), "signature").join(shared.select("node").distinct(), "node", "left_semi")
    signatures = materialize(signatures, "signatures")
    edges = likely(edges, signatures)
    if more is not None:
        edges = materialize(edges.unionByName(more).distinct(), "edges")

    def sets_for(nodes: DataFrame) -> DataFrame:
        met = rows.select(F.col("row").alias("node"), "text").join(nodes, "node")
        return materialize(met.select("node", sets_of(F.col("text"), shingle).alias("members")), "sets")

    sets = sets_for(materialize(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct(), "there"))
    links = materialize(verified(edges, sets, num, den), "links")
    forget(sets)
    between = materialize(rest(shared, centres, materialize(components(links), "labels"), signatures, sets_for, num, den), "links")
    return materialize(components(links.unionByName(between)), "roots")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 17, den: int = 20) -> DataFrame:
    """One row for each row of ``df``: ``key``, ``n_shingles`` (distinct ones), ``component_id`` and ``kept``.

    Rows link when the Jaccard similarity of their sets of ``shingle``-word runs is ``num / den`` or more; A-Z count as
    lower case. ``component_id`` is the smallest key reachable, null only if there is none but null; ``kept`` tells the
    rows that have it. Fewer words are one shingle. Null, empty and blank texts have no shingle and link with nothing:
    each is its own component. Rows that repeat a key are rows of their own. An empty table gives no rows; other columns
    are not read.
    """
    return grouped(sketched(df, key, text, shingle, num, den), key, shingle, num, den)


def grouped(rows: DataFrame, key: str, shingle: int, num: int, den: int, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """groups() of sketched() rows; ``more`` gives further candidate edges (u, v) between the first rows of the distinct sets, of these rows."""
    nodes = materialize(rows.where("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("key").alias("least")), "nodes")
    edges = more(rows.join(nodes.select(F.col("node").alias("row")), "row")) if more else None
    roots = linked(rows, nodes, shingle, num, den, edges)
    named = materialize(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    smallest = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    own = materialize(named.join(smallest, "root").select("h1", "h2", "component_id"), "own")
    found = rows.where("n > 0").select("key", "n", "h1", "h2").join(own, ["h1", "h2"]).select("key", "n", "component_id")
    found = found.unionByName(rows.where("n = 0").select("key", "n", F.col("key").alias("component_id")))
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash_near_dedup(spark, sf_dir) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
