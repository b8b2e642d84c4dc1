"""Merkle manifest of a dataset: a digest for each row, a tree for each group, a tree over the groups, and proofs.

Rows are numbered within their group by a range sort. Aligned blocks of a power of the fanout are contiguous matrices
of 64-byte hex digests, one row of the block table each: a level is hashed by reshaping it to rows of ``fanout``
digests, and siblings are found by arithmetic on the places. The blocks' roots are the rows of the next, smaller table,
until each group has one node. On the way back each block gets the path from its root to the root of all, so a
leaf's proof is what its block knows and that path. No table but the last has more than one row for each block.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import materialize, small_batches, table
from mnemos.llm.numbering import numbered

#: Nodes of a block at most, unless the fanout is larger.
SPAN = 1024
#: Bytes of a digest in hex.
HEX = 64
#: A path: for each level the place in its run, and the run's other digests in order.
PATH = "array<struct<slot: int, siblings: string>>"


def field(column: str | Column) -> Column:
    """A value as the leaf takes it: ``-`` for null, else its number of UTF-8 bytes, ``:`` and itself."""
    c = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(*columns: str | Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def matrix(digests) -> np.ndarray:
    """Hex digests as the rows of one contiguous matrix."""
    return np.array(digests, dtype=f"S{HEX}").view(np.uint8).reshape(-1, HEX)


def parents(level: np.ndarray, fanout: int) -> np.ndarray:
    """The next level: each run of ``fanout`` rows as one, the last run shorter if need be."""
    full = len(level) // fanout * fanout
    found = [sha256(row).hexdigest() for row in level[:full].reshape(-1, fanout * HEX)]
    return matrix(found + [sha256(level[full:].tobytes()).hexdigest()] * (full < len(level)))


def depth(total: int, span: int, fanout: int) -> int:
    """Levels that a block of a group of ``total`` nodes has above its own: all of a block's where there are others."""
    n, d = min(total, span), 0
    while fanout**d < n:
        d += 1
    return d


def span_of(fanout: int) -> int:
    """Nodes of a block: the largest power of the fanout up to SPAN, or the fanout itself."""
    return fanout ** max(1, depth(SPAN + 1, SPAN + 1, fanout) - 1)


def levels(nodes: np.ndarray, up: int, fanout: int) -> list[np.ndarray]:
    found = [nodes]
    for _ in range(up):
        found.append(parents(found[-1], fanout))
    return found


def siblings(found: list[np.ndarray], fanout: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level below the root and each node of the block: its slot, the others of its run, and how many there are."""
    at, out, others = np.arange(len(found[0])), [], np.arange(fanout - 1)
    for level in found[:-1]:
        run = at // fanout
        slot = at - run * fanout
        index = (run * fanout)[:, None] + others + (others >= slot[:, None])
        out.append((slot, level[np.minimum(index, len(level) - 1)], (index < len(level)).sum(axis=1)))
        at = run
    return out


def fold(nodes: np.ndarray, known: list[tuple[np.ndarray, np.ndarray, np.ndarray]], fanout: int) -> np.ndarray:
    """What the nodes, each with its own siblings, come to at the block's root."""
    for slot, others, count in known:
        place = np.arange(fanout) - (np.arange(fanout) > slot[:, None])
        place[np.arange(len(nodes)), slot] = fanout - 1
        runs = np.take_along_axis(np.concatenate([others, nodes[:, None]], axis=1), place[:, :, None], axis=1).reshape(len(nodes), -1)
        nodes = matrix([sha256(run[: (n + 1) * HEX]).hexdigest() for run, n in zip(runs, count.tolist(), strict=True)])
    return nodes


def along(nodes: list[str], path: list[dict]) -> list[str]:
    """What digests come to at the end of a path that they share; equal ones are hashed once."""
    for step in path:
        cut, others = step["slot"] * HEX, step["siblings"]
        up = {d: sha256((others[:cut] + d + others[cut:]).encode()).hexdigest() for d in set(nodes)}
        nodes = [up[d] for d in nodes]
    return nodes


def blocks(nodes: DataFrame, fanout: int, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each aligned block of (group, n, position, digest and the columns ``more``), with its digests and its ``root``; ``n`` is the group's nodes."""
    span = span_of(fanout)
    schema = nodes.schema

    def run(key, rows):
        rows = rows.take(np.argsort(rows.column("position").to_numpy(), kind="stable"))
        own = matrix(rows.column("digest").to_pylist())
        n = rows.column("n")[0].as_py()
        root = levels(own, depth(n, span, fanout), fanout)[-1].tobytes().decode()
        out = {"group": [key[0].as_py()], "block": [key[1].as_py()], "n": [n], "digests": [own.tobytes()], "root": [root]}
        return pa.table(out | {c: pa.array([rows.column(c).to_pylist()], pa.list_(rows.schema.field(c).type)) for c in more})

    extra = "".join(f", {c} array<{schema[c].dataType.simpleString()}>" for c in more)
    dealt = nodes.withColumn("block", F.floor(F.col("position") / span))
    found = dealt.groupBy("group", "block").applyInArrow(run, "group long, block long, n long, digests binary, root string" + extra)
    return materialize(found, "blocks")


def climb(nodes: DataFrame, fanout: int, more: tuple[str, ...] = ()) -> list[DataFrame]:
    """Tables of blocks, from those of ``nodes`` up to the one where each group has a single block."""
    span = span_of(fanout)
    found = [blocks(nodes, fanout, more)]
    while (found[-1].agg(F.max("block")).first()[0] or 0) > 0:
        up = found[-1].select("group", F.ceil(F.col("n") / span).alias("n"), F.col("block").alias("position"), F.col("root").alias("digest"))
        found.append(blocks(up, fanout))
    return found


def _down(fanout: int):
    """Of blocks with their paths: the nodes with theirs."""
    span = span_of(fanout)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["digests"], np.uint8).reshape(-1, HEX)
                known = siblings(levels(own, depth(row["n"], span, fanout), fanout), fanout)
                paths = [[{"slot": int(s[i]), "siblings": o[i, : c[i]].tobytes().decode()} for s, o, c in known] + row["path"] for i in range(len(own))]
                digests = [d.tobytes().decode() for d in own]
                n, kind = len(own), pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.string())]))
                arrays = [pa.array([row["group"]] * n, pa.int64()), pa.array(range(row["block"] * span, row["block"] * span + n), pa.int64()), pa.array(digests), pa.array(paths, kind)]
                yield pa.RecordBatch.from_arrays(arrays, names=["group", "position", "digest", "path"])

    return run


def _leaves(fanout: int, key: str):
    span = span_of(fanout)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["digests"], np.uint8).reshape(-1, HEX)
                known = siblings(levels(own, depth(row["n"], span, fanout), fanout), fanout)
                rest, n = "".join(step["siblings"] for step in row["path"]).encode(), len(own)
                if known:
                    there = np.concatenate([np.arange(fanout - 1) < c[:, None] for _, _, c in known], axis=1)
                    flat, ends = np.concatenate([o for _, o, _ in known], axis=1)[there].tobytes(), np.cumsum(there.sum(axis=1)) * HEX
                else:
                    flat, ends = b"", np.zeros(n, np.int64)
                cuts = [0, *ends.tolist()]
                proofs = [sha256(flat[a:b] + rest).hexdigest() for a, b in zip(cuts, cuts[1:])]
                digests = [d.tobytes().decode() for d in own]
                tried = matrix([a or d for a, d in zip(row["altered"], digests, strict=True)])
                folded = along([d.tobytes().decode() for d in fold(tried, known, fanout)], row["path"])
                columns = {
                    key: row["key"], "leaf": digests, "subroot": [row["subroot"]] * n, "root": [row["top"]] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [f == row["top"] for f in folded],
                }
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)], names=list(columns))

    return run


def manifest(df: DataFrame, columns: tuple[str, ...], key: str = "doc_id", group: str = "lang", altered: Column | None = None, fanout: int = 2) -> DataFrame:
    """One row for each row of ``df``: ``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``leaf`` is the digest of ``columns``. Within a group leaves stand by key, null keys first, rows with one key by
    digest; groups stand by UTF-8 bytes, a null group first. Runs of ``fanout`` nodes become their digest while more
    than one node is left, the last run also if it is a single node. ``folded_root`` is what ``altered`` (a digest to
    try in place of the leaf; null: the leaf itself) comes to with the leaf's siblings, ``verified`` whether that is the
    root. Repeated rows are leaves of their own. An empty table gives no rows; other columns of ``df``, whatever their
    names, are not read. Keys are integers.
    """
    if fanout < 2:
        raise ValueError("a run needs two nodes at least")
    small_batches(df.sparkSession, rows=16)
    kept = df.select(F.col(key).cast("long").alias("key"), F.col(group).cast("string").alias("name"), leaf(*columns).alias("digest"), (F.lit(None).cast("string") if altered is None else altered).alias("altered"))
    kept = materialize(kept.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = numbered(kept, F.col("name").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest"), F.col("row"))
    placed = materialize(placed.drop("row"), "placed")
    groups = materialize(placed.groupBy("name").agg(F.min("position").alias("first"), F.count("*").alias("n")), "groups")
    groups = materialize(numbered(groups, F.col("name").asc_nulls_first(), into="group"), "groups").withColumnRenamed("name", "own")
    placed = placed.join(groups, placed["name"].eqNullSafe(groups["own"]))
    nodes = placed.select("group", "n", (F.col("position") - F.col("first")).alias("position"), "digest", "key", "altered")

    lower = climb(nodes, fanout, ("key", "altered"))
    tops = lower[-1].select(F.lit(0).cast("long").alias("group"), F.lit(groups.count()).cast("long").alias("n"), F.col("group").alias("position"), F.col("root").alias("digest"))
    upper = climb(tops, fanout)
    paths = upper[-1].select("group", "block", F.array().cast(PATH).alias("path"))
    top = upper[-1].select(F.col("root").alias("top")).first()
    for level in reversed(upper):
        down = level.join(paths, ["group", "block"]).select("group", "block", "n", "digests", "path").mapInArrow(_down(fanout), f"group long, position long, digest string, path {PATH}")
        paths = materialize(down.select("group", F.col("position").alias("block"), "digest", "path"), "paths")
    # from here on the groups are those of the rows, and each has one block on top
    paths = paths.select(F.col("block").alias("group"), F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "path")
    subroots = materialize(paths.select("group", "subroot"), "subroots")
    paths = paths.drop("subroot")
    for level in reversed(lower[1:]):
        down = level.join(paths, ["group", "block"]).select("group", "block", "n", "digests", "path").mapInArrow(_down(fanout), f"group long, position long, digest string, path {PATH}")
        paths = materialize(down.select("group", F.col("position").alias("block"), "path"), "paths")
    last = lower[0].join(paths, ["group", "block"]).join(subroots, "group").withColumn("top", F.lit(top[0] if top else None).cast("string"))
    kinds = f"`{key}` long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return last.select("n", "digests", "key", "altered", "path", "subroot", "top").mapInArrow(_leaves(fanout, key), kinds)


#: What a leaf of documents is made of.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark, sf_dir) -> DataFrame:
    """Every document; where 7 divides the checksum of its id, the leaf that is tried has a character more in n_chars."""
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    altered = F.when(chosen & F.col("n_chars").isNotNull(), leaf("doc_id", "source", "lang", more, "text"))
    return manifest(table(spark, sf_dir, "documents"), COLUMNS, altered=altered)


#: Levels are lists of digests; the table of CRC-32 comes from its polynomial.
OP11_SQL = r"""
WITH RECURSIVE crc(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
crc_table AS (SELECT list(c::BIGINT ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (SELECT *, doc_id::VARCHAR AS id FROM documents),
m AS (SELECT d.*, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(id)::BIGINT + 1), lambda p: ascii(substr(id, p, 1))::BIGINT), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295::BIGINT) % 7 = 0 AND n_chars IS NOT NULL AS tampered FROM d, crc_table),
f AS (SELECT doc_id, lang, tampered, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS chars, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS chars_more, coalesce(strlen(text) || ':' || text, '-') AS tail FROM m),
l AS (SELECT doc_id, lang, sha256(head || chars || tail) AS leaf, sha256(head || CASE WHEN tampered THEN chars_more ELSE chars END || tail) AS tried FROM f),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM l)),
p AS (SELECT l.*, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l JOIN langs ON l.lang IS NOT DISTINCT FROM langs.lang),
low(g, k, nodes) AS (
  SELECT g, 0, list(leaf ORDER BY i) FROM p GROUP BY g
  UNION ALL SELECT g, k + 1, list_transform(range(0, len(nodes), 2), lambda x: sha256(nodes[x + 1] || coalesce(nodes[x + 2], ''))) FROM low WHERE len(nodes) > 1),
subroots AS (SELECT g, k AS height, nodes[1] AS subroot FROM low WHERE len(nodes) = 1),
high(k, nodes) AS (
  SELECT 0, list(subroot ORDER BY g) FROM subroots
  UNION ALL SELECT k + 1, list_transform(range(0, len(nodes), 2), lambda x: sha256(nodes[x + 1] || coalesce(nodes[x + 2], ''))) FROM high WHERE len(nodes) > 1),
flat AS (SELECT g, k, unnest(nodes) AS digest, unnest(range(len(nodes))) AS i FROM low),
flat_high AS (SELECT k, unnest(nodes) AS digest, unnest(range(len(nodes))) AS i FROM high),
steps AS (
  SELECT p.g, p.i, s.k, b.digest AS sibling, (p.i >> s.k) & 1 AS slot FROM p JOIN subroots USING (g) JOIN (SELECT DISTINCT k FROM low) s ON s.k < height LEFT JOIN flat b ON b.g = p.g AND b.k = s.k AND b.i = xor(p.i >> s.k, 1)
  UNION ALL SELECT p.g, p.i, height + s.k, b.digest, (p.g >> s.k) & 1 FROM p JOIN subroots USING (g) JOIN (SELECT k FROM high WHERE len(nodes) > 1) s ON true LEFT JOIN flat_high b ON b.k = s.k AND b.i = xor(p.g >> s.k, 1)),
paths AS (SELECT g, i, list(coalesce(sibling, '') ORDER BY k) AS siblings, list(slot ORDER BY k) AS slots FROM steps GROUP BY g, i),
tops AS (SELECT nodes[1] AS root FROM high WHERE len(nodes) = 1),
e AS (SELECT p.doc_id, leaf, subroot, root, coalesce(siblings, []) AS siblings, coalesce(slots, []) AS slots, tried FROM p JOIN subroots USING (g) LEFT JOIN paths USING (g, i), tops),
folded(doc_id, leaf, subroot, root, siblings, slots, now, k) AS (
  SELECT doc_id, leaf, subroot, root, siblings, slots, tried, 0 FROM e
  UNION ALL SELECT doc_id, leaf, subroot, root, siblings, slots, sha256(CASE WHEN slots[k + 1] = 0 THEN now || siblings[k + 1] ELSE siblings[k + 1] || now END), k + 1 FROM folded WHERE k < len(siblings))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(siblings, '')) AS proof_sha256, now AS folded_root, now = root AS verified FROM folded WHERE k = len(siblings)
"""
