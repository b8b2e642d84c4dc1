import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from mnemos.llm import merkle
from mnemos.llm.registry import QUERIES, SQL
from tests.llm.util import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


def digest(text):
    return sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_root(nodes, fanout):
    """The root, and for each node its path: (digests before it, digests after it) level by level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(places):
            run = nodes[p // fanout * fanout :][:fanout]
            paths[k].append((run[: p % fanout], run[p % fanout + 1 :]))
        nodes, places = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)], [p // fanout for p in places]
    return nodes[0], paths


def brute(rows, fanout, tampered):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r))) for lang in langs}
    low = {lang: brute_root([brute_leaf(r) for r in own[lang]], fanout) for lang in langs}
    root, high = brute_root([low[lang][0] for lang in langs], fanout)
    out = []
    for lang, above in zip(langs, high):
        for r, path in zip(own[lang], low[lang][1]):
            now = brute_leaf((*r[:3], r[3] + 1, r[4])) if tampered(r) and r[3] is not None else brute_leaf(r)
            for before, after in path + above:
                now = digest("".join(before) + now + "".join(after))
            proof = digest("".join("".join(before + after) for before, after in path + above))
            out.append([r[0], brute_leaf(r), low[lang][0], root, proof, now, now == root])
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def mine(rows):
    return sorted([[r[c] for c in COLUMNS] for r in rows.collect()], key=repr)


def test_query_equals_sql_and_brute_force(spark):
    got = QUERIES["op11_merkle_manifest"](spark, SF)
    assert spark_rows(got) == sql_rows(SQL["op11_merkle_manifest"], SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = brute(rows, 2, lambda r: zlib.crc32(str(r[0]).encode()) % 7 == 0)
    assert mine(got) == want and 0 < sum(not r[-1] for r in want) < len(want)


@pytest.mark.parametrize("fanout,span,n", [(2, 4, 150), (3, 9, 100), (16, 16, 300), (2, 1024, 1)])
def test_blocks_and_fanouts(spark, monkeypatch, fanout, span, n):
    """Blocks in several levels, one node over in a run, groups of one row, ties, repeated rows, nulls in every column."""
    monkeypatch.setattr(merkle, "SPAN", span)
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, "s", "ß"]), rng.choice([None, "", "a", "a", "a", "a", "ä", "z"]), rng.choice([None, 0, 2**63 - 1]), rng.choice([None, "", "x\ty", "é" * 50_000])) for _ in range(n)]
    rows += rows[:3] + [(7, "s", "single", 1, "t")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("group", "position", "digest", "root", "n", "row")})
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    altered = F.when((F.col("doc_id") % 3 == 0) & F.col("n_chars").isNotNull(), merkle.leaf("doc_id", "source", "lang", more, "text"))
    got = merkle.manifest(df, merkle.COLUMNS, altered=altered, fanout=fanout)
    assert mine(got) == brute(rows, fanout, lambda r: r[0] is not None and r[0] % 3 == 0)


def test_empty_table(spark):
    found = merkle.manifest(spark.createDataFrame([], SCHEMA), merkle.COLUMNS)
    assert found.columns == list(COLUMNS) and found.count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], SCHEMA), merkle.COLUMNS, fanout=1)
